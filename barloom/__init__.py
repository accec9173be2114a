"""Market-panel analytics on Spark: DataFrame-in, DataFrame-out operators."""
