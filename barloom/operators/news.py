"""News tables: sentiment, categories, roll-ups, latest items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import text as tx


def score_news(news: DataFrame, lexicon: DataFrame, categories: DataFrame) -> DataFrame:
    """Sentiment and category per item, over the whole title and summary. No shuffle: the lexicon and the categories are
    constants of the plan. Each text is split once; the generator keeps its counts from being computed for every field."""
    pos, neg = tx.lexicon_arrays(lexicon)
    entries = tx.category_entries(categories)
    body = F.concat_ws(" ", "title", "summary")
    w = tx.words(body)
    counts = F.struct(F.size(F.array_intersect(w, pos)).alias("__p"), F.size(F.array_intersect(w, neg)).alias("__n"))
    d = news.select("*", F.inline(F.array(counts)), entries.alias("__e"))
    s = d.select("*", tx.category(body, F.col("__e")).alias("category"), tx.sentiment(F.col("__p"), F.col("__n")).alias("__s"))
    return s.select("*", "__s.*").drop("__s", "__e", "__p", "__n")


def sentiment_rollup(scored: DataFrame, key: str = "symbol") -> DataFrame:
    """Counts per label; the overall label needs a strict majority over both others."""
    labels = ("positive", "negative", "neutral")
    g = scored.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("label") == x).alias(x) for x in labels]
    )
    p, n, z = (F.col(x) for x in labels)
    overall = F.when((p > n) & (p > z), "positive").when((n > p) & (n > z), "negative").otherwise("neutral")
    score = F.bround((p - n) / F.greatest(F.col("total"), F.lit(1)), 3)
    return g.select("*", overall.alias("overall"), score.alias("overall_score"))


def latest_news(news: DataFrame, now: Column, n: int = 30, key: str = "symbol") -> DataFrame:
    """The newest ``n`` items per key. Spark's rank limit drops other rows before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.col("published").desc(), "doc_id")
    top = news.select("*", F.row_number().over(w).alias("place")).where(F.col("place") <= n)
    return top.select(
        key, "doc_id", F.substring("summary", 1, 200).alias("summary"), tx.age_label(now, F.col("published")).alias("age"), "place"
    )
