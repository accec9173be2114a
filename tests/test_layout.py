import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barloom.operators.layout import block_panel, carry_scan, chunk_of, with_ordinal
from barloom.operators.recurrence import Recurrence, reach_of, solve, sub_rows_for


def test_scans_match_one_pass(spark):
    rng = np.random.default_rng(1)
    n = 400
    pdf = pd.DataFrame({
        "k": np.where(rng.random(n) < 0.7, "hot", "b"), "t": pd.to_datetime("2024-01-01") + pd.to_timedelta(np.arange(n) * 3700, "s"),
        "v": np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n)),
    })
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    how = ("sum", "count", "max", "min", "last", "prev", "next", "after")
    got = carry_scan(df, ["k"], ["t"], chunk_of("t", 86400), {h: (h, F.col("v")) for h in how}).toPandas()
    for _, g in got.sort_values("t").groupby("k"):
        v = pdf.loc[g["t"].map(dict(zip(pdf["t"], pdf.index, strict=True))), "v"].reset_index(drop=True)
        want = {
            "count": v.notna().cumsum(), "max": v.cummax().ffill(), "min": v.cummin().ffill(), "last": v.ffill(),
            "prev": v.ffill().shift(1), "next": v.bfill(), "after": v.bfill().shift(-1),
        }
        for h, w in want.items():
            np.testing.assert_allclose(g[h].astype(float).to_numpy(), w.astype(float).to_numpy(), err_msg=h)
        seen = v.notna().cumsum() > 0
        np.testing.assert_allclose(g["sum"].to_numpy()[seen], v.fillna(0).cumsum()[seen], atol=1e-12)


def test_windows_do_not_depend_on_block_size(spark, bars):
    panel = with_ordinal(bars, chunk_seconds=50 * 86400)

    def means(rows):
        w = block_panel(panel, back=40, ahead=6, block_rows=rows, sub_rows=16)
        d = w.with_df(w.df.select("*", w.mean("close", 30).alias("m"), w.lag("close", 40).alias("l"), w.lead("close", 5).alias("f")))
        return d.own_rows().select("symbol", "time", "m", "l", "f").orderBy("symbol", "time").toPandas()

    whole = means(100_000)
    for rows in (16, 64, 256):  # also blocks shorter than the look-back
        pd.testing.assert_frame_equal(means(rows), whole)


def test_recurrence_matches_loop(spark):
    rng = np.random.default_rng(3)
    u = rng.normal(size=900)
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "rn": np.arange(1, 901), "u": u}))
    ratios = {"slow": 0.97, "mid": 13 / 14, "fast": 0.2}
    sub = sub_rows_for(ratios.values(), limit=32)
    back = reach_of(ratios.values(), sub)
    w = block_panel(df, back=back, block_rows=sub * 8, sub_rows=sub)
    items = [Recurrence(n, F.col("u"), q) for n, q in ratios.items()]
    items.append(Recurrence("by_column", F.col("u"), F.lit(0.9), slowest=0.97))
    got = solve(w, items).own_rows().orderBy("rn").toPandas()
    for name, q in {**ratios, "by_column": 0.9}.items():
        y, want = 0.0, []
        for x in u:
            y = q * y + x
            want.append(y)
        np.testing.assert_allclose(got[name], want, atol=1e-12)
