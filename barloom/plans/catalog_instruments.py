"""Options, news, articles, statements and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import text as tx
from barloom.operators import news as nw
from barloom.operators import options as op
from barloom.plans.fixtures import Inputs
from barloom.plans.registry import query
from barloom.sources.staging import new_path
from barloom.sources import payloads as pl


@query(
    "option_chain_summary", "A-11",
    """SELECT *, round_even(total_put_oi / greatest(total_call_oi, 1), 3) AS put_call_ratio FROM (
       SELECT symbol, expiration, CAST(coalesce(sum(open_interest) FILTER (WHERE side = 'call'), 0) AS BIGINT) AS total_call_oi,
       CAST(coalesce(sum(open_interest) FILTER (WHERE side = 'put'), 0) AS BIGINT) AS total_put_oi,
       avg(implied_volatility) FILTER (WHERE side = 'call') AS call_iv_mean, avg(implied_volatility) FILTER (WHERE side = 'put') AS put_iv_mean
       FROM chain GROUP BY ALL)""",
    ["chain"], ["expiration"], {"call_iv_mean": 9, "put_iv_mean": 9, "put_call_ratio": 6}, ["symbol", "total_call_oi", "total_put_oi"],
)
def _(i: Inputs) -> DataFrame:
    return op.chain_summary(i.option_chain())


@query(
    "option_max_pain", "J-7 U-2",
    """SELECT symbol, expiration, arg_min(k, (pain, k)) AS max_pain, min(pain) AS pain FROM (
       SELECT s.symbol, s.expiration, s.strike AS k, sum(CASE WHEN side = 'call' THEN greatest(c.strike - s.strike, 0) ELSE greatest(s.strike - c.strike, 0) END * open_interest) AS pain
       FROM (SELECT DISTINCT symbol, expiration, strike FROM chain) s JOIN chain c USING (symbol, expiration) GROUP BY ALL) GROUP BY ALL""",
    ["chain"], ["expiration"], ["max_pain", "pain"], ["symbol"],
)
def _(i: Inputs) -> DataFrame:
    return op.max_pain(i.option_chain())


@query(
    "option_top_strikes", "K-3",
    """SELECT symbol, expiration, side, strike, open_interest, last_price, implied_volatility, volume, row_number() OVER w AS place FROM chain
       WINDOW w AS (PARTITION BY symbol, expiration, side ORDER BY open_interest DESC, strike) QUALIFY row_number() OVER w <= 5""",
    ["chain"], ["expiration"], {"strike": 6, "last_price": 6, "implied_volatility": 9}, ["symbol", "side", "open_interest", "volume", "place"],
)
def _(i: Inputs) -> DataFrame:
    return op.top_strikes(i.option_chain()).withColumn("place", F.col("place").cast("long"))


@query(
    "option_target_expiration", "K-9 K-6",
    """SELECT symbol, coalesce(min(expiration) FILTER (WHERE CAST(expiration AS DATE) - DATE '2001-06-28' >= 7), min(expiration)) AS expiration FROM chain GROUP BY symbol""",
    ["chain"], ["expiration"], (), ["symbol"],
)
def _(i: Inputs) -> DataFrame:
    return op.target_expiration(i.option_chain(), F.lit("2001-06-28"))


@query(
    "option_first_expirations", "K-6",
    """SELECT symbol, expiration, row_number() OVER (PARTITION BY symbol ORDER BY expiration) AS place FROM (SELECT DISTINCT symbol, expiration FROM chain)
       QUALIFY place <= 8""",
    ["chain"], ["expiration"], (), ["symbol", "place"],
)
def _(i: Inputs) -> DataFrame:
    return op.first_expirations(i.option_chain()).withColumn("place", F.col("place").cast("long"))


@query(
    "risk_buckets", "F-14",
    """SELECT s_suppkey, CASE WHEN s < 10 THEN 'negligible' WHEN s < 20 THEN 'low' WHEN s < 30 THEN 'medium' WHEN s < 40 THEN 'high' ELSE 'severe' END AS risk
       FROM (SELECT s_suppkey, s_acctbal / 200 AS s FROM supplier)""",
    (), (), (), ["s_suppkey", "risk"],
)
def _(i: Inputs) -> DataFrame:
    return i.table("supplier").select("s_suppkey", op.risk_level(F.col("s_acctbal") / 200).alias("risk"))


_words = "list_distinct(string_split_regex(trim(lower(title || ' ' || summary)), '\\s+'))"
_hits = f"""SELECT doc_id, symbol, title, published, len(list_intersect(w, (SELECT list(word) FROM lexicon WHERE polarity > 0))) AS p,
  len(list_intersect(w, (SELECT list(word) FROM lexicon WHERE polarity < 0))) AS n,
  coalesce((SELECT arg_min(category, priority) FROM categories WHERE contains(low, keyword)), 'general') AS category
  FROM (SELECT doc_id, symbol, title, published, {_words} AS w, lower(title || ' ' || summary) AS low FROM news)"""
_scored = f"""SELECT doc_id, symbol, published, category, p + n AS hits, CASE WHEN p + n > 0 THEN (p - n) / (p + n) ELSE 0 END AS s FROM ({_hits})"""
_labelled = f"""SELECT *, round_even(s, 3) AS score, CASE WHEN s > 0.3 THEN 'positive' WHEN s < -0.3 THEN 'negative' ELSE 'neutral' END AS label,
  CASE WHEN hits >= 3 THEN 'high' WHEN hits >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM ({_scored})"""


def scored(i: Inputs) -> DataFrame:
    return nw.score_news(i.news(), i.lexicon(), i.categories())


@query(
    "news_sentiment", "F-11 F-12 U-6 K-12",
    f"SELECT doc_id, symbol, CAST(hits AS INTEGER) AS hits, score, label, confidence, category FROM ({_labelled})",
    ["news", "lexicon", "categories"], (), ["score"], ["doc_id", "symbol", "hits", "label", "confidence", "category"],
)
def _(i: Inputs) -> DataFrame:
    return scored(i)


@query(
    "news_sentiment_rollup", "A-12",
    f"""SELECT *, CASE WHEN positive > negative AND positive > neutral THEN 'positive' WHEN negative > positive AND negative > neutral THEN 'negative' ELSE 'neutral' END AS overall,
        round_even((positive - negative) / greatest(total, 1), 3) AS overall_score FROM (
        SELECT symbol, count(*) AS total, count(*) FILTER (WHERE label = 'positive') AS positive, count(*) FILTER (WHERE label = 'negative') AS negative,
        count(*) FILTER (WHERE label = 'neutral') AS neutral FROM ({_labelled}) GROUP BY symbol)""",
    ["news", "lexicon", "categories"], (), ["overall_score"], ["symbol", "total", "positive", "negative", "neutral", "overall"],
)
def _(i: Inputs) -> DataFrame:
    return nw.sentiment_rollup(scored(i))


@query(
    "news_latest_per_symbol", "K-6 F-5 P-25",
    """SELECT symbol, doc_id, substr(summary, 1, 200) AS summary, CASE WHEN age < 3600 THEN greatest(1, age // 60) || 'm ago' WHEN age < 86400 THEN (age // 3600) || 'h ago'
        ELSE (age // 86400) || 'd ago' END AS age, row_number() OVER (PARTITION BY symbol ORDER BY published DESC, doc_id) AS place
       FROM (SELECT *, CAST(epoch(TIMESTAMP '2024-02-11 15:20:00') - epoch(published) AS BIGINT) AS age FROM news) QUALIFY place <= 30""",
    ["news"], (), (), ["symbol", "doc_id", "summary", "age", "place"],
)
def _(i: Inputs) -> DataFrame:
    return nw.latest_news(i.news(), F.expr("timestamp'2024-02-11 15:20:00'"), 30).withColumn("place", F.col("place").cast("long"))


def news_payloads(i: Inputs) -> DataFrame:
    """Items in both schemas, as JSON text."""
    n = i.news()
    k = F.col("doc_id")
    title = F.when(k % 13 == 0, "").otherwise(F.col("title"))
    thumbs = F.array(
        F.struct(F.lit("").alias("url"), F.lit(10).alias("width")),
        F.struct(F.concat(F.lit("b"), k.cast("string")).alias("url"), F.lit(400).alias("width")),
        F.struct(F.concat(F.lit("a"), k.cast("string")).alias("url"), (k % 3 * 300 + 100).cast("int").alias("width")),
    )
    new = F.to_json(F.struct(F.struct(
        title.alias("title"), F.lit("").alias("summary"), F.substring("summary", 1, 80).alias("description"),
        F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("pubDate"),
        F.struct(F.col("symbol").alias("displayName")).alias("provider"),
        F.struct(F.concat(F.lit("u"), k.cast("string")).alias("url")).alias("clickThroughUrl"),
        F.struct(thumbs.alias("resolutions")).alias("thumbnail"),
    ).alias("content")))
    old = F.to_json(F.struct(
        title.alias("title"), F.col("symbol").alias("publisher"), F.concat(F.lit("u"), k.cast("string")).alias("link"),
        F.unix_seconds("published").alias("providerPublishTime"), F.struct(thumbs.alias("resolutions")).alias("thumbnail"),
    ))
    return n.select("doc_id", F.when(k % 2 == 0, new).otherwise(old).alias("payload"))


@query(
    "news_payload_rows", "S-7 K-8 F-10 F-15",
    """SELECT doc_id, title, CASE WHEN doc_id % 2 = 0 THEN nullif(substr(summary, 1, 80), '') END AS summary, symbol AS publisher, 'u' || doc_id AS link,
        CAST(epoch(published) AS BIGINT) AS published,
        CASE WHEN doc_id % 2 = 1 THEN '' WHEN doc_id % 3 * 300 + 100 <= 400 THEN 'a' || doc_id ELSE 'b' || doc_id END AS thumbnail
       FROM news WHERE doc_id % 13 <> 0 AND title <> ''""",
    ["news"], (), (), ["doc_id", "title", "summary", "publisher", "link", "published", "thumbnail"],
)
def _(i: Inputs) -> DataFrame:
    path = new_path(i.spark, "news_payloads")
    news_payloads(i).write.json(path)
    landed = i.spark.read.schema("doc_id long, payload string").json(path)
    return pl.news_rows(landed, ["doc_id"])


@query(
    "chart_payload_bars", "S-5 J-3 F-8",
    "SELECT symbol, time, open, close, CASE WHEN n_ticks % 4 = 0 THEN 0 ELSE CAST(volume AS BIGINT) END AS volume FROM bars",
    ["bars"], ["time"], ["open", "close"], ["symbol", "volume"],
)
def _(i: Inputs) -> DataFrame:
    b = i.bars()
    row = F.struct(F.unix_seconds("time").alias("t"), "open", "high", "low", "close",
                   F.when(F.col("n_ticks") % 4 != 0, F.col("volume").cast("long")).alias("volume"))
    yearly = b.groupBy("symbol", F.year("time").alias("y")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    quote = F.struct(*[F.col(f"r.{c}").alias(c) for c in ("open", "high", "low", "close", "volume")])
    body = F.struct(F.struct("symbol").alias("meta"), F.col("r.t").alias("timestamp"), F.struct(F.array(quote).alias("quote")).alias("indicators"))
    path = new_path(i.spark, "charts")
    yearly.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("payload")).write.text(path)
    return pl.chart_bars(i.spark.read.text(path).withColumnRenamed("value", "payload"))


_furniture = "html"
for _t in tx.SKIPPED_TAGS:
    _furniture = f"regexp_replace({_furniture}, '(?is)<{_t}[^>]*>.*?</{_t}>', ' ', 'g')"
_src = f"""SELECT page_id, CASE WHEN length(a) > 200 THEN a ELSE clean END AS src FROM (
   SELECT page_id, clean, regexp_extract(clean, '(?is)<article[^>]*>(.*?)</article>', 1) AS a FROM (SELECT page_id, {_furniture} AS clean FROM pages))"""
_txt = "regexp_replace(src, '<[^>]+>', ' ', 'g')"
for _e, _ch in tx.ENTITIES:
    _txt = f"replace({_txt}, '{_e}', '{_ch.replace(chr(39), chr(39) * 2)}')"
_txt = f"trim(regexp_replace({_txt}, '\\s+', ' ', 'g'))"
_noise = "|".join(tx.NOISE_STARTS)
_sent = f"""SELECT page_id, list_filter(string_split(regexp_replace({_txt}, '([.!?])\\s+', '\\1' || chr(30), 'g'), chr(30)),
   lambda s: length(s) >= 40 AND NOT regexp_matches(s, '(?i)^({_noise})')) AS ss FROM ({_src})"""


@query(
    "article_extraction", "F-13 F-2 P-25",
    f"SELECT page_id, '' AS title, '' AS author, len(ss) AS n_sentences, substr(array_to_string(ss[1:50], ' '), 1, 4000) AS body FROM ({_sent})",
    (), (), (), ["page_id", "title", "author", "n_sentences", "body"],
)
def _(i: Inputs) -> DataFrame:
    return i.table("pages").select("page_id", *[c.alias(n) for n, c in tx.article(F.col("html")).items()])


def statements(i: Inputs) -> tuple[DataFrame, list[str]]:
    long = i.brand_years().unpivot(["symbol", "y"], ["units", "revenue", "tax"], "metric", "value")
    named = long.withColumn("d", F.concat(F.col("y").cast("string"), F.lit("-12-31 00:00:00")))
    # a column for each year that there is
    wide = named.groupBy("symbol", "metric").pivot("d").agg(F.first("value"))
    return wide, [c for c in wide.columns if c not in ("symbol", "metric")]


@query(
    "statement_rows", "S-6 P-24",
    """SELECT s.symbol, 'income' AS statement, 'yearly' AS freq, m.metric, y.y || '-12-31' AS period,
        CASE m.metric WHEN 'units' THEN CAST(b.units AS DOUBLE) WHEN 'revenue' THEN b.revenue ELSE b.tax END AS value
       FROM (SELECT DISTINCT symbol FROM brand_years) s, (VALUES ('units'), ('revenue'), ('tax')) m(metric), (SELECT DISTINCT y FROM brand_years) y
       LEFT JOIN brand_years b ON b.symbol = s.symbol AND b.y = y.y""",
    ["brand_years"], (), {"value": 3}, ["symbol", "statement", "freq", "metric", "period"],
)
def _(i: Inputs) -> DataFrame:
    wide, dates = statements(i)
    return pl.statement_long(wide, ["symbol"], "metric", dates, "income", "yearly")


_texts, _numbers = list(pl.PROFILE_TEXTS), list(pl.PROFILE_NUMBERS)


def _held(k: int) -> str:
    """Every profile lacks some fields: field ``k`` where ``n`` divides by ``k % 7 + 2``."""
    return f"n % {k % 7 + 2} <> 0"


@query(
    "company_profiles", "P-26 F-15 K-12 K-13 F-10",
    """SELECT symbol, CASE WHEN n % 2 = 0 THEN symbol || ' Inc' ELSE 'Short ' || symbol END AS name, 'Chief ' || symbol AS ceo, substr(repeat(symbol || ' ', 100), 1, 500) AS description,
        CAST(DATE '2001-01-01' + CAST(n % 300 + CASE WHEN n % 300 < 100 THEN 200 ELSE 0 END AS INTEGER) AS VARCHAR) AS next_event, """
    + ", ".join(f"CASE WHEN {_held(k)} THEN symbol || ' {f}' END AS {f}" for k, f in enumerate(_texts)) + ", "
    + ", ".join(f'CASE WHEN {_held(k)} THEN units * {k + 1} / 16 END AS "{f}"' for k, f in enumerate(_numbers))
    + " FROM (SELECT symbol, sum(units) AS units, max(y) + sum(units) AS n FROM brand_years GROUP BY symbol)",
    ["brand_years"], (), (), ["symbol", "name", "ceo", "next_event", "description", *_texts, *[f'"{f}"' for f in _numbers]],
)
def _(i: Inputs) -> DataFrame:
    g = i.brand_years().groupBy("symbol").agg(F.sum("units").alias("units"), (F.max("y") + F.sum("units")).alias("n"))
    day = F.date_add(F.lit("2001-01-01").cast("date"), (F.col("n") % 300).cast("int"))
    officers = F.array(
        F.struct(F.lit("Head of Sales").alias("title"), F.lit("x").alias("name")),
        F.struct(F.lit("President & CEO").alias("title"), F.concat(F.lit("Chief "), "symbol").alias("name")),
    )
    texts = [F.when(F.expr(_held(k)), F.concat("symbol", F.lit(f" {f}"))).alias(key) for k, (f, key) in enumerate(pl.PROFILE_TEXTS.items())]
    numbers = [F.when(F.expr(_held(k)), F.col("units") * (k + 1) / 16).cast("string").alias(key) for k, key in enumerate(pl.PROFILE_NUMBERS.values())]
    info = F.to_json(F.struct(
        F.when(F.col("n") % 2 == 0, F.concat("symbol", F.lit(" Inc"))).otherwise("").alias("longName"),
        F.concat(F.lit("Short "), "symbol").alias("shortName"), F.repeat(F.concat("symbol", F.lit(" ")), 100).alias("longBusinessSummary"),
        officers.alias("officers"), F.array(day, F.date_add(day, 200)).alias("dates"), *texts, *numbers,
    ))
    raw = g.select("symbol", info.alias("info"))
    known = F.from_json("info", "officers array<struct<title: string, name: string>>, dates array<date>")
    return raw.select(
        "symbol", *pl.whole_profile(F.col("info")),
        pl.first_officer(known["officers"], "ceo").alias("ceo"),
        pl.next_event(known["dates"], F.lit(None).cast("date"), F.lit("2001-04-11").cast("date")).cast("string").alias("next_event"),
    )


@query(
    "full_profiles", "J-17",
    """SELECT b.symbol, CAST(b.bars AS BIGINT) AS overview, CAST(f.units AS BIGINT) AS financials, CAST(g.n AS BIGINT) AS analyst, CAST(h.n AS BIGINT) AS holders,
        CAST(h.last AS BIGINT) AS insider, CAST(f.y AS BIGINT) AS earnings, CAST(c.total AS BIGINT) AS options, CAST(n.n AS BIGINT) AS news, sector AS esg
       FROM (SELECT symbol, count(*) AS bars FROM bars GROUP BY symbol) b LEFT JOIN sector USING (symbol)
       LEFT JOIN (SELECT symbol, sum(units) AS units, max(y) AS y FROM brand_years GROUP BY symbol) f USING (symbol)
       LEFT JOIN (SELECT symbol, count(*) AS n FROM signals GROUP BY symbol) g USING (symbol)
       LEFT JOIN (SELECT symbol, count(DISTINCT user_id) AS n, max(id) AS last FROM requests GROUP BY symbol) h USING (symbol)
       LEFT JOIN (SELECT symbol, sum(open_interest) AS total FROM chain GROUP BY symbol) c USING (symbol)
       LEFT JOIN (SELECT symbol, count(*) AS n FROM news GROUP BY symbol) n USING (symbol)""",
    ["bars", "sector", "brand_years", "signals", "requests", "chain", "news"], (), (),
    ["symbol", "overview", "financials", "analyst", "holders", "insider", "earnings", "options", "news", "esg"],
)
def _(i: Inputs) -> DataFrame:
    """All nine sections, each from its own table; a symbol may lack some."""
    n = F.count(F.lit(1)).alias("v")
    years, asked = i.brand_years().groupBy("symbol"), i.requests().groupBy("symbol")
    sections = {
        "overview": i.bars().groupBy("symbol").agg(n), "financials": years.agg(F.sum("units").alias("v")), "analyst": i.signals().groupBy("symbol").agg(n),
        "holders": asked.agg(F.count_distinct("user_id").alias("v")), "insider": asked.agg(F.max("id").alias("v")), "earnings": years.agg(F.max("y").alias("v")),
        "options": i.option_chain().groupBy("symbol").agg(F.sum("open_interest").alias("v")), "news": i.news().groupBy("symbol").agg(n),
        "esg": i.sector().withColumnRenamed("sector", "v"),
    }
    full = pl.assemble(i.bars().select("symbol").distinct(), sections)
    values = [F.get_json_object(s, "$.v").cast("string" if s == "esg" else "long").alias(s) for s in sections]
    return full.select("symbol", *values)


@query(
    "price_digests", "F-3 F-16",
    """SELECT symbol, substr(md5(string_agg(CAST(round_even(close, 2) AS VARCHAR), '|' ORDER BY time)), 1, 8) AS digest,
        'p:' || symbol || ':1y' AS key, sha256(symbol) AS token FROM (SELECT * FROM rbars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) <= 10) GROUP BY symbol""",
    ["rbars"], (), (), ["symbol", "digest", "key", "token"],
)
def _(i: Inputs) -> DataFrame:
    from barloom.operators.forecast import last_rows

    g = last_rows(i.panel(), 10).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("rn", "close"))).alias("r"))
    return g.select(
        "symbol", tx.price_digest(F.col("r.close")).alias("digest"),
        tx.cache_key([F.lit("p"), F.col("symbol"), F.lit("1y")]).alias("key"), F.sha2("symbol", 256).alias("token"),
    )
