"""Landed JSON payloads (charts, statements, news, profiles) to tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.text import first_filled

CHART = (
    "meta struct<symbol: string>, timestamp array<long>, "
    "indicators struct<quote: array<struct<open: array<double>, high: array<double>, low: array<double>, "
    "close: array<double>, volume: array<long>>>>"
)
NEWS = (
    "title string, publisher string, link string, providerPublishTime long, "
    "thumbnail struct<resolutions: array<struct<url: string, width: int>>>, "
    "content struct<title: string, summary: string, description: string, pubDate: string, "
    "provider: struct<displayName: string>, canonicalUrl: struct<url: string>, clickThroughUrl: struct<url: string>, "
    "thumbnail: struct<resolutions: array<struct<url: string, width: int>>>>"
)


def chart_bars(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Parallel arrays to one row per bar; missing volume is 0."""
    p = payloads.select(F.from_json(column, CHART).alias("p"))
    q = F.element_at("p.indicators.quote", 1)
    z = F.arrays_zip("p.timestamp", q["open"], q["high"], q["low"], q["close"], q["volume"])
    named = F.transform(
        z,
        lambda s: F.struct(
            F.timestamp_seconds(s["timestamp"]).alias("time"), s["open"].alias("open"), s["high"].alias("high"),
            s["low"].alias("low"), s["close"].alias("close"), F.coalesce(s["volume"], F.lit(0)).alias("volume"),
        ),
    )
    return p.select(F.col("p.meta.symbol").alias("symbol"), F.inline(named))


def statement_long(wide: DataFrame, keys: Sequence[str], metric: str, periods: Sequence[str], statement: str, freq: str) -> DataFrame:
    """Dates-as-columns statement to (keys, statement, freq, metric, period, value)."""
    long = wide.unpivot([*keys, metric], list(periods), "period", "value")
    value = F.col("value").cast("double")
    return long.select(
        *keys, F.lit(statement).alias("statement"), F.lit(freq).alias("freq"), F.col(metric).alias("metric"),
        F.substring("period", 1, 10).alias("period"), F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value).alias("value"),
    )


def smallest_image(resolutions: Column) -> Column:
    """URL of the narrowest image that has one."""
    usable = F.filter(resolutions, lambda r: F.length(r["url"]) > 0)
    ranked = F.array_sort(
        F.transform(usable, lambda r: F.struct(F.coalesce(r["width"], F.lit(9999)).alias("w"), r["url"].alias("u")))
    )
    return F.try_element_at(ranked, F.lit(1))["u"]


def news_rows(payloads: DataFrame, keep: Sequence[str], column: str = "payload") -> DataFrame:
    """Old flat and new nested news items in one shape; items without a title are skipped."""
    p = payloads.select(*keep, F.from_json(column, NEWS).alias("p"))
    c = F.col("p.content")
    nested = c.isNotNull()

    def pick(new: Column, old: Column) -> Column:
        return F.when(nested, new).otherwise(old)

    none = F.lit(None).cast("string")
    iso = F.unix_seconds(F.try_to_timestamp(F.col("p.content.pubDate")))
    rows = p.select(
        *keep,
        pick(c["title"], F.col("p.title")).alias("title"),
        pick(first_filled(c["summary"], c["description"]), none).alias("summary"),
        pick(c["provider"]["displayName"], F.col("p.publisher")).alias("publisher"),
        pick(first_filled(c["canonicalUrl"]["url"], c["clickThroughUrl"]["url"]), F.col("p.link")).alias("link"),
        pick(iso, F.col("p.providerPublishTime")).alias("published"),
        pick(
            smallest_image(c["thumbnail"]["resolutions"]),
            F.try_element_at("p.thumbnail.resolutions", F.lit(1))["url"],
        ).alias("thumbnail"),
    )
    return rows.where(F.length("title") > 0)


# Fields of a company profile and the keys of the payload that they are read from (fixed values). Texts, then numbers.
PROFILE_TEXTS = {
    "sector": "sector", "industry": "industry", "country": "country", "website": "website", "exchange": "exchange", "currency": "currency",
    "analyst_rating": "recommendationKey",
}
PROFILE_NUMBERS = {
    "employees": "fullTimeEmployees", "market_cap": "marketCap", "enterprise_value": "enterpriseValue", "beta": "beta", "pe_ratio": "trailingPE",
    "forward_pe": "forwardPE", "peg_ratio": "pegRatio", "price_to_book": "priceToBook", "price_to_sales": "priceToSalesTrailing12Months",
    "ev_to_ebitda": "enterpriseToEbitda", "ev_to_revenue": "enterpriseToRevenue", "eps": "trailingEps", "forward_eps": "forwardEps",
    "book_value": "bookValue", "dividend_yield": "dividendYield", "dividend_rate": "dividendRate", "payout_ratio": "payoutRatio",
    "ex_dividend_date": "exDividendDate", "profit_margin": "profitMargins", "operating_margin": "operatingMargins", "gross_margin": "grossMargins",
    "roe": "returnOnEquity", "roa": "returnOnAssets", "roic": "returnOnCapital", "debt_to_equity": "debtToEquity", "current_ratio": "currentRatio",
    "quick_ratio": "quickRatio", "revenue_growth": "revenueGrowth", "earnings_growth": "earningsGrowth",
    "earnings_quarterly_growth": "earningsQuarterlyGrowth", "free_cashflow": "freeCashflow", "operating_cashflow": "operatingCashflow",
    "total_revenue": "totalRevenue", "revenue_per_share": "revenuePerShare", "ebitda": "ebitda", "shares_outstanding": "sharesOutstanding",
    "float_shares": "floatShares", "shares_short": "sharesShort", "short_ratio": "shortRatio", "short_percent_float": "shortPercentOfFloat",
    "52w_high": "fiftyTwoWeekHigh", "52w_low": "fiftyTwoWeekLow", "50d_avg": "fiftyDayAverage", "200d_avg": "twoHundredDayAverage",
    "target_mean": "targetMeanPrice", "target_high": "targetHighPrice", "target_low": "targetLowPrice", "num_analysts": "numberOfAnalystOpinions",
}


def whole_profile(info: Column) -> list[Column]:
    """Every field of a company profile from its payload; the description keeps 500 characters."""
    aliases = {"name": ["longName", "shortName"]} | {k: [v] for k, v in (PROFILE_TEXTS | PROFILE_NUMBERS).items()}
    about = F.substring(F.coalesce(F.get_json_object(info, "$.longBusinessSummary"), F.lit("")), 1, 500)
    return [*profile(info, aliases, list(PROFILE_NUMBERS)), about.alias("description")]


def profile(info: Column, aliases: dict[str, Sequence[str]], numbers: Sequence[str] = ()) -> list[Column]:
    """Named scalars from a nested info object; each takes the first alias that is filled."""
    out = []
    for name, paths in aliases.items():
        v = first_filled(*[F.get_json_object(info, f"$.{p}") for p in paths])
        out.append((v.try_cast("double") if name in numbers else v).alias(name))
    return out


def first_officer(officers: Column, title: str) -> Column:
    """Name of the first officer whose title contains ``title``."""
    hit = F.filter(officers, lambda o: F.lower(o["title"]).contains(title.lower()))
    return F.try_element_at(hit, F.lit(1))["name"]


def next_event(dates: Column, fallback: Column, as_of: Column) -> Column:
    """Earliest listed date from ``as_of`` on, else the single-date field."""
    return F.coalesce(F.array_min(F.filter(dates, lambda d: d >= as_of)), fallback)


def assemble(symbols: DataFrame, sections: dict[str, DataFrame]) -> DataFrame:
    """One row per symbol with one JSON column per section; a missing section is NULL.

    Sections arrive as one row per symbol. They are stacked and pivoted: one shuffle for all.
    """
    parts = [
        d.select("symbol", F.lit(n).alias("section"), F.to_json(F.struct(*[c for c in d.columns if c != "symbol"])).alias("body"))
        for n, d in sections.items()
    ]
    base = symbols.select("symbol", F.lit("").alias("section"), F.lit(None).cast("string").alias("body"))
    for p in parts:
        base = base.unionByName(p)
    return base.groupBy("symbol").pivot("section", list(sections)).agg(F.first("body", ignorenulls=True))
