"""URL filters with redirect equivalence: rules by host and path, and block decisions that reach a page's aliases.

All of it is DataFrame operations. Hosts are matched by joining each distinct (host, path) pair's host suffixes with the
rules' hosts; the longest rule that fits wins. Pages name aliases of themselves: the canonical link and the refresh
redirect in their HTML, and any further edges that are given. Connected components over these edges are the
equivalence; an alias counts with the rule that fits it even if it is no page of the table. A page without a rule of its own is allowed if a page of its component is allowed by a rule, else blocked if
one is blocked by a rule, else allowed: an explicit allow goes before a block that only reaches the page by aliases.

Defined results: a url that is null or has no ``://`` has an empty host and path, no rule and no aliases; a fragment is
not part of an alias; repeated pages repeat; no pages give an empty result, no rules allow everything. Pages are read for
``page_id``, ``url`` and ``html``; other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import staged
from barloom.llm.components import components

#: Verdict, host, path prefix.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """What two urls of one page share: scheme and fragment left out, the host in lower case."""
    query = F.regexp_extract(url, r"(?s)^[^#]*?(\?[^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host_of(url), path_of(url), query))


def node_of(url: str) -> Column:
    return F.xxhash64(address(F.col(url))).alias("node")


def _attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", 1)
    return F.trim(F.regexp_replace(value, "^[\"']|[\"']$", ""))


def _absolute(base: Column, link: Column) -> Column:
    scheme, host = F.regexp_extract(base, r"(?s)^(.*?)://", 1), F.regexp_extract(base, r"(?s)^.*?://([^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^?#]*/)", 1)
    root = F.concat(scheme, F.lit("://"), host)
    return (
        F.when(link.isNull() | (link == ""), None)
        .when(link.rlike("(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(F.when(F.length(folder) > F.length(root), folder).otherwise(F.concat(root, F.lit("/"))), link))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """``url, alias``: where the canonical link or a refresh of a page points."""
    tags = pages.filter("url is not null and html is not null").select(
        "url", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)(<(?:link|meta)\s[^>]*>)"), 1)).alias("tag")
    )
    link = F.when(F.lower(_attribute(F.col("tag"), "rel")).rlike(r"(^|\s)canonical(\s|$)"), _attribute(F.col("tag"), "href")).when(
        F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh",
        F.trim(F.regexp_replace(F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?is)url\s*=\s*(.*)$", 1), "^[\"']|[\"']$", "")),
    )
    named = tags.filter(F.lower("tag").contains("canonical") | F.lower("tag").contains("refresh"))
    plain = named.select("url", F.regexp_replace(link, "&amp;", "&").alias("link")).filter("link <> ''").distinct()
    return plain.select("url", _absolute(F.col("url"), F.col("link")).alias("alias")).filter("alias is not null").distinct()


def matched(places: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, rule, decided`` of the distinct (host, path) pairs that a rule (``verdict, on, below``) fits."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    wide = places.filter("host <> ''").select("host", "path", F.explode(suffixes).alias("on"))
    fits = wide.join(rules, "on").filter(F.expr("startswith(path, below)"))
    name = F.concat("on", "below")
    return fits.groupBy("host", "path").agg(F.max_by(F.struct(name.alias("rule"), "verdict"), F.struct(F.length(name), name)).alias("best")).select(
        "host", "path", "best.rule", F.col("best.verdict").alias("decided")
    )


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, edges: DataFrame | None = None) -> DataFrame:
    """``page_id, url, host, path, rule, verdict`` for every row of ``pages``; ``edges`` (``url, alias``) adds redirects."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules or [("allow", "", "")], "verdict string, on string, below string")
    rules = rules.filter("`on` <> ''")
    links = alias_edges(pages)
    links = staged(links.union(edges.select("url", "alias")) if edges is not None else links, "aliases")
    own = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ends = links.select("url").union(links.select("alias")).distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    decided = matched(own.select("host", "path").union(ends.select("host", "path")).distinct(), rules)

    groups = components(links.select(node_of("url").alias("a"), node_of("alias").alias("b")))
    # a group's decision is the least of 1 (allow) and 2 (block)
    named = own.select("url", "host", "path").union(ends).join(decided, ["host", "path"])
    ways = named.groupBy(node_of("url").alias("node")).agg(F.min(F.when(F.col("decided") == "allow", 1).otherwise(2)).alias("way"))
    reached = groups.join(ways, "node").groupBy("component").agg(F.min("way").alias("way"))
    spread = groups.join(reached, "component").select("node", F.when(F.col("way") == 1, "allow").otherwise("block").alias("passed"))
    final = own.join(decided, ["host", "path"], "left").withColumn("node", node_of("url")).join(spread, "node", "left")
    return final.select("page_id", "url", "host", "path", "rule", F.coalesce("decided", "passed", F.lit("allow")).alias("verdict"))
