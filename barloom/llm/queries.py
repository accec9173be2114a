"""The registered queries of this folder, each over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.bpe import token_digests
from barloom.llm.common import table
from barloom.llm.decontaminate import contaminated_words
from barloom.llm.hard_negatives import hard_negatives
from barloom.llm.html_text import main_text
from barloom.llm.neighbours import nearest_neighbours
from barloom.llm.ngram_join import jaccard_components, jaccard_links
from barloom.llm.quality import quality_scores
from barloom.llm.repeats import without_repeats
from barloom.llm.secret_scan import secret_spans
from barloom.llm.topk_search import top_k
from barloom.llm.toxicity import toxicity_scores
from barloom.llm.url_filter import url_verdicts
from barloom.llm.vector_codes import vector_codes

TOKENIZER = "byte_bpe_50k.tiktoken"


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op1_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("id") % 50 == 0)


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


_ALL = (
    op1_ngram_join, op1_ngram_links, op2_toxicity, op3_topk, op4_bpe, op5_url_filter, op6_repeats, op7_quality, op8_decontamination, op9_secrets,
    op10_html_text, op11_hard_negatives, op12_neighbours, op13_codes,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_ASCII_LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_ASCII_LOWER.format(text="coalesce(text, '')"))} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[k : k + 4], ' ') END AS g
  FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS t(k) WHERE len(ws) > 0
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.c >= 75 * (x.n + y.n - c.c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.m AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) m ON m.a = d.doc_id
"""

_OP1_LINKS = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(text=_ASCII_LOWER.format(text="coalesce(text, '')"))} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[k : k + 4], ' ') END AS g
  FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS t(k) WHERE len(ws) > 0
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
  SELECT c.a AS doc_id, count(*) AS n FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b
  WHERE 100 * c.c >= 75 * (x.n + y.n - c.c) GROUP BY c.a
)
SELECT j.doc_id, j.n_shingles, j.component_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links
FROM ({_OP1}) j LEFT JOIN l ON l.doc_id = j.doc_id
"""

_OP3 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS "rank", vec_id, score FROM r WHERE k <= 5
"""

_OP8 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
),
i AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[k : k + least(10, len(ws)) - 1], ' ') AS g
  FROM b, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS t(k) WHERE len(ws) > 0
),
h AS (
  SELECT d.doc_id, k, i.n, i.item_id
  FROM d, (SELECT DISTINCT n FROM i) AS sizes(n), unnest(range(1, len(ws) - sizes.n + 2)) AS t(k)
  JOIN i ON i.n = sizes.n AND i.g = array_to_string(ws[k : k + sizes.n - 1], ' ')
),
p AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS w FROM h) GROUP BY doc_id),
q AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN q ON q.doc_id = d.doc_id
"""

_OP6 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
w AS (SELECT doc_id, k, sha256(array_to_string(ws[k : k + 19], ' ')) AS g FROM d, unnest(range(1, len(ws) - 18)) AS t(k)),
f AS (SELECT doc_id, k, row_number() OVER (PARTITION BY g ORDER BY doc_id, k) AS place FROM w),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS at FROM f WHERE place > 1),
x AS (SELECT doc_id, k AS at, ws[k] AS word FROM d, unnest(range(1, len(ws) + 1)) AS t(k)),
kept AS (SELECT x.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY x.at) AS text FROM x ANTI JOIN gone ON gone.doc_id = x.doc_id AND gone.at = x.at GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

_HOST = "translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The given pages name no aliases; a test holds the operator against brute force where they do.
_OP5 = f"""
WITH p AS (SELECT page_id, url, coalesce({_HOST}, '') AS host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(verdict, h, b) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT host, path, h || b AS rule, verdict, row_number() OVER (PARTITION BY host, path ORDER BY length(h || b) DESC) AS k
  FROM (SELECT DISTINCT host, path FROM p) JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, b)
)
SELECT p.page_id, p.url, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON m.host = p.host AND m.path = p.path AND m.k = 1
"""

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

_OP11 = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_FINITE}
),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id AND len(c.v) = len(a.v)
),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
),
n AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS k
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS "rank", negative_id, positive_score, negative_score FROM n WHERE k <= 3
"""


def _op13(rounds: int = 4) -> str:
    """Squared distances are whole numbers below 2^53, so double precision is exact."""
    steps = [
        f"""
v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE {_FINITE}
),
x AS MATERIALIZED (
  SELECT vec_id, j, v[len(v) // 4 * j + 1 : len(v) // 4 * (j + 1)] AS x FROM v, unnest(range(4)) AS t(j)
),
c0 AS MATERIALIZED (
  SELECT j, row_number() OVER (PARTITION BY j ORDER BY vec_id) - 1 AS e, x AS c FROM x
  WHERE vec_id IN (SELECT vec_id FROM v WHERE vec_id IS NOT NULL ORDER BY vec_id LIMIT 256)
)"""
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""
a{i} AS MATERIALIZED (
  SELECT vec_id, j, any_value(x) AS x, min({{'d': d, 'e': e}}) AS m FROM (
    SELECT vec_id, x.j, x, e, list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c) AS d FROM x JOIN c{i} c ON c.j = x.j
  ) GROUP BY vec_id, j
)"""
        )
        if i < rounds:
            steps.append(
                f"""
m{i} AS MATERIALIZED (
  SELECT j, e, list(f ORDER BY k) AS c FROM (
    SELECT j, m.e AS e, k, floor(sum(x[k + 1]) / count(*)) AS f FROM a{i}, unnest(range(len(x))) AS t(k) GROUP BY j, m.e, k
  ) GROUP BY j, e
),
c{i + 1} AS MATERIALIZED (SELECT c.j, c.e, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN m{i} m ON m.j = c.j AND m.e = c.e)"""
            )
    return f"""
WITH {",".join(steps)},
k AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY j, e)) AS h FROM c{rounds}),
r AS (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY j) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT r.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, k.h AS codebooks_sha256
FROM r JOIN v ON v.vec_id = r.vec_id, k
"""


SQL: dict[str, str] = {
    "op1_ngram_join": _OP1, "op1_ngram_links": _OP1_LINKS, "op3_topk": _OP3, "op5_url_filter": _OP5, "op6_repeats": _OP6, "op8_decontamination": _OP8,
    "op11_hard_negatives": _OP11, "op13_codes": _op13(),
}
