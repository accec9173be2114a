"""Whole operators against plain Python: pipeline stages row by row, redirect graphs, long runs, invalid text."""

import hashlib
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import bpe, decontaminate, ngram_join, secret_scan, url_filter

DATA = "/root/testdata/sf0.001"


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w]
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def components(texts):
    """Smallest id that each id reaches by links of 75 % similar sets."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in texts if sets[i])
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in texts}


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def windows(items):
    found = {}
    for t in items:
        w = item_words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            found.setdefault(n, set()).add(tuple(w[k : k + n]))
    return found


def test_pipeline_stages_equal_plain_python(spark):
    """Each stage on what the stage before kept, a third of the documents, repeated and empty ones among them."""
    given = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id % 3 = 0")
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    rows = [(90_001, None), (90_002, ""), (90_003, "password = hunter2hunter2 and more"), (90_004, f"Words before it. {items[0].upper()} And after.")]
    extra = spark.createDataFrame(rows, "doc_id long, text string")
    docs = given.unionByName(extra, allowMissingColumns=True)
    columns = set(docs.columns)
    by_name = dict(corpus_pipeline.STAGES)

    kept = by_name["near copies"](spark, docs, DATA)
    assert set(kept.columns) == columns
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r.text for r in kept.collect()}
    parts = components(before)
    assert set(after) == {i for i, c in parts.items() if i == c} and len(after) < len(before)
    assert all(after[i] == before[i] for i in after)

    wanted = windows(items)
    clean = {i for i, t in after.items() if not any(tuple(w[k : k + n]) in wanted[n] for w in [item_words(t)] for n in wanted for k in range(len(w) - n + 1))}
    left = by_name["decontamination"](spark, kept, DATA)
    assert {r.doc_id for r in left.collect()} == clean and set(left.columns) == columns and 0 < len(clean) < len(after)

    safe = by_name["secrets"](spark, left, DATA)
    texts = {r.doc_id: r for r in safe.collect()}
    assert set(texts) == clean and set(safe.columns) == columns
    secret = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,})|AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}""", re.A)
    for i, r in texts.items():
        had = secret.search(after[i] or "") is not None
        assert (secret.search(r.text or "") is None) and (r.text != after[i] if had else True)
        if r.text != after[i]:
            assert r.n_chars is None or r.n_chars == len(r.text)
    assert texts[90_003].text == "[SECRET] and more" and texts[90_001].text is None

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.rank_table(public_tokenizers.path(corpus_pipeline.TOKENIZER)), special_tokens={})
    for r in by_name["tokens"](spark, safe, DATA).collect():
        ids = library.encode_ordinary(texts[r.doc_id].text or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id].text or "").encode()).hexdigest()


def test_pipeline_of_an_empty_table(spark):
    none = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, DATA).count() == 0, name


def test_linked_sets_share_a_key_in_which_the_smaller_leads():
    """Random pairs around the bound, in a random order of rarity: no pair of 75 % similar sets is parted by size bands or leads."""
    rng = np.random.default_rng(7)
    linked = 0
    for _ in range(4000):
        n = int(rng.integers(1, 130))
        m = int(n * rng.uniform(0.75, 1.34)) + int(rng.integers(0, 2))
        shared = min(n, m, int(rng.integers(int(0.8 * min(n, m)), min(n, m) + 1)))
        pool = rng.integers(0, 1 << 40, n + m)  # all different, but for one case in 10^7
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:shared], pool[n : n + m - shared]]))
        if not len(b) or 100 * shared < 75 * (len(a) + len(b) - shared):
            continue
        linked += 1
        keys = [ngram_join.token_keys(x[: ngram_join.prefix_of(len(x))], len(x)) for x in (a, b)]
        leads = [set(k[lead].tolist()) for k, lead in keys]
        every = [set(k.tolist()) for k, _ in keys]
        small = int(len(b) < len(a))
        met = leads[small] & every[1 - small]
        assert met or len(a) == len(b) and leads[1 - small] & every[small]
    assert linked > 500


def test_shipped_sets_come_back():
    names = np.random.default_rng(1).integers(0, 1 << 62, 500).astype(np.uint64)
    back = ngram_join.received(ngram_join.shipped(names))
    assert (back == (names & np.uint64((1 << 56) - 1))).all()
    assert len(ngram_join.received(b"")) == 0


def test_one_of_each_keeps_columns_that_have_no_order(spark):
    rows = [(1, "one two three four five six", {"a": 1}), (2, "one two three four five six", {"b": 2}), (1, "one two three four five six", None), (3, None, {"c": 3})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra map<string, int>")
    got = ngram_join.one_of_each(docs).collect()
    assert sorted(r.doc_id for r in got) == [1, 3] and got[0].asDict().keys() == {"doc_id", "text", "extra"}


def test_redirect_graphs_equal_a_union_find(spark):
    rng = random.Random(4)
    hosts = ["a.net", "example.net", "x.example.com", "b.org", "plain.edu"]
    urls = sorted({f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr', 'x'])}/{k}" for k in range(60)})
    links = [(rng.choice(urls), rng.choice([*urls, "https://away.net/1", "https://ok.org/fr/2"])) for _ in range(45)]
    pages = spark.createDataFrame([(k, u, None) for k, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.url: r.verdict for r in url_filter.url_verdicts(pages, edges=spark.createDataFrame(links, "url string, alias string")).collect()}

    def rule(url):
        host, path = re.match(r".*?://([^/]*)(.*)", url).groups()
        fits = [(len(h + b), v) for v, h, b in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(b)]
        return max(fits)[1] if fits else None

    root = {u: u for pair in links for u in pair} | {u: u for u in urls}

    def find(u):
        while root[u] != u:
            u = root[u]
        return u

    for a, b in links:
        root[find(a)] = find(b)
    for u in urls:
        near = {rule(v) for v in root if find(v) == find(u)}
        assert got[u] == (rule(u) or ("allow" if "allow" in near else "block" if "block" in near else "allow")), u


def test_long_runs_take_time_in_proportion():
    for run in ("ab-" * 5000 + "a1b2c3d4", "https://example.com/how-to-" + "very-" * 3000 + "long-x1y2z3", "a" * 20_000 + "1", "Ab_" * 4000 + "9" * 9):
        start = time.perf_counter()
        secret_scan.spans_of(run.encode())
        assert time.perf_counter() - start < 3, run[:20]
    start = time.perf_counter()
    assert re.fullmatch(secret_scan.WORDS, "ab-" * 3000 + "a1b2c3d4") is None
    assert time.perf_counter() - start < 0.1
    for words in ("plain", "Two-words", "SHOUTED_words-12", "camel-", "a"):
        assert re.fullmatch(secret_scan.WORDS, words)
    for other in ("a1", "-a", "abc-12345", "aBc", ""):
        assert not re.fullmatch(secret_scan.WORDS, other)


@pytest.mark.parametrize("seed", [0, 1])
def test_windows_of_random_items(spark, seed):
    rng = random.Random(seed)
    vocabulary = "Ab cd ef gh Äb é1 ß".split()

    def text(n):
        return rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))

    items = [(k, text(rng.choice([0, 1, 3, 4, 9, 10, 11, 14]))) for k in range(12)] + [(12, None)]
    docs = [(k, text(rng.randrange(0, 60))) for k in range(40)] + [(40, None), (41, ""), (3, text(20))]
    got = decontaminate.contaminated_words(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = []
    for i, t in docs:
        w, hit, named = item_words(t), set(), set()
        for item, u in items:
            v = item_words(u)
            n = min(10, len(v))
            for k in range(len(v) - n + 1 if n else 0):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == v[k : k + n]:
                        hit |= set(range(at, at + n))
                        named.add(str(item))
        want.append((i, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    assert sorted(map(tuple, got.drop("key").collect())) == sorted(want)


def test_text_that_is_no_utf8(spark):
    """Bytes that are not UTF-8 count as the replacement character, as in the other operators."""
    raw = spark.createDataFrame([(1, bytearray(b"caf\xe9 \xff ok"))], "doc_id long, raw binary")
    docs = raw.select("doc_id", F.col("raw").cast("string").alias("text"))
    row = bpe.token_digests(docs, public_tokenizers.path(corpus_pipeline.TOKENIZER), public_tokenizers.PATTERN).first()
    assert row.decoded_sha256 == hashlib.sha256(b"caf\xe9 \xff ok".decode("utf-8", "replace").encode()).hexdigest()


def test_scan_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert secret_scan.secret_spans(none).count() == 0 and secret_scan.redacted(none).count() == 0
    assert bpe.token_digests(none, public_tokenizers.path(corpus_pipeline.TOKENIZER), public_tokenizers.PATTERN).count() == 0
