"""Small cases of the operators: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import bpe, components, decontaminate, html_text, ngram_join, quality, repeats, secret_scan, topk_search, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, component string, key string, score double"


def table(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), 7, "c", "k", 0.5) for i, t in rows], SCHEMA)


def sentence(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(9)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = sentence(rng, 120)
    out = [(1, base), (2, base), (3, base.replace("alpha1", "other", 1)), (4, base + " " + sentence(rng, 12)), (5, None), (6, ""), (7, " \t\n"), (8, "Two words"), (9, "two WORDS")]
    out += [(k, sentence(rng, rng.randrange(1, 90))) for k in range(10, 40)] + [(12, base), (1, base), (None, base), (None, None)]
    words = base.split()
    for k in range(40, 60):  # near copies, some of them linked by way of others only
        mine = list(words)
        for _ in range(k - 39):
            mine[rng.randrange(len(mine))] = f"edit{k}"
        out.append((k, " ".join(mine)))
    out.append((90, "long" + "x" * 50_000 + " " + "again and again " * 3000))
    return out


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    w = [re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in w]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_components_match_all_pairs(spark, rows):
    docs = [(i, sets(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in docs}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in docs:
        for b, y in docs:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    got = ngram_join.jaccard_components(table(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == {(i, top(i)) for i, _ in docs}
    assert sorted((r.doc_id or -1, r.n_shingles) for r in got) == sorted((i or -1, len(sets(t))) for i, t in rows)
    kept = ngram_join.one_of_each(table(spark, rows))
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({top(i) for i, _ in docs}) and ids.count(None) == 2
    assert kept.columns == SCHEMA.replace(",", " ").split()[::2]


def test_links_match_all_pairs(spark, rows, monkeypatch):
    def expected(of):
        docs = [(i, frozenset(sets(t))) for i, t in of if i is not None]
        near = {i: set() for i, _ in docs}
        distinct = sorted({(i, x) for i, x in docs if x}, key=lambda d: (d[0], len(d[1])))
        for a, x in distinct:
            near[a] |= {b for b, y in distinct if b != a and 4 * len(x & y) >= 3 * len(x | y)}
        return sorted([(i, len(x), len(near[i])) for i, x in docs])

    def got(of):
        return sorted((r.doc_id, r.n_shingles, r.n_links) for r in ngram_join.jaccard_links(table(spark, of)).collect() if r.doc_id is not None)

    # ids of several texts that link with each other, with the same class, and with nothing
    texts = {i: t for i, t in rows if i is not None}
    more = rows + [(41, texts[44]), (3, texts[2]), (3, texts[42]), (201, texts[15]), (201, texts[16]), (202, texts[1]), (202, texts[43])]
    assert got(rows) == expected(rows)
    assert max(n for _, _, n in expected(rows)) > 4
    monkeypatch.setattr(ngram_join, "BLOCK", 3)  # many sides to a component
    assert got(more) == expected(more)
    assert ngram_join.jaccard_links(table(spark, rows).limit(0)).isEmpty()
    assert [r.n_links for r in ngram_join.jaccard_links(table(spark, [(None, "a b c"), (None, "a b c"), (1, "a b c"), (2, "")])).orderBy("doc_id").collect()] == [None, None, 0, 0]


def test_bound_of_the_tree_loses_nothing():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    some = [np.unique(np.concatenate([base[rng.random(300) < 0.9], rng.integers(0, 2**63, int(rng.integers(0, 40))).astype(np.uint64)])) for _ in range(60)]
    sizes, points = np.array([len(s) for s in some]), [ngram_join.point(s) for s in some]
    near = {(min(i, j), max(i, j)) for own, members, tree in ngram_join.trees(points, sizes) for i in own for j in members[tree.query(points[i].astype(np.int32), sizes[i])[0]]}
    links = {(i, j) for i in range(60) for j in range(i + 1, 60) if 7 * ngram_join.common(some[i], some[j]) >= 3 * (sizes[i] + sizes[j])}
    assert links and links <= near


def test_component_steps(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {k: 0 for k in range(51)} | {100: 100, 101: 100}
    assert components.components(edges.limit(0)).isEmpty()


def test_repeats_match_brute_force(spark, rows):
    def order(row):
        return (row[0] is not None, row[0] or 0)

    rows = [r for r in rows if r[0] not in (1, 12, None)] + [(1, rows[0][1]), (12, rows[0][1])]
    seen, want = set(), {}
    for i, t in sorted(rows, key=order):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        keep = [True] * len(w)
        for a in range(len(w) - 19):
            g = tuple(w[a : a + 20])
            if g in seen:
                keep[a : a + 20] = [False] * 20
            seen.add(g)
        kept = [x for x, k in zip(w, keep, strict=True) if k]
        want[i] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    got = repeats.without_repeats(table(spark, rows)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want
    assert repeats.without_repeats(table(spark, rows).limit(0)).isEmpty()


def test_decontamination(spark, rows):
    text = rows[0][1]
    items = spark.createDataFrame([(1, " ".join(text.split()[20:45]).upper()), (2, "two words"), (3, None), (4, ""), (2, "two words"), (None, "again and")], "item_id long, text string")
    got = {(r.doc_id, r.n_words): r for r in decontaminate.contaminated_words(table(spark, rows), items).collect()}
    assert got[(2, 120)].n_hit >= 25 and got[(2, 120)].n_items == 1
    assert got[(2, 120)].items_sha256 == hashlib.sha256(b"1").hexdigest()
    assert got[(8, 2)].n_hit == 2 and got[(9, 2)].contaminated and not got[(6, 0)].contaminated
    assert got[(90, 9001)].n_hit == 6000 and got[(90, 9001)].n_items == 0
    kept = decontaminate.decontaminated(table(spark, rows), items)
    assert {5, 6, 7} <= {r.doc_id for r in kept.collect()} and not {1, 2, 8, 9, 90} & {r.doc_id for r in kept.collect()}
    assert decontaminate.decontaminated(table(spark, rows), items.limit(0)).count() == len(rows)


def test_bpe_equals_the_library(spark, rows):
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.rank_table(path), special_tokens={})
    rng = random.Random(2)
    mixed = ["".join(rng.choice(["a", "the", " ", "\n", "é", "ß", "漢", "😀", "'s", "1", "_", "\t", "\x85", "‍"]) for _ in range(rng.randrange(60))) for _ in range(500)]
    texts = [t for _, t in rows if t] + ["<|endoftext|>", "ab" * 9000, *mixed]
    coder = bpe.Encoder(path, public_tokenizers.PATTERN)
    ids = coder.encode_all(texts)
    assert [[int(i) for i in x.split()] for x in ids] == [library.encode_ordinary(t) for t in texts]
    assert [coder.decode(i).decode() for i in ids] == texts
    assert all(bpe.merged(t.encode(), coder.ranks) == bpe.merged_together([t.encode()], 64, path)[0] for t in mixed if 0 < len(t.encode()) <= 64)
    tokens = bpe.decoded(bpe.encoded(table(spark, rows), path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert sorted((r.text or "") for r in tokens.collect()) == sorted(bytes(r.decoded).decode() for r in tokens.collect())
    assert {r.n_tokens for r in bpe.token_digests(table(spark, [(1, None), (2, "")]), path, public_tokenizers.PATTERN).collect()} == {0}


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(1)
    vectors = [(int(i), [float(v) for v in rng.normal(size=8).round(1)]) for i in range(300)] + [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (303, [1.0]), (7, [0.5] * 8)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {}
    for r in topk_search.top_k(frame, F.col("id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = [(i, np.floor(np.array(v) * 256).astype(int)) for i, v in vectors if v and len(v) == 8 and i < 300]
    for q, v in whole[:300:50]:
        best = sorted(((-int(v @ x), i) for i, x in whole if i != q))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert set(got) == {0, 50, 100, 150, 200, 250}
    assert topk_search.top_k(frame.limit(0), F.col("id") % 50 == 0).isEmpty()


def test_url_rules_and_aliases(spark):
    pages = [
        (1, "http://a.net/x", '<link rel="canonical" href="http://b.com/y?z=1">'), (2, "https://B.com/y?z=1#t", None), (3, "http://c.org/fr/q", "<META HTTP-EQUIV=refresh content=\"0; URL='/en'\">"),
        (4, "http://c.org/en", ""), (5, None, "x"), (6, "nothing", "<p>"), (7, "http://u.com/de/1", None), (8, "http://sub.example.net/en/", None), (9, "http://sub.example.net/fr", None),
        (10, "http://example.com/de/", None), (11, "http://k.net", None), (8, "http://sub.example.net/en/", None),
    ]
    frame = spark.createDataFrame([(*p, "r", "v") for p in pages], "page_id long, url string, html string, rule string, node string")
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.url_verdicts(frame).collect()}
    assert got == {
        1: ("a.net", "net/", "block"), 2: ("b.com", None, "block"), 3: ("c.org", "org/fr/", "allow"), 4: ("c.org", None, "allow"), 5: ("", None, "allow"), 6: ("", None, "allow"),
        7: ("u.com", None, "allow"), 8: ("sub.example.net", "example.net/en/", "allow"), 9: ("sub.example.net", "net/", "block"), 10: ("example.com", "example.com/de/", "block"), 11: ("k.net", None, "allow"),
    }
    plan = url_filter.url_verdicts(frame)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow", plan)
    assert url_filter.url_verdicts(frame.limit(0)).isEmpty() and url_filter.url_verdicts(frame, []).count() == len(pages)


def test_secrets():
    text = "é password = 'abcdefgh1' api_key=token:'abcdefghi' AKIA1234567890AB " + "0123456789abcdef" * 2 + " token=x qJ8zKp3LmX0vRt7YwB2nQd"
    base, spans = secret_scan.spans_of(text.encode())
    assert [(secret_scan.KINDS[k], text[a:b]) for a, k, b in base] == [("assign", "password = 'abcdefgh1"), ("access", "AKIA1234567890AB"), ("hex", "0123456789abcdef" * 2)]
    assert ("entropy", "qJ8zKp3LmX0vRt7YwB2nQd") in [(secret_scan.KINDS[k], text[a:b]) for a, k, b in spans]
    assert secret_scan.spans_of(b"") == ([], []) and secret_scan.entropy_spans("internationalisation-of-everything 12345678901234567890", []) == []
    rng = random.Random(4)
    for _ in range(50):  # incremental counts against counting each window
        run = "".join(rng.choice("abcXYZ0189+/") for _ in range(rng.randrange(20, 60)))
        need = secret_scan.BITS[secret_scan.character_class(run)]
        high = {k for k in range(len(run) - 19) if -sum(c / 20 * np.log2(c / 20) for c in map(run[k : k + 20].count, set(run[k : k + 20]))) >= need - 1e-9}
        assert {i for a, b in secret_scan.high_entropy(run) for i in range(a, b)} == {i for k in high for i in range(k, k + 20)}


def test_secret_classes():
    def found(text):
        return [text[a:b] for a, _, b in secret_scan.entropy_spans(text, [])]

    # a class each: letters of one case, digits, hex after a prefix (its windows need 3.1 bits, not the 3.7 of a mixed run)
    capitals = "QZXKVJWMPFHGTRBNYDLCXQJVKZWPMHGFBTNRDYLS"
    for text in ("qzxkvjwmpfhgtrbnydlc", capitals, "Qzxkvjwmpfhgtrbnydlc", "83019274650918273645", "q8Kz-83019274650918273645"):
        assert found(text) and text.endswith(found(text)[-1]), text
    assert found("key=qzxkvjwmpfhgtrbnydlc")[0].endswith("qzxkvjwmpfhgtrbnydlc")
    weak = "a7f3a0c7b3f1a0e7c3b1f0a"
    assert secret_scan.character_class(weak) == "hex" and found(weak) == [weak]
    assert all(found(p + weak)[0].endswith(weak) for p in ("hmac=", "sid-", "v1/")) and found("HMAC=" + weak.upper())[0].endswith(weak.upper())
    assert {secret_scan.character_class(x) for x in ("12", "1f", "xy", "xY")} == set(secret_scan.BITS)
    # words, rules, numbers and what counts on are none
    plain = "counterrevolutionaries Donaudampfschifffahrtsgesellschaft anticonstitutionnellement electroencefalografista THE_MAXIMUM_NUMBER_OF_ITEMS"
    assert found(plain + " path/to/some/folder/of/reports-2024 2024-01-31/2024-02-29_17 ====-----=====-----==== 98765432109876543210") == []
    assert found("123e4567-e89b-12d3-a456-426614174000") == []
    rng = random.Random(6)
    for letters, least in (("abcdefghijklmnopqrstuvwxyz", 0.95), ("0123456789", 0.95), ("0123456789abcdef", 0.95)):
        hits = [bool(found("id=" + "".join(rng.choice(letters) for _ in range(24)))) for _ in range(400)]
        assert np.mean(hits) >= least, letters


def test_secret_rows(spark):
    docs = table(spark, [(1, "x secret: abcdefgh99 y"), (2, None), (3, "clean"), (3, "clean")])
    assert {(r.doc_id, r.n_assign, r.spans) for r in secret_scan.secret_spans(docs).collect()} == {(1, 1, "assign:2:20"), (2, 0, ""), (3, 0, "")}
    got = secret_scan.redacted(docs)
    assert sorted((r.doc_id, r.text or "", r.n_chars) for r in got.collect()) == [(1, "x [SECRET] y", 12), (2, "", 0), (3, "clean", 5), (3, "clean", 5)]
    assert got.columns == docs.columns


def test_classifiers_hold_out(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    known = {r.doc_id: r for r in labels.collect()}
    good = [(r.predicted, known[r.doc_id].quality) for r in quality.quality_scores(docs, labels).collect() if r.held_out and r.doc_id in known]
    assert np.mean([a == b for a, b in good]) > 0.95
    toxic = [(r.score, known[r.doc_id].toxic) for r in toxicity.toxicity_scores(docs, labels).collect() if r.held_out and r.doc_id in known]
    assert np.mean([s for s, t in toxic if t == 1]) > np.mean([s for s, t in toxic if t == 0]) + 0.2
    odd = table(spark, [(1, None), (2, ""), (None, "x y z"), (4, "w " * 20_000)])
    for scores in (quality.quality_scores, toxicity.toxicity_scores):
        got = scores(odd, labels.limit(0)).collect()
        assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
        assert scores(odd.limit(0), labels).isEmpty()


def test_html():
    model = html_text.taught()

    def text(html):
        page = html_text.Page(html)
        return page.text(page.states(model.probability(page.features())))

    more = "and a sentence of the usual length follows here, as an article has it. " * 4
    page = f"<html><head><title>T</title></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class=ad>Buy now</div><article><h1>A &amp; B</h1><p><b>One\n two<br>three, {more}<p>Four &eacute; {more}</p><script>x</script><!-- c --></article><footer>&copy; me</footer>"
    assert text(page) == " ".join(f"A & B One two three, {more} Four é {more}".split())
    assert text("") == "" and text("<html><body></body></html>") == "" and text("<p") == ""
    assert "reader" not in text("<article><h1>A title</h1><p>Some text of the article.</p><section class=comments><p>reader says</p></section></article>")


def test_html_long_pages_bare_text_and_formulas():
    model = html_text.taught()

    def text(html):
        page = html_text.Page(html)
        return page.text(page.states(model.probability(page.features())))

    # the place among siblings holds at every size
    page = html_text.Page("<article>" + "<p>Some words.</p>" * 301 + "</article>")
    assert np.allclose(page.features()[2:, 7], np.arange(301) / 300)
    assert text("Plain words only.\n") == "Plain words only." and text("Bare <b>bold</b> words <!-- c -->") == "Bare bold words"
    more = "and a sentence of the usual length follows here, as an article has it. " * 4
    formula = "<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>TeX</annotation></semantics></math>"
    assert text(f"<html><body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>One {formula} {more}</p></article></body></html>") == f"Title One x=2 {more}".strip()


def test_pipeline_stages(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert 0 < out.count() < docs.count() and {"doc_id", "n_tokens"} <= set(out.columns)
    assert len(corpus_pipeline.STAGES) == 5
