"""Chat formatting, search, near duplicates, urls and embeddings against brute force and edge cases."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from latticework.llm import embedding_dedup, graph, near_dedup, oracles, preferences, queries, search, url_filter

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    problem, _ = compare(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name])
    assert not problem


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 40)] + [(100 + i, 100) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(25)]
    want = components({x for e in links for x in e if e[0] != e[1]}, links)
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_copies():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    docs = {0: " ".join(base), 1: " ".join(base).upper(), 2: "\t".join(base)}
    for i in range(3, 60):  # copies of copies at all similarities around the threshold
        w = docs[rng.randrange(i)].lower().split()
        for _ in range(rng.choice([1, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = rng.choice(words)
        docs[i] = " ".join(w)
    docs |= {70: None, 71: "", 72: " \n\t", 73: "one two", 74: "One  two", 75: "one two three", 76: "x " * 9000, 77: "x " * 8000}
    return docs


def brute_near(docs, percent):
    sets = {}
    for i, t in docs.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    links = [(a, b) for a in docs for b in docs if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, components(docs, links)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, percent):
    docs = near_copies()
    rows = [(i, t, "kept", "digest") for i, t in docs.items()] + [(0, docs[0], None, None), (None, docs[0], None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string, component string").repartition(3)
    got = near_dedup.near_duplicates(df, percent=percent).collect()
    sizes, comp = brute_near(docs, percent)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"] is False
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (sizes[r["doc_id"]], comp[r["doc_id"]], comp[r["doc_id"]] == r["doc_id"])


def test_near_duplicates_empty(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], DOC)).count() == 0


def test_parity_bounds_difference():
    rng = np.random.default_rng(2)
    for n in (3, 40, 900):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[: n // 2], rng.integers(0, 2**63, n, dtype=np.uint64)])
        z = sum(int(x).bit_count() for x in (near_dedup._parity(a) ^ near_dedup._parity(b)).view(np.uint64))
        assert z <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("similarity", [0.8, 0.85])
def test_sketch_keeps_pairs_at_the_threshold(similarity):
    rng, n = np.random.default_rng(6), 64 * near_dedup.SKETCH_WORDS
    bands, rows = near_dedup.bands_for(similarity)
    limit, lost = near_dedup.sketch_limit(similarity, bands * rows), 0
    for _ in range(150):  # 300,000 pairs; a limit without the noise of bits flipped twice loses 5 to 7 of them
        flips = 2 * rng.binomial(bands * rows, 1 - similarity, 2000)
        bits = np.repeat(np.arange(2000), flips) * n + rng.integers(0, n, flips.sum())
        lost += int(((np.bincount(bits, minlength=2000 * n).reshape(2000, n) & 1).sum(1) > limit).sum())
    assert lost <= 1


def bm25(docs, qs, k):
    tokens = {i: Counter((t or "").encode().translate(search._FOLD).split()) for i, t in docs}
    n, avg = len(tokens), sum(sum(c.values()) for c in tokens.values()) / len(tokens)
    df = Counter(w for c in tokens.values() for w in c)
    out = {}
    for q in qs:
        scored = []
        for j, c in tokens.items():
            norm = search.K1 * (1 - search.B + search.B * sum(c.values()) / avg)
            s = sum(m * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (search.K1 + 1) / (c[w] + norm) for w, m in tokens[q].items() if w in c)
            if s > 0:
                scored.append((-round(s, 9), j))
        out[q] = [(j, -s) for s, j in sorted(scored)[:k]]
    return out


def test_search(spark, monkeypatch):
    for name, value in (("SHARD", 64), ("GATHER", 100), ("BLOCK", 8), ("BATCH", 4), ("QUERIES", 7), ("SAMPLE", 4), ("FIRST", 64), ("MATCHES", 50)):
        monkeypatch.setattr(search, name, value)
    rng = random.Random(9)
    words = ["the", "of", "a"] * 30 + [f"t{i}" for i in range(150)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(300)] + [(300, None), (301, "..!"), (302, "the " * 5000)]
    docs += [(400 + i, docs[17][1]) for i in range(12)]  # ties beyond k
    df = spark.createDataFrame([(*d, "x") for d in docs] + [(None, "the", "y")], "doc_id long, text string, score string").repartition(3)
    qs = [i for i, _ in docs if i % 20 == 0 and i < 300] + [17, 302]
    got = defaultdict(list)
    for r in search.bm25_top_k(df, df.where((F.col("doc_id") % 20 == 0) & (F.col("doc_id") < 300) | F.col("doc_id").isin(17, 302)), k=5).orderBy("query_id", "place").collect():
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    want = bm25(docs, qs, 5)
    assert set(got) == set(want)
    for q in qs:
        assert [d for d, _ in got[q]] == [d for d, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-9)
    assert search.bm25_top_k(df.limit(0), df).count() == 0
    assert search.bm25_top_k(df, df.limit(0)).count() == 0


def test_search_prunes():
    """Blocks whose bound is below the k-th best stay closed, query by query, and alike documents share shards."""
    rng = np.random.default_rng(4)
    n = 640
    lists = [np.unique(np.concatenate([rng.integers(0, 40, 30) if i % 2 else rng.integers(1000, 1040, 30), [5000 + i]])) for i in range(n)]
    sizes, lengths = np.array([len(x) for x in lists]), np.array([len(x) for x in lists], float)
    own = [3, 4, 7, 8]
    q = search.Queries(np.arange(4), sizes[own], np.concatenate([lists[i] for i in own]), np.ones(sizes[own].sum()))
    made = [search.shard_of(r, lengths.mean(), q.vocabulary) for r in search.laid_out(np.arange(n), lengths, sizes, np.concatenate(lists), np.ones(sizes.sum(), int))]
    best, pairs = search.Best(4, 5), 4 * sum(len(s.edges) for s in made)
    first = sum(search.search_shard(s, q, best) for s in made)
    again = sum(search.search_shard(s, q, best) for s in made)
    assert again <= first <= pairs and again <= 0.6 * pairs
    docs = np.concatenate([s.docs for s in made])
    assert sorted(docs) == list(range(n)) and (np.diff(docs % 2) != 0).sum() <= 2 * len(made)


def test_search_prunes_documents(spark):
    """Under half of the (query, block) pairs are opened once floors are known."""
    rows = [r for r in queries.table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text").collect() if r["text"]]
    cache = search._Hashes()
    got = [search.terms(r["text"], cache) for r in rows]
    ids, sizes = np.array([r["doc_id"] for r in rows]), np.array([len(t) for t, _ in got])
    flat, counts, lengths = np.concatenate([t for t, _ in got]), np.concatenate([c for _, c in got]), np.array([c.sum() for _, c in got], float)
    known, df = np.unique(flat, return_counts=True)
    own = np.flatnonzero((ids % 20 == 0) & (sizes > 0))
    terms = np.concatenate([got[i][0] for i in own])
    seen = df[np.searchsorted(known, terms)]
    q = search.Queries(ids[own], sizes[own], terms, np.concatenate([got[i][1] for i in own]) * np.log(1 + (len(rows) - seen + 0.5) / (seen + 0.5)))
    best = search.Best(len(own), 10)
    made = [search.shard_of(r, lengths.mean(), q.vocabulary) for r in search.laid_out(ids, lengths, sizes, flat, counts)]
    for s in made:
        search.search_shard(s, q, best)
    again = sum(search.search_shard(s, q, best) for s in made)
    assert again < 0.5 * len(own) * sum(len(s.edges) for s in made)


def test_url_parts_and_rules(spark):
    rules = [url_filter.Rule("allow", "org", "/"), url_filter.Rule("block", "example.org", "/es/"), url_filter.Rule("block", "example.org", "/es/x")]
    rows = [
        (1, "https://A.Example.ORG/es/1?x#y", "a.example.org", "/es/1", "example.org/es/", "block"),
        (2, "http://example.org/es/xy", "example.org", "/es/xy", "example.org/es/x", "block"),
        (3, "http://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
        (4, "http://a.org", "a.org", "", None, "allow"),
        (5, "http://bad.com/a/?utm_source=x#frag", "bad.com", "/a/", None, "block"),
        (6, "https://bad.com/a?b=2&a=1&ref=z", "bad.com", "/a", None, "block"),
        (7, "https://bad.com/a?a=1", "bad.com", "/a", None, "allow"),
        (8, None, "", "", None, "allow"),
        (9, "no scheme", "", "", None, "allow"),
        (10, "", "", "", None, "allow"),
        (11, "x://h?q=http://y/z", "h", "", None, "allow"),
        (12, "http://ÀB.org/" + "p" * 50000, "Àb.org", "/" + "p" * 50000, "org/", "allow"),
    ]
    pages = spark.createDataFrame([(r[0], r[1], "own") for r in rows] + [(5, rows[4][1], "own")], "page_id long, url string, host string")
    listed = spark.createDataFrame([("HTTPS://BAD.com/a/",), ("http://bad.com/a?a=1&b=2",), (None,), ("http://bad.com/a/#z",)], "url string")
    got = [tuple(r) for r in url_filter.url_verdicts(pages, rules, listed).select("page_id", "url", "host", "path", "rule", "verdict").collect()]
    assert sorted(got, key=repr) == sorted([*rows, rows[4]], key=repr)
    clash = pages
    for c in ("w0", "w7", "_listed", "_rest", "_maybe", "_best", "_url", "_u", "_row", "canonical", "block"):
        clash = clash.withColumn(c, F.lit(c))
    kept = url_filter.url_verdicts(clash, rules, listed)
    assert [tuple(r) for r in kept.select("w0", "w7", "_listed", "_rest", "_maybe", "_best", "_url", "_u", "_row", "block").distinct().collect()] == [("w0", "w7", "_listed", "_rest", "_maybe", "_best", "_url", "_u", "_row", "block")]
    none = url_filter.url_verdicts(pages, [], listed.limit(0))
    assert none.where("verdict = 'block'").count() == 0 and none.count() == len(rows) + 1
    assert url_filter.url_verdicts(pages.limit(0), rules, listed).count() == 0


def test_bloom_never_misses(spark):
    from latticework.llm.bloom import bloom_filter, probe

    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    bloom, blocks = bloom_filter(keys, "key", 3000)
    tried = probe(spark.range(60000).select(F.concat(F.lit("k"), "id").alias("key"), "id"), "key", bloom, blocks)
    assert tried.where("id < 3000 AND NOT _maybe").count() == 0
    assert tried.where("id >= 3000 AND _maybe").count() < 600


def test_preferences(spark):
    t = "conv_id long, turn long, role string, text string, prompt string"
    rows = [(0, 0, "system", "s"), (0, 1, "user", "hi"), (0, 2, "assistant", "héllo"), (0, 2, "assistant", "héllo"), (1, 0, "user", "q"), (1, 1, "assistant", "other"), (2, 5, "user", None), (3, 0, None, "n"), (5, 0, "assistant", "x" * 30000), (None, 0, "user", "lost")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], t)
    pairs = preferences.with_partner_replies(df).withColumn("prompt", F.lit("old"))
    got = {r["conv_id"]: r for r in preferences.format_preferences(pairs).collect()}
    assert set(got) == {0, 1, 2, 3, 5}
    a = got[0]
    assert a["prompt_turns"] == 2 and a["prompt"] == "<|system|>\ns<|end|>\n<|user|>\nhi<|end|>\n"
    assert a["chosen_text"] == "<|assistant|>\nhéllo<|end|>\n" and a["rejected_text"] == "<|assistant|>\nother<|end|>\n"
    (s,) = a["chosen_spans"]
    assert a["chosen_text"][s["start"] : s["end"]] == "héllo<|end|>"
    assert got[2]["chosen_text"] == "" and got[2]["prompt_turns"] == 1 and got[2]["prompt"] == "<|user|>\n<|end|>\n"
    assert got[3]["prompt"] == "<|none|>\nn<|end|>\n"
    assert got[5]["rejected_text"] == "" and len(got[5]["chosen_text"]) == 30000 + 14 + 8
    helpers = ["_c", "_r", "_same", "_at", "_rest", "c", "r", "same", "at", "rest", "row", "turns", "a.b"]
    more = pairs
    for name in helpers:
        more = more.withColumn(name, F.lit(name))
    made = preferences.format_preferences(more)
    new = ["prompt_turns", "prompt", "chosen_text", "rejected_text", "chosen_spans", "rejected_spans", "equal"]
    assert made.columns == [c for c in more.columns if c != "prompt"] + new
    assert {r["conv_id"]: (r["chosen_text"], r["equal"]) for r in made.collect()} == {k: (r["chosen_text"], r["chosen_text"] == r["rejected_text"]) for k, r in got.items()}
    assert all(r[name] == name for r in made.collect() for name in helpers)
    # partners whose replies are alike teach nothing, and are marked
    alike = spark.createDataFrame([(8, 0, "user", "x"), (8, 1, "assistant", "yes"), (9, 0, "user", "z"), (9, 1, "assistant", "yes")], "conv_id long, turn long, role string, text string")
    assert [r["equal"] for r in preferences.format_preferences(preferences.with_partner_replies(alike)).collect()] == [True, True]
    nothing = spark.createDataFrame([(1, None, None)], f"id long, chosen {preferences.TURNS}, rejected {preferences.TURNS}")
    r = preferences.format_preferences(nothing).first()
    assert (r["prompt_turns"], r["prompt"], r["chosen_text"], r["rejected_spans"]) == (0, "", "", [])
    assert preferences.with_partner_replies(df.limit(0)).count() == 0


def test_native_plans(spark):
    for name in ("op1_chat_preferences", "op4_url_filter"):
        plan = queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def vectors(rng):
    base = rng.standard_normal((40, 24))
    out = [b for b in base]
    for b in base[:12]:
        for cos in (0.86, 0.895, 0.905, 0.95, 0.999):
            z = rng.standard_normal(24)
            z -= z @ b / (b @ b) * b
            z *= np.linalg.norm(b) / np.linalg.norm(z)
            out.append(cos * b + math.sqrt(1 - cos * cos) * z)
    out += [base[0] * 3, base[0] * 0.5, base[1], base[1]]
    return [list(map(float, np.float32(v))) for v in out]


def test_embeddings(spark):
    rows = [(100 - i, v) for i, v in enumerate(vectors(np.random.default_rng(8)))]
    odd = [(200, None), (201, []), (202, [0.0] * 24), (203, [float("nan")] * 24), (204, [None] + [1.0] * 23), (205, rows[0][1] + [0.0]), (206, [float("inf")] + [1.0] * 23)]
    df = spark.createDataFrame([(*r, "c") for r in rows + odd] + [(None, rows[0][1], "c")], "vec_id long, embedding array<float>, component string")
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    ids = [i for i, _ in rows]
    comp = components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)])
    want = {i: (int(n), comp[i]) for i, n in zip(ids, near.sum(1), strict=True)} | {i: (0, i) for i, _ in odd}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(df).collect() if r["vec_id"] is not None}
    assert got == want
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_embedding_recall():
    rng = np.random.default_rng(3)
    for n in (500, 20_000):
        height, words = embedding_dedup.plan_filters(n, 0.9)
        caps = embedding_dedup.Caps(64, height, words)
        a = rng.standard_normal((400, 64))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        z = rng.standard_normal((400, 64))
        z -= (z * a).sum(1, keepdims=True) * a
        b = 0.9 * a + math.sqrt(0.19) * z / np.linalg.norm(z, axis=1, keepdims=True)
        first, second = (set(zip(*caps.passed(v), strict=True)) for v in (a, b))
        assert len({i for i, _ in first & second}) >= 0.98 * 400


@pytest.mark.parametrize("n", [10**6, 10**7, 10**8])
def test_embedding_recall_at_scale(n):
    """Sampled pairs exactly at the threshold, with the filters planned for n vectors."""
    rng = np.random.default_rng(3)
    caps = embedding_dedup.Caps(64, *embedding_dedup.plan_filters(n, 0.9))
    a = rng.standard_normal((300, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = rng.standard_normal((300, 64))
    z -= (z * a).sum(1, keepdims=True) * a
    b = 0.9 * a + math.sqrt(0.19) * z / np.linalg.norm(z, axis=1, keepdims=True)
    first, second = (set(zip(*caps.passed(v), strict=True)) for v in (a, b))
    assert len({i for i, _ in first & second}) == 300


def test_oracles_are_sql():
    assert oracles.OP1.strip().startswith("WITH")
