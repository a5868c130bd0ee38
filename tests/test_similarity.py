"""Set-similarity and gestalt joins against all pairs; what they look at is counted."""

import random
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from latticework.functions import names as N
from latticework.operators import gestalt as G
from latticework.operators import resolve as M
from latticework.operators import similarity as J
from latticework.operators.order import numbered
from latticework.plans import catalogue

SF = "/root/testdata/sf0.01"


def word_sets(rng, n, common=6, rare=60):
    """Sets of words, some of common words alone, some empty, some equal."""
    out = []
    for i in range(n):
        words = rng.sample([f"c{k}" for k in range(common)], rng.randrange(common + 1)) + rng.sample([f"r{k}" for k in range(rare)], min(rare, rng.choice([0, 0, 1, 3, 9, 25])))
        out.append((i, "xy"[rng.randrange(2)] if rng.random() < 0.9 else None, words + words[:1]))
    return out + [(n + i, b, w) for i, (_, b, w) in enumerate(out[:5])]


def brute(qs, ds, block):
    out = {}
    for i, b, w in qs:
        for j, c, v in ds:
            both = set(w) & set(v)
            if both and (not block or (b == c and b is not None)):
                out[i, j] = (len(set(w)), len(set(v)), len(both))
    return out


@pytest.mark.parametrize("block", [None, "b"])
def test_joins_against_all_pairs(spark, block):
    rng = random.Random(7)
    qs, ds = word_sets(rng, 60), word_sets(rng, 120)
    q, d = spark.createDataFrame(qs, "q long, b string, words array<string>"), spark.createDataFrame(ds, "e long, b string, words array<string>")
    sides, pairs = J.word_sides(q, d, "q", "e", block=block), brute(qs, ds, block)
    score = {k: s / (a + b - s) for k, (a, b, s) in pairs.items()}
    for least in (0.05, 0.3, 0.5, 2 / 3, 1.0):
        got = {(r["q"], r["e"]): (r["n_query"], r["n_entity"], r["n_shared"]) for r in J.similar(sides, least).collect()}
        assert got == {k: v for k, v in pairs.items() if score[k] >= least}
        for matches in (1, 3):
            looked = {tuple(r) for r in J.jaccard_candidates(sides, least, matches).collect()}
            assert set(got) <= looked
    for n in (1, 2):
        assert {(r["q"], r["e"]) for r in J.containing(sides, n).collect()} == {k for k, (a, _, s) in pairs.items() if a == s >= n}
    best = {}
    for (i, j), s in sorted(score.items()):
        if i not in best or s > best[i][1]:
            best[i] = (j, s)
    for levels in (J.most_similar.__defaults__[0], (0.9,), ()):
        assert {r["q"]: (r["e"], r["score"]) for r in J.most_similar(sides, levels).collect()} == best
    empty = J.word_sides(q.limit(0), d, "q", "e", block=block)
    assert J.similar(empty, 0.5).count() == J.most_similar(empty).count() == J.containing(empty).count() == 0


def test_sharing_counts_rows(spark):
    rng = random.Random(8)
    qs, ds = word_sets(rng, 30), word_sets(rng, 90)
    q, d = spark.createDataFrame(qs, "q long, b string, words array<string>"), spark.createDataFrame(ds, "e long, b string, words array<string>")
    # far apart numbers fall into bitmaps of their own
    for step in (1, 1000, 40000):
        got = {r["q"]: r["n"] for r in J.sharing(q, d.withColumn("i", F.col("e") * step), "q", "i").collect()}
        want = {}
        for i, _ in brute(qs, ds, None):
            want[i] = want.get(i, 0) + 1
        assert got == want


def test_few_pairs_are_looked_at(spark, monkeypatch):
    """Of the pairs of items and documents that share a word, well under a tenth reach an exact count, for every join."""
    words = F.array_distinct(N.words(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")))
    items, docs = (spark.read.parquet(f"{SF}/{t}.parquet").select(F.col(k), words.alias("words")) for t, k in (("benchmark", "item_id"), ("documents", "doc_id")))
    every = M.shared_words(items, docs, "item_id", "doc_id").count()
    looked, count = [], J.counted

    def counting(sides, pairs):
        looked.append(pairs.count())
        return count(sides, pairs)

    monkeypatch.setattr(J, "counted", counting)
    sides = J.word_sides(items, docs, "item_id", "doc_id")
    for join in (J.most_similar, lambda s: J.containing(s, 2), lambda s: J.similar(s, 0.3)):
        looked.clear()
        join(sides).collect()
        assert 0 < sum(looked) < every / 10


def test_word_match_against_plain_join(spark):
    """The best clear match of each row in its block, as jaccard_match finds it among all pairs."""
    rng = random.Random(9)
    rows = spark.createDataFrame(word_sets(rng, 150, common=3, rare=12), "e long, b string, words array<string>")
    q = rows.withColumnRenamed("e", "q")
    pairs = q.withColumnRenamed("words", "qw").join(rows.withColumnRenamed("words", "ew"), "b").where("q <> e")
    want = {tuple(r) for r in M.jaccard_match(pairs, "q", "e", "qw", "ew").collect()}
    assert want and {tuple(r) for r in M.word_match(q, rows, "q", "e", block="b", other=F.col("q") != F.col("e")).collect()} == want


# --- gestalt ratio ----------------------------------------------------------------------------------------------


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abc 1é", max_size=12), st.text(alphabet="abc 1é", max_size=12)), min_size=1, max_size=40))
def test_bounds_hold(spark, texts):
    df = spark.createDataFrame(texts, "a string, b string")
    for r in G.scored(G.bounded(df, "a", "b"), "a", "b").collect():
        assert r["bound"] >= r["ratio"] == SequenceMatcher(None, r["a"], r["b"]).ratio()


def name_pairs(rng, n):
    stems = ["north river college", "river north college", "north rivers college", "saint ann academy", "st anne academy", "technical institute", ""]
    names = [rng.choice(stems)[: rng.randrange(4, 25)] + rng.choice(["", " a", " west", "x"]) for _ in range(n)]
    return [(i, j, names[i], names[j]) for i in range(n) for j in range(n) if i != j] + [(0, n + 1, None, "x"), (0, n + 2, "x", None)]


def test_top_ratios_against_difflib(spark):
    rows = name_pairs(random.Random(10), 40)
    pairs = spark.createDataFrame(rows, "q long, e long, a string, b string")
    ratios = {(q, e): SequenceMatcher(None, a, b).ratio() for q, e, a, b in rows if a is not None and b is not None}
    got = {(r["q"], r["e"]): r["ratio"] for r in G.top_ratios(pairs, "q", "e", "a", "b").collect()}
    assert all(ratios[k] == v for k, v in got.items()) and len(got) < len(ratios)
    for q in {q for q, _ in ratios}:
        theirs = sorted(((-v, e) for (i, e), v in ratios.items() if i == q))[:2]
        assert sorted(((-v, e) for (i, e), v in got.items() if i == q))[:2] == theirs
    near = {(r["q"], r["e"]): r["ratio"] for r in G.ratios_from(pairs, "a", "b", 0.8).collect()}
    assert near == {k: v for k, v in ratios.items() if v >= 0.8}
    assert G.top_ratios(pairs.limit(0), "q", "e", "a", "b").count() == G.ratios_from(pairs.limit(0), "a", "b", 0.5).count() == 0


def test_ratio_queries_against_difflib(spark, monkeypatch):
    """fuzzy_ratio_match and near_miss_names as over all pairs; few of these, and every text pair once, reach Python."""
    from latticework.plans import text_queries as T

    every, known, ratios = [tuple(r) for r in T._name_pairs(spark, SF).collect()], {}, {}
    for q, e, a, b in every:
        if (a, b) not in known:
            known[a, b] = SequenceMatcher(None, a, b).ratio()
        ratios.setdefault(q, []).append((-known[a, b], e))
    want = {}
    for q, all_ in ratios.items():
        (s1, e), *rest = sorted(all_)
        gap = -s1 + (rest[0][0] if rest else 0.0)
        sure = -s1 >= 0.86 and gap >= 0.03
        want[q] = (e if sure else None, "high" if sure and -s1 >= 0.92 else "medium" if sure else "low", "fuzzy" if sure else "ambiguous" if gap < 0.03 else "low")
    looked, scored = [], G.scored

    def counting(pairs, a, b, *names):
        looked.append(pairs.select(a, b).distinct().count())
        return scored(pairs, a, b, *names)

    monkeypatch.setattr(G, "scored", counting)
    got = {r["q"]: (r["id"], r["confidence"], r["method"]) for r in catalogue.queries()["fuzzy_ratio_match"](spark, SF).collect()}
    assert got == want
    assert sum(looked) < 0.05 * len(every)
    looked.clear()
    near = {(r["q"], r["id"]): r["ratio"] for r in catalogue.queries()["near_miss_names"](spark, SF).collect()}
    assert near == {(q, e): -s for q, all_ in ratios.items() for s, e in sorted(all_)[:2] if -s >= 0.92}
    assert sum(looked) < 0.01 * len(every)


def test_numbers_along_an_order(spark):
    rng = random.Random(11)
    rows = [(i, rng.choice([None, *range(5)]), "k") for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v long, _part string").repartition(7)
    got = {r["id"]: r["place"] for r in numbered(df, [F.col("v").desc_nulls_first(), F.col("id")]).collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or 0), r[0]))
    assert got == {r[0]: i + 1 for i, r in enumerate(order)}
    assert numbered(df, ["id"]).columns == ["id", "v", "_part", "place"] and numbered(df.limit(0), ["id"]).count() == 0
