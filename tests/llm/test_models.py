"""Classifiers, language identification, mixing, packing and the pipeline: held-out accuracy, round trips, edge cases."""

import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_pairs import brute_near

from latticework.llm import language_id, mixing, packing, quality, queries, toxicity
from latticework.llm.common import ranked, remainder, table

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n", "en", None, 2), (4, "12 34 !!", "fr", "s", 8), (5, "Straße " * 30000, "de", "t", 1), (5, "Straße " * 30000, "de", "t", 1), (None, "some text", None, "s", 9)]


def held_accuracy(out, truth, label, value):
    both = out.where("held_out").join(truth.select("doc_id", label), "doc_id").where(F.col(label).isNotNull())
    return both.agg(F.avg((F.col(value) == F.col(label)).cast("double"))).first()[0]


def test_held_out(spark):
    docs = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long")
    for m in (3, 4):
        got = {r["doc_id"]: r["x"] for r in docs.select("doc_id", remainder("doc_id", m).alias("x")).collect()}
        assert got == {i: zlib.crc32(str(i).encode()) % m for i in range(50)} | {None: None}


def test_quality_held_out(spark):
    out = queries.op8_quality(spark, SF)
    assert held_accuracy(out, table(spark, SF, "labels"), "quality", "predicted") >= 0.97
    assert out.where("score NOT BETWEEN 0 AND 1 OR score IS NULL").count() == 0


def test_toxicity_held_out(spark):
    """Recall and precision, not accuracy, as few documents are toxic; evidence for every text with a letter."""
    out, large = queries.op5_toxicity(spark, "/root/testdata/sf0.1"), "/root/testdata/sf0.1"
    both = out.where("held_out").join(table(spark, large, "labels").select("doc_id", "toxic"), "doc_id").collect()
    hit = sum(r["toxic"] == 1 and r["predicted"] == 1 for r in both)
    assert hit >= 0.9 * sum(r["toxic"] == 1 for r in both) and hit >= 0.9 * sum(r["predicted"] == 1 for r in both)
    assert all(0 <= r["score"] <= 1 for r in both)
    small = queries.op5_toxicity(spark, SF)
    assert small.where("score NOT BETWEEN 0 AND 1 OR score IS NULL").count() == 0
    assert small.where("size(evidence_ids) = 0").join(table(spark, SF, "documents").where(F.col("text").rlike("\\p{L}")), "doc_id").count() == 0


def test_languages_held_out(spark):
    out = queries.op10_language_id(spark, SF)
    assert held_accuracy(out, table(spark, SF, "documents"), "lang", "lang_pred") >= 0.97


def test_models_on_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOC)
    labels = spark.createDataFrame([(2, 0, 0), (4, 1, 1), (5, 1, 0), (None, 1, 1), (9, None, 7)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        for fn in (quality.quality_scores, toxicity.toxicity_scores):
            rows = fn(docs, lab).collect()
            assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
            assert fn(docs.limit(0), lab).count() == 0
    got = {r["doc_id"]: r for r in language_id.languages(docs).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["und"] * 4 and got[1]["score"] == 0
    assert language_id.languages(docs.limit(0)).count() == 0
    clash = docs.withColumn("lang_pred", F.lit(1)).withColumn("toxic_score", F.lit("x")).withColumn("quality_score", F.lit("x"))
    for out, name in (
        (toxicity.score(clash, toxicity.fit(docs, labels)), "toxic_score"),
        (quality.score(clash, quality.fit(docs, labels)), "quality_score"),
        (language_id.identify(clash, language_id.fit(docs)), "lang_pred"),
    ):
        assert out.columns.count(name) == 1 and out.count() == len(ODD)
        twice = out.where("doc_id = 5").select(name).collect()
        assert twice[0] == twice[1]


def counted(rows, beginnings=True):
    """Terms of texts by a plain loop: words and the beginnings of longer words."""
    import re

    out = []
    for t in rows:
        c = Counter()
        for w in re.findall(r"[^\W\d_]+", (t or "").lower()):
            c[w] += 1
            for n in toxicity.BEGINNINGS:
                if len(w) > n:
                    c["^" + w[:n]] += 1
        out.append(c)
    return out


def test_toxicity_against_brute_force(spark):
    """Cosines, evidence and votes of whole texts against a plain loop over all examples."""
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("mora", "lito", "pen", "sudiro", "kal") for b in ("", "n", "ndo", "stera", "x", "qui")]
    text = lambda bad: " ".join([rng.choice(words) for _ in range(rng.randrange(3, 40))] + ["vilebad"] * bad)
    labelled = [(i, text(i % 4 == 0 and rng.random() < 0.9), int(i % 4 == 0)) for i in range(240)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in labelled], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in labelled], "doc_id long, toxic int"))
    train = {i: (t, y) for i, t, y in labelled if zlib.crc32(str(i).encode()) % 4 != 2}
    assert set(model.ids.tolist()) <= set(train) and len(model.ids) > 0.9 * len(train)
    own = counted([train[i][0] for i in model.ids.tolist()])
    labels = [train[i][1] for i in model.ids.tolist()]
    n, d = Counter(labels), {y: Counter(t for c, z in zip(own, labels, strict=True) if z == y for t in c) for y in (0, 1)}

    def gain(t):
        if not d[0][t] + d[1][t]:
            return 0.0
        p0, p1, both = (d[0][t] + 0.5) / (n[0] + 1), (d[1][t] + 0.5) / (n[1] + 1), (d[0][t] + d[1][t] + 1) / (n[0] + n[1] + 2)
        z2 = (p1 - p0) ** 2 / (both * (1 - both) * (1 / n[0] + 1 / n[1]))
        return (np.log((1 + n[0] + n[1]) / (1 + d[0][t] + d[1][t])) + 1) * max(z2 / (z2 + toxicity.HALF), toxicity.LEAST)

    def unit(c):
        v = {t: (1 + np.log(k)) * gain(t) for t, k in c.items() if gain(t)}
        norm = sum(x * x for x in v.values()) ** 0.5
        return {t: x / norm for t, x in v.items()}

    vectors = [unit(c) for c in own]
    asked = [t for _, t, _ in labelled[:60]] + ["", None, "zzz 12 !!", "VILEBAD vilebad"]
    found = dict(zip(asked, zip(*model.score(pa.array(asked)), strict=True), strict=True))
    for t, c in zip(asked, counted(asked), strict=True):
        q = unit(c)
        sims = sorted(((round(sum(x * v.get(w, 0) for w, x in q.items()), 9), -j) for j, v in enumerate(vectors)), reverse=True)
        near = [(x, -j) for x, j in sims if x > 0][: toxicity.NEIGHBOURS]
        score, ids, cosines = found[t]
        assert np.allclose(cosines, [x for x, _ in near[: toxicity.EVIDENCE]], atol=1e-8)
        if not near:
            assert score == model.base and not ids
            continue
        weight = [1 / (1.05 - min(x, 1.0)) for x, _ in near]
        vote = sum(w * labels[j] for w, (_, j) in zip(weight, near, strict=True)) / sum(weight)
        xs, ys = zip(*model.steps, strict=True)
        assert abs(score - np.clip(np.interp(vote, xs, ys), 0, 1)) < 1e-6
    assert found["VILEBAD vilebad"][0] >= toxicity.LEVEL > found[asked[1]][0]


def test_labelled_sample(spark):
    """Numbers count documents that are there; contradicting labels, repeated ids, null ids and odd labels."""
    from latticework.llm.common import labelled_sample

    docs = spark.createDataFrame([(i, f"t{i}") for i in range(40)] + [(1, "again"), (None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(4, 1), (6, None), (8, 7), (None, 1)], "doc_id long, toxic int")
    ok = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    want = {i: 1 if i == 4 else i % 2 for i in ok}
    rows, counts = labelled_sample(docs, labels, "toxic", 100)
    assert {r["_id"]: r["_y"] for r in rows.collect()} == want and counts == Counter(want.values())
    assert {r["_id"]: r["_text"] for r in rows.collect()}.get(1, "again") == "again"
    some, again = labelled_sample(docs, labels, "toxic", 5)
    assert Counter(r["_y"] for r in some.collect()) == {0: 5, 1: 5} and again == counts
    assert labelled_sample(docs.limit(0), labels, "toxic", 5)[0].count() == 0


def test_isotonic():
    steps = toxicity.isotonic([(0.1, 0, 1.0), (0.2, 1, 1.0), (0.3, 0, 1.0), (0.9, 1, 1.0)])
    assert [round(y, 3) for _, y in steps] == [0.0, 0.5, 1.0]


def test_bradley_terry_orders_pairs():
    good, bad = ["The cat sat on the mat and looked at the dog."] * 20, ["BUY!! NOW!! $$$ ### @@@"] * 20
    m = quality.Ranker(quality.features(pa.array(good + bad)), [1] * 20 + [0] * 20, {0: 20, 1: 20})
    s = m.scores(pa.array(["A dog looked at the cat on the mat.", "CHEAP!! $$$ BUY!! ###"]))
    assert s[0] >= quality.LEVEL > s[1]


def test_quality_features_against_plain_loop():
    texts = ["The cat sat. The cat ran!\nThe cat sat. The cat ran!\n\n x|y 12", "a a a", "É é 日本", " \n ", "", None, "word " * 5000]
    x = quality.features(pa.array(texts))
    for t, row in zip(texts, x, strict=True):
        w, raw = (t or "").split(), (t or "").encode()
        if not raw:
            assert not row.any()
            continue
        lines = [y.strip() for y in t.split("\n") if y.strip()]
        assert np.isclose(row[9], sum(a == b for a, b in zip(w, w[1:], strict=False)) / max(1, len(w) - 1), atol=1e-6)
        assert np.isclose(row[10], 1 - len(set(w)) / len(w) if w else 0, atol=1e-6)
        assert np.isclose(row[14], 1 - len(set(zip(w, w[1:], strict=False))) / (len(w) - 1) if len(w) > 1 else 0, atol=1e-6)
        assert np.isclose(row[16], 1 - len(set(lines)) / len(lines) if lines else 0, atol=1e-6)
        assert np.isclose(row[7], sum(b > 127 for b in raw) / len(raw), atol=1e-6)
        assert np.isclose((row[quality.SURFACE : quality.SURFACE + quality.BUCKETS] ** 2).sum(), 1 if w else 0, atol=1e-3)
        assert np.isclose((row[quality.SURFACE + quality.BUCKETS :] ** 2).sum(), max(0, len(raw) - 2) / len(raw), atol=1e-3)
    alone = np.concatenate([quality.features(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(x, alone)


def test_quality_threshold_is_a_quantile():
    """Ties, and the share of label 0 that the level cuts off."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(30)) + ("." if y else "!!!") for y in [1] * 60 + [0] * 20]
    m = quality.Ranker(quality.features(pa.array(texts)), [1] * 60 + [0] * 20, {0: 300, 1: 900})
    s = m.scores(pa.array(texts + texts[:5]))
    assert (s[:80] < quality.LEVEL).sum() == 20 and (s[60:80] < quality.LEVEL).all()
    assert (s[80:] == s[:5]).all()
    z = (quality.features(pa.array(texts)) - m.mean) / m.std @ m.w
    assert (z[:60, None] > z[None, 60:]).mean() == 1  # the preferred one of every pair is ahead


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    m = language_id.Crf(["a", "b", "c"], [frozenset()] * 3)
    m.transition = rng.normal(size=(3, 3))
    sizes = [1, 2, 127, 128, 129, 700]
    e, owner = rng.normal(size=(sum(sizes), 3)) * 2, np.repeat(np.arange(len(sizes)), sizes)
    got = m.posteriors(e, owner)
    for i in range(len(sizes)):
        want, _ = m._rectangular(e[owner == i][None])
        assert np.allclose(got[owner == i], want[0], atol=1e-9)
    small = np.exp(e[1:3])  # chain of two words: by enumeration
    t = np.exp(m.transition)
    joint = small[0][:, None] * t * small[1][None, :]
    assert np.allclose(got[1], joint.sum(1) / joint.sum(), atol=1e-9)


def test_code_switching():
    rng = random.Random(2)
    en, fr = ([pre + "".join(rng.choice(mid) for _ in range(2)) + end for pre in "bdg" for end in ends for _ in range(6)] for mid, ends in (("aeo", ("th", "ing")), ("iuy", ("eux", "ment"))))
    pools = [[[rng.choice(words).encode() for _ in range(80)] for _ in range(12)] for words in (en, fr)]
    m = language_id.Crf(["en", "fr"], [frozenset(), frozenset()])
    m.train(pools)
    text = " ".join([rng.choice(en) for _ in range(20)] + [rng.choice(fr) for _ in range(20)])
    codes, owner, words = language_id.word_codes(pa.array([text]))
    best = m.posteriors(m.emissions(words)[codes], owner).argmax(1)
    assert (best == [0] * 20 + [1] * 20).mean() > 0.9


def brute_targets(sizes, weights, share, cap):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), share * sum(sizes.values())
    while free:
        total = sum(w[s] for s in free)
        full = [s for s in free if left * w[s] / total >= cap * sizes[s]]
        if not full:
            return target | {s: left * w[s] / total for s in free}
        for s in full:
            target[s] = cap * sizes[s]
        free -= set(full)
        left -= sum(target[s] for s in full)
    return target


def check_mix(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    want = brute_targets({s: sum(r["size"] for r in x) for s, x in by.items()}, (3, 1, 2), 1.5, 2.0)
    for s, x in by.items():
        assert all(abs(r["target"] - want[s]) < 1e-6 * max(1, want[s]) for r in x)
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in x)
        assert abs(sum(r["taken"] for r in x) - want[s]) <= max(r["size"] for r in x)


def test_mixing(spark, monkeypatch):
    rows = queries.op6_mix_sources(spark, SF).collect()
    check_mix(rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op6_mix_sources(spark, SF).collect()))
    monkeypatch.setattr(mixing, "CHUNK", 16)  # several rounds of flight
    check_mix(queries.op6_mix_sources(spark, SF).collect())


def test_mixing_odd_rows(spark):
    docs = spark.createDataFrame([(*r, "x") for r in ODD], DOC + ", copies string")
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ODD) and all((r["copies"] <= 2) for r in rows)
    assert len({r["copies"] for r in rows if r["doc_id"] == 5}) == 1
    assert mixing.mix(docs.limit(0)).count() == 0


def test_flight_keeps_totals():
    rng = random.Random(1)
    size, p = [rng.randrange(1, 900) for _ in range(500)], [rng.random() for _ in range(500)]
    q = mixing.flight(size, p, random.Random(2))
    assert sum(0 < x < 1 for x in q) <= 2
    assert abs(sum(q) - sum(p)) < 1e-6 and abs(sum(s * x for s, x in zip(size, q, strict=True)) - sum(s * x for s, x in zip(size, p, strict=True))) < 1e-3


def test_ranked(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "s string")
    assert {r["s"]: r["n"] for r in ranked(df, "s", "n").collect()} == {"a": 0, "b": 1, "c": 2, None: 3}


def full_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_tokenizer_equals_library(spark):
    tok = packing.Tokenizer(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    full = full_tokenizer()
    texts = ["", "a", " a ", "a  b", "a \n b\n\n  c\t\td", "it's we'll  'x", "\n\n", "a\n \nb \n", "  ", "\xa0 b \x1c c", "é ñ 12 3.5!!  ok 日本 語", "<|endoftext|> x", "x" * 5000 + " y"]
    texts += [r["text"] for r in table(spark, SMALL, "documents").limit(60).collect()]
    for t, raw in zip(texts, tok.many(texts), strict=True):
        assert np.frombuffer(raw, "<u2").tolist() == full.encode(t, add_special_tokens=False).ids, t[:40]


def test_hilbert_is_a_curve():
    grid = np.array([[i, j, k] for i in range(8) for j in range(8) for k in range(8)])
    key = packing.hilbert(grid, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


def check_packing(rows, docs):
    """docs: list of (id, text); rows may hold pieces of repeated documents."""
    full = full_tokenizer()
    want = Counter()
    for i, t in docs:
        ids = [*full.encode(t or "", add_special_tokens=False).ids, 0]
        want[i, np.array(ids, "<u4").tobytes()] += 1
    one = {(i): raw for (i, raw) in want}
    covered, sequences = Counter(), defaultdict(list)
    for r in rows:
        part = one[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]
        assert r["length"] > 0 and len(part) == 4 * r["length"] and zlib.crc32(part) == r["ids_crc32"] and r["doc_tokens"] * 4 == len(one[r["doc_id"]])
        covered[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert covered == Counter({i: n * len(raw) // 4 for (i, raw), n in want.items()})
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0


def test_packing(spark):
    docs = table(spark, SMALL, "documents")
    check_packing(queries.op7_pack_hilbert(spark, SMALL).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_packing_odd_rows(spark):
    rows = [r for r in ODD if r[0] is not None]
    df = spark.createDataFrame([(*r, 1) for r in rows], DOC + ", ids int")
    args = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    out = packing.pack(df, *args).withColumnRenamed("id", "doc_id").withColumn("ids_crc32", F.crc32("ids"))
    check_packing(out.collect(), [(r[0], r[1]) for r in rows])
    assert packing.pack(df.limit(0), *args).count() == 0


def brute_stage(name, docs, texts, labels):
    """Ids that a stage keeps, by a plain loop over the texts; None where the stage draws."""
    if name == "quality":
        model = quality.fit(docs, labels)
        return {i for i, t in texts.items() if model.scores(pa.array([t], pa.string()))[0] >= quality.LEVEL}
    if name == "toxicity":
        model = toxicity.fit(docs, labels)
        return {i for i, t in texts.items() if model.score(pa.array([t], pa.string()))[0][0] < toxicity.LEVEL}
    if name == "near_duplicates":
        _, comp = brute_near(texts, 80)
        return {i for i in texts if comp[i] == i}
    return None


def test_pipeline(spark):
    docs, sizes = table(spark, SMALL, "documents"), []
    labels = {r["doc_id"]: r for r in table(spark, SMALL, "labels").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        texts = {r["doc_id"]: r["text"] for r in docs.collect()}
        before = Counter(r["doc_id"] for r in docs.collect())
        want = brute_stage(name, docs, texts, table(spark, SMALL, "labels"))
        docs = stage(spark, docs, SMALL)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = docs.collect()
        docs = spark.createDataFrame(rows, DOC)
        after = Counter(r["doc_id"] for r in rows)
        assert set(after) <= set(before)
        assert want is None or set(after) == want
        sizes.append((name, len(rows)))
        if name == "near_duplicates":
            assert max(after.values()) == 1
        if name == "mixing":
            total = lambda c: sum(n * len((texts[i] or "").split()) for i, n in c.items())
            assert abs(total(after) - 1.5 * total(before)) < 0.05 * total(before)
            assert max(after.values()) <= 2
    kept = {r["doc_id"] for r in docs.collect()}
    assert sum(i in kept for i, r in labels.items() if r["quality"] == 0) <= 0.1 * max(10, len(labels))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    check_packing(packed.collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("n", [0, 1])
def test_pipeline_on_almost_nothing(spark, n):
    docs = spark.createDataFrame(ODD[3 : 3 + n], DOC)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    rows = docs.collect()
    assert len(rows) == n * len(rows) and {r["doc_id"] for r in rows} == ({4} if n else set())
    assert docs.columns[:5] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


#: Names that operators and stages use for columns of their own.
HELPERS = [
    "_key", "_hash", "_blank", "_s", "_i", "_z", "_c", "_r", "_same", "_at", "_rest", "s", "i", "z", "c", "r", "at", "same", "rest", "row", "unit", "rows", "id",
    "size", "source_size", "target", "copies", "quality_score", "quality_kept", "toxic_score", "evidence_ids", "evidence_cosines", "component_id", "kept", "n_shingles", "extra0", "a.b",
]


def test_stages_keep_callers_columns(spark):
    """Every helper's name as a caller's column, and odd rows: each stage returns the caller's rows as they were."""
    docs = spark.createDataFrame(ODD, DOC)
    for k, name in enumerate(HELPERS):
        docs = docs.withColumn(name, F.concat(F.lit(f"{k}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    given = Counter(map(tuple, docs.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        got = Counter(map(tuple, out.collect()))
        assert got and set(got) <= set(given), name
        if name == "near_duplicates":
            assert set(got) == set(given) and max(got.values()) == 1
        if name == "mixing":
            assert {r[0] for r in got} >= {4, 5, None}
        assert stage(spark, docs.limit(0), SMALL).count() == 0
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()} == {r[0] for r in ODD}


def test_mix_keeps_callers_columns(spark):
    docs = spark.createDataFrame(ODD, DOC)
    for name in HELPERS:
        docs = docs.withColumn(name, F.lit(name))
    out = mixing.mix(docs)
    new = ["size", "source_size", "target", "copies"]
    assert out.columns == [c for c in docs.columns if c not in new] + new
    rows = out.collect()
    assert len(rows) == len(ODD) and all(r[name] == name for r in rows for name in HELPERS if name not in new)


def test_near_duplicate_stage_by_row(spark):
    """Unrelated texts under one id stay, repeated rows and copies without id do not."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(7, one), (7, two), (7, two), (9, one), (None, two), (None, three), (None, three), (8, three + " x"), (5, " "), (5, " "), (6, " "), (None, ""), (None, ""), (4, None), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC).repartition(3)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL)
    assert got.columns == docs.columns
    want = [(7, one), (7, two), (8, three + " x"), (5, " "), (6, " "), (None, ""), (4, None)]
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter(want)
