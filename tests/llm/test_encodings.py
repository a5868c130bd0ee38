"""Fill-in-middle, byte-level BPE and whitening against brute force, on whole tables and on odd rows."""

import base64
import copy
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import compare, connect
from pyspark.sql import functions as F

from latticework.llm import byte_bpe, fill_middle, queries, whitening
from latticework.llm.common import table

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WIDE = "aé漢😀 \n"


# --- fill-in-middle ---------------------------------------------------------------------------------------------


def moved(key, text, units, seed=1):
    """The transformation by plain Python on a list of units: (n, form, prefix, middle, output)."""
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    pre, mid, suf = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def words(text):
    out = []
    for c in text:
        space = c in " \t\n\v\f\r"
        if out and (out[-1][-1] in " \t\n\v\f\r") == space:
            out[-1] += c
        else:
            out.append(c)
    return out


def odd_texts():
    rng = random.Random(3)
    texts = [None, "", "a", "é", "<P>", "x<M>y", "<", "ab<S", "S>", "漢字😀" * 9, WIDE * 40000, "é" * 7, "\u0000�"]
    texts += ["".join(rng.choice(WIDE + "<PSM>") for _ in range(rng.randrange(60))) for _ in range(300)]
    return [(None if i == 5 else i // 2, t) for i, t in enumerate(texts)] + [(7, "same text"), (7, "same text")]


@pytest.mark.parametrize("unit", fill_middle.UNITS)
def test_fill_in_middle(spark, unit):
    rows = odd_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = fill_middle.fill_in_middle(docs, unit=unit).withColumn("back", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    got = sorted((repr(r["doc_id"]), r["n"], r["form"], r["prefix_units"], r["middle_units"], r["output"]) for r in out)
    want = sorted((repr(i), *moved(i, t or "", list(t or "") if unit == "codepoint" else words(t or ""))) for i, t in rows)
    assert [tuple(map(str, g)) for g in got] == [tuple(map(str, w)) for w in want]
    assert {r["form"] for r in out} == {"plain", "spm", "psm"}
    assert all(r["back"] == (r["text"] or "") for r in out)


def test_fill_in_middle_empty_and_clashes(spark):
    docs = spark.createDataFrame([(1, "abc", "own", 5, 6)], "doc_id long, text string, row string, id int, form int")
    out = fill_middle.fill_in_middle(docs.withColumn("cut", F.lit(9)).withColumn("a.b", F.lit(8)))
    r = out.first()
    assert (r["row"], r["id"], r["cut"], r["a.b"], r["text"]) == ("own", 5, 9, 8, "abc") and r["form"] == moved(1, "abc", list("abc"))[1]
    assert out.columns.count("form") == 1
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(docs, unit="letter")


def plain_runs(texts, unit):
    """(units before, bytes before, width) of each run by a loop over characters."""
    out, units, at = [], 0, 0
    for t in texts:
        last = None
        for u in list(t) if unit == "codepoint" else words(t):
            size = len(u.encode())
            if unit == "word" or size != last:
                out.append((units, at, size))
            last, units, at = size, units + 1, at + size
    return out


@pytest.mark.parametrize("unit", fill_middle.UNITS)
@pytest.mark.parametrize("block", [1, 3, 7, 1 << 20])
def test_runs(monkeypatch, unit, block):
    """Runs are maximal and end with their text, wherever blocks end; every unit is located."""
    monkeypatch.setattr(fill_middle, "BLOCK", block)
    rng = random.Random(block)
    texts = ["", "aaa", "aab", "éé", "", *("".join(rng.choice(WIDE) * rng.randrange(4) for _ in range(12)) for _ in range(20)), ""]
    raw = [t.encode() for t in texts]
    runs = fill_middle.encode_runs(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), unit)
    assert list(zip(runs.unit.tolist(), runs.byte.tolist(), runs.width.tolist(), strict=True)) == plain_runs(texts, unit)
    each = [u for t in texts for u in (list(t) if unit == "codepoint" else words(t))]
    assert runs.texts[-1] == len(each)
    assert runs.locate(np.arange(len(each))).tolist() == np.cumsum([0, *(len(u.encode()) for u in each)])[:-1].tolist()


def test_fill_in_middle_query(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        problem, n = compare(queries.op11_fill_middle(spark, sf), connect(sf), queries.oracle_sql()["op11_fill_middle"])
        assert not problem and n


# --- byte-level BPE ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary.from_file(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash():
    """n keys fill n slots; every key is found; strings that are no key are not, prefixes and extensions among them."""
    rng = random.Random(4)
    for n in (1, 2, 3, 50, 5000):
        keys = list({bytes(rng.randrange(256) for _ in range(rng.randrange(1, 9))) for _ in range(n)})
        table_ = byte_bpe.PerfectHash(keys, np.arange(len(keys)) * 3)
        assert sorted(table_._order.tolist()) == list(range(len(keys)))
        others = [k + b"\0" for k in keys] + [k[:-1] for k in keys] + [bytes(rng.randrange(256) for _ in range(40))]
        known, asked = {k: 3 * i for i, k in enumerate(keys)}, keys + others
        data, size = np.frombuffer(b"".join(asked), np.uint8), np.array([len(k) for k in asked])
        assert table_.find(data, np.cumsum(size) - size, size).tolist() == [known.get(k, -1) for k in asked]
    assert byte_bpe.PerfectHash([], np.zeros(0, int)).find(np.zeros(1, np.uint8), np.array([0]), np.array([1])).tolist() == [-1]
    with pytest.raises(ValueError):
        byte_bpe.PerfectHash([b"a", b"a"], np.arange(2))


def test_vocabulary_resolves_every_entry(vocabulary, library):
    keys = library.token_byte_values()
    size = np.array([len(k) for k in keys])
    found = vocabulary._hash.find(np.frombuffer(b"".join(keys), np.uint8), np.cumsum(size) - size, size)
    assert found.tolist() == [library.encode_single_token(k) for k in keys]
    with pytest.raises(ValueError):
        byte_bpe.Vocabulary({b"a": 0}, "a")


def slow_merge(piece, ranks):
    """The lowest-ranked neighbours first, the leftmost of equal ones, by scanning all parts each time."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merges():
    rng = random.Random(5)
    for _ in range(300):
        ranks = {bytes([c]): i for i, c in enumerate(b"abc")}
        for _ in range(rng.randrange(12)):
            a, b = rng.sample(list(ranks), 2) if rng.random() < 0.7 else [rng.choice(list(ranks))] * 2
            ranks.setdefault(a + b, len(ranks))
        piece = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 30)))
        assert list(byte_bpe.merged(piece, ranks, byte_bpe.short_ranks(ranks))) == slow_merge(piece, ranks)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(), st.text(alphabet="ab' t\n é漢1<|>x")), max_size=6))
def test_bpe_on_any_text(vocabulary, library, texts):
    got = vocabulary.encode(pa.array(texts, pa.string()))
    assert got.to_pylist() == [library.encode_ordinary(t or "") for t in texts]
    whole = copy.copy(vocabulary)
    whole.space_led = False
    assert whole.encode(pa.array(texts, pa.string())) == got
    assert vocabulary.decode(got).to_pylist() == [(t or "").encode() for t in texts]


def test_bpe_on_every_code_point(vocabulary, library):
    """Each code point beside letters, digits, spaces and itself: classes of the pattern agree on all of them, those
    that a newer version of Unicode calls letters among them."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b1{c}2 {c} ,{c}" for c in points[i : i + 20000]) for i in range(0, len(points), 20000)]
    assert vocabulary.encode(pa.array(texts)).to_pylist() == [library.encode_ordinary(t) for t in texts]


def test_bpe_pieces_in_parts(monkeypatch, vocabulary, library):
    """Long texts are matched in parts, and pre-tokens of any length are merged whole."""
    monkeypatch.setattr(byte_bpe, "PIECES", 5)
    monkeypatch.setattr(byte_bpe, "DECODED", 7)
    monkeypatch.setattr(vocabulary, "space_led", False)
    texts = ["one two  three\n\nfour five six seven eight", "", None, "x y", "ab" * 50000, "漢字" * 3000, " " * 3000 + "z"]
    got = vocabulary.encode(pa.array(texts))
    assert got.to_pylist() == [library.encode_ordinary(t or "") for t in texts]
    assert vocabulary.decode(got).to_pylist() == [(t or "").encode() for t in texts]


def test_bpe_query(spark, library):
    want = []
    for r in table(spark, SF, "documents").select("doc_id", "text").collect():
        ids = library.encode_ordinary(r["text"] or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids)).encode()), sha((r["text"] or "").encode())))
    assert sorted(map(tuple, queries.op12_byte_bpe(spark, SF).collect())) == sorted(want)


def test_bpe_on_odd_rows(spark, vocabulary, library):
    rows = [(None, None, "k"), (1, "", "k"), (2, "word " * 9, None), (2, "word " * 9, None), (3, "Straße😀" * 5000, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = byte_bpe.decode(byte_bpe.encode(docs.withColumn("a.b", F.lit(1)), vocabulary), vocabulary)
    assert out.columns == ["doc_id", "text", "ids", "a.b", "decoded"]
    assert sorted((repr(r["doc_id"]), r["ids"], bytes(r["decoded"])) for r in out.collect()) == sorted((repr(i), library.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows)
    assert byte_bpe.encode(docs.limit(0), vocabulary).count() == 0
    nulls = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [bytes(r["decoded"]) for r in byte_bpe.decode(nulls, vocabulary).collect()] == [b"", b""]
    with pytest.raises(ValueError):
        vocabulary.decode(pa.array([[1, 99999999]], pa.list_(pa.int32())))


# --- whitening --------------------------------------------------------------------------------------------------


def brute_whitening(rows, k):
    """Whole vectors, distinct fit list, covariance and eigenvectors by numpy; rows are (id, vector)."""
    kept = {i: [int(np.floor(256 * float(np.float32(c)))) for c in v] for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)}
    x = np.array(sorted(set(map(tuple, kept.values()))), object)
    n, s = len(x), x.sum(0)
    centred = (x - s / n).astype(float)
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return n, {
        i: (sum((n * c - t) ** 2 for c, t in zip(v, s.tolist(), strict=True)), ((np.array(v) - (s / n).astype(float)) @ vectors) / np.sqrt(values)) for i, v in kept.items()
    }, values / np.trace(cov), (values, vectors, cov)


def close_to(out, rows, k):
    n, want, shares, _ = brute_whitening(rows, k)
    got = {}
    for r in out:
        assert r["n"] == n and abs(r["explained"] - shares[r["component"] - 1]) < 1e-9 and r["identity_error"] < 1e-9
        assert r["deviation"] == want[r["vec_id"]][0]
        got.setdefault(r["vec_id"], {})[r["component"]] = r["whitened"]
    assert set(got) == set(want)
    for j in range(k):
        a = np.array([got[i][j + 1] for i in sorted(got)])
        b = np.array([want[i][1][j] for i in sorted(got)])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9


def test_whitening_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, SF, "embeddings").collect()]
    close_to(queries.op13_whitening(spark, SF).collect(), rows, 4)


def planted(rng, n, dims):
    scale = np.geomspace(1, 0.05, dims)
    return [[float(np.float32(c)) for c in v] for v in rng.standard_normal((n, dims)) * scale + 0.3]


def whitened(spark, tmp_path, rows):
    path = str(tmp_path / "sf")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.mode("overwrite").parquet(f"{path}/embeddings.parquet")
    return queries.op13_whitening(spark, path).collect()


def test_whitening_counts_copies_once_and_drops_bad_vectors(spark, tmp_path):
    rng = np.random.default_rng(8)
    vectors = planted(rng, 120, 12)
    vectors += [vectors[0]] * 300 + [None, [None] * 12, [float("nan")] * 12, [float("inf")] + [0.0] * 11]
    rows = [(i, v, None) for i, v in enumerate(vectors)]
    out = whitened(spark, tmp_path, rows)
    assert len(out) == 4 * 420
    close_to(out, [(i, v) for i, v, _ in rows], 4)


def test_whitening_of_low_rank_and_empty(spark, tmp_path):
    rng = np.random.default_rng(9)
    one = [(i, [float(i), 2.0 * i, 0.0, 0.0, 0.0], 0) for i in range(20)]
    out = whitened(spark, tmp_path, one)
    assert {r["component"] for r in out} == {1} and all(abs(r["explained"] - 1) < 1e-9 and r["identity_error"] < 1e-9 for r in out)
    assert whitened(spark, tmp_path, one[:1]) == [] and whitened(spark, tmp_path, one[:1] * 3) == []
    assert whitened(spark, tmp_path, []) == [] and whitened(spark, tmp_path, [(1, None, 0), (2, [], 0)]) == []
    # the commonest length counts, and of equally common ones the larger
    ragged = [(i, planted(rng, 1, 3)[0], 0) for i in range(9)] + [(50 + i, planted(rng, 1, 2)[0], 0) for i in range(9)] + [(99, [1.0], 0)]
    assert {r["vec_id"] for r in whitened(spark, tmp_path, ragged)} == set(range(9))


def test_whitening_keeps_columns_and_null_ids(spark):
    rng = np.random.default_rng(10)
    vectors = planted(rng, 30, 6)
    rows = [(None if i < 2 else i, v, "r", "x", 3) for i, v in enumerate(vectors)] + [(7, vectors[7], "r", "x", 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row string, x string, n int")
    out = whitening.whiten(df, components=2)
    assert sorted(out.columns) == sorted(["vec_id", "embedding", "row", "x", "n", "deviation", "whitened", "explained", "identity_error"])
    got = out.collect()
    assert len(got) == 31 and {(r["row"], r["x"], r["n"]) for r in got} == {("r", "x", 30)}
    twice = [r for r in got if r["vec_id"] == 7]
    assert twice[0] == twice[1]


def test_exact_deviations():
    """Of small and of huge entries and counts, against Python's whole numbers."""
    rng = random.Random(11)
    for size, n in ((300, 9), (300, 10**9), (2**30, 10**6), (2**62, 10**12)):
        x = [[rng.randrange(-size, size) for _ in range(5)] for _ in range(20)]
        sums = [rng.randrange(-size * n, size * n) for _ in range(5)]
        want = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
        assert whitening.deviations(np.array(x, np.int64), n, sums, size) == want


def test_entries_out_of_range(spark):
    df = spark.createDataFrame([([1e300, -1e300, 0.0],), ([-0.001, 0.999, 1.0],)], "v array<double>")
    assert [r["x"] for r in df.select(whitening.whole(F.col("v")).alias("x")).collect()] == [[2**63 - 1, -(2**63), 0], [-1, 255, 256]]


@pytest.mark.parametrize("spectrum", ["gaps", "equal", "few", "clusters"])
def test_block_lanczos(spectrum):
    """Largest eigenpairs of dense matrices: separate, all equal, low rank (break-downs), and clustered ones."""
    rng, dims = np.random.default_rng(12), 300
    values = {"gaps": np.geomspace(1e3, 1e-3, dims), "equal": np.ones(dims), "few": np.r_[[9.0, 5.0, 2.0], np.zeros(dims - 3)], "clusters": np.r_[np.full(3, 7.0), np.full(4, 6.0), np.linspace(1, 0, dims - 7)]}[spectrum]
    q, _ = np.linalg.qr(rng.standard_normal((dims, dims)))
    a = (q * values) @ q.T
    got, vectors, residual, passes = whitening.block_lanczos(lambda b: a @ b, dims, 5)
    assert np.allclose(got, values[:5], rtol=1e-12, atol=1e-11) and residual < 1e-12
    assert np.abs(vectors.T @ vectors - np.eye(5)).max() < 1e-12 and np.abs(a @ vectors - vectors * got).max() < 1e-10 * values[0]
    assert passes < 38
    # with little room the search starts anew from the best directions, and ends in the same place
    again, vectors, residual, _ = whitening.block_lanczos(lambda b: a @ b, dims, 5, blocks=6)
    assert np.allclose(again, values[:5], rtol=1e-10, atol=1e-10) and residual < 1e-10


def test_lanczos_multiplies_few_directions():
    """The operator is only known by its products with narrow blocks."""
    a, widths = np.diag(np.arange(50.0)), []

    def product(b):
        widths.append(b.shape[1])
        return a @ b

    whitening.block_lanczos(product, 50, 3)
    assert max(widths) <= whitening.BLOCK and sum(widths) <= 50
