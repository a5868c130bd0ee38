"""Quality scores by Bradley-Terry pairwise ranking of documents."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.percentiles import exact_percentiles
from .common import give_back, materialize, release, remainder, slices, small_batches

#: Decision level of the score.
LEVEL = 0.7
#: Surface statistics of a text; buckets of its hashed words and of its hashed byte trigrams, and their scale.
SURFACE, BUCKETS, SCALE = 20, 256, 0.25
WIDTH = SURFACE + 2 * BUCKETS

#: Labelled documents to a group, and examples of the rarer class that a group has at least, about.
GROUP, RARE = 1024, 32

_SYMBOLS = b"!$%&*#|@<>{}[]=+~^_\\/"


def _distinct(owner: np.ndarray, code: np.ndarray, rows: int) -> np.ndarray:
    """Number of distinct codes of every row."""
    if not len(owner):
        return np.zeros(rows)
    most = int(code.max()) + 1
    return np.bincount(np.unique(owner * most + code) // most, minlength=rows).astype(float)


def _split(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.values


def features(texts: pa.Array) -> np.ndarray:
    """Surface statistics of whole texts, all of them bounded, and shares of hashed words and byte trigrams.

    Zeros for an empty or null text. Whole batches are counted at once; no row is looked at by itself.
    """
    texts, n = pc.fill_null(texts.cast(pa.large_string()), ""), len(texts)
    out = np.zeros((n, WIDTH), np.float32)
    size = pc.binary_length(texts).to_numpy().astype(np.int64)
    if not size.sum():
        return out
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.int64)
    of = np.repeat(np.arange(n), size)
    c = np.bincount(of * 256 + raw, minlength=n * 256).reshape(n, 256)
    length = np.maximum(size, 1)
    out[:, 0] = c[:, 65:91].sum(1) / (c[:, 65:91].sum(1) + c[:, 97:123].sum(1) + 1)
    out[:, 1] = np.sqrt(c[:, list(_SYMBOLS)].sum(1) / length)
    for at, some in ((2, c[:, 33]), (3, c[:, 124]), (4, c[:, 46] + c[:, 44]), (5, c[:, 48:58].sum(1)), (6, c[:, 10])):
        out[:, at] = np.sqrt(some / length)
    out[:, 7], out[:, 8] = c[:, 128:].sum(1) / length, c[:, :32].sum(1) / length
    owner, words = _split(pc.utf8_split_whitespace(texts))
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    owner, coded = owner[full], words.filter(pa.array(full)).dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64) if len(coded) else np.empty(0, np.int64)
    m = np.bincount(owner, minlength=n).astype(float)
    some, many = np.maximum(m, 1), np.maximum(m - 1, 1)
    distinct = _distinct(owner, code, n)
    inside = owner[1:] == owner[:-1]
    again = np.bincount(owner[1:][inside & (code[1:] == code[:-1])], minlength=n)
    pairs = _distinct(owner[1:][inside], (code[:-1] * max(1, len(coded.dictionary)) + code[1:])[inside], n) if len(code) < 1 << 20 else _pairs(owner, code, inside, n)
    has = m > 0
    out[:, 9] = again / many
    out[:, 10] = np.where(has, 1 - distinct / some, 0)
    out[:, 11] = np.minimum(2.0, np.log(some) / 6)
    out[:, 12] = np.where(has, np.minimum(3.0, size / some / 8), 0)
    out[:, 13] = np.where(has, 1 - np.log1p(distinct) / np.log1p(some), 0)
    out[:, 14] = np.where(m > 1, 1 - pairs / many, 0)
    out[:, 15] = has & (m < 20)
    of_line, lines = _split(pc.split_pattern(texts, "\n"))
    lines = pc.utf8_trim_whitespace(lines)
    full = pc.greater(pc.binary_length(lines), 0).to_numpy(zero_copy_only=False)
    of_line, lines = of_line[full], lines.filter(pa.array(full))
    rows = np.bincount(of_line, minlength=n).astype(float)
    ended = pc.match_substring_regex(lines, "[.!?\"']$").to_numpy(zero_copy_only=False)
    line = lines.dictionary_encode().indices.to_numpy().astype(np.int64) if len(lines) else np.empty(0, np.int64)
    out[:, 16] = np.where(rows > 0, 1 - _distinct(of_line, line, n) / np.maximum(rows, 1), 0)
    out[:, 17] = np.where(rows > 0, np.minimum(2.0, np.log1p(m / np.maximum(rows, 1)) / 4), 0)
    out[:, 18] = np.bincount(of_line[ended.astype(bool)], minlength=n) / np.maximum(rows, 1)
    out[:, 19] = np.maximum(0.0, out[:, 10] - 0.6)
    spelled = np.fromiter((xxhash.xxh3_64_intdigest(w.lower()) % BUCKETS for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    if len(code):
        out[:, SURFACE : SURFACE + BUCKETS] = np.sqrt(np.bincount(owner * BUCKETS + spelled[code], minlength=n * BUCKETS).reshape(n, BUCKETS) / some[:, None])
    if len(raw) > 2:
        three = ((raw[:-2] * 961 + raw[1:-1] * 31 + raw[2:]) * 0x9E3779B1 >> 11) % BUCKETS
        within = of[2:] == of[:-2]
        out[:, SURFACE + BUCKETS :] = np.sqrt(np.bincount(of[2:][within] * BUCKETS + three[within], minlength=n * BUCKETS).reshape(n, BUCKETS) / length[:, None])
    out[size == 0] = 0
    return out


def _pairs(owner: np.ndarray, code: np.ndarray, inside: np.ndarray, rows: int) -> np.ndarray:
    """Distinct neighbouring words of every row, where numbers of pairs would not fit beside the row."""
    _, both = np.unique(np.stack([code[:-1], code[1:]], 1)[inside], axis=0, return_inverse=True)
    return _distinct(owner[1:][inside], both.ravel().astype(np.int64), rows)


class Ranker:
    """Bradley-Terry scores: P(a preferred to b) = sigmoid(w . (x(a) - x(b)))."""

    def __init__(self, x: np.ndarray, labels: list[int], counts: dict[int, int], opponents: int = 8, ridge: float = 1e-3, steps: int = 300):
        """Learn from preference pairs: every example of the larger class meets `opponents` of the other.

        The decision threshold is the quantile of the learned scores at the share of label 0 among the labelled
        training documents (counts), read from the score distribution with each class weighted as often as it occurs.
        """
        x, y = np.asarray(x, float).reshape(len(labels), WIDTH), np.array(labels, int)
        self.mean, self.std = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(WIDTH), np.ones(WIDTH))
        self.std[:SURFACE] -= 1e-3 - 1e-6
        self.std[SURFACE:] /= SCALE
        self.w, self.cut, self.gain = np.zeros(WIDTH), 0.0, 1.0
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(good) or not len(bad):
            # one class only: every text gets that class's side of the level
            self.cut = -2.0 if len(good) or not len(bad) else 2.0
            return
        z = (x - self.mean) / self.std
        m = max(len(good), len(bad))
        pairs = [(good[(i + 131 * j) % len(good)], bad[(i * 7 + j) % len(bad)]) for i in range(m) for j in range(opponents)]
        a, b = np.array(pairs).T
        # accelerated gradient descent; the loss is smooth with this constant at most
        bound = 0.25 * float(((z[a[:: max(1, len(a) // 2000)]] - z[b[:: max(1, len(a) // 2000)]]) ** 2).sum(1).mean()) + ridge
        v, momentum = self.w.copy(), 1.0
        for _ in range(steps):
            s = z @ v
            miss = 1 / (1 + np.exp(np.clip(s[a] - s[b], -30, 30))) / len(a)
            grad = z.T @ (np.bincount(a, miss, len(z)) - np.bincount(b, miss, len(z))) - ridge * v
            new, after = v + grad / bound, (1 + math.sqrt(1 + 4 * momentum**2)) / 2
            v, self.w, momentum = new + (momentum - 1) / after * (new - self.w), new, after
        s = z @ self.w
        share = counts[0] / (counts[0] + counts[1])
        weight = np.where(y == 0, share / len(bad), (1 - share) / len(good))
        order = np.argsort(s, kind="stable")
        at = int(np.searchsorted(np.cumsum(weight[order]), share))
        low, high = s[order[max(0, min(at, len(s) - 1))]], s[order[min(at + 1, len(s) - 1)]]
        self.cut = float((low + high) / 2)
        self.gain = 2.0 / max(1e-6, float(s[good].std() + s[bad].std()))

    @classmethod
    def of(cls, mean: np.ndarray, std: np.ndarray, w: np.ndarray, cut: float, gain: float) -> Ranker:
        """A ranker learned elsewhere (see fit)."""
        r = cls.__new__(cls)
        r.mean, r.std, r.w, r.cut, r.gain = mean, std, w, cut, gain
        return r

    def scores(self, texts: pa.Array) -> np.ndarray:
        """0 to 1; LEVEL exactly at the quantile threshold."""
        s = ((features(texts) - self.mean) / self.std) @ self.w
        return 1 / (1 + np.exp(-np.clip((s - self.cut) * self.gain + math.log(LEVEL / (1 - LEVEL)), -30, 30)))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in slices(b, 1, 512, 1 << 21):
            x = features(part.column(1))
            offsets = pa.array(np.arange(0, (len(x) + 1) * WIDTH, WIDTH, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["_id", "_h", "x"])


def _grouped(docs: pa.Table, labels: pa.Table) -> pa.Table:
    """One row with the examples of a group, by id: labels and descriptions."""
    d = docs.select(["_id", "_h", "x"]).combine_chunks()
    ids, known = d["_id"].to_numpy(), labels["_id"].to_numpy()
    order = np.lexsort((d["_h"].to_numpy(), ids))
    order = order[np.concatenate(([True], ids[order][1:] != ids[order][:-1]))] if len(order) else order
    order = order[np.isin(ids[order], known)]
    by = np.argsort(known)
    y = labels["_y"].to_numpy()[by][np.searchsorted(known[by], ids[order])].astype(np.int32)
    g = docs["g"][0].as_py() if docs.num_rows else labels["g"][0].as_py()
    return pa.table({"g": pa.array([g], pa.int64()), "y": pa.array([y], pa.list_(pa.int32())), "x": pa.array([d["x"].take(pa.array(order)).combine_chunks().flatten().to_numpy()], pa.list_(pa.float32()))})


def _matches(y: np.ndarray, opponents: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Preference pairs of a group: every example of the larger class meets `opponents` of the other, all of which take part."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i, j = (v.ravel() for v in np.meshgrid(np.arange(max(len(good), len(bad))), np.arange(opponents), indexing="ij"))
    return good[(i + 131 * j) % len(good)], bad[(i * 7 + j) % len(bad)]


def _each(groups: DataFrame, what: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of what(x, y) over the groups, always in the same order; the driver gets one short vector a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                y = b.column(1).slice(i, 1).flatten().to_numpy()
                got = what(b.column(2).slice(i, 1).flatten().to_numpy().reshape(len(y), WIDTH).astype(float), y)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([got], pa.list_(pa.float64()))], ["g", "v"])

    with small_batches(groups.sparkSession):
        rows = groups.mapInArrow(run, "g long, v array<double>").toArrow().combine_chunks()
    at = np.argsort(rows["g"].to_numpy())
    return rows["v"].combine_chunks().flatten().to_numpy().reshape(len(at), -1)[at].sum(0)


def _pull(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient of the logistic loss over a group's pairs, then the loss and the number of pairs."""
    a, b = _matches(y)
    s = z @ w
    gap = np.clip(s[a] - s[b], -30, 30)
    miss = 1 / (1 + np.exp(gap))
    return np.append(z.T @ (np.bincount(b, miss, len(z)) - np.bincount(a, miss, len(z))), [np.log1p(np.exp(-gap)).sum(), len(a)])


def _curvature(z: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float) -> np.ndarray:
    a, b = _matches(y)
    if not len(a):
        return np.eye(WIDTH)
    d = z[a] - z[b]
    p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
    return (d * (p * (1 - p))[:, None]).T @ d / len(a) + ridge * np.eye(WIDTH)


def _descend(value: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, curvature: np.ndarray, passes: int) -> np.ndarray:
    """L-BFGS from w; an approximate curvature only sets the first direction, so the minimum is that of `value`."""
    (f, g), past = value(w), []
    for _ in range(passes):
        q, parts = g.copy(), []
        for s, t in reversed(past):
            parts.append(s @ q / (s @ t))
            q -= parts[-1] * t
        q = np.linalg.solve(curvature, q)
        for (s, t), part in zip(past, reversed(parts), strict=True):
            q += (part - t @ q / (s @ t)) * s
        if g @ q < 1e-6 * max(f, 1e-6):
            break
        step = 1.0
        while step > 1e-3:
            new = w - step * q
            f_new, g_new = value(new)
            if f_new <= f - 1e-4 * step * (g @ q):
                break
            step /= 3
        else:
            break
        if (new - w) @ (g_new - g) > 0:
            past = [*past[-9:], (new - w, g_new - g)]
        w, f, g = new, f_new, g_new
    return w


def fit(docs: DataFrame, labels: DataFrame, ridge: float = 1e-3, passes: int = 16) -> Ranker:
    """Fit on all labelled training documents: documents with a label whose crc32(id) mod 4 is not 2.

    Texts are described on the executors and dealt to groups of about GROUP by a hash of the id, larger ones where the
    rarer class would have under RARE examples in one. Pairs are made inside a group; every example is in some. Means, deviations, the
    gradient of each pass and the threshold come from all groups; the start and the first curvature come from one group and
    change only the number of passes. An id with contradicting labels has the larger one; rows that repeat an id count as one, the
    first by a hash of the text. Null ids and labels other than 0 and 1 are left out.
    """
    lab = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_y"))
        .where(F.col("_y").isin(0, 1) & (remainder("_id", 4) != 2)).groupBy("_id").agg(F.max("_y").alias("_y"))
    )
    own = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text")).where(remainder("_id", 4) != 2)
    known = materialize(own.select("_id").distinct().join(lab, "_id"))
    counts = {0: 0, 1: 0} | {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    n = counts[0] + counts[1]
    if not counts[0] or not counts[1]:
        return Ranker(np.zeros((min(n, 1), WIDTH)), [int(counts[1] > 0)] * min(n, 1), counts)
    many = max(1, min(math.ceil(n / GROUP), min(counts.values()) // RARE))
    group = F.pmod(F.xxhash64("_id"), F.lit(many)).alias("g")
    described = own.withColumn("_h", F.xxhash64("_text")).mapInArrow(_described, "_id long, _h long, x array<float>").select(group, "*")
    groups = materialize(described.groupBy("g").cogroup(known.select(group, "*").groupBy("g")).applyInArrow(_grouped, "g long, y array<int>, x array<float>"), 4)
    total = _each(groups, lambda x, y: np.concatenate([x.sum(0), (x * x).sum(0)])) / n
    mean = total[:WIDTH]
    std = np.sqrt(np.maximum(0, total[WIDTH:] - mean**2)) + 1e-3
    std[:SURFACE] -= 1e-3 - 1e-6
    std[SURFACE:] /= SCALE

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        got = _each(groups, lambda x, y: _pull((x - mean) / std, y, w))
        return got[-2] / got[-1] + ridge / 2 * w @ w, got[:-2] / got[-1] + ridge * w

    one = groups.where("g = 0").select("y", "x").toArrow().combine_chunks()
    y0 = one["y"].combine_chunks().flatten().to_numpy()[:GROUP]
    z0 = (one["x"].combine_chunks().flatten().to_numpy()[: len(y0) * WIDTH].reshape(len(y0), WIDTH) - mean) / std

    def start(w: np.ndarray) -> tuple[float, np.ndarray]:
        got = _pull(z0, y0, w)
        return got[-2] / max(1, got[-1]) + ridge / 2 * w @ w, got[:-2] / max(1, got[-1]) + ridge * w

    w = np.zeros(WIDTH)
    for _ in range(4):
        w = _descend(start, w, _curvature(z0, y0, w, ridge), 4)
    w = _descend(value, w, _curvature(z0, y0, w, ridge), passes)

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                y = b.column(1).slice(i, 1).flatten()
                x = b.column(2).slice(i, 1).flatten().to_numpy().reshape(len(y), WIDTH)
                yield pa.RecordBatch.from_arrays([y, pa.array((x - mean) / std @ w)], ["y", "s"])

    with small_batches(docs.sparkSession):
        scores = materialize(groups.mapInArrow(ranks, "y int, s double"))
    release(groups, known)
    # in the middle between the ranks that label 0 ends and label 1 begins with
    cut = exact_percentiles(scores, "s", [(counts[0] - 0.5) / (n - 1)]).first()["percentiles"][0]
    spread = scores.groupBy("y").agg(F.stddev_pop("s").alias("d")).agg(F.sum("d")).first()[0]
    release(scores)
    give_back()
    return Ranker.of(mean, std, w, float(cut), 2.0 / max(1e-6, round(spread, 9)))


def score(docs: DataFrame, model: Ranker, text_col: str = "text") -> DataFrame:
    """docs with quality_score (double) and quality_kept (score >= LEVEL) appended.

    Null and empty texts are scored like a text without any feature. Equal texts get equal scores; a clashing column of
    either name is replaced. No row moves between partitions; long texts are taken in slices of bounded bytes.
    """
    rest = docs.drop("quality_score", "quality_kept")
    at, names = rest.columns.index(text_col), [*rest.columns, "quality_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, at, 1024, 1 << 21):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.scores(part.column(at)))], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    return rest.mapInArrow(run, f"{schema}, quality_score double").withColumn("quality_kept", F.col("quality_score") >= LEVEL)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document (null ids: held_out null)."""
    model = fit(docs, labels)
    out = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_kept").cast("int").alias("predicted"))
