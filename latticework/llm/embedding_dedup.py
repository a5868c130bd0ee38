"""Near-duplicate embeddings by spherical-cap filters made of random product codes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release
from .graph import connected_components

#: Parts of a product code, independent codes, cells per unit length that directions are rounded to, rows of a
#: compared block.
PARTS, CODES, CELLS, BLOCK = 2, 12, 4096, 1024


#: Random pairs that a plan is measured on; what single precision may change in a dot product of unit vectors.
PAIRS, ROUNDING = 2048, 1e-6


def _space(dims: int) -> int:
    return max(16, -(-dims // PARTS) * PARTS)


def _cap_height(space: int, p: float) -> float:
    """Height of the cap that holds a share p of the unit sphere in `space` dimensions."""
    x = np.linspace(1, -1, 400_001)
    tail = np.cumsum((1 - x * x).clip(0) ** ((space - 3) / 2))
    return float(x[np.searchsorted(tail, p * tail[-1])])


def _words_needed(rng: np.random.Generator, pairs: int, space: int, cosine: float, least: float, pool: int) -> np.ndarray:
    """For random pairs at `cosine`: with how many codewords a part one code of `pool` first gives a common filter (else pool + 1).

    A part of a pair spans a plane, so of a random unit codeword only its two coordinates there are drawn.
    """
    part = space // PARTS
    a, z = rng.standard_normal((2, pairs, space))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z -= (z * a).sum(1, keepdims=True) * a
    b = cosine * a + math.sqrt(1 - cosine * cosine) * z / np.linalg.norm(z, axis=1, keepdims=True)
    dots = []
    for x, y in zip(a.reshape(pairs, PARTS, part).swapaxes(0, 1), b.reshape(pairs, PARTS, part).swapaxes(0, 1), strict=True):
        along = np.linalg.norm(x, axis=1, keepdims=True)
        same = (x * y).sum(1, keepdims=True) / along
        across = np.sqrt(np.maximum((y * y).sum(1, keepdims=True) - same * same, 0))
        g, h = rng.standard_normal((2, pairs, pool))
        norm = np.sqrt(g * g + h * h + rng.chisquare(part - 2, (pairs, pool)))
        dots.append((along * g / norm, (same * g + across * h) / norm))
    (a1, b1), (a2, b2) = dots
    first = (a1 >= least - a2.max(1, keepdims=True)) & (b1 >= least - b2.max(1, keepdims=True))
    last = (a2 >= least - a1.max(1, keepdims=True)) & (b2 >= least - b1.max(1, keepdims=True))
    need = np.full(pairs, pool + 1)
    for k in range(pairs):
        i, j = np.flatnonzero(first[k]), np.flatnonzero(last[k])
        hit = (a1[k, i, None] + a2[k, j] >= least) & (b1[k, i, None] + b2[k, j] >= least)
        if hit.any():
            need[k] = np.maximum(i[:, None], j)[hit].min() + 1
    return need


@lru_cache(maxsize=256)
def plan_filters(n: int, cosine: float, bucket: float = 64.0, miss: float = 1e-5, dims: int = 64) -> tuple[float, int]:
    """(cap height in standard deviations, codewords per part) for n vectors of `dims` components.

    A cap holds about `bucket` of n unrelated vectors, by the tail of the sphere of these dimensions. Rotations and
    codes are random, so a pair at `cosine` fails to meet in one code with the same chance q wherever it lies, and in
    all with q ** CODES. q is measured on PAIRS random pairs with codes of their own, and the codewords are as many
    as bring it, with three standard errors added, down to miss ** (1 / CODES). The number of filters so grows with n
    and a filter's size does not.
    """
    space, p = _space(dims), min(0.4, bucket / max(n, 1))
    height = _cap_height(space, p)
    q = miss ** (1 / CODES)
    lost = int((q - 3 * math.sqrt(q * (1 - q) / PAIRS)) * PAIRS)
    pool = max(16, math.ceil(4 / math.sqrt(p)))
    while True:
        rng, step = np.random.default_rng(53), max(1, min(PAIRS, 250_000 // pool))
        need = np.concatenate([_words_needed(rng, min(step, PAIRS - at), space, cosine, height * math.sqrt(PARTS), pool) for at in range(0, PAIRS, step)])
        words = int(np.sort(need)[PAIRS - lost - 1])
        if words <= pool:
            return height * math.sqrt(space), max(4, words)
        pool *= 2


class Caps:
    """Filters whose directions join one random unit codeword for each part of a rotated space; CODES rotations."""

    def __init__(self, dims: int, height: float, words: int):
        self.space = _space(dims)
        rng = np.random.default_rng(97)
        self.turn = [np.linalg.qr(rng.standard_normal((self.space, self.space)))[0][:dims] for _ in range(CODES)]
        code = rng.standard_normal((CODES, PARTS, words, self.space // PARTS))
        self.code = code / np.linalg.norm(code, axis=3, keepdims=True)
        self.words, self.least = words, height / math.sqrt(self.space) * math.sqrt(PARTS)

    def passed(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) for every filter that a row of unit vectors passes, by list decoding.

        The dot products of the second part are sorted once; each one of the first part takes the run of them
        that lifts the sum over the cap, found by binary search: the work follows the number of filters passed.
        Those of the second part that not even the largest of the first lifts over it are left out of the sorting.
        """
        rows, filters = [], []
        for c in range(CODES):
            turned = (unit @ self.turn[c]).reshape(len(unit), PARTS, -1)
            first, last = (turned[:, j] @ self.code[c, j].T for j in range(PARTS))
            for i in range(len(unit)):
                order = np.flatnonzero(last[i] >= self.least - first[i].max())
                order = order[np.argsort(-last[i][order], kind="stable")]
                counts = np.searchsorted(-last[i][order], first[i] - self.least, side="right")
                hit = np.flatnonzero(counts)
                if len(hit):
                    n = counts[hit]
                    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    filters.append((c * self.words + np.repeat(hit, n)) * self.words + order[inner])
                    rows.append(np.full(len(inner), i))
        return (np.concatenate(rows), np.concatenate(filters)) if rows else (np.empty(0, int), np.empty(0, int))


def _unit(values: list | None) -> np.ndarray | None:
    if not values or any(v is None for v in values):
        return None
    x = np.array(values, float)
    norm = np.linalg.norm(x)
    return x / norm if np.isfinite(norm) and norm > 0 else None


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        units = [_unit(v) for v in b.column(1).to_pylist()]
        keys = [None if u is None else xxhash.xxh3_128_digest(np.rint(u * CELLS).astype(np.int16).tobytes()) for u in units]
        kept = [None if u is None else u.tolist() for u in units]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(kept, pa.list_(pa.float64()))], ["id", "cell", "unit"])


def _filters(plans: dict[int, tuple[float, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caps: dict[int, Caps] = {}
        for b in batches:
            ids, units = b.column(0).to_numpy(), b.column(1).to_pylist()
            for dims in sorted({len(u) for u in units}):
                own = [i for i, u in enumerate(units) if len(u) == dims]
                if dims not in caps:
                    caps[dims] = Caps(dims, *plans[dims])
                for at in range(0, len(own), 512):
                    part = own[at : at + 512]
                    rows, filters = caps[dims].passed(np.array([units[i] for i in part]))
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dims, np.int32)), pa.array(filters.astype(np.int64)), pa.array(ids[np.array(part)[rows]] if n else np.empty(0, np.int64))], ["dims", "cap", "rep"])

    return run


def _met_before(cap: int, left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Which pairs of a left and a right vector share a cap below this one (each has the sorted list of its caps, up to this one at least)."""
    met = np.zeros((len(left), len(right)), bool)
    sides = [[c[: np.searchsorted(c, cap)] for c in side] for side in (left, right)]
    flat = [np.concatenate(side) for side in sides]
    rows = [np.repeat(np.arange(len(side)), [len(c) for c in side]) for side in sides]
    both = np.intersect1d(*flat)
    for at in range(0, len(both), width):
        some, marks = both[at : at + width], []
        for f, r, n in zip(flat, rows, (len(left), len(right)), strict=True):
            place = np.minimum(np.searchsorted(some, f), len(some) - 1)
            ok = some[place] == f
            m = np.zeros((n, len(some)), np.float32)
            m[r[ok], place[ok]] = 1
            marks.append(m)
        met |= marks[0] @ marks[1].T > 0
    return met


def _compare(cosine: float, slack: float):
    """What the runs (dims, cap, lo, hi) of sorted rows tell, each pair of vectors counted at its first common cap.

    kind 0: vector a has n more links; kind 1: a and b are connected, a tree for each group of linked vectors;
    kind 2: the pair (a, b) is too near the threshold to be decided by representatives. A run crossing batches is
    carried over. Rows out are as many as vectors in, but for kind 2: linked pairs themselves are not emitted.
    """

    def tell(cap: int, rep: np.ndarray, size: np.ndarray, caps: list[np.ndarray], side: np.ndarray, x: np.ndarray, lo: int, hi: int) -> list[tuple[np.ndarray, ...]]:
        left, right = (np.arange(len(rep)),) * 2 if lo == hi else (np.flatnonzero(side == lo), np.flatnonzero(side == hi))
        g = x[left] @ x[right].T
        near = g >= cosine - slack
        if lo == hi:
            np.fill_diagonal(near, False)
        # only vectors with a neighbour here go on
        keep_l, keep_r = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        if not len(keep_l):
            return []
        left, right, g, near = left[keep_l], right[keep_r], g[np.ix_(keep_l, keep_r)], near[np.ix_(keep_l, keep_r)]
        near &= ~_met_before(cap, [caps[i] for i in left], [caps[i] for i in right])
        sure, maybe = near & (g >= cosine + slack), near & (g < cosine + slack)
        out = []
        sides = ((left, sure @ size[right]),) if lo == hi else ((left, sure @ size[right]), (right, sure.T @ size[left]))
        for who, n in sides:
            has = n > 0
            out.append((np.zeros(has.sum(), np.int64), rep[who[has]], np.zeros(has.sum(), np.int64), n[has]))
        # smallest representative within each group of linked vectors, by passing labels along links
        label_l, label_r, top = rep[left].copy(), rep[right].copy(), np.iinfo(np.int64).max
        while sure.any():
            new_l = np.minimum(label_l, np.where(sure, label_r, top).min(1))
            new_r = np.minimum(label_r, np.where(sure, new_l[:, None], top).min(0))
            if lo == hi:
                new_l = new_r = np.minimum(new_l, new_r)
            if (new_l == label_l).all() and (new_r == label_r).all():
                break
            label_l, label_r = new_l, new_r
        for who, label in (((left, label_l),) if lo == hi else ((left, label_l), (right, label_r))):
            moved = label != rep[who]
            out.append((np.ones(moved.sum(), np.int64), rep[who[moved]], label[moved], np.zeros(moved.sum(), np.int64)))
        i, j = np.nonzero(maybe)
        a, b = rep[left[i]], rep[right[j]]
        once = a > b if lo == hi else a != b
        out.append((np.full(once.sum(), 2), np.maximum(a, b)[once], np.minimum(a, b)[once], np.zeros(once.sum(), np.int64)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
            key = np.stack([t[c].to_numpy().astype(np.int64) for c in ("dims", "cap", "lo", "hi")], 1)
            cut = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(key)]))
            rep, side, size = (t[c].to_numpy() for c in ("rep", "side", "size"))
            flat, off = {}, {}
            for c in ("unit", "caps"):
                lists = t[c].combine_chunks()
                flat[c], off[c] = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            out = []
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                if e - s > 1:
                    x = flat["unit"][off["unit"][s] : off["unit"][e]].reshape(e - s, -1).astype(float)
                    caps = [flat["caps"][off["caps"][i] : off["caps"][i + 1]] for i in range(s, e)]
                    out += tell(key[s, 1], rep[s:e], size[s:e], caps, side[s:e], x, key[s, 2], key[s, 3])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], ["kind", "a", "b", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            t = pa.Table.from_batches(held)
            last = tuple(t[c][-1].as_py() for c in ("dims", "cap", "lo", "hi"))
            same = np.ones(t.num_rows, bool)
            for c, v in zip(("dims", "cap", "lo", "hi"), last, strict=True):
                same &= t[c].to_numpy() == v
            start = int(np.argmax(same))
            if start:
                yield from flush(t.slice(0, start))
                held = t.slice(start).combine_chunks().to_batches()
        if held:
            yield from flush(pa.Table.from_batches(held))

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """Links at cosine >= `cosine` in double precision: id, n_links, component_id (smallest id reachable), kept.

    1. Vectors whose directions round to the same cell (1/4096 per coordinate) form a class: they are all
       linked, and one of them stands for the class. So copies never meet in pairs.
    2. Every representative is list-decoded to the caps it exceeds. Representatives are joined on caps; a cap
       with many is compared in blocks of about 1024, never all in one task. Each pair counts at its first common
       cap; numbers of links and trees of linked vectors leave the tasks, not the pairs.
    3. Pairs of representatives clearly at or over `cosine` link their classes; those within the rounding of it
       are compared member by member. Links found are exact; the share of links found is that of plan_filters.

    Null, empty, zero vectors, vectors with null or non-finite components and rows without id link with
    nothing. Vectors of different length never link. Repeated rows count as vectors of their own; one id must not
    stand for different vectors.
    """
    vecs = materialize(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(_cells, "id long, cell binary, unit array<double>"))
    valid = vecs.where("cell IS NOT NULL AND id IS NOT NULL")
    classes = materialize(valid.groupBy("cell", F.size("unit").alias("dims")).agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.min_by("unit", "id").alias("unit")))
    counts = {r["dims"]: r["n"] for r in classes.groupBy("dims").agg(F.count("*").alias("n")).collect()}
    slack = 2 * math.sqrt(max(counts, default=1)) / CELLS
    # members at `cosine` may stand behind representatives that are the slack farther apart
    plans = {dims: plan_filters(n, cosine - slack, dims=dims) for dims, n in counts.items()}
    reps = classes.select("rep", "unit")
    caps = materialize(reps.mapInArrow(_filters(plans), "dims int, cap long, rep long"))
    sizes = caps.groupBy("dims", "cap").agg(F.count("*").alias("n")).where("n > 1").select("dims", "cap", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = caps.join(sizes, ["dims", "cap"]).withColumn("side", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    number = "int" if CODES * max((words for _, words in plans.values()), default=0) ** 2 < 2**31 else "long"
    lists = caps.groupBy("rep").agg(F.array_sort(F.collect_list(F.col("cap").cast(number))).alias("caps"))
    known = classes.select("rep", "size", F.col("unit").cast("array<float>").alias("unit")).join(lists, "rep")
    tasks = placed.select("dims", "cap", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "rep").join(known, "rep")
    # a pair looks only for caps below the one it meets in, and single precision moves a dot product by less than ROUNDING
    tasks = tasks.withColumn("caps", F.slice("caps", 1, (F.array_position("caps", F.col("cap").cast(number)) - 1).cast("int")))
    order = ["dims", "cap", "lo", "hi"]
    told = materialize(tasks.repartition(*order).sortWithinPartitions(*order).select(*order, "side", "rep", "size", "unit", "caps").mapInArrow(_compare(cosine, slack + ROUNDING), "kind long, a long, b long, n long"))
    release(caps)
    by_class = told.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    tree = told.where("kind = 1").select("a", "b").distinct()
    maybe = told.where("kind = 2").select("a", "b").distinct()
    key = classes.select("cell", "dims", "rep")
    member = valid.withColumn("dims", F.size("unit")).join(key, ["cell", "dims"]).select("rep", "id", "unit")
    left, right = (member.select(F.col("rep").alias(c), F.col("id").alias(f"{c}_id"), F.col("unit").alias(f"{c}_unit")) for c in ("a", "b"))
    dot = F.aggregate(F.zip_with("a_unit", "b_unit", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    exact = materialize(maybe.join(left, "a").join(right, "b").where(dot >= cosine).select("a", "b", "a_id", "b_id"))
    by_member = exact.select(F.col("a_id").alias("id")).unionByName(exact.select(F.col("b_id").alias("id"))).groupBy("id").agg(F.count("*").alias("more"))
    comp = connected_components(tree.unionByName(exact.select("a", "b").distinct())).withColumnRenamed("node", "rep")
    labelled = classes.join(by_class, "rep", "left").join(comp, "rep", "left").select("cell", F.col("dims").alias("_d"), (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("base"), F.coalesce("component", "rep").alias("component"))
    rows = vecs.withColumn("_cell", F.when(F.col("id").isNotNull(), F.col("cell")))
    out = rows.join(labelled.withColumnRenamed("cell", "_c"), (F.col("_cell") == F.col("_c")) & (F.size("unit") == F.col("_d")), "left").join(by_member, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col), (F.coalesce("base", F.lit(0)) + F.coalesce("more", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
