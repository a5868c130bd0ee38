"""Whitening of embeddings by matrix-free block Lanczos."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Entries become whole numbers of 1/SCALE.
SCALE = 256
#: Directions multiplied in one pass, and blocks kept before the search starts anew from the best directions.
BLOCK, BLOCKS = 8, 32
#: A residual of so many units in the last place of the largest eigenvalue counts as none.
ULPS = 8
#: Rows of vectors taken at a time in a task.
ROWS = 4096


@dataclass
class Whitening:
    """Mean and leading components of the fit list: n distinct vectors with the sums given.

    vectors: dims x components, unit columns; values: their eigenvalues, falling; trace: of the covariance.
    """

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residual: float
    passes: int
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def whole(vector: Column) -> Column:
    """Entries as whole numbers: floor(SCALE * entry), null where the vector or an entry is null or not finite."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(finite, F.transform(v, lambda c: F.floor(c * SCALE).cast("long")))


def _matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    """Whole vectors of batches, in matrices of ROWS rows at most."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            flat = batch.column(0).slice(at, ROWS).flatten().to_numpy(zero_copy_only=False)
            yield flat.astype(np.int64).reshape(-1, dims)


def _summed(fit: DataFrame, partial: Callable[[Iterator[np.ndarray]], np.ndarray], dims: int, kind: str) -> list:
    """Sum over all tasks of the flat arrays that `partial` makes of a task's vectors; a sum of one task counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = partial(_matrices(batches, dims))
        values = pa.array([Decimal(int(v)) for v in found], pa.decimal128(38, 0)) if kind != "double" else pa.array(found, pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found))), values], ["cell", "part"])

    rows = fit.mapInArrow(run, f"cell long, part {kind}").groupBy("cell").agg(F.sum("part").alias("part")).collect()
    return [r["part"] for r in sorted(rows, key=lambda r: r["cell"])]


def _product(fit: DataFrame, mean: np.ndarray, n: int, q: np.ndarray) -> np.ndarray:
    """Covariance times q in one pass over the fit list: the sum of (x - mean)((x - mean)'q), over n."""

    def partial(matrices: Iterator[np.ndarray]) -> np.ndarray:
        out = np.zeros(q.shape)
        for x in matrices:
            c = x - mean
            out += c.T @ (c @ q)
        return out.ravel()

    return np.array(_summed(fit, partial, len(mean), "double")).reshape(q.shape) / n


def _orthogonal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator, scale: float) -> np.ndarray:
    """Unit columns that span what block adds to basis. A column that adds nothing has broken down and is restarted
    from a random direction; no more columns are returned than the space has room for."""
    dims, out = len(block), basis
    for column in block.T[: dims - basis.shape[1]]:
        size = 0.0
        while size == 0.0:
            for _ in range(3):  # full reorthogonalisation, repeated
                column = column - out @ (out.T @ column)
            size = float(np.linalg.norm(column))
            if size <= 64 * np.finfo(float).eps * scale:
                column, scale, size = rng.standard_normal(dims), 1.0, 0.0
        column = column / size
        column = column - out @ (out.T @ column)
        out = np.column_stack([out, column / np.linalg.norm(column)])
    return out[:, basis.shape[1] :]


def block_lanczos(product: Callable[[np.ndarray], np.ndarray], dims: int, k: int, block: int = BLOCK, blocks: int = BLOCKS, most: int = 1000) -> tuple[np.ndarray, np.ndarray, float, int]:
    """The k largest eigenvalues (falling) and unit eigenvectors of a symmetric operator known by its products.

    Each pass multiplies a block of directions; the products are orthogonalised against all directions so far and
    become the next block. Ritz pairs come from the projection on all directions, and their residuals from the products
    already made. Ends when the k residuals are a few units in the last place of the largest eigenvalue, when they stop
    falling below a millionth of that, when the directions span the whole space, or after `most` passes. After `blocks`
    blocks the search starts anew from the best 2 * block directions.

    Returns values, vectors, the largest residual relative to the largest eigenvalue, and the number of passes.
    """
    rng, k = np.random.default_rng(13), min(k, dims)
    block = max(block, min(k, dims))
    basis, images, passes, best, stale = np.zeros((dims, 0)), np.zeros((dims, 0)), 0, np.inf, 0
    new = _orthogonal(rng.standard_normal((dims, block)), basis, rng, 1.0)
    while True:
        image = product(new)
        passes += 1
        basis, images = np.column_stack([basis, new]), np.column_stack([images, image])
        small = basis.T @ images
        values, turned = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values, kind="stable")
        values, turned = values[order], turned[:, order]
        top = max(abs(values[0]), abs(values[-1]), np.finfo(float).tiny)
        vectors = basis @ turned[:, :k]
        residual = float(np.linalg.norm(images @ turned[:, :k] - vectors * values[:k], axis=0).max() / top) if basis.shape[1] >= k else np.inf
        stale = stale + 1 if residual >= best / 2 else 0
        best = min(best, residual)
        done = residual <= ULPS * np.finfo(float).eps or (stale >= 2 and best <= 1e-14)
        if (done and basis.shape[1] >= k) or basis.shape[1] == dims or passes >= most:
            return values[:k], vectors / np.linalg.norm(vectors, axis=0), residual, passes
        if basis.shape[1] >= block * blocks:
            keep = min(2 * block, basis.shape[1])
            image = images @ turned[:, :block] - (basis @ turned[:, :block]) * values[:block]
            basis, images = basis @ turned[:, :keep], images @ turned[:, :keep]
        new = _orthogonal(image, basis, rng, top)


def fit_list(vectors: DataFrame, vec_col: str = "embedding") -> tuple[DataFrame | None, int, int]:
    """(each distinct whole vector once, as x, written to shared storage; dimensions; largest absolute entry).

    Dimensions are the commonest length (the larger of equally common ones); other vectors are left out. Vectors are
    shuffled as the narrowest integers that hold every entry. None without vectors.
    """
    x = vectors.select(whole(F.col(f"`{vec_col}`")).alias("x")).where("x IS NOT NULL")
    lengths = x.select(F.size("x").alias("dims"), F.array_max(F.transform("x", lambda c: F.greatest(c, -1 - c))).alias("most")).groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.max("most").alias("most"))
    found = lengths.orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    if not found or found[0]["dims"] == 0:
        return None, 0, 0
    dims, most = found[0]["dims"], found[0]["most"]
    kind = "smallint" if most < 1 << 15 else "int" if most < 1 << 31 else "bigint"
    return materialize(x.where(F.size("x") == dims).select(F.col("x").cast(f"array<{kind}>").alias("x")).distinct()), dims, most + 1


def deviations(x: np.ndarray, n: int, sums: list[int], most: int) -> list[int]:
    """The exact sum over dimensions of (n * x - sums)^2 for each row of x, whose entries are within most.

    It is n^2 * x.x - 2n * x.sums + sums.sums: the products with x run in 64 bits, sums cut into limbs of as many
    bits as fit, and only these few numbers a row are put together by Python's whole numbers.
    """
    bits = 62 - most.bit_length() - len(sums).bit_length()
    wide = x.astype(object) if bits < 8 or 2 * most.bit_length() + len(sums).bit_length() > 62 else x
    squares, cross = (wide * wide).sum(1).tolist(), [0] * len(x)
    if wide is x:
        shift, left, sign = 0, [abs(s) for s in sums], np.array([1 if s >= 0 else -1 for s in sums], np.int64)
        while any(left):
            limb = np.array([s & ((1 << bits) - 1) for s in left], np.int64) * sign
            cross = [c + (int(d) << shift) for c, d in zip(cross, (x @ limb).tolist(), strict=True)]
            left, shift = [s >> bits for s in left], shift + bits
    else:
        cross = (wide * np.array(sums, object)).sum(1).tolist()
    own = sum(s * s for s in sums)
    return [n * n * q - 2 * n * c + own for q, c in zip(squares, cross, strict=True)]


def fit(vectors: DataFrame, vec_col: str = "embedding", components: int = 4) -> tuple[Whitening | None, int, int]:
    """(model or None without vectors, dimensions, bound on entries); see whiten."""
    listed, dims, most = fit_list(vectors, vec_col)
    if listed is None:
        return None, 0, 0

    def sums(matrices: Iterator[np.ndarray]) -> list[int]:
        total = [0] * (dims + 1)
        for x in matrices:
            parts = [len(x), *(x.sum(0) if most.bit_length() < 48 else x.astype(object).sum(0)).tolist()]
            total = [t + p for t, p in zip(total, parts, strict=True)]
        return total

    n, *totals = (int(v) for v in _summed(listed, sums, dims, "decimal(38,0)"))
    model = Whitening(n, totals, 0.0, np.zeros(0), np.zeros((dims, 0)), 0.0, 0)
    mean = model.mean
    # a sum of exact deviations may pass 38 digits where n does not: each task's part is in floating point from there on
    deviation = _summed(listed, lambda ms: [float(sum(sum(deviations(x, n, totals, most)) for x in ms))], dims, "double")[0]
    model.trace = deviation / n / n / n
    if model.trace == 0:
        return model, dims, most
    values, basis, model.residual, model.passes = block_lanczos(lambda q: _product(listed, mean, n, q), dims, components)
    real = values > max(dims, 16) * np.finfo(float).eps * values[0]
    model.values, model.vectors = values[real], basis[:, real]
    k = len(model.values)
    white = model.vectors / np.sqrt(model.values)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _matrices(batches, dims):
            w = (x - mean) @ white
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in w.T], [f"w{i}" for i in range(k)])

    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = listed.mapInArrow(projected, ", ".join(f"w{i} double" for i in range(k))).agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    model.identity_error = max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    return model, dims, most


def whiten(vectors: DataFrame, vec_col: str = "embedding", components: int = 4) -> DataFrame:
    """vectors with n, deviation, whitened, explained and identity_error, without the rows that have no whole vector.

    1. Entries become whole numbers (`whole`); rows with a null vector or with a null or non-finite entry go. Each
       distinct whole vector is written once: the fit list. Copies meet in a map-side distinct first.
    2. One pass counts the fit list (n) and adds up each dimension (S), one adds up the exact deviations, whose total
       gives the trace of the covariance.
    3. Block Lanczos (`block_lanczos`) finds the leading components. A pass multiplies the covariance with 8 directions
       as centred X'(Xq), matrix-free: a task returns dims x 8 numbers.
    4. Every row is projected. Covariances have divisor n and are centred before multiplying.

    deviation is decimal(38, 0), the exact sum of (n*x - S)^2 (null where it has more digits); whitened the coordinates
    of x - S/n on the unit components over the root of their eigenvalues; explained the eigenvalues' shares of the
    trace; identity_error the largest absolute entry of the fit list's whitened covariance minus the identity.
    Components are numbered by falling eigenvalue; those without variance (to rounding) are left out, so a fit list of
    rank r has at most r, and one distinct vector none (empty arrays). Equal eigenvalues have any orthogonal components.

    The commonest length of vectors counts as their number of dimensions (of equally common ones the larger); rows with
    vectors of another length go. Repeated rows come out alike and count once in the fit. Ids are not looked at, so null
    ones stay. Entries beyond 64 bits are held at their bounds. An empty table, or one of empty vectors, gives no rows.
    Extra columns stay, whatever their names, except that those called as a new one are replaced.
    """
    new = ["n", "deviation", "whitened", "explained", "identity_error"]
    keep = [c for c in vectors.columns if c not in new]
    model, dims, most = fit(vectors, vec_col, components)
    # the caller's columns travel as one, so that no name of theirs meets a name used here
    rows = vectors.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), whole(F.col(f"`{vec_col}`")).alias("x"))
    rows = rows.where(F.col("x").isNotNull() & (F.size("x") == dims) if model else F.lit(False))
    mean, n, sums = (model.mean, model.n, model.sums) if model else (np.zeros(0), 0, [])
    white = model.vectors / np.sqrt(model.values) if model else np.zeros((0, 0))
    k = white.shape[1]

    def project(lists: pa.Array) -> pa.Array:
        digits, coordinates = [], []
        for at in range(0, len(lists), ROWS):
            x = lists.slice(at, ROWS).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            digits += [Decimal(d) if d < 10**38 else None for d in deviations(x, n, sums, most)]
            coordinates.append(((x - mean) @ white).ravel())
        flat = np.concatenate(coordinates) if coordinates else np.zeros(0)
        listed = pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * k, pa.int32()), pa.array(flat))
        return pa.StructArray.from_arrays([pa.array(digits, pa.decimal128(38, 0)), listed], ["deviation", "whitened"])

    out = rows.withColumn("made", F.arrow_udf(project, "deviation decimal(38,0), whitened array<double>")("x"))
    shares = [float(v / model.trace) for v in model.values] if model else []
    return out.select(
        *[F.col("row")[c].alias(c) for c in keep], F.lit(n).cast("long").alias("n"), "made.deviation", "made.whitened",
        F.array(*map(F.lit, shares)).cast("array<double>").alias("explained"), F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )
