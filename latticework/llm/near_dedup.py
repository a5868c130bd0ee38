"""Near-duplicate documents: MinHash bands, odd-sketch checks, exact confirmation, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import bloom_filter, probe
from .common import materialize, release, slices
from .graph import connected_components

#: 64-bit words of an odd sketch (512 bits).
SKETCH_WORDS = 8
_CHUNK = 1 << 16


class _WordHashes(dict):
    """word -> 64-bit hash; forgets everything when it holds too many words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(text: str | None, words: int, cache: dict) -> tuple[np.ndarray, bytes]:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text, and a digest of its words.

    Words are runs of non-white-space with A-Z lower-cased; fewer than `words` of them make one
    shingle of them all; no word makes none.
    """
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return np.empty(0, np.uint64), b""
    joined = b" ".join(w)
    digest = xxhash.xxh3_128_digest(joined)
    if len(w) < words:
        return np.array([xxhash.xxh3_64_intdigest(joined, seed=len(w))], np.uint64), digest
    h = np.fromiter(map(cache.__getitem__, w), np.uint64, len(w))
    n = len(w) - words + 1
    s = np.zeros(n, np.uint64)
    for j in range(words):
        s *= np.uint64(0x9E3779B97F4A7C15)
        s += _mix(h[j : j + n] + np.uint64(j))
    return np.unique(_mix(s)), digest


def bands_for(similarity: float, miss: float = 2e-6) -> tuple[int, int]:
    """(bands, rows): a pair exactly at `similarity` shares no band with probability `miss` at most."""
    rows = 5 if similarity < 0.83 else 6
    return math.ceil(math.log(miss) / math.log(1 - similarity**rows)), rows


def sketch_limit(similarity: float, samples: int, sigmas: float = 5.0) -> int:
    """Largest XOR population count of two odd sketches that a pair at `similarity` may plausibly show.

    Of k samples a binomial number differ, and each that does flips two random bits of n: the count's distribution
    is followed bit by bit, with the noise of the MinHash estimate and that of bits flipped twice. The check loses
    a borderline pair with the chance of a normal value beyond `sigmas` at most (5: 3 in ten million) and drops the
    dissimilar majority before any text is compared.
    """
    n, apart = 64 * SKETCH_WORDS, 1 - similarity
    odd, total = np.zeros(n + 1), np.zeros(n + 1)
    odd[0], up = 1.0, 1 - np.arange(n + 1) / n
    for differ in range(samples + 1):
        total += math.comb(samples, differ) * apart**differ * similarity ** (samples - differ) * odd
        for _ in range(2):
            more, less = odd * up, odd * (1 - up)
            odd = np.append(0, more[:-1]) + np.append(less[1:], 0)
    beyond = np.append(np.cumsum(total[::-1])[::-1][1:], 0)
    return int(np.argmax(beyond <= 0.5 * math.erfc(sigmas / math.sqrt(2))))


def _signatures(sets: list[np.ndarray], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (n x bands) and odd sketches (n x SKETCH_WORDS), both int64, of non-empty hash sets."""
    k, rng = bands * rows, np.random.default_rng(20240501)
    mul = rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    xor = rng.integers(0, 2**63, k, dtype=np.uint64)
    sig, at = np.empty((len(sets), k), np.uint64), 0
    while at < len(sets):
        end, total = at, 0
        while end < len(sets) and (end == at or total + len(sets[end]) <= _CHUNK):
            total += len(sets[end])
            end += 1
        flat = np.concatenate(sets[at:end])
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[at : end - 1]], dtype=np.int64))).astype(np.int64)
        buf = np.empty_like(flat)
        for i in range(k):
            np.bitwise_xor(flat, xor[i], out=buf)
            np.multiply(buf, mul[i], out=buf)
            sig[at:end, i] = np.minimum.reduceat(buf, starts)
        at = end
    keys = np.zeros((len(sets), bands), np.uint64)
    for r in range(rows):
        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::rows] + np.arange(bands, dtype=np.uint64))
    bits = (_mix(sig * np.uint64(0xD6E8FEB86659FD93) + np.arange(k, dtype=np.uint64)) >> np.uint64(64 - int(math.log2(64 * SKETCH_WORDS)))).astype(np.int64)
    n = 64 * SKETCH_WORDS
    parity = np.bincount((bits + np.arange(len(sets))[:, None] * n).ravel(), minlength=len(sets) * n) & 1
    sketch = np.packbits(parity.astype(np.uint8).reshape(len(sets), n), axis=1, bitorder="little").view(np.int64)
    return keys.view(np.int64), sketch


def band_keys(texts: list[str | None], words: int, bands: int, rows: int) -> np.ndarray:
    """MinHash band keys (texts x bands) over word shingles; a text without words has keys of its own place only."""
    cache = _WordHashes()
    sets = [shingle_hashes(t, words, cache)[0] for t in texts]
    full = [i for i, s in enumerate(sets) if len(s)]
    keys = np.zeros((len(texts), bands), np.int64)
    if full:
        keys[full], _ = _signatures([sets[i] for i in full], bands, rows)
    return keys


def _parity(hashes: np.ndarray) -> np.ndarray:
    """Parity bitmap of a whole set: two bitmaps differ in at most as many bits as their sets in elements."""
    n = 64 * SKETCH_WORDS
    bits = np.bincount((hashes >> np.uint64(64 - int(math.log2(n)))).astype(np.int64), minlength=n) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def _sketch_batches(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHashes()
        for batch in batches:
            for part in slices(batch, 1, 512, 1 << 22):
                sets, digests = [], []
                for text in part.column(1).to_pylist():
                    s, d = shingle_hashes(text, words, cache)
                    sets.append(s)
                    digests.append(d)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys, sketch = np.zeros((len(sets), bands), np.int64), np.zeros((len(sets), SKETCH_WORDS), np.int64)
                parity = np.array([_parity(s) for s in sets], np.int64).reshape(len(sets), SKETCH_WORDS)
                if full:
                    keys[full], sketch[full] = _signatures([sets[i] for i in full], bands, rows)
                offsets = pa.array(np.arange(0, (len(sets) + 1) * bands, bands, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([d or None for d in digests], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))]
                    + [pa.array(np.ascontiguousarray(m[:, j])) for m in (sketch, parity) for j in range(SKETCH_WORDS)],
                    ["node", "n_shingles", "digest", "keys", *(f"{c}{j}" for c in "sf" for j in range(SKETCH_WORDS))],
                )

    return run


def _set_batches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHashes()
        for batch in batches:
            for part in slices(batch, 1, 512, 1 << 22):
                sets = [shingle_hashes(t, words, cache)[0].view(np.int64) for t in part.column(1).to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["node", "shingles"])

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union, written out.

    A Bloom filter of the nodes in pairs spares most texts the second reading; it is checked where the texts
    are scanned, so no text is shuffled. Its false hits only make sets that no pair asks for.
    """
    wanted = pairs.select(F.col("a").alias("wanted")).unionByName(pairs.select(F.col("b").alias("wanted"))).distinct()
    filter_, blocks = bloom_filter(wanted, "wanted", wanted.count())
    some = probe(texts, "node", filter_, blocks).where("_maybe").select("node", "text")
    sets = materialize(some.mapInArrow(_set_batches(words), "node long, shingles array<long>"))
    one = sets.dropDuplicates(["node", "shingles"])
    left = one.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = one.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b").withColumn("i", F.size(F.array_intersect("x", "y")))
    out = materialize(both.where(100 * F.col("i") >= percent * (F.size("x") + F.size("y") - F.col("i"))).select("a", "b"))
    release(sets)
    return out


def _plausible(limit: int, percent: int) -> Column:
    """Whether the sketches of a pair (columns, and h_ columns of its other side) allow it to be a link.

    The MinHash sketches must be within `limit`. The parity bitmaps of the full sets, and the set sizes, are
    lower bounds on the symmetric difference, which a link keeps within (100 - p) / (100 + p) of both sizes'
    sum: that test loses nothing.
    """
    apart = {c: sum((F.bit_count(F.col(f"{c}{j}").bitwiseXOR(F.col(f"h_{c}{j}"))) for j in range(SKETCH_WORDS)), F.lit(0)) for c in "sf"}
    sizes, gap = F.col("n_shingles") + F.col("h_n_shingles"), F.abs(F.col("n_shingles") - F.col("h_n_shingles"))
    return (apart["s"] <= limit) & (F.greatest(apart["f"].cast("long"), gap) * (100 + percent) <= sizes * (100 - percent))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Class of near copies of every document.

    Documents link when 100 * |A & B| >= percent * |A | B| over their sets of distinct word shingles;
    classes are the connected components of the links. Candidates come from MinHash bands (see bands_for),
    pass an odd-sketch check (see sketch_limit) and are confirmed on full sets. Steps:

    1. One pass over the texts makes band keys and odd sketches; equal word sequences become one class node.
    2. In every bucket each node is compared with one random member: as many pairs as rows. Components of
       the confirmed links follow.
    3. Only buckets that still hold several components are joined with themselves; the sketch check, the
       demand for different components and "no earlier shared band" are part of the join condition.

    Returns one row per input row: id, n_shingles, component_id (smallest id reachable), kept.
    Null ids: component_id null, kept false. Null, empty or blank texts: no shingles, alone. Repeated rows
    and equal texts share a component. Other columns are ignored. An empty table gives an empty result.
    """
    bands, rows = bands_for(percent / 100)
    limit = sketch_limit(percent / 100, bands * rows)
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text"))
    sk = [f"{c}{j}" for c in "sf" for j in range(SKETCH_WORDS)]
    schema = "node long, n_shingles long, digest binary, keys array<long>, " + ", ".join(f"{c} long" for c in sk)
    marks = materialize(texts.mapInArrow(_sketch_batches(words, bands, rows), schema))
    # one node for each word sequence; its columns are equal within the class, so any will do
    held = ["n_shingles", *sk]
    classes = materialize(
        marks.where("node IS NOT NULL AND n_shingles > 0").groupBy("digest")
        .agg(F.min("node").alias("node"), F.first("keys").alias("keys"), *[F.first(c).alias(c) for c in held])
    )
    buckets = materialize(
        classes.select("node", F.explode("keys").alias("key"))
        .groupBy("key").agg(F.min_by("node", F.xxhash64("node", "key")).alias("head"), F.count("*").alias("n")).where("n > 1").select("key", "head")
    )
    members = materialize(classes.select("node", F.posexplode("keys").alias("band", "key")).join(buckets, "key"))
    head = classes.select(F.col("node").alias("b"), *[F.col(c).alias(f"h_{c}") for c in held])
    alike = _plausible(limit, percent)
    stars = (
        members.where("node <> head").select(F.greatest("node", "head").alias("a"), F.least("node", "head").alias("b")).distinct()
        .join(classes.select(F.col("node").alias("a"), *held), "a").join(head, "b").where(alike).select("a", "b").distinct()
    )
    stars = materialize(stars)
    first = _confirmed(stars, texts, words, percent)
    comp = connected_components(first)
    labelled = materialize(members.join(comp, "node", "left").select("key", "band", "node", F.coalesce("component", "node").alias("c")))
    release(members, buckets)
    mixed = labelled.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    rest = materialize(labelled.join(mixed, "key", "left_semi").join(classes.select("node", "keys", *held), "node"))
    release(labelled)
    other = rest.select("key", F.col("node").alias("b"), F.col("c").alias("h_c"), F.col("keys").alias("h_keys"), *[F.col(c).alias(f"h_{c}") for c in held])
    pairs = (
        rest.withColumnRenamed("node", "a").join(other, "key")
        .where((F.col("a") > F.col("b")) & (F.col("c") != F.col("h_c")) & alike)
        .where(F.expr("NOT exists(slice(zip_with(keys, h_keys, (x, y) -> x = y), 1, band), e -> e)"))
        .select("a", "b")
    )
    pairs = materialize(pairs.join(stars, ["a", "b"], "left_anti"))
    release(rest, stars)
    second = _confirmed(pairs, texts, words, percent)
    release(pairs)
    final = connected_components(first.unionByName(second))
    label = classes.join(final, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    out = marks.select("node", "n_shingles", "digest").join(label, "digest", "left")
    component = F.when(F.col("node").isNotNull(), F.coalesce("component", "node"))
    return out.select(F.col("node").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("node") == component, F.lit(False)).alias("kept"))
