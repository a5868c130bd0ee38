"""Exact top-k BM25 search: sharded inverted indexes, block-max pruning, global statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release, slices, small_batches

K1, B = 1.2, 0.75
#: Documents to a shard and postings of one; documents to a block of it; queries to a batch.
SHARD, SHARD_POSTINGS, BLOCK, BATCH = 2048, 1 << 19, 64, 256
#: Shards to a file: a task decodes one file's at a time, however many documents it lays out.
FILE = 4
#: Documents and postings that are cut into shards together.
GATHER, GATHER_POSTINGS = 8192, 1 << 21
#: Queries and terms of queries to a block that is sent to the executors.
QUERIES, QUERY_TERMS = 1 << 15, 2_500_000
#: Nested samples hold one document in SAMPLE, SAMPLE ** 2, ...; the smallest has at most FIRST documents.
SAMPLE, FIRST = 8, 4096
#: Terms in at least this share of a shard's documents are scored as dense columns.
DENSE = 1 / 16
#: Share of a group's spread along one axis that tells groups of unlike documents.
APART = 0.15
#: (term of a query, posting) pairs that are added up at a time.
MATCHES = 1 << 19

_FOLD = bytes(32 if i < 128 and not chr(i).isalnum() else ord(chr(i).lower()) if i < 128 else i for i in range(256))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) >> 1
        return h


def terms(text: str | None, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct term hashes (63 bits) and counts: runs of letters and digits, A-Z lower-cased."""
    w = text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []
    return np.unique(np.fromiter(map(cache.__getitem__, w), np.int64, len(w)), return_counts=True)


def _lists(values: list[np.ndarray], kind) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values).astype(kind) if values else np.empty(0, kind)))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = _Hashes()
    for b in batches:
        for part in slices(b, 1, 512, 1 << 22):
            got = [terms(t, cache) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([int(c.sum()) for _, c in got], pa.int64()), _lists([t for t, _ in got], np.int64), _lists([c for _, c in got], np.int32)], ["doc", "length", "terms", "counts"])


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, n: documents of each term, added up over the shards of a task as far as memory allows."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> pa.RecordBatch:
        t, back = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        n = np.bincount(back, np.concatenate([x for _, x in held]), len(t)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(t), pa.array(n)], ["term", "n"])

    for b in batches:
        held.append((b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy()))
        if sum(len(x) for x, _ in held) > 2_000_000:
            yield out()
            held.clear()
    if held:
        yield out()


def spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers start[i], ..., start[i] + n[i] - 1 of every i, one after another."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def outline(owner: np.ndarray, place: np.ndarray, value: np.ndarray, rows: int, width: int = 64) -> np.ndarray:
    """Unit vectors of few dimensions that keep rows with common terms together: signed hashing of the frequent ones.

    Terms in less than one row of 32 are noise here; where no term is that frequent, all count.
    """
    wide = np.bincount(place) * 32 >= rows if len(place) else np.empty(0, bool)
    if wide.any():
        own = wide[place]
        owner, place, value = owner[own], place[own], value[own]
    h = (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    column = ((h >> np.uint64(20)) % np.uint64(width)).astype(np.int64)
    out = np.bincount(owner * width + column, sign * value, rows * width).reshape(rows, width)
    return out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-12)


def bisected(x: np.ndarray, weight: np.ndarray, most: int, heaviest: float, apart: float = APART) -> list[np.ndarray]:
    """Rows of x in groups of at most `most` rows and, unless it is one row, `heaviest` weight, alike rows together.

    A group that is too large, or whose principal axis holds more than `apart` of its spread, is cut where that axis
    crosses the mean, or, where that cuts off less than a sixteenth of it, in the middle. Rows of a group come in the order of that axis.
    """
    done, open_ = [], [np.arange(len(x))]
    while open_:
        own = open_.pop()
        if not len(own):
            continue
        y = x[own] - x[own].mean(0)
        v = np.random.default_rng(1).standard_normal(x.shape[1])
        for _ in range(6):
            v = y.T @ (y @ v)
            v /= np.linalg.norm(v) + 1e-12
        along = y @ v
        mixed = len(own) >= 4 * BLOCK and along @ along > apart * (y * y).sum()
        order = np.argsort(along, kind="stable")
        own, along = own[order], along[order]
        if len(own) == 1 or len(own) <= most and weight[own].sum() <= heaviest and not mixed:
            done.append(own)
            continue
        cut = int(np.searchsorted(along, 0))
        if min(cut, len(own) - cut) * 16 < len(own):
            cut = len(own) // 2
        open_ += [own[cut:], own[:cut]]
    return done


class Queries:
    """A block of queries in one array layout: for query i, terms[first[i]:first[i + 1]] (places in vocabulary) and weights.

    Alike queries are neighbours, so that those of a batch need the same blocks of documents.
    """

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        vocabulary, place = np.unique(terms, return_inverse=True)
        self._lay(ids, sizes, place, weights, vocabulary)

    def _lay(self, ids: np.ndarray, sizes: np.ndarray, places: np.ndarray, weights: np.ndarray, vocabulary: np.ndarray | None) -> None:
        first = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        groups = bisected(outline(np.repeat(np.arange(len(ids)), sizes), places, weights, len(ids)), sizes, BATCH, np.inf)
        order = np.concatenate(groups) if groups else np.empty(0, np.int64)
        at = spans(first[:-1][order], sizes[order])
        self.ids, self.vocabulary = ids[order], vocabulary
        self.terms, self.weights = places[at].astype(np.int32), weights[at]
        self.first = np.concatenate(([0], np.cumsum(sizes[order]))).astype(np.int64)
        #: A score that k documents are known to reach, for each query.
        self.least = np.zeros(len(ids))

    @classmethod
    def placed(cls, ids: np.ndarray, sizes: np.ndarray, places: np.ndarray, weights: np.ndarray) -> Queries:
        """Of terms that are places in a vocabulary already; every query has a term."""
        q = cls.__new__(cls)
        q._lay(ids, sizes, places, weights, None)
        return q

    @classmethod
    def of(cls, t: pa.Table) -> Queries:
        """From columns query, term, w (lists of equal length)."""
        t = t.combine_chunks()
        if not t.num_rows:
            return cls(*(np.empty(0, kind) for kind in (np.int64, np.int64, np.int64, float)))
        lists, weights = (t[c].combine_chunks() for c in ("term", "w"))
        return cls(t["query"].to_numpy(), lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy(), weights.flatten().to_numpy())

    def raise_floors(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """Take a k-th best score of some documents as the lower bound of the named queries."""
        order = np.argsort(self.ids)
        at = order[np.searchsorted(self.ids[order], ids)]
        self.least[at] = np.maximum(self.least[at], scores)


class Shard:
    """Inverted index of some documents over the terms of a block of queries, with block maxima.

    Terms in many documents have their postings as columns of a matrix, the others as lists; `whole` holds the
    largest impact of every term in the shard, `top` that of the frequent ones in every block.
    """

    def __init__(self, docs: np.ndarray, owner: np.ndarray, place: np.ndarray, impact: np.ndarray, terms: int):
        """owner (row of docs), place (number of the term, ascending) and impact of every posting; docs in block order."""
        self.docs, n = docs, len(docs)
        n_docs = np.bincount(place, minlength=terms)
        common = np.flatnonzero(n_docs >= max(4, DENSE * n))
        self.column = np.full(terms, -1, np.int32)
        self.column[common] = np.arange(len(common))
        self.matrix = np.zeros((n, len(common)))
        column = self.column[place]
        dense = column >= 0
        self.matrix[owner[dense], column[dense]] = impact[dense]
        self.fast = self.matrix.astype(np.float32)
        self.edges = np.arange(0, n, BLOCK)
        self.top = np.maximum.reduceat(self.matrix, self.edges, axis=0) if len(common) else np.zeros((len(self.edges), 0))
        held = np.flatnonzero(n_docs)
        self.whole = np.zeros(terms, np.float32)
        # rounded up, so that it stays a bound
        self.whole[held] = np.nextafter(np.maximum.reduceat(impact, (np.cumsum(n_docs) - n_docs)[held]).astype(np.float32), np.float32(np.inf)) if len(held) else 0
        self.owner, self.impact = owner[~dense].astype(np.int32), impact[~dense]
        self.start = np.concatenate(([0], np.cumsum(np.where(self.column >= 0, 0, n_docs)))).astype(np.int32)

    def rare(self, q: Queries, batch: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Scores of the batch's queries by terms with posting lists; at, row: its terms and the query of each."""
        t = q.terms[at]
        m = self.start[t + 1] - self.start[t]
        hit = np.flatnonzero(m)
        at, t, row, m = at[hit], t[hit], row[hit], m[hit]
        out, width, upto, s = np.zeros((len(batch), len(self.docs))), len(self.docs), np.cumsum(m), 0
        while s < len(m):
            # whole queries, so many that their matches fit; one at least
            e = int(np.searchsorted(upto, upto[s] - m[s] + MATCHES, side="right"))
            last = row[min(e, len(m) - 1)]
            e = len(m) if e >= len(m) else int(np.searchsorted(row, last if last > row[s] else last + 1))
            lo, hi = row[s], row[e - 1] + 1
            p = spans(self.start[t[s:e]], m[s:e])
            cell = np.repeat((row[s:e] - lo) * width, m[s:e]) + self.owner[p]
            out[lo:hi] = np.bincount(cell, np.repeat(q.weights[at[s:e]], m[s:e]) * self.impact[p], (hi - lo) * width).reshape(hi - lo, width)
            s = e
        return out

    def common_weights(self, q: Queries, batch: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Weights of the batch's queries for the terms with columns."""
        c = self.column[q.terms[at]]
        hit = np.flatnonzero(c >= 0)
        out = np.zeros((len(batch), self.matrix.shape[1]))
        out.ravel()[row[hit] * self.matrix.shape[1] + c[hit]] = q.weights[at[hit]]
        return out


def laid_out(docs: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Shards of documents given by lists of terms one after another; alike documents share shards and blocks.

    A shard is (documents, lengths, distinct terms in ascending order, documents of each, then row and count of every
    posting, term by term).
    """
    owner = np.repeat(np.arange(len(docs)), sizes)
    distinct, place = np.unique(terms, return_inverse=True)
    # only how alike texts are matters here, so any document length serves
    tf = counts.astype(float)
    first = np.cumsum(sizes) - sizes
    for own in bisected(outline(owner, place, tf / (tf + K1), len(docs)), sizes, SHARD, SHARD_POSTINGS):
        at = spans(first[own], sizes[own])
        by = np.argsort(place[at], kind="stable")
        t, n = np.unique(place[at], return_counts=True)
        yield docs[own], lengths[own], distinct[t], n.astype(np.int32), np.repeat(np.arange(len(own), dtype=np.int32), sizes[own])[by], counts[at][by]


def shard_of(row: tuple[np.ndarray, ...], average: float, vocabulary: np.ndarray) -> Shard:
    """The index of a laid-out shard over the terms of a vocabulary."""
    docs, lengths, distinct, n, owner, counts = row
    place = np.minimum(np.searchsorted(vocabulary, distinct), len(vocabulary) - 1)
    known = vocabulary[place] == distinct
    own = np.repeat(known, n)
    owner, tf = owner[own], counts[own].astype(float)
    impact = tf * (K1 + 1) / (tf + (K1 * (1 - B + B * lengths / average))[owner])
    return Shard(docs, owner, np.repeat(place[known], n[known]), impact, len(vocabulary))


class Best:
    """The k best (score, document) of each query so far; equal scores by smaller document."""

    def __init__(self, n: int, k: int):
        self.score, self.doc = np.zeros((n, k)), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, scores: np.ndarray, docs: np.ndarray) -> None:
        """Merge candidates, each with the number of its query."""
        k = self.score.shape[1]
        who = np.unique(rows)
        r = np.concatenate([np.repeat(who, k), rows])
        s, d = np.concatenate([self.score[who].ravel(), scores]), np.concatenate([self.doc[who].ravel(), docs])
        order = np.lexsort((d, -s, r))
        r, s, d = r[order], s[order], d[order]
        new = np.concatenate(([0], np.flatnonzero(r[1:] != r[:-1]) + 1))
        place = np.arange(len(r)) - np.repeat(new, np.diff(np.append(new, len(r))))
        top = place < k
        self.score[r[top], place[top]], self.doc[r[top], place[top]] = s[top], d[top]


def search_shard(shard: Shard, q: Queries, best: Best) -> int:
    """Improve `best` by a shard; the number of (query, block) pairs whose documents can matter.

    1. A query whose weights times the shard's largest impacts stay below its k-th best score so far is done.
    2. The lists of infrequent terms, the essential ones, are added up for the queries left. A block stays closed
       for a query whose best sum in it plus the block's maxima of the frequent terms stay below that score.
    3. Frequent terms are added in blocks that some query of the batch opens. As alike queries share batches and
       alike documents blocks, that is little more than the pairs opened.

    What is skipped cannot hold a better document, so the result is exact.
    """
    k, opened = best.score.shape[1], 0
    if not len(shard.docs) or not len(q.ids):
        return 0
    # scores below this cannot enter; rounding apart, equal ones can
    floors = np.maximum(best.score[:, -1], q.least) - 1e-8
    reach = np.add.reduceat(q.weights * shard.whole[q.terms], q.first[:-1])
    asked = np.flatnonzero((reach >= floors) & (reach > 0))
    for i in range(0, len(asked), BATCH):
        own = asked[i : i + BATCH]
        n = q.first[own + 1] - q.first[own]
        at, row = spans(q.first[own], n), np.repeat(np.arange(len(own)), n)
        rare, weights, floor = shard.rare(q, own, at, row), shard.common_weights(q, own, at, row), floors[own][:, None]
        bound = weights @ shard.top.T + np.maximum.reduceat(rare, shard.edges, axis=1)
        wanted = (bound >= floor) & (bound > 0)
        opened += int(wanted.sum())
        open_ = np.flatnonzero(wanted.any(0))
        if not len(open_):
            continue
        at = np.arange(len(shard.docs)) if len(open_) == len(shard.edges) else (shard.edges[open_][:, None] + np.arange(BLOCK)).ravel()
        at = at[at < len(shard.docs)]
        whole = len(at) == len(shard.docs)
        score = (rare if whole else rare[:, at]).astype(np.float32)
        score += weights.astype(np.float32) @ (shard.fast if whole else shard.fast[at]).T
        # sums of positive numbers: single precision may lower them by this share at most
        less = 1 - 1.3e-7 * (weights.shape[1] + 8)
        mask = score >= np.maximum(floor * less, 1e-30).astype(np.float32)
        # the k-th best of this shard, where many documents are over the floor
        crowded = np.flatnonzero(mask.sum(1) > 4 * k)
        if len(crowded):
            edge = np.partition(score[crowded], len(at) - k, axis=1)[:, len(at) - k]
            floor[crowded, 0] = np.maximum(floor[crowded, 0], edge * less - 1e-8)
            mask[crowded] = score[crowded] >= floor[crowded] * np.float32(less)
        row, col = np.nonzero(mask)
        exact = rare[row, at[col]] + np.einsum("ij,ij->i", weights[row], shard.matrix[at[col]])
        reached = exact >= floor[row, 0]
        row, col, exact = row[reached], col[reached], exact[reached]
        if len(row):
            best.add(own[row], np.round(exact, 9), shard.docs[at[col]])
    return opened


_ROW = "docs array<long>, lengths array<long>, terms array<long>, sizes array<int>, owners array<int>, counts array<int>"


def _lay_out(texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of a task's documents, one to a row."""
    held, rows, postings = [], 0, 0

    def flush() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        lists, counts = t["terms"].combine_chunks(), t["counts"].combine_chunks().flatten().to_numpy()
        for row in laid_out(t["doc"].to_numpy(), t["length"].to_numpy(), lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy(), counts):
            yield pa.RecordBatch.from_arrays([_lists([x], x.dtype) for x in row], [f.split()[0] for f in _ROW.split(", ")])

    for part in _index(texts):
        held.append(part)
        rows += part.num_rows
        postings += len(part.column(2).flatten())
        if rows >= GATHER or postings >= GATHER_POSTINGS:
            yield from flush()
            held, rows, postings = [], 0, 0
    if rows:
        yield from flush()


def _search(q: Queries, average: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(q.vocabulary):
            return
        best = Best(len(q.ids), k)
        for b in batches:
            for i in range(b.num_rows):
                search_shard(shard_of(tuple(b.column(j).slice(i, 1).flatten().to_numpy() for j in range(6)), average, q.vocabulary), q, best)
        row, col = np.nonzero(best.score > 0)
        yield pa.RecordBatch.from_arrays([pa.array(q.ids[row]), pa.array(best.doc[row, col]), pa.array(best.score[row, col])], ["query", "doc", "score"])

    return run


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id: str = "doc_id", query_text: str = "text") -> DataFrame:
    """query_id, place, doc_id, score: the k documents of highest BM25 score for each query, exactly.

    1. One pass turns texts into term counts. Documents are dealt to shards, alike ones together, and the shards'
       posting lists are written to shared storage once; the number of documents, their average length and the
       document frequency of every query term are counted over all of them.
    2. Queries of equal terms count once. They go to the executors in blocks, bounded in rows and in terms. A block is
       searched in nested samples of the documents, each SAMPLE times the one before, and at last in all: the k-th best
       score in one is a lower bound on the k-th best in the next, so a task reports few documents besides the k best
       of all. Tasks search their shards with block maxima (see search_shard); a task decodes a few shards at a time.
    3. The tasks' k best are merged by score; as all scores use the global counts, the merge is exact.

    A query is the bag of its text's terms. Texts without terms find and are found by nothing. Scores are rounded to
    nine decimals, so that the order of a sum does not matter; equal ones go by smaller id. Repeated documents are
    found as often as they occur; queries that repeat an id count as one, the first by text. Rows with a null id are
    left out; other columns are ignored. Empty tables give an empty result.
    """
    bag = "doc long, length long, terms array<long>, counts array<int>"
    samples = [docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))]
    levels = [materialize(samples[0].mapInArrow(_lay_out, _ROW), FILE)]
    n, total = levels[0].agg(F.sum(F.size("docs")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    if not n or not total:
        return docs.sparkSession.createDataFrame([], "query_id long, place int, doc_id long, score double")
    while n / SAMPLE ** (len(samples) - 1) > FIRST:
        own = F.pmod(F.xxhash64("doc"), F.lit(SAMPLE ** len(samples))) == 0
        samples.append(materialize(samples[-1].where(own)))
        levels.append(materialize(samples[-1].repartition(math.ceil(n / SAMPLE ** (len(samples) - 1) / SHARD)).mapInArrow(_lay_out, _ROW), FILE))
    release(*samples)
    q = queries.where(F.col(query_id).isNotNull()).groupBy(F.col(query_id).cast("long").alias("doc")).agg(F.min(F.col(query_text).cast("string")).alias("text"))
    every = materialize(q.mapInArrow(_index, bag).where("length > 0").withColumn("bag", F.xxhash64("terms", "counts")))
    asked = materialize(every.groupBy("bag", "terms", "counts").agg(F.min("doc").alias("query")))
    alike = every.select("bag", "terms", "counts", "doc").join(asked, ["bag", "terms", "counts"]).select("query", F.col("doc").alias("query_id"))
    words = asked.select("query", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("query", F.col("t.terms").alias("term"), F.col("t.counts").alias("m"))
    found = levels[0].select("terms", "sizes").mapInArrow(_document_counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = words.join(found, "term").withColumn("w", F.col("m") * idf).groupBy("query").agg(F.collect_list(F.struct("term", "w")).alias("t"))
    queries_, terms_ = asked.agg(F.count("*"), F.sum(F.size("terms"))).first()
    blocks = max(1, math.ceil(queries_ / QUERIES), math.ceil((terms_ or 0) / QUERY_TERMS))
    ready = materialize(weighed.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks))))
    parts, kind = [], "query long, doc long, score double"
    for i in range(blocks):
        block = Queries.of(ready.where(F.col("block") == i).select("query", F.col("t.term").alias("term"), F.col("t.w").alias("w")).orderBy("query").toArrow())
        for level in reversed(levels[1:] if len(block.ids) else []):
            # the k-th best of some documents is a lower bound on the k-th best of all
            with small_batches(docs.sparkSession):
                seen = materialize(level.mapInArrow(_search(block, total / n, k), kind))
            last = _best(seen, k).where(F.col("place") == k).select("query", "score").toArrow()
            block.raise_floors(last["query"].to_numpy(), last["score"].to_numpy())
            release(seen)
        with small_batches(docs.sparkSession):
            parts.append(materialize(levels[0].mapInArrow(_search(block, total / n, k), kind)))
    release(ready, *levels)
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    return _best(merged, k).join(alike, "query").select("query_id", "place", F.col("doc").alias("doc_id"), "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with their place."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("doc"))
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
