"""Toxicity scores from the nearest labelled examples under exact TF-IDF cosine."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, labelled_sample, remainder, slices
from .near_dedup import band_keys
from .search import Best, Queries, Shard, bisected, outline, search_shard, spans

#: Decision level of the score.
LEVEL = 0.3
#: Nearest examples that vote; evidence shown of them; folds of the calibration.
NEIGHBOURS, EVIDENCE, FOLDS = 15, 3, 4
#: Examples that the calibration asks about at a time.
ASKED = 256
#: Lengths of the word beginnings that count as terms; MinHash bands and rows that tell near copies among examples.
BEGINNINGS, BANDS, ROWS = (4, 6), 12, 3
#: Squared standard errors at which a term counts half, and what a term that tells nothing counts at least.
HALF, LEAST = 40.0, 0.01


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, number of the word) of every word of whole texts, and the distinct words: lower-cased runs of letters."""
    letters = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"[^\p{L}]+", " ")
    lists = pc.utf8_split_whitespace(letters)
    flat = lists.values.dictionary_encode()
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    codes = flat.indices.to_numpy() if len(flat) else np.empty(0, np.int64)
    full = pc.not_equal(flat.dictionary, "").to_numpy(zero_copy_only=False) if len(flat.dictionary) else np.empty(0, bool)
    keep = full[codes] if len(codes) else np.empty(0, bool)
    return owner[keep], codes[keep].astype(np.int64), flat.dictionary


def beginnings(words: pa.Array) -> list[pa.Array]:
    """For each length of BEGINNINGS, the marked beginning of every word, null where the word is no longer than that."""
    long = pc.utf8_length(words)
    return [pc.if_else(pc.greater(long, n), pc.binary_join_element_wise(pa.scalar("^", pa.large_string()), pc.utf8_slice_codeunits(words, 0, n), pa.scalar("", pa.large_string())), pa.scalar(None, pa.large_string())) for n in BEGINNINGS]


def summed(owner: np.ndarray, term: np.ndarray, count: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) in ascending order, equal pairs added up."""
    key, back = np.unique(owner * terms + term, return_inverse=True)
    return key // max(terms, 1), key % max(terms, 1), np.bincount(back, count, len(key))


class Examples:
    """Labelled rows as counted terms: row, term, count of every pair; terms are places in `vocabulary`."""

    def __init__(self, ids: list[int], labels: list[int], term_lists: pa.Array, count_lists: pa.Array, keys: np.ndarray):
        """keys: MinHash band keys; of near copies within a class (rows that share a key) only the first stays.

        Without this, words of one copied document look typical of its class.
        """
        labels = np.array(labels, np.int64)
        root = np.arange(len(ids))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        first: dict = {}
        for i, row in enumerate(keys.tolist()):
            for b, key in enumerate(row):
                a, c = find(i), find(first.setdefault((labels[i], b, key), i))
                root[max(a, c)] = min(a, c)
        kept = np.array([find(i) == i for i in range(len(ids))], bool)
        sizes = term_lists.value_lengths().to_numpy() if len(ids) else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(ids)), sizes)
        own = kept[owner]
        coded = pc.filter(term_lists.flatten(), pa.array(own)).dictionary_encode()
        self.vocabulary = coded.dictionary
        self.term = coded.indices.to_numpy().astype(np.int32)
        self.count = count_lists.flatten().to_numpy()[own].astype(np.float32)
        self.owner = (np.cumsum(kept) - 1)[owner[own]].astype(np.int32)
        self.ids, self.labels = np.array(ids, np.int64)[kept], labels[kept]


def gains(term: np.ndarray, owner: np.ndarray, labels: np.ndarray, terms: int) -> np.ndarray:
    """Weight of every term: inverse document frequency times how surely the term tells the classes apart.

    The second factor is z^2 / (z^2 + HALF) with z the difference of the term's shares of the two classes in standard
    errors, at least LEAST: no term is left out, and words that occur in either class alike hardly count.
    """
    d = [np.bincount(term[labels[owner] == y], minlength=terms) for y in (0, 1)]
    n = [max(1, int((labels == y).sum())) for y in (0, 1)]
    p0, p1 = (d[0] + 0.5) / (n[0] + 1), (d[1] + 0.5) / (n[1] + 1)
    both = (d[0] + d[1] + 1) / (n[0] + n[1] + 2)
    z2 = (p1 - p0) ** 2 / (both * (1 - both) * (1 / n[0] + 1 / n[1]))
    idf = np.log((1 + n[0] + n[1]) / (1 + d[0] + d[1])) + 1
    return idf * np.maximum(z2 / (z2 + HALF), LEAST)


class Voter:
    """Distance-weighted votes of the nearest examples, calibrated by isotonic regression on examples left out."""

    def __init__(self, examples: Examples, counts: dict[int, int]):
        """counts: labelled training documents of each class, sampled or not; an example of a class stands for that many."""
        self.vocabulary, self.ids, self.labels = examples.vocabulary, examples.ids, examples.labels
        n = [max(1, int((self.labels == y).sum())) for y in (0, 1)]
        weight = np.array([counts.get(0, 0) / n[0], counts.get(1, 0) / n[1]])[self.labels] if len(self.labels) else np.empty(0)
        self.base = counts.get(1, 0) / max(1, counts.get(0, 0) + counts.get(1, 0))
        votes, fold = np.full(len(self.ids), np.nan), np.arange(len(self.ids)) % FOLDS
        for f in range(FOLDS):
            inside = fold[examples.owner] != f
            self._build(examples, inside, fold != f)
            own = np.flatnonzero(fold == f)
            for part in np.split(own, range(ASKED, len(own), ASKED)):
                place = np.full(len(fold), -1)
                place[part] = np.arange(len(part))
                at = np.flatnonzero(place[examples.owner] >= 0)
                v, who, _ = self.votes(place[examples.owner[at]], examples.term[at], examples.count[at], len(part))
                votes[part[who[:, 0] >= 0]] = v[who[:, 0] >= 0]
        heard = ~np.isnan(votes)
        self.steps = isotonic(list(zip(votes[heard].tolist(), self.labels[heard].tolist(), weight[heard].tolist(), strict=True)))
        self._build(examples, np.ones(len(examples.term), bool), np.ones(len(self.ids), bool))

    def _build(self, examples: Examples, pairs: np.ndarray, rows: np.ndarray) -> None:
        """Take the examples in `rows`, whose postings are `pairs`; the first vote indexes them."""
        self._index, place = None, (np.cumsum(rows) - 1).astype(np.int32)
        self.rows = np.flatnonzero(rows)
        self.owner, self.term, self.count = place[examples.owner[pairs]], examples.term[pairs], examples.count[pairs]
        terms = len(self.vocabulary)
        self.gain = gains(self.term, self.owner, examples.labels[rows], terms)
        self.gain[np.bincount(self.term, minlength=terms) == 0] = 0.0

    @property
    def shards(self) -> list[Shard]:
        """The index, built where it is first asked: a driver that only sends the model holds none."""
        if self._index is None:
            self._index = self._shards()
        return self._index

    def _shards(self) -> list[Shard]:
        value, n = self.weights(self.owner, self.term, self.count, len(self.rows)), np.bincount(self.owner, minlength=len(self.rows))
        first, shards = np.cumsum(n) - n, []
        groups = bisected(outline(self.owner, self.term, value, len(self.rows)), n, 2048, 1 << 20, np.inf) if len(self.rows) else []
        for own in groups:
            at = spans(first[own], n[own])
            by = np.argsort(self.term[at], kind="stable")
            shards.append(Shard(self.rows[own], np.repeat(np.arange(len(own)), n[own])[by], self.term[at][by], value[at][by], len(self.vocabulary)))
        return shards

    def __getstate__(self) -> bytes:
        """Postings travel compactly; the executors build the index of them."""
        kept = {k: v for k, v in self.__dict__.items() if k != "_index"}
        kept |= {"owner": self.owner.astype(np.int32), "term": self.term.astype(np.int32), "count": self.count.astype(np.float32)}
        raw = pickle.dumps(kept, protocol=5)
        return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)

    def __setstate__(self, state: bytes) -> None:
        kept = pickle.loads(pa.decompress(state[8:], int.from_bytes(state[:8], "little"), codec="zstd", asbytes=True))
        self.__dict__.update(kept | {"_index": None})

    def weights(self, owner: np.ndarray, term: np.ndarray, count: np.ndarray, rows: int) -> np.ndarray:
        """Unit TF-IDF vectors, pair by pair."""
        w = (1 + np.log(count.astype(float))) * self.gain[term]
        norm = np.sqrt(np.bincount(owner, w * w, rows))
        return w / np.where(norm > 0, norm, 1)[owner]

    def votes(self, owner: np.ndarray, term: np.ndarray, count: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vote, nearest examples or -1, cosines) of `rows` texts; pairs come in the order of rows."""
        w = self.weights(owner, term, count, rows)
        known = w > 0
        owner, term, w = owner[known], term[known], w[known]
        n = np.bincount(owner, minlength=rows)
        q = Queries.placed(np.arange(rows)[n > 0], n[n > 0], term, w)
        best = Best(len(q.ids), NEIGHBOURS)
        for shard in self.shards:
            search_shard(shard, q, best)
        who, sims = np.full((rows, NEIGHBOURS), -1), np.zeros((rows, NEIGHBOURS))
        who[q.ids] = np.where(best.score > 0, best.doc, -1)
        sims[q.ids] = best.score
        near = np.where(who >= 0, 1 / (1.05 - np.minimum(sims, 1.0)), 0.0)
        heard = near.sum(1)
        return np.where(heard > 0, (near * np.append(self.labels, 0)[who]).sum(1) / np.where(heard > 0, heard, 1), np.nan), who, sims

    def terms(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, count) of whole texts for the terms that some example has."""
        owner, code, words = words_of(texts)
        if not len(owner) or not len(self.vocabulary):
            return (np.empty(0, np.int64),) * 2 + (np.empty(0),)
        row, word, count = summed(owner, code, np.ones(len(owner)), len(words))
        rows, found, counts = [], [], []
        for spelled in (words, *beginnings(words)):
            place = pc.fill_null(pc.index_in(spelled, self.vocabulary, skip_nulls=True), -1).to_numpy()[word]
            hit = place >= 0
            rows.append(row[hit])
            found.append(place[hit].astype(np.int64))
            counts.append(count[hit])
        return summed(np.concatenate(rows), np.concatenate(found), np.concatenate(counts), len(self.vocabulary))

    def score(self, texts: pa.Array) -> tuple[np.ndarray, list[list[int]], list[list[float]]]:
        """Calibrated scores, ids of the nearest examples, their cosines."""
        vote, who, sims = self.votes(*self.terms(texts), len(texts))
        if self.steps:
            xs, ys = zip(*self.steps, strict=True)
            vote = np.interp(vote, xs, ys)
        score = np.clip(np.where(np.isnan(vote), self.base, vote), 0, 1)
        shown = who[:, :EVIDENCE]
        ids = [[int(self.ids[i]) for i in row if i >= 0] for row in shown]
        return score, ids, [[float(s) for s in row[: len(i)]] for row, i in zip(sims, ids, strict=True)]


def isotonic(votes: list[tuple[float, int, float]]) -> list[tuple[float, float]]:
    """Pool-adjacent-violators fit of the label on the vote: (vote, probability) in ascending order."""
    pools: list[list[float]] = []
    for x, y, w in sorted(votes):
        pools.append([w, w * y, x * w])
        while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0] - 1e-12:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return [(p[2] / p[0], p[1] / p[0]) for p in pools]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_id, _y, terms, counts, band keys of labelled texts."""
    for b in batches:
        for part in slices(b, 1, 512, 1 << 22):
            owner, code, words = words_of(part.column(1))
            spelled = pa.concat_arrays([words, *beginnings(words)]) if len(words) else pa.array([], pa.large_string())
            coded = spelled.dictionary_encode()
            number = pc.fill_null(coded.indices, -1).to_numpy().reshape(len(BEGINNINGS) + 1, -1)[:, code] if len(words) else np.empty((1, 0), np.int64)
            who = np.tile(owner, len(number))
            ok = number.ravel() >= 0
            row, term, count = summed(who[ok], number.ravel()[ok].astype(np.int64), np.ones(ok.sum()), max(1, len(coded.dictionary)))
            offsets = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32))
            named = coded.dictionary.take(pa.array(term)).cast(pa.string())
            keys = band_keys(part.column(1).to_pylist(), 3, BANDS, ROWS)
            cuts = pa.array(np.arange(0, (part.num_rows + 1) * BANDS, BANDS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.ListArray.from_arrays(offsets, named), pa.ListArray.from_arrays(offsets, pa.array(count.astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(keys.ravel()))],
                ["_id", "_y", "terms", "counts", "keys"],
            )


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> Voter:
    """Index at most per_class labelled training documents of either class (see labelled_sample).

    Terms are words and their beginnings; all terms of the examples are kept, weighted as in `gains`. Texts are
    counted on the executors; the driver holds the examples' terms and counts.
    """
    rows, counts = labelled_sample(docs, labels, "toxic", per_class)
    got = rows.mapInArrow(_counted, "_id long, _y int, terms array<string>, counts array<int>, keys array<long>").orderBy("_id").toArrow()
    lists = [got[c].combine_chunks() if got.num_rows else pa.array([], got[c].type) for c in ("terms", "counts", "keys")]
    keys = lists[2].flatten().to_numpy().reshape(got.num_rows, BANDS)
    examples = Examples(got["_id"].to_pylist(), got["_y"].to_pylist(), lists[0], lists[1], keys)
    del got, lists, keys
    give_back()
    model = Voter(examples, counts)
    del examples
    give_back()
    return model


def score(docs: DataFrame, model: Voter, text_col: str = "text") -> DataFrame:
    """docs with toxic_score, evidence_ids, evidence_cosines (up to three nearest examples) appended.

    Null and empty texts, and those without a term of any example, get the share of toxic documents among the
    labelled ones and no evidence. Equally near examples: the smaller id first. Equal texts get equal scores; clashing
    columns are replaced. No row moves between partitions; long texts are taken in slices of bounded bytes.
    """
    new = ["toxic_score", "evidence_ids", "evidence_cosines"]
    rest = docs.drop(*new)
    at, names = rest.columns.index(text_col), [*rest.columns, *new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, at, 1024, 1 << 22):
                value, ids, sims = model.score(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(value), pa.array(ids, pa.list_(pa.int64())), pa.array(sims, pa.list_(pa.float64()))], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    return rest.mapInArrow(run, f"{schema}, toxic_score double, evidence_ids array<long>, evidence_cosines array<double>")


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence for every document (null ids: held_out null)."""
    model = fit(docs, labels)
    out = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return out.select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= LEVEL).cast("int").alias("predicted"), "evidence_ids", "evidence_cosines",
    )
