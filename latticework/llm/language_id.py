"""Language identification of code-switched text by a linear-chain conditional random field over words."""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import remainder, slices

#: Hashed feature space, byte n-gram lengths (word ends are bytes of their own: affixes are n-grams with one).
SPACE, GRAMS = 1 << 18, (2, 3, 4, 5)
#: Words of a language's lexicon; words to a training sequence; words to a lane of the parallel scan.
LEXICON, SEQUENCE, LANE = 200, 64, 128
UNKNOWN = "und"


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(code of each word, text of each word, distinct words): lower-cased letter runs of white-space tokens."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    coded = lists.values.dictionary_encode()
    letters = pc.replace_substring_regex(coded.dictionary, r"[^\p{L}]+", "")
    again = letters.dictionary_encode()
    words = [w.encode() for w in again.dictionary.to_pylist()]
    codes = again.indices.to_numpy()[coded.indices.to_numpy()] if len(coded) else np.empty(0, int)
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    full = np.array([bool(w) for w in words], bool)
    keep = full[codes] if len(codes) else np.empty(0, bool)
    return codes[keep], owner[keep], words


def word_features(words: list[bytes], lexicons: list[frozenset]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words one after another, and where each word's begin.

    Byte n-grams, the word itself, and membership in each language's lexicon.
    """
    wrapped = [b"\x02" + w + b"\x03" for w in words]
    raw = np.frombuffer(b"".join(wrapped), np.uint8).astype(np.uint64)
    size = np.array([len(w) for w in wrapped], np.int64)
    first = np.concatenate(([0], np.cumsum(size)))[:-1]
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(first + size, size) - np.arange(len(raw))
    ids, own = [], []
    h = np.zeros(len(raw), np.uint64)
    mult = np.uint64(0x100000001B3)
    for n in range(1, max(GRAMS) + 1):
        step = np.zeros(len(raw), np.uint64)
        step[: len(raw) - n + 1] = raw[n - 1 :]
        h = (h + step + np.uint64(n)) * mult
        h ^= h >> np.uint64(31)
        if n in GRAMS:
            ok = left >= n
            ids.append((((h[ok] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 18)).astype(np.int64)) & (SPACE - 1))
            own.append(owner[ok])
    whole = np.zeros(len(words), np.uint64)
    weight = np.power(np.uint64(0x100000001B3), (np.arange(len(raw)) - np.repeat(first, size)).astype(np.uint64))
    np.add.at(whole, owner, raw * weight)
    ids.append(((whole * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - 18)).astype(np.int64))
    own.append(np.arange(len(words)))
    for k, lexicon in enumerate(lexicons):
        hit = np.flatnonzero(np.fromiter((w in lexicon for w in words), bool, len(words)))
        ids.append(np.full(len(hit), SPACE + k, np.int64))
        own.append(hit)
    ids, own = np.concatenate(ids), np.concatenate(own)
    order = np.argsort(own, kind="stable")
    counts = np.bincount(own, minlength=len(words))
    return ids[order], np.concatenate(([0], np.cumsum(counts)))[:-1]


class Crf:
    """Emission weights by feature and language, and learned transitions between languages."""

    def __init__(self, languages: list[str], lexicons: list[frozenset]):
        self.languages, self.lexicons = languages, lexicons
        k = len(languages)
        self.weight, self.transition = np.zeros((SPACE + k, k), np.float32), np.zeros((k, k))

    def emissions(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.languages)))
        ids, first = word_features(words, self.lexicons)
        return np.add.reduceat(self.weight[ids], first, axis=0).astype(float)

    def train(self, pools: list[list[list[bytes]]], epochs: int = 3, rate: float = 0.3, seed: int = 5) -> None:
        """Maximise the conditional log-likelihood of spliced sequences by AdaGrad.

        A sequence is cut from documents of the pools: runs of 8 to 40 words, after each of which the language
        may change, so transitions are learned from text that switches.
        """
        k, rng = len(pools), random.Random(seed)
        vocabulary: dict[bytes, int] = {}
        coded = [[np.array([vocabulary.setdefault(w, len(vocabulary)) for w in doc], int) for doc in pool] for pool in pools]
        ids, first = word_features(list(vocabulary), self.lexicons)
        span = np.diff(np.append(first, len(ids)))
        total = sum(len(d) for pool in coded for d in pool)
        rows, labels = [], []
        for _ in range(max(8, total // SEQUENCE)):
            row, label, now = [], [], rng.randrange(k)
            while len(row) < SEQUENCE:
                doc = coded[now][rng.randrange(len(coded[now]))]
                at, n = rng.randrange(len(doc)), rng.randint(8, 40)
                part = doc[at : at + n].tolist()
                row += part
                label += [now] * len(part)
                if rng.random() < 0.3:
                    now = rng.randrange(k)
            rows.append(row[:SEQUENCE])
            labels.append(label[:SEQUENCE])
        x, y = np.array(rows), np.array(labels)
        seen, seen_t = np.full_like(self.weight, 1e-2), np.full((k, k), 1e-2)
        shuffle = np.random.default_rng(seed)
        for _ in range(epochs):
            order = shuffle.permutation(len(x))
            for at in range(0, len(x), 128):
                own = order[at : at + 128]
                used, inverse = np.unique(x[own], return_inverse=True)
                inverse = inverse.reshape(len(own), SEQUENCE)
                at_ids = np.concatenate([np.arange(first[w], first[w] + span[w]) for w in used])
                feats, starts = ids[at_ids], np.concatenate(([0], np.cumsum(span[used])))[:-1]
                e = np.add.reduceat(self.weight[feats], starts, axis=0).astype(float)[inverse]
                post, pair = self._rectangular(e)
                miss = np.eye(k)[y[own]] - post
                by_word = np.stack([np.bincount(inverse.ravel(), miss[..., c].ravel(), len(used)) for c in range(k)], 1) / len(own)
                spread = np.repeat(by_word, span[used], axis=0)
                rows_, back = np.unique(feats, return_inverse=True)
                grad = np.stack([np.bincount(back, spread[:, c], len(rows_)) for c in range(k)], 1)
                seen[rows_] += grad**2
                self.weight[rows_] += rate * 0.2 * grad / np.sqrt(seen[rows_])
                true = np.zeros((k, k))
                np.add.at(true, (y[own][:, :-1].ravel(), y[own][:, 1:].ravel()), 1)
                g = (true - pair) / len(own)
                seen_t += g**2
                self.transition += rate * g / np.sqrt(seen_t)

    def _rectangular(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors and expected transitions of equally long sequences, e of shape (n, length, languages)."""
        n, length, k = e.shape
        m, t = np.exp(e - e.max(2, keepdims=True)), np.exp(self.transition)
        a, b = np.empty_like(m), np.ones_like(m)
        a[:, 0] = m[:, 0] / m[:, 0].sum(1, keepdims=True)
        for i in range(1, length):
            v = (a[:, i - 1] @ t) * m[:, i]
            a[:, i] = v / v.sum(1, keepdims=True)
        for i in range(length - 2, -1, -1):
            v = (b[:, i + 1] * m[:, i + 1]) @ t.T
            b[:, i] = v / v.sum(1, keepdims=True)
        post = a * b
        post /= post.sum(2, keepdims=True)
        both = a[:, :-1, :, None] * t * (b[:, 1:] * m[:, 1:])[:, :, None, :]
        both /= both.sum((2, 3), keepdims=True)
        return post, both.sum((0, 1))

    def posteriors(self, e: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Forward-backward marginals of every word; owner (ascending) says which chain a word belongs to.

        Chains are cut into lanes of LANE words. The lanes' transfer matrices are multiplied side by side,
        joined along each chain, and all lanes are then run from their true first messages: the result is
        exact for chains of any length.
        """
        n, k = e.shape
        m, t = np.exp(e - e.max(1, keepdims=True)), np.exp(self.transition - self.transition.max())
        new = np.flatnonzero(np.diff(owner, prepend=-1))
        size = np.diff(np.append(new, n))
        lanes = -(-size // LANE)
        chain = np.repeat(np.arange(len(new)), lanes)
        number = np.arange(len(chain)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = new[chain] + number * LANE
        length = np.minimum(LANE, new[chain] + size[chain] - start)
        order = np.argsort(-length, kind="stable")
        start, length, chain, number = start[order], length[order], chain[order], number[order]
        active = [int(np.searchsorted(-length, -i, side="left")) for i in range(LANE)]  # lanes longer than i
        place = np.empty(len(order), int)
        place[order] = np.arange(len(order))
        offset = np.cumsum(lanes) - lanes
        # transfer matrices of lanes in chains of several lanes
        several = lanes[chain] > 1
        matrix = np.broadcast_to(np.eye(k), (len(order), k, k)).copy()
        for i in range(LANE):
            on = np.flatnonzero(several[: active[i]])
            if not len(on):
                break
            p = (matrix[on] @ t) * m[start[on] + i][:, None, :]
            matrix[on] = p / p.sum((1, 2), keepdims=True)
        head, tail = np.full((len(order), k), 1.0 / k), np.ones((len(order), k))
        for j in range(1, int(lanes.max(initial=1))):
            c = np.flatnonzero(lanes > j)
            v = np.einsum("nk,nkl->nl", head[place[offset[c] + j - 1]] @ np.eye(k), matrix[place[offset[c] + j - 1]])
            head[place[offset[c] + j]] = v / v.sum(1, keepdims=True)
        for j in range(int(lanes.max(initial=1)) - 2, -1, -1):
            c = np.flatnonzero(lanes > j + 1)
            v = np.einsum("nkl,nl->nk", matrix[place[offset[c] + j + 1]], tail[place[offset[c] + j + 1]])
            tail[place[offset[c] + j]] = v / v.sum(1, keepdims=True)
        a = np.empty((n, k))
        v = head
        for i in range(LANE):
            c = active[i]
            if not c:
                break
            # the first word of a chain has no word before it: a uniform message
            w = v[:c] @ t
            if i == 0:
                w = np.where((number == 0)[:c, None], 1.0, w)
            w = w * m[start[:c] + i]
            v = w / w.sum(1, keepdims=True)
            a[start[:c] + i] = v
        b = np.empty((n, k))
        v = tail.copy()
        for i in range(LANE - 1, -1, -1):
            c = active[i]
            at = start[:c] + i
            b[at] = v[:c]
            w = (v[:c] * m[at]) @ t.T
            v[:c] = w / w.sum(1, keepdims=True)
        post = a * b
        return post / post.sum(1, keepdims=True)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language with the largest mean posterior over a text's words, and that mean."""
        n, k = len(texts), len(self.languages)
        codes, owner, words = word_codes(texts)
        if not len(codes) or not k:
            return [UNKNOWN] * n, np.zeros(n)
        post = self.posteriors(self.emissions(words)[codes], owner)
        count = np.bincount(owner, minlength=n)
        share = np.stack([np.bincount(owner, post[:, c], n) for c in range(k)], 1) / np.maximum(count, 1)[:, None]
        best = share.argmax(1)
        return [self.languages[b] if c else UNKNOWN for b, c in zip(best, count, strict=True)], np.where(count > 0, share[np.arange(n), best], 0.0).clip(0, 1)


def fit(docs: DataFrame, per_language: int = 150, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Crf:
    """Train on at most per_language documents of each language, the first by a hash of the id.

    Rows whose crc32(id) mod 3 is 1, with a null language, or without a letter, are not used; rows that repeat an id and
    language count as one. Combining marks and other signs that are no letters are not part of a word.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text"))
    fits = rows.where(F.col("_lang").isNotNull() & (remainder("_id", 3) != 1) & F.col("_text").rlike("\\p{L}"))
    first = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    chosen = fits.select("_id", "_lang").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= per_language).drop("_n")
    got = fits.join(F.broadcast(chosen.distinct()), ["_id", "_lang"]).dropDuplicates(["_id", "_lang"]).select("_lang", "_id", "_text").collect()
    by: dict[str, list[list[bytes]]] = {}
    for r in sorted(got, key=lambda r: (r["_lang"], str(r["_id"]))):
        codes, _, words = word_codes(pa.array([r["_text"]]))
        if len(codes):
            by.setdefault(r["_lang"], []).append([words[c] for c in codes])
    languages = sorted(by)
    lexicons = [frozenset(w for w, _ in Counter(x for d in by[lang] for x in d).most_common(LEXICON)) for lang in languages]
    model = Crf(languages, lexicons)
    if languages:
        model.train([by[x] for x in languages])
    return model


def identify(docs: DataFrame, model: Crf, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and lang_score appended (clashing names are replaced).

    Null texts and texts without a letter are `und` with score 0. Equal texts get equal answers. No row moves.
    """
    rest = docs.drop("lang_pred", "lang_score")
    at, names = rest.columns.index(text_col), [*rest.columns, "lang_pred", "lang_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, at, 4096, 1 << 22):
                lang, score = model.predict(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score)], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    return rest.mapInArrow(run, f"{schema}, lang_pred string, lang_score double")


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document (null ids: held_out null)."""
    model = fit(docs)
    out = identify(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
