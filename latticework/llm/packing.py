"""Packing tokenized documents into sequences along a space-filling curve."""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, stored_bytes

#: Dimensions of the projected document vectors and bits of the curve for each.
DIMS, BITS = 4, 15
#: Stored bytes of ids that a range of the curve holds at most on average.
RANGE_BYTES = 1 << 24
#: Tokens of a row at most: long documents travel in parts, so that ranges of as many rows are of about as many bytes.
PIECE = 4096


class Tokenizer:
    """Byte-level BPE ids of whole texts, as little-endian unsigned integers of `width` bytes.

    Equals the `tokenizers` library on the JSON file: a space followed by anything but white space always
    starts a pre-token, so a text without other spaces is the concatenation of its space-led pieces. The distinct
    pieces of a batch are encoded in one call and put together by numpy. Other texts, and those with a special
    token's name, are encoded whole.
    """

    _OTHER = re.compile(r" (?:\s|\Z)")

    def __init__(self, json_path: str, ranks_path: str, pattern: str, special: str = "<|endoftext|>"):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._json, self._full, self._special = json_path, None, special
        self.width = 2 if len(ranks) < 65536 else 4
        self.type = np.dtype(f"<u{self.width}")
        self._bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self._bytes[i] = len(token)

    def _whole(self, text: str) -> bytes:
        if self._special in text:
            if self._full is None:
                from tokenizers import Tokenizer as Full

                self._full = Full.from_file(self._json)
            return np.array(self._full.encode(text, add_special_tokens=False).ids, self.type).tobytes()
        return np.array(self._bpe.encode_ordinary(text), self.type).tobytes()

    def many(self, texts: list[str | None]) -> list[bytes]:
        out, later = [b""] * len(texts), []
        for i, t in enumerate(texts):
            if t and (self._special in t or self._OTHER.search(t)):
                out[i] = self._whole(t)
            elif t:
                later.append(i)
        if not later:
            return out
        lists = pc.split_pattern(pa.array([texts[i] for i in later], pa.large_string()), " ")
        starts = lists.offsets.to_numpy()
        # a text's first piece has no space before it and is encoded by itself
        follows = np.ones(len(lists.values), bool)
        follows[starts[:-1]] = False
        coded = lists.values.filter(pa.array(follows)).dictionary_encode()
        bounds, codes = starts - np.arange(len(starts)), coded.indices.to_numpy()
        blank = pa.scalar("", pa.large_string())
        pieces = pc.binary_join_element_wise(blank, coded.dictionary, pa.scalar(" ", pa.large_string()))
        ids = np.array(self._bpe.encode_ordinary("".join(pieces.to_pylist())), self.type)
        ends = np.cumsum(pc.binary_length(pieces).to_numpy())
        cuts = np.concatenate(([0], np.searchsorted(np.cumsum(self._bytes[ids]), ends) + 1))
        counts = np.diff(cuts)[codes]
        upto = np.concatenate(([0], np.cumsum(counts)))
        flat = ids[np.repeat(cuts[codes] - upto[:-1], counts) + np.arange(upto[-1])]
        for j, i in enumerate(later):
            head = texts[i].partition(" ")[0]
            out[i] = (self._whole(head) if head else b"") + flat[upto[bounds[j]] : upto[bounds[j + 1]]].tobytes()
        return out

    def __call__(self, text: str | None) -> bytes:
        return self.many([text])[0]


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert-curve positions of integer points (n x d, each below 2**bits): Gray-code transposition."""
    x = points.astype(np.int64).T.copy()
    d, q = len(x), 1 << (bits - 1)
    while q > 1:
        mask = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & mask)
            x[0] = np.where(high, x[0] ^ mask, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip = np.where(x[d - 1] & q, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _projection(n_ids: int) -> np.ndarray:
    return np.random.default_rng(11).standard_normal((n_ids, DIMS))


def _tokenize(paths: tuple[str, str, str], end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, table = Tokenizer(*paths), None
        end = np.array([end_id], tok.type).tobytes()
        for batch in batches:
            for part in slices(batch, 1, 4096, 1 << 23):
                ids = [x + end for x in tok.many(part.column(1).to_pylist())]
                if table is None:
                    table = _projection(1 << 16 if tok.width == 2 else 1 << 20)
                where = np.empty((len(ids), DIMS))
                for i, raw in enumerate(ids):
                    v = np.frombuffer(raw, tok.type)
                    where[i] = table[v if tok.width == 2 else v & np.uint32(len(table) - 1)].sum(0) / math.sqrt(len(v))
                spot = hilbert(((np.tanh(where / 4) + 1) / 2 * (2**BITS - 1)).astype(np.int64), BITS)
                step, keys = PIECE * tok.width, part.column(0).to_pylist()
                cut = [(k, c, at // tok.width, len(x) // tok.width, x[at : at + step]) for k, c, x in zip(keys, spot.tolist(), ids, strict=True) for at in range(0, len(x), step)]
                columns = [pa.array([r[i] for r in cut], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "curve", "start", "tokens", "ids"])

    return run


def powers(n: int) -> list[int]:
    """n as falling powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def _pack(length: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        seq, fill, held, done = 0, 0, [], []

        def out(rows: list) -> pa.RecordBatch:
            wide = [r[3] if width == 4 else np.frombuffer(r[3], "<u2").astype("<u4").tobytes() for r in rows]
            cols = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], wide, [r[4] for r in rows], [base + r[5] for r in rows], [r[6] for r in rows]]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("id", "start", "tokens")), batch.column("ids"), strict=True)
            for key, first, total, raw in rows:
                raw = raw.as_py()
                n, at = len(raw) // width, 0
                while at < n:
                    take = min(length - fill, n - at)
                    held.append((key, first + at, take, raw[at * width : (at + take) * width], total, seq, fill))
                    at, fill = at + take, fill + take
                    if fill == length:
                        done += held
                        held, seq, fill = [], seq + 1, 0
                if len(done) >= 2000:
                    yield out(done)
                    done = []
        # the last, open sequence of the partition is cut into sequences whose lengths are powers of two
        room, offset = powers(fill), 0
        for key, start, n, raw, total, _, _ in held:
            at = 0
            while at < n:
                take = min(room[0] - offset, n - at)
                done.append((key, start + at, take, raw[at * width : (at + take) * width], total, seq, offset))
                at, offset = at + take, offset + take
                if offset == room[0]:
                    room, seq, offset = room[1:], seq + 1, 0
        if done:
            yield out(done)

    return run


def pack(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of documents packed into sequences of `length` tokens along a Hilbert curve.

    1. One pass tokenizes each whole text (null: empty), appends end_id and places the document: its hashed
       token vector is projected to a few dimensions and located on the curve. Written to shared storage, long
       documents in parts.
    2. Rows are range-partitioned (in number by the bytes written) and sorted by (curve position, id, start), so
       neighbours on the curve are packed together; equal positions (copies) spread by id.
    3. Each partition fills sequences one after another, cutting documents where a sequence is full. The last
       sequence of a partition is split at powers of two, which need no padding. A task holds one batch of
       documents and one open sequence.

    Returns id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset. Repeated
    rows and equal texts are packed as often as they occur; null ids, which come first among equal positions, are packed
    like others. Extra columns are left behind, whatever their names. Empty table: empty result.
    """
    rows = materialize(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_tokenize((json_path, ranks_path, pattern), end_id), "id long, curve long, start long, tokens long, ids binary"))
    width = _width(ranks_path)
    # as many ranges as the ids fill, so that a task's share stays the same whatever the size of the corpus
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(stored_bytes(rows) / RANGE_BYTES))
    sorted_ = rows.repartitionByRange(n, "curve", "id", "start").sortWithinPartitions("curve", "id", "start", F.xxhash64("ids"))
    return sorted_.mapInArrow(_pack(length, width), "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def _width(ranks_path: str) -> int:
    with open(ranks_path, "rb") as f:
        return 2 if sum(1 for _ in f) < 65536 else 4
