"""Byte-level BPE: whole pre-tokens by a minimal perfect hash, the rest by merges taken from a heap."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

#: Keys per bucket of the perfect hash, and pilots tried at a time.
PER_BUCKET, TRIES = 3, 256
#: Pre-tokens that are looked up at a time where one text may have more.
PIECES = 1 << 18
#: Ids that are decoded at a time.
DECODED = 1 << 18
#: A space that need not start a pre-token (RE2).
SPACES = r" ([\s\x0b\x{85}\p{Z}]|\z)"
#: Misses a worker remembers, and the longest of them in bytes.
KEPT, LONGEST_KEPT = 1 << 18, 64


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit words spread over all of them (wraps around)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Minimal perfect hash of byte strings: n keys, n slots, one pilot a bucket.

    A key's bytes give a 64-bit value, which names its bucket; value and the bucket's pilot name its slot. Buckets
    are placed by falling size, each by the first pilot that sends its keys to free slots; a bucket of one key names its
    slot itself, as -1 - slot. Every slot holds a key, so `find` compares bytes: no other string passes.
    """

    def __init__(self, keys: list[bytes], values: np.ndarray):
        n = len(keys)
        self._n, self._buckets, self._longest = n, max(1, n // PER_BUCKET), max(map(len, keys), default=1)
        data, offsets = np.frombuffer(b"".join(keys), np.uint8), np.cumsum([0, *map(len, keys)])
        for seed in range(64):
            self._weights = np.random.default_rng(seed).integers(1, 1 << 63, self._longest, np.uint64) * np.uint64(2) + np.uint64(1)
            hashes = self._hash(data, offsets[:-1], np.diff(offsets))
            if len(np.unique(hashes)) == n and self._place(hashes):
                break
        else:
            raise ValueError("keys repeat")
        size = np.diff(offsets)[self._order]
        self._size, self._start = size, np.cumsum(size) - size
        self._bytes = np.frombuffer(b"".join(keys[i] for i in self._order), np.uint8)
        self._values = np.asarray(values)[self._order]

    def _hash(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        if not len(start):
            return np.zeros(0, np.uint64)
        first = np.cumsum(size) - size
        within = np.arange(int(size.sum())) - np.repeat(first, size)
        terms = (data[np.repeat(start, size) + within].astype(np.uint64) + np.uint64(1)) * self._weights[within]
        return _mixed(np.add.reduceat(terms, first))

    def _slot(self, hashes: np.ndarray, pilots: np.ndarray) -> np.ndarray:
        return (_mixed(hashes ^ (pilots.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(self._n)).astype(np.int64)

    def _place(self, hashes: np.ndarray) -> bool:
        bucket = ((hashes >> np.uint64(32)) % np.uint64(self._buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self._buckets + 1))
        sizes = np.diff(bounds)
        self._pilots, self._order, free = np.zeros(self._buckets, np.int64), np.full(self._n, -1, np.int64), np.ones(self._n, bool)
        for b in np.argsort(-sizes, kind="stable"):
            members = order[bounds[b] : bounds[b + 1]]
            if len(members) < 2:
                break
            for low in range(0, 1 << 22, TRIES):
                slots = self._slot(hashes[members][None, :], np.arange(low, low + TRIES)[:, None])
                ranked = np.sort(slots, 1)
                fits = np.flatnonzero(free[slots].all(1) & (ranked[:, 1:] != ranked[:, :-1]).all(1))
                if len(fits):
                    self._pilots[b], chosen = low + fits[0], slots[fits[0]]
                    self._order[chosen], free[chosen] = members, False
                    break
            else:
                return False
        single = np.flatnonzero(sizes == 1)
        left = np.flatnonzero(free)
        self._pilots[single] = -1 - left
        self._order[left] = order[bounds[single]]
        return True

    def find(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The value of each string data[start:start + size], or -1 for strings that are no key."""
        out = np.full(len(start), -1, np.int64)
        short = np.flatnonzero((size > 0) & (size <= self._longest)) if self._n else np.zeros(0, np.int64)
        if not len(short):
            return out
        start, size = start[short].astype(np.int64), size[short].astype(np.int64)
        hashes = self._hash(data, start, size)
        pilot = self._pilots[((hashes >> np.uint64(32)) % np.uint64(self._buckets)).astype(np.int64)]
        slot = np.where(pilot < 0, -1 - pilot, self._slot(hashes, np.maximum(pilot, 0)))
        same = np.flatnonzero(self._size[slot] == size)
        slot, start, size, short = slot[same], start[same], size[same], short[same]
        if len(same):
            first = np.cumsum(size) - size
            within = np.arange(int(size.sum())) - np.repeat(first, size)
            equal = self._bytes[np.repeat(self._start[slot], size) + within] == data[np.repeat(start, size) + within]
            hit = np.logical_and.reduceat(equal, first)
            out[short[hit]] = self._values[slot[hit]]
        return out


def _ranges(points: set[str]) -> str:
    """Code points as the inside of a character class."""
    codes, parts = sorted(map(ord, points)), []
    for c in codes:
        if parts and parts[-1][1] == c - 1:
            parts[-1][1] = c
        else:
            parts.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in parts)


def disputed(pattern: str) -> tuple[str, str, int]:
    """(class, pattern, least first byte in UTF-8): the code points that `regex` and the reference library put into different classes, as their
    Unicode versions differ, and the pattern with the library's classes. Texts without such code points need neither.

    Asked of the library in the driver: all code points go once through an encoding of bytes whose pattern is the class.
    """
    import regex
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single, points, strict = {bytes([b]): b for b in range(256)}, set(), pattern
    for name in sorted(set(regex.findall(r"\\p\{\w+\}|\\[sSwWdD]", pattern))):
        asked = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
        theirs, ours = set(asked.decode_bytes(asked.encode_ordinary(every)).decode()), set(regex.findall(name, every))
        if more := theirs - ours:
            strict = strict.replace(name, f"[{name}||[{_ranges(more)}]]")
        if less := ours - theirs:
            strict = strict.replace(name, f"[{name}--[{_ranges(less)}]]")
        points |= theirs ^ ours
    return (f"[{_ranges(points)}]" if points else ""), "(?V1)" + strict, min((p.encode()[0] for p in points), default=256)


class Vocabulary:
    """Ranks of byte strings with their perfect hash; what tasks need of a rank file, in a few flat arrays."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, space_led: bool = True):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no rank for the bytes {missing[:5]}")
        self.space_led, self.pattern = space_led, pattern
        self._disputed, self._strict, self._lead = disputed(pattern)
        keys = list(ranks)
        self._hash = PerfectHash(keys, np.array([ranks[k] for k in keys], np.int64))
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for key, rank in ranks.items():
            size[rank] = len(key)
        self._size, self._start = size, np.cumsum(size) - size
        self._bytes = np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), np.uint8)
        self._prepared = None

    @classmethod
    def from_file(cls, path: str, pattern: str, space_led: bool = True) -> Vocabulary:
        """A file of lines "base64 rank", read in the driver."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern, space_led)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_prepared": None}

    def _ready(self):
        """(usual pattern, strict pattern, search for disputed code points, ranks, short_ranks, remembered
        misses), made once in a worker."""
        if self._prepared is None:
            import regex

            raw = self._bytes.tobytes()
            ranks = {raw[s : s + n]: i for i, (s, n) in enumerate(zip(self._start.tolist(), self._size.tolist(), strict=True)) if n}
            rare = regex.compile(self._disputed).search if self._disputed else None
            self._prepared = regex.compile(self.pattern), regex.compile(self._strict), rare, ranks, short_ranks(ranks), {}
        return self._prepared

    def pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens end to end, and how many each has. Equal pre-tokens are looked up once."""
        coded = pa.array(pieces, pa.string()).dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy()
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        found = self._hash.find(data, offsets[:-1], np.diff(offsets))
        _, _, _, ranks, pairs, kept = self._ready()
        missed, parts = np.flatnonzero(found < 0), []
        for word in words.take(pa.array(missed)).to_pylist():
            ids = kept.get(word)
            if ids is None:
                ids = merged(word.encode(), ranks, pairs)
                if len(word) <= LONGEST_KEPT and len(kept) < KEPT:
                    kept[word] = ids
            parts.append(ids)
        counts = np.ones(len(words), np.int64)
        counts[missed] = np.fromiter(map(len, parts), np.int64, len(parts))
        single = np.repeat(found >= 0, counts)
        flat = np.empty(len(single), np.int32)
        flat[single] = found[found >= 0]
        flat[~single] = np.fromiter(chain.from_iterable(parts), np.int32, int(counts[missed].sum()))
        return _gathered(flat, counts, codes), counts[codes]

    def _split(self, texts: list[str], strict: bool) -> tuple[list[str], np.ndarray]:
        """Pre-tokens of texts end to end, and how many each has."""
        usual, exact, rare = self._ready()[:3]
        held, n = [], np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            found = (exact if strict and rare(text) else usual).findall(text)
            held += found
            n[i] = len(found)
        return held, n

    def _long(self, text: str, strict: bool) -> np.ndarray:
        """Ids of one text, whose pre-tokens are taken PIECES at a time."""
        usual, exact, rare = self._ready()[:3]
        matches, out = (m.group() for m in (exact if strict and rare(text) else usual).finditer(text)), []
        while part := list(islice(matches, PIECES)):
            out.append(self.pieces(part)[0])
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text (null: none).

        A space before anything but white space starts a pre-token, so a text without other spaces is the
        concatenation of its space-led chunks: each distinct chunk is matched and encoded once. Other texts are matched
        whole. (Vocabularies whose pattern does not split there say space_led=False: all texts are matched whole.)
        """
        texts = texts.cast(pa.large_string()).fill_null("")
        size = pc.binary_length(texts).to_numpy()
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer((texts.buffers()[2] if len(texts) else None) or b"", np.uint8)[offsets[0] : offsets[-1]]
        strict = bool(self._disputed) and bool((data >= self._lead).any())
        spaced = pc.match_substring_regex(texts, SPACES).to_numpy(zero_copy_only=False) if self.space_led else np.ones(len(texts), bool)
        long = size > PIECES
        chunked, whole = np.flatnonzero(~spaced), np.flatnonzero(spaced & ~long)
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        if len(chunked):
            lists = pc.split_pattern(texts.take(pa.array(chunked)), " ")
            starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            follows = np.ones(int(starts[-1]), np.int64)
            follows[starts[:-1]] = 0
            coded = lists.flatten().dictionary_encode()
            # a chunk with a space before it and the same at a text's start are two
            keys, codes = np.unique(coded.indices.to_numpy().astype(np.int64) * 2 + follows, return_inverse=True)
            chunks = [" " + c if k & 1 else c for c, k in zip(coded.dictionary.take(pa.array(keys >> 1)).to_pylist(), keys.tolist(), strict=True)]
            held, n = self._split(chunks, strict)
            ids, each = self.pieces(held) if held else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            counts = _summed_runs(each, n)
            flat, upto = _gathered(ids, counts, codes), np.concatenate(([0], np.cumsum(counts[codes])))[starts]
            for j, i in enumerate(chunked):
                out[i] = flat[upto[j] : upto[j + 1]]
        if len(whole):
            held, n = self._split(texts.take(pa.array(whole)).to_pylist(), strict)
            if held:
                ids, each = self.pieces(held)
                upto = np.concatenate(([0], np.cumsum(_summed_runs(each, n))))
                for j, i in enumerate(whole):
                    out[i] = ids[upto[j] : upto[j + 1]]
        for i in np.flatnonzero(spaced & long):
            out[i] = self._long(texts[int(i)].as_py(), strict)
        ends = np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out) if out else np.zeros(0, np.int32), pa.int32()))

    def decode(self, ids: pa.Array) -> pa.Array:
        """Bytes of each list of ids (null: none); ids outside the vocabulary raise."""
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        if len(flat) and not (flat.min() >= 0 and flat.max() < len(self._size) and (self._size[flat] > 0).all()):
            raise ValueError("ids outside the vocabulary")
        counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        # bytes are gathered for some ids at a time, as their positions take eight times their room
        data, sizes = [], np.empty(len(flat), np.int32)
        for at in range(0, len(flat), DECODED):
            part = flat[at : at + DECODED]
            sizes[at : at + len(part)] = size = self._size[part]
            before = np.cumsum(size) - size
            data.append(self._bytes[np.repeat(self._start[part] - before, size) + np.arange(int(size.sum()))])
        ends = np.concatenate(([0], np.cumsum(_summed_runs(sizes, counts)))).astype(np.int64)
        joined = np.concatenate(data) if data else np.zeros(0, np.uint8)
        return pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(joined)]).cast(pa.binary())


def _gathered(flat: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Segments of flat, with counts entries each, in the order of codes."""
    first, n = np.cumsum(counts) - counts, counts[codes]
    before = np.cumsum(n) - n
    return flat[np.repeat(first[codes] - before, n) + np.arange(int(n.sum()))]


def _summed_runs(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values, of the lengths given."""
    upto = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(lengths)
    return upto[ends] - upto[ends - lengths]


def short_ranks(ranks: dict[bytes, int]) -> tuple[list[int], list[int]]:
    """The rank of each byte, and that of each two bytes at 256 * first + second; -1 without one."""
    return [ranks.get(bytes([a]), -1) for a in range(256)], [ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]


def merged(piece: bytes, ranks: dict[bytes, int], pairs: tuple[list[int], list[int]]) -> tuple[int, ...]:
    """Ids of a pre-token: the neighbours whose joint rank is lowest are merged first, the leftmost of equal ones.

    Parts are a linked list over byte positions; joint holds each part's rank together with the next (-1: none), and a
    heap holds (rank, position), as one number, of all that were ever set: entries that no longer agree with joint are passed over.
    O(n log n) for n bytes.
    """
    n, get = len(piece), ranks.get
    shift, last = n.bit_length(), (1 << n.bit_length()) - 1
    single, pairs = pairs
    following, previous, ids = list(range(1, n + 1)), list(range(-1, n)), [single[a] for a in piece]
    joint = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]
    heap = [r << shift | i for i, r in enumerate(joint) if r >= 0]
    joint.append(-1)
    heapify(heap)
    while heap:
        top = heappop(heap)
        left, rank = top & last, top >> shift
        if joint[left] != rank:
            continue
        gone = following[left]
        right = following[left] = following[gone]
        joint[gone] = joint[left] = ids[gone] = -1
        ids[left] = rank
        if right < n:
            previous[right] = left
            rank = get(piece[left : following[right]])
            if rank is not None:
                joint[left] = rank
                heappush(heap, rank << shift | left)
        if left:
            before = previous[left]
            rank = get(piece[before:right])
            if rank is not None:
                joint[before] = rank
                heappush(heap, rank << shift | before)
            else:
                joint[before] = -1
    return tuple([i for i in ids if i >= 0])


def _slices(texts: pa.Array, most: int = 1 << 21) -> Iterator[pa.Array]:
    """Parts of an array of at most `most` bytes, unless one text has more."""
    upto = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + most, side="right")) - 1)
        yield texts.slice(at, end - at)
        at = end


def encoded(text: Column, vocabulary: Vocabulary) -> Column:
    """array<int>: BPE ids of a whole text; see encode."""

    def ids(texts: pa.Array) -> pa.Array:
        parts = [vocabulary.encode(part) for part in _slices(texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return F.arrow_udf(ids, "array<int>")(text)


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """docs with out_col: array<int> of the BPE ids of each whole text.

    1. The pattern splits a text into pre-tokens; each is encoded separately, no special token is known.
    2. Tier one: the distinct pre-tokens of some megabytes of text are looked up in the vocabulary's minimal perfect
       hash, all in one numpy pass, with a comparison of bytes. In natural text this resolves most of them.
    3. Tier two: a missed pre-token is merged from its bytes by a heap over a linked list (`merged`), O(n log n) in its
       length. A worker remembers up to 2^18 short ones (some 70 MB).

    The vocabulary (about 1 MB, bounded by the rank file) goes to the tasks with the code; nothing is shuffled. Null and
    empty texts have no ids; pre-tokens of any length are encoded whole. Repeated rows come out alike. Extra columns
    stay; a column called out_col is replaced.
    """
    return docs.withColumn(out_col, encoded(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), vocabulary))


def decode(df: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with out_col: the bytes that ids_col stands for (null: none). Inverse of encode for every valid text.

    Rows pass through Arrow as they are, so that ids made by `encode` are not made a second time for the decoder.
    Extra columns stay; a column called out_col is replaced.
    """
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c != out_col])
    names, at = df.columns, df.columns.index(ids_col)
    df = df.toDF(*[f"c{i}" for i in range(len(names))])  # any name may be the caller's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("decoded", vocabulary.decode(batch.column(at)))

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("decoded", BinaryType())])).toDF(*names, out_col)
