"""Fill-in-middle transformation: two cuts a text, found on a run-length encoding of its character classes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a text is cut into: "codepoint" (single code points) or "word" (maximal runs of white space or of anything else).
UNITS = ("codepoint", "word")
#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes that are classed at a time.
BLOCK = 1 << 22
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


@dataclass
class Runs:
    """Maximal runs of one class, over the texts of a batch end to end.

    unit and byte: units and bytes before a run; width: bytes of one of its units; texts: units before each text,
    and in all.
    """

    unit: np.ndarray
    byte: np.ndarray
    width: np.ndarray
    texts: np.ndarray

    def locate(self, units: np.ndarray) -> np.ndarray:
        """Byte positions of unit positions: binary search for the run, then arithmetic within it."""
        if not len(self.unit):
            return np.zeros(len(units), np.int64)
        run = np.searchsorted(self.unit, units, side="right") - 1
        return self.byte[run] + (units - self.unit[run]) * self.width[run]


def _block(data: np.ndarray, at: int, fresh: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Position and class of each run of a block that starts at byte `at`; fresh are the starts of texts in it."""
    if unit == "word":
        kind = _SPACE[data].astype(np.uint8)
        first = np.ones(len(data), bool)
        first[1:] = kind[1:] != kind[:-1]
        first[fresh - at] = True
        pos = np.flatnonzero(first)
        return pos + at, kind[pos].astype(np.int64)
    lead = (data & 0xC0) != 0x80
    lead[fresh - at] = True
    pos = np.flatnonzero(lead)
    width = np.diff(np.append(pos, len(data)))
    first = np.ones(len(pos), bool)
    first[1:] = width[1:] != width[:-1]
    first[np.searchsorted(pos, fresh - at)] = True
    return pos[first] + at, width[first]


def encode_runs(data: np.ndarray, offsets: np.ndarray, unit: str = "codepoint") -> Runs:
    """Run-length class encoding of texts: text i is the UTF-8 in data[offsets[i]:offsets[i + 1]], offsets[0] is 0.

    A unit "codepoint" starts at every byte but continuation bytes, and its class is its width. A unit "word" is a
    whole run. Bytes are classed block by block; a block ends before a unit, and runs that a block's end cut in two
    are joined again.
    """
    starts, total = np.unique(offsets[:-1][np.diff(offsets) > 0]), int(offsets[-1])
    found, at = [], 0
    while at < total:
        end = min(at + BLOCK, total)
        while unit == "codepoint" and end < total and data[end] & 0xC0 == 0x80:
            end += 1
        fresh = starts[np.searchsorted(starts, at) : np.searchsorted(starts, end)]
        found.append(_block(data[at:end], at, fresh, unit))
        at = end
    pos = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
    kind = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
    new = np.ones(len(pos), bool)
    new[1:] = (kind[1:] != kind[:-1]) | np.isin(pos[1:], starts, assume_unique=True)
    pos, kind = pos[new], kind[new]
    size = np.diff(np.append(pos, total))
    width = size if unit == "word" else kind
    units = np.concatenate(([0], np.cumsum(np.ones_like(size) if unit == "word" else size // np.maximum(width, 1))))
    return Runs(units[:-1], pos, width, units[np.searchsorted(pos, offsets)])


def _cuts(unit: str):
    def cuts(text: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        text = text.cast(pa.large_binary())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        runs = encode_runs(data, offsets - offsets[0], unit)
        n, base = np.diff(runs.texts), offsets[:-1] - offsets[0]
        a, b = (h.to_numpy(zero_copy_only=False) % (n + 1) for h in (one, two))
        low, high = np.minimum(a, b), np.maximum(a, b)
        # a cut at the very end of a text lies where the next one starts
        where = [np.where(c == n, np.diff(offsets), runs.locate(runs.texts[:-1] + c) - base) for c in (low, high)]
        return pa.StructArray.from_arrays([pa.array(x) for x in (n, low, high, *where)], ["n", "low", "high", "low_byte", "high_byte"])

    return F.arrow_udf(cuts, "n long, low long, high long, low_byte long, high_byte long")


def _hashes(key: Column, seed: int) -> list[Column]:
    """The first four 8-digit groups of the hex sha256 of "seed:key" as integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "codepoint", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """docs with n, form, prefix_units, middle_units and output.

    A text has n units. Two cuts, drawn from the hash of seed and id, part it into prefix, middle and suffix:
    the first after min(h1 % (n + 1), h2 % (n + 1)) units, the second after the larger. The text's bytes are classed
    once (encode_runs); a cut's byte is found by binary search among the runs. Python returns only the cuts; texts are
    cut and put together in the JVM.

    form is "plain" (output is the text) for empty texts, texts with one of MARKS, and plain_percent of the others by
    h3; else "spm" (suffix, prefix, middle) for spm_percent by h4, or "psm" (prefix, suffix, middle). prefix_units and
    middle_units are null for plain.

    Null texts count as empty. Null ids are hashed as an empty id. Rows of the same id have the same hash, so repeated
    rows come out alike. Extra columns stay, whatever their names, except that those called as a new one are replaced.
    A task holds one batch of texts and their runs.
    """
    if unit not in UNITS:
        raise ValueError(f"unit {unit!r}: one of {UNITS}")
    new = ["n", "form", "prefix_units", "middle_units", "output"]
    keep = [c for c in docs.columns if c not in new]
    h1, h2, h3, h4 = _hashes(F.col("id"), seed)
    # the caller's columns travel as one, so that no name of theirs meets a name used here
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    base = docs.select(row.alias("row"), F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    cut = base.withColumn("cut", _cuts(unit)(F.col("text"), h1, h2))
    marked = F.contains("text", F.lit(MARKS[0])) | F.contains("text", F.lit(MARKS[1])) | F.contains("text", F.lit(MARKS[2]))
    form = F.when((F.col("text") == "") | marked | (h3 % 100 >= 100 - plain_percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    raw, low, high = F.col("text").cast("binary"), F.col("cut.low_byte").cast("int"), F.col("cut.high_byte").cast("int")
    part = lambda start, size: F.substring(raw, start + 1, size)
    prefix, middle, suffix = part(F.lit(0), low), part(low, high - low), part(high, F.octet_length("text") - high)
    p, s, m = (F.lit(x).cast("binary") for x in MARKS)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle).cast("string")).otherwise(F.concat(p, prefix, s, suffix, m, middle).cast("string"))
    moved = F.col("form") != "plain"
    return cut.withColumn("form", form).select(
        *[F.col("row")[c].alias(c) for c in keep], F.col("cut.n").alias("n"), "form",
        F.when(moved, F.col("cut.low")).alias("prefix_units"), F.when(moved, F.col("cut.high") - F.col("cut.low")).alias("middle_units"), output.alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text an output was made from. Exact: a moved text holds none of MARKS, so each mark is found once."""
    parts = F.split(output, "|".join(MARKS), 4)
    first, second, middle = (F.get(parts, i) for i in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "spm", F.concat(second, middle, first)).otherwise(F.concat(first, middle, second))
