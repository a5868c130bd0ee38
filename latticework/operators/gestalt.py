"""Gestalt-ratio joins: built-in upper bounds first, the exact ratio for the pairs that can matter, each text pair once."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import gestalt_ratio
from ..storage import written
from . import similarity as J

# Python functions of this module travel to executors by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def letter_counts(text: Column) -> Column:
    """How often each letter, digit and the space occur, and last how many characters are none of these."""
    each = [F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in _LETTERS]
    return F.array(*each, F.length(F.translate(text, _LETTERS, "")))


def length_bound(n: Column, m: Column) -> Column:
    """No two texts of n and m characters have a higher ratio; 1 for two empty ones."""
    return F.when(n + m == 0, 1.0).otherwise(2.0 * F.least(n, m) / (n + m))


def letter_bound(n: Column, m: Column, a: Column, b: Column) -> Column:
    """No two texts of these lengths and letter_counts have a higher ratio, whatever the order of their letters."""
    common = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda acc, x: acc + x)
    return F.when(n + m == 0, 1.0).otherwise(2.0 * common / (n + m))


def bounded(pairs: DataFrame, a: str, b: str, least: Column | float = 0.0) -> DataFrame:
    """pairs with `bound`, an upper bound on the ratio of texts a and b, where it is `least` or more.

    Lengths are compared first, letters only where those allow it. The letters of a text are counted once, before it
    meets its partners. Null texts are in no pair.
    """
    def counts(c: str, mark: str) -> DataFrame:
        return pairs.select(F.col(c)).where(F.col(c).isNotNull()).distinct().select(F.col(c).alias(f"_{mark}"), F.length(c).alias(f"_n{mark}"), letter_counts(F.col(c)).alias(f"_c{mark}"))

    got = pairs.join(counts(a, "a"), F.col(a) == F.col("_a")).join(counts(b, "b"), F.col(b) == F.col("_b"))
    short = length_bound(F.col("_na"), F.col("_nb"))
    bound = F.when(short >= least, letter_bound(F.col("_na"), F.col("_nb"), F.col("_ca"), F.col("_cb"))).otherwise(short)
    return got.withColumn("bound", bound).where(F.col("bound") >= least).select(*[F.col(f"`{c}`") for c in pairs.columns], "bound")


#: Texts of either side in a tile.
TILE = 4096, 32768
#: Pairs of a query and a group of texts that are looked at together.
FRONTIER = 1 << 18


def reaching(queries: DataFrame, directory: DataFrame) -> DataFrame:
    """k, e of the pairs of a block b whose texts may have a ratio of the query's `near` (same city) or `far` (other) and more.

    queries: k, b, city, form, far, near; directory: e, b, city, form; nothing but cities may be null. Both sides of a block
    are cut into tiles of bounded size by a hash; each two tiles meet once, on their own, wherever Spark puts them.
    Lengths and letters are bounded as in `bounded`, but for groups of texts with the same counts of some letters
    (letter_pairs), so that work grows with the groups close to a query and not with the pairs of texts.
    """
    def tiles(df: DataFrame, key: str, size: int, out: str) -> DataFrame:
        n = df.groupBy("b").agg(F.ceil(F.count("*") / size).alias("n"))
        return df.join(n, "b").groupBy("b", F.pmod(F.xxhash64(key, "form"), "n").alias("t"), "n").agg(F.collect_list(F.struct(*[c for c in df.columns if c != "b"])).alias(out))

    d = written(tiles(directory, "e", TILE[1], "ds"))
    met = tiles(queries, "k", TILE[0], "qs").drop("t", "n").join(d.select("b", "t"), "b")
    parts = max(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), d.count())
    both = met.repartition(parts, "b", "t").join(d.drop("n").repartition(parts, "b", "t"), ["b", "t"]).select("qs", "ds")
    return both.mapInArrow(_reached, f"k {queries.schema['k'].dataType.simpleString()}, e {directory.schema['e'].dataType.simpleString()}")


def _letters(forms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and letter_counts with a row for each letter."""
    n = pc.utf8_length(forms).to_numpy(zero_copy_only=False).astype(np.int32)
    each = np.stack([pc.count_substring(forms, c).to_numpy(zero_copy_only=False) for c in _LETTERS]).astype(np.int32)
    return n, np.concatenate([each, (n - each.sum(0))[None]])


def _apart(x: np.ndarray, y: np.ndarray) -> float:
    """Mean difference of a number of x and one of y, all from 15 on taken as 15."""
    x, y = (np.cumsum(np.bincount(np.minimum(v, 15), minlength=16)) / len(v) for v in (x, y))
    return float((x * (1 - y) + y * (1 - x)).sum())


def _spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers start[i], ..., start[i] + n[i] - 1 of every i, one after another."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def letter_pairs(n: np.ndarray, a: np.ndarray, own: np.ndarray, far: np.ndarray, near: np.ndarray, m: np.ndarray, c: np.ndarray, other: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (of n, of m) of the pairs with 2 * common letters >= least * (n + m), least being `near` in one city, else `far`.

    n, m: lengths; a, c: letter counts, a row for each letter; own, other: cities, those below 0 equal to none.
    Texts are sorted by city, length and letter after letter, those first that tell the sides apart best. Texts with
    the same values so far are a group. A query enters the parts of a group only while its common letters so far and
    the lesser rest of both may reach the level.
    """
    both = a.any(1) & c.any(1)
    order = sorted(np.flatnonzero(both), key=lambda x: -_apart(a[x], c[x]))
    keys = [other, m, c[both].sum(0), *c[order]]
    by, new = np.lexsort(keys[::-1]), np.arange(len(m)) == 0
    starts, values = [], []
    for key in keys:
        new[1:] |= np.diff(key[by]) != 0
        starts.append(np.flatnonzero(new))
        values.append(key[by][starts[-1]])
    # the parts of group i of a level are those from parts[level][i] on
    parts = [np.searchsorted(y, np.append(x, len(by))) for x, y in zip(starts, [*starts[1:], np.arange(len(by))], strict=True)]
    top, rest = starts[2], a[both].sum(0)
    city, length, left = other[by][top], m[by][top], values[2]
    step = max(1, FRONTIER // len(top))
    for i in range(0, len(n), step):
        q, g = (x.ravel() for x in np.meshgrid(np.arange(i, min(i + step, len(n))), np.arange(len(top)), indexing="ij"))
        least = np.where((own[q] == city[g]) & (own[q] >= 0), near[q], far[q]) * (n[q] + length[g]) / 2 - 5e-7
        can = np.minimum(rest[q], left[g]) >= least
        # depth first, so that little is open at a time: level, query, group, common letters missing, rests of both
        open_ = [(2, q[can], g[can], least[can], rest[q[can]], left[g[can]])]
        while open_:
            level, q, g, need, x, y = open_.pop()
            size = parts[level][g + 1] - parts[level][g]
            upto = np.cumsum(size)
            if len(q) > 1 and upto[-1] > FRONTIER:
                cut = min(max(1, int(np.searchsorted(upto, FRONTIER))), len(q) - 1)
                open_ += [(level, *(v[cut:] for v in (q, g, need, x, y))), (level, *(v[:cut] for v in (q, g, need, x, y)))]
                continue
            if not len(q):
                continue
            g, q = _spans(parts[level][g], size), np.repeat(q, size)
            if level + 1 == len(keys):
                yield q, by[g]
                continue
            mine, its = a[order[level - 2]][q], values[level + 1][g]
            need = np.repeat(need, size) - np.minimum(mine, its)
            x, y = np.repeat(x, size) - mine, np.repeat(y, size) - its
            can = np.minimum(x, y) >= need
            open_.append((level + 1, q[can], g[can], need[can], x[can], y[can]))


def _reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            q, d = (pa.Table.from_struct_array(b.column(j).slice(i, 1).flatten()).combine_chunks() for j in (0, 1))
            (n, a), (m, c) = _letters(q["form"].combine_chunks()), _letters(d["form"].combine_chunks())
            codes = pa.chunked_array([q["city"].combine_chunks(), d["city"].combine_chunks()]).combine_chunks().dictionary_encode().indices
            codes = pc.fill_null(codes, -1).to_numpy(zero_copy_only=False)
            for row, col in letter_pairs(n, a, codes[: len(n)], q["far"].to_numpy(), q["near"].to_numpy(), m, c, codes[len(n) :]):
                yield pa.RecordBatch.from_arrays([q["k"].combine_chunks().take(pa.array(row)), d["e"].combine_chunks().take(pa.array(col))], ["k", "e"])


def scored(pairs: DataFrame, a: str, b: str, out: str = "ratio") -> DataFrame:
    """pairs with the exact ratio of texts a and b; equal text pairs are scored once, all others run in Python once each."""
    texts = pairs.select(a, b).distinct().withColumn(out, gestalt_ratio(F.col(a), F.col(b)))
    return pairs.join(texts, [a, b])


def top_ratios(pairs: DataFrame, query_key: str, entity: str, a: str, b: str, top: int = 2, out: str = "ratio") -> DataFrame:
    """pairs with `out`: of each query at least the `top` pairs with the highest ratios, and all that tie with the last.

    1. The `top` pairs of a query with the highest bounds are scored; the lowest of these ratios is the query's floor.
    2. Pairs whose bound reaches the floor are scored as well. No other pair can be among the top.
    Pairs with a null text are left out.
    """
    got = written(bounded(pairs, a, b))
    order = Window.partitionBy(query_key).orderBy(F.desc("bound"), F.asc(entity))
    first = got.withColumn("_p", F.row_number().over(order)).where(F.col("_p") <= top)
    floor = scored(first.drop("_p"), a, b, "_r").groupBy(query_key).agg(F.min("_r").alias("_floor"), F.count("*").alias("_n"))
    floor = written(floor.withColumn("_floor", F.when(F.col("_n") < top, 0.0).otherwise(F.col("_floor"))).drop("_n"))
    return scored(got.join(floor, query_key).where(F.col("bound") >= F.col("_floor")).drop("_floor", "bound"), a, b, out)


def ratios_from(pairs: DataFrame, a: str, b: str, least: float, out: str = "ratio") -> DataFrame:
    """pairs with `out` where it is `least` or more; only pairs whose bound reaches that are scored."""
    return scored(bounded(pairs, a, b, least).drop("bound"), a, b, out).where(F.col(out) >= least)


def bigrams(text: Column) -> Column:
    """Neighbouring letters of a text, each with its number among equal ones: a set as large as the text has pairs."""
    pairs = F.when(F.length(text) > 1, F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.transform(pairs, lambda x, i: F.concat(x, F.size(F.filter(F.slice(pairs, F.lit(1), i + 1), lambda y: y == x)).cast("string")))


def close_names(queries: DataFrame, directory: DataFrame, query_key: str, entity: str, text: str, least: float = 0.92) -> DataFrame:
    """query_key, entity, ratio of all pairs with a ratio of `least` (above 2/3) or more, without any block.

    Texts of n and m letters with M matched ones in k runs share M - k bigrams, and k - 1 is at most the number of
    unmatched letters; so a ratio t leaves at least (1.5 t - 1)(n + m) - 1 shared bigrams. Pairs that may share so many
    are found by prefixes of rare bigrams (similarity.candidates); then the bounds above, then the exact ratio. Pairs
    too short to need a shared bigram can only be equal, and are joined as such. Keys must be unique; null texts are in no pair.
    """
    if least <= 2 / 3:
        raise ValueError("ratios of 2/3 and less need no common bigram")
    q, d = (df.select(F.col(k).alias(k), F.col(text).alias(t)).where(F.col(text).isNotNull()).withColumn("grams", bigrams(F.col(t))) for df, k, t in ((queries, query_key, "_qtext"), (directory, entity, "_etext")))
    sides, share = J.word_sides(q, d, query_key, entity, "grams"), 1.5 * least - 1
    # sizes are of bigrams, one less than letters each
    need = lambda n, m: (n + m + 2) * (share * (1 - J.SLACK)) - 1
    most = lambda n, left: F.floor((left + 1) / (share * (1 - J.SLACK)) - n - 2)
    longer = J.candidates(sides, need, most, lambda n: F.ceil((n + 1) * (least / (2 - least)) * (1 - J.SLACK)) - 1)
    longer = longer.select(F.col("qk").alias(query_key), F.col("ek").alias(entity)).join(q.drop("grams"), query_key).join(d.drop("grams"), entity)
    equal = q.drop("grams").join(d.drop("grams"), F.col("_qtext") == F.col("_etext"))
    pairs = longer.where("_qtext <> _etext").unionByName(equal)
    return ratios_from(pairs, "_qtext", "_etext", least).select(query_key, entity, "ratio")
