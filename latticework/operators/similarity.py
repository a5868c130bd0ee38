"""Set-similarity joins on words: prefixes of rare words, length and position bounds, then exact counts.

Both sides are seen through the words they have in common: a row's `left` is how many of them it has from a word on, in
the order of rising document frequency. Two sets whose first common word has `left` a and b share min(a, b) words at
most; a pair is looked at only where that can reach what is asked of it. Nothing bounds the length, number or frequency
of words, so rows of common words alone are compared exactly as well.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written


@dataclass
class WordSides:
    """queries and directory with n (distinct words) and shared (numbers of its words that occur on both sides, rarest first)."""

    queries: DataFrame
    directory: DataFrame
    query_key: str
    entity: str


def word_sides(queries: DataFrame, directory: DataFrame, query_key: str, entity: str, words: str = "words", block: str | None = None, directory_words: str | None = None) -> WordSides:
    """Both sides prepared for the joins below. Keys must be unique; rows without words take part in no pair.

    block names a column on both sides: only rows of equal blocks meet, and words are told apart by it. Words are
    ordered by how many directory rows have them, and numbered in this order. Each side is written once, in files as large
    as in memory, so that no side is broadcast for its small files.
    """
    def side(df: DataFrame, key: str, words: str) -> DataFrame:
        b = F.col(block) if block else F.lit(0)
        # explode_outer: for explode the words would be made once more to see whether there are any, and again for nulls
        each = df.select(F.col(key).alias("k"), b.alias("b"), F.array_distinct(words).alias("ws")).where("b IS NOT NULL")
        return each.select("k", "b", F.size("ws").alias("n"), F.explode_outer("ws").alias("w")).where("w IS NOT NULL")

    asked, known = side(queries, query_key, words), side(directory, entity, directory_words or words)
    # how many rows have a word is counted before anything is joined, so a word that all rows have is one row here
    frequency = written(known.groupBy("b", "w").agg(F.count("*").alias("f")).join(asked.select("b", "w").distinct(), ["b", "w"], "left_semi"), plain=True)
    # words go on as numbers that rise with f: of ranges in order, each row's number is above those before it
    order = ["f", "b", "w"]
    numbers = written(frequency.repartitionByRange(*order).sortWithinPartitions(*order).select("b", "w", F.monotonically_increasing_id().alias("i")), plain=True)

    def shared(df: DataFrame) -> DataFrame:
        got = df.join(numbers, ["b", "w"]).groupBy("k", "b", "n").agg(F.sort_array(F.collect_list("i")).alias("shared"))
        return written(got, plain=True)

    return WordSides(shared(asked), shared(known), query_key, entity)


def _positions(df: DataFrame, prefix: str) -> DataFrame:
    """One row for each word of a side, with left: how many of its shared words come from there on."""
    out = df.select("k", "b", "n", F.size("shared").alias("m"), F.posexplode("shared").alias("at", "w"))
    return out.select("b", "w", F.col("k").alias(f"{prefix}k"), F.col("n").alias(f"{prefix}n"), (F.col("m") - F.col("at")).alias(f"{prefix}left"))


def _class(n: Column) -> Column:
    """Class of a set's size: sets of one class differ by less than a factor of two."""
    return F.floor(F.log2(n.cast("double"))).cast("int")


def candidates(sides: WordSides, needed: Callable[[Column, Column], Column], most_n: Callable[[Column, Column], Column], least_n: Callable[[Column], Column], matches: int = 1, queries: DataFrame | None = None) -> DataFrame:
    """qk, ek of the pairs that may share needed(qn, en) words, once each; qn and en are the sizes of the sets.

    Of the words that a pair needs, all but `matches` - 1 may lie beyond its prefixes: a pair has `matches` words (or all
    it needs, if those are fewer) among those with left >= needed - matches + 1 on both sides, so these words are joined
    and pairs with fewer go. One match needs the shortest prefixes; more of them look at commoner words, but leave fewer pairs.

    least_n(qn) bounds the sizes that a query can meet from below, most_n(qn, left) from above where `left` words are to
    come. A word meets the size classes between them only: the class is part of the join's key, so common words, which
    come last and allow small sets only, do not meet the large ones. `queries` (qk and further columns that the
    bounds use) restricts the queries.
    """
    q = _positions(sides.queries, "q")
    if queries is not None:
        q = q.join(queries, "qk")
    qn, en = F.col("qn"), F.col("en")
    q = q.withColumn("low", F.greatest(least_n(qn), F.lit(1))).withColumn("high", F.least(most_n(qn, F.col("qleft") + matches - 1), F.lit(float(1 << 40))))
    q = q.where("low <= high").withColumn("c", F.explode(F.sequence(_class(F.col("low")), _class(F.col("high")))))
    e = _positions(sides.directory, "e").withColumn("c", _class(en))
    need = F.greatest(F.ceil(needed(qn, en)), F.lit(1))
    prefix = (en >= F.col("low")) & (F.least("qleft", "eleft") >= need - F.least(need, F.lit(matches)) + 1)
    met = q.join(e, ["b", "w", "c"]).where(prefix)
    if matches == 1:
        return met.select("qk", "ek").distinct()
    return met.groupBy("qk", "ek").agg(F.count("*").alias("met"), F.max(need).alias("need")).where(F.col("met") >= F.least("need", F.lit(matches))).select("qk", "ek")


def counted(sides: WordSides, pairs: DataFrame) -> DataFrame:
    """query_key, entity, n_query, n_entity, n_shared of pairs (qk, ek): exact numbers of distinct words."""
    q = sides.queries.select(F.col("k").alias("qk"), F.col("n").alias("n_query"), F.col("shared").alias("_qs"))
    e = sides.directory.select(F.col("k").alias("ek"), F.col("n").alias("n_entity"), F.col("shared").alias("_es"))
    got = pairs.join(q, "qk").join(e, "ek").withColumn("n_shared", F.size(F.array_intersect("_qs", "_es")))
    return got.where("n_shared > 0").select(F.col("qk").alias(sides.query_key), F.col("ek").alias(sides.entity), "n_query", "n_entity", "n_shared")


def jaccard_score() -> Column:
    return F.col("n_shared") / (F.col("n_query") + F.col("n_entity") - F.col("n_shared"))


#: Bounds are held a little wider than exact, so that rounding loses no pair; what is kept is decided on whole numbers.
SLACK = 1e-9


def _jaccard_bounds(t: Column) -> dict:
    """Bounds of pairs with a Jaccard similarity of t or more."""
    return {
        "needed": lambda q, e: (q + e) * (t / (1 + t)) * (1 - SLACK),
        "most_n": lambda q, left: left * ((1 + t) / t) * (1 + SLACK) - q,
        "least_n": lambda q: F.ceil(q * t * (1 - SLACK)),
    }


def jaccard_candidates(sides: WordSides, least: float, matches: int = 1) -> DataFrame:
    """Pairs that may reach a Jaccard similarity of `least` (above 0)."""
    return candidates(sides, **_jaccard_bounds(F.lit(float(least))), matches=matches)


def similar(sides: WordSides, least: float) -> DataFrame:
    """query_key, entity, n_query, n_entity, n_shared, score of all pairs with a Jaccard similarity of `least` or more."""
    return counted(sides, jaccard_candidates(sides, least)).withColumn("score", jaccard_score()).where(F.col("score") >= least)


def containing(sides: WordSides, least_words: int = 1) -> DataFrame:
    """query_key, entity, ... of all pairs whose entity has all words of the query, for queries of least_words or more.

    All words of such a query are shared ones, and an entity has its rarest: that word alone is looked up.
    """
    asked = sides.queries.where((F.col("n") >= least_words) & (F.size("shared") == F.col("n"))).select(F.col("k").alias("qk"))
    pairs = candidates(sides, lambda q, e: q, lambda q, left: F.when(left >= q, float(1 << 40)), lambda q: q, queries=asked)
    return counted(sides, pairs).where("n_shared = n_query")


def floors(sides: WordSides, queries: DataFrame, probe: int = 1) -> DataFrame:
    """qk, t: for each of queries (qk) the best similarity among the entities with one of its `probe` rarest shared words."""
    first = sides.queries.join(queries, F.col("k") == F.col("qk"), "left_semi").select("b", F.col("k").alias("qk"), F.explode(F.slice("shared", 1, probe)).alias("w"))
    some = first.join(_positions(sides.directory, "e"), ["b", "w"]).select("qk", "ek").distinct()
    return counted(sides, some).groupBy(F.col(sides.query_key).alias("qk")).agg(F.max(jaccard_score()).alias("t"))


def most_similar(sides: WordSides, levels: Sequence[float] = (0.6, 0.4, 0.27, 0.18, 0.12, 0.08, 0.055), matches: int = 4) -> DataFrame:
    """query_key, entity, score: the entity of the highest Jaccard similarity; of equal ones the smallest.

    Rounds of falling levels: a query whose best entity reaches the level is done, as all entities that reach it were
    compared; only the others go on. What is left after the last level joins with a floor of its own (`floors`). A round
    goes over all words of the directory, so a large one is served better without levels, at the price of more pairs.
    Exact for every query that shares a word with an entity; the others have no row.
    """
    left = written(sides.queries.where(F.size("shared") > 0).select(F.col("k").alias("qk")))
    found = []
    for level in (*levels, None):
        bound = queries = None
        if level is None:
            queries, bound = written(floors(sides, left)), F.col("t")
        pairs = candidates(sides, **_jaccard_bounds(F.lit(level) if bound is None else bound), matches=matches, queries=left if queries is None else queries)
        scored = counted(sides, pairs).withColumn("score", jaccard_score())
        best = F.struct((-F.col("score")).alias("s"), F.col(sides.entity).alias("e"))
        done = scored.where(F.col("score") >= (level or 0.0)).groupBy(sides.query_key).agg(F.min(best).alias("_b"))
        found.append(written(done.select(sides.query_key, F.col("_b.e").alias(sides.entity), (-F.col("_b.s")).alias("score"))))
        left = left.join(found[-1], F.col("qk") == F.col(sides.query_key), "left_anti")
        if level is not None:
            left = written(left)
            if left.isEmpty():
                break
    return reduce(DataFrame.unionByName, found)


def sharing(queries: DataFrame, directory: DataFrame, query_key: str, number: str, words: str = "words") -> DataFrame:
    """query_key, n: how many directory rows share a word with a query, without a row for each pair.

    number is a whole number of its own for each directory row, from 0 on and dense (order.numbered). A word's rows are
    bitmaps of 32,768 numbers; a query's bitmaps are joined by OR and counted. Words that no query has make no bitmap.
    """
    asked = queries.select(query_key, F.explode(F.array_distinct(words)).alias("w"))
    known = directory.select(F.col(number).alias("i"), F.explode(words).alias("w")).join(asked.select("w").distinct(), "w", "left_semi")
    maps = known.groupBy("w", F.expr("bitmap_bucket_number(i)").alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(i))").alias("m"))
    each = asked.join(maps, "w").groupBy(query_key, "part").agg(F.expr("bitmap_count(bitmap_or_agg(m))").alias("n"))
    return each.groupBy(query_key).agg(F.sum("n").alias("n"))
