"""Exact percentiles by histograms that narrow the interval holding a rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

#: Bins of a pass, for each rank that is looked for.
BINS = 1024


def exact_percentiles(df: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str] = (), bins: int = BINS) -> DataFrame:
    """by and `percentiles`, an array: linearly interpolated percentiles of the non-null values of each group.

    A percentile lies between the values of two ranks. A pass counts the values of each rank's interval in `bins` bins and
    keeps, of the bin that holds the rank, its smallest and largest value: the next interval. An interval of one value is
    the answer, so passes end after a few, copies of one value or not; doubles cannot be cut in more than eight times
    1,024. A pass reads df once and shuffles at most `bins` counts for each rank and task; no task ever holds the
    values of a group. NaN counts as larger than any other value. Groups without a value have no row; null keys are a
    group of their own.
    """
    keys = [f"g{i}" for i in range(len(by))] or ["g0"]
    columns = [F.col(c) for c in by] or [F.lit(0)]
    rows = df.select(*[c.alias(k) for c, k in zip(columns, keys, strict=True)], F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    sizes = written(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    at = F.array(*[F.lit(float(p)) for p in probabilities])
    ranks = sizes.withColumn("at", F.explode(F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(F.floor(p * (F.col("n") - 1)), F.ceil(p * (F.col("n") - 1))))))))
    open_, solved = written(ranks.select(*keys, "at", F.lit(0).cast("long").alias("before"), "lo", "hi")), None
    while True:
        done = open_.where(F.col("lo") == F.col("hi")).select(*keys, "at", F.col("lo").alias("v"))
        solved = done if solved is None else solved.unionByName(done)
        left = open_.where(F.col("lo") != F.col("hi"))
        if left.isEmpty():
            break
        open_ = written(_narrowed(rows, left, keys, bins))
    known = solved.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m"))
    found = _joined(sizes.select(*keys, "n"), known, keys)

    def between(p: Column) -> Column:
        r = p * (F.col("n") - 1)
        low, high = F.element_at("m", F.floor(r)), F.element_at("m", F.ceil(r))
        return F.when(low == high, low).otherwise(low + (high - low) * (r - F.floor(r)))

    return found.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=False)], F.transform(at, between).alias("percentiles"))


def _narrowed(rows: DataFrame, left: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """The intervals of `left`, each cut down to the values of the bin that holds its rank."""
    each = left.groupBy(*keys).agg(F.collect_list(F.struct("at", "before", "lo", "hi")).alias("open"))
    met = _joined(rows, each, keys).select(*keys, "v", F.explode(F.filter("open", lambda o: (F.col("v") >= o["lo"]) & (F.col("v") <= o["hi"]))).alias("o"))
    # halves, so that no difference overflows; bins rise with values
    share = (F.col("v") / 2 - F.col("o.lo") / 2) / (F.col("o.hi") / 2 - F.col("o.lo") / 2)
    cell = F.when(F.col("v") == F.col("o.lo"), 0).when(F.col("v") == F.col("o.hi"), bins - 1).otherwise(F.least(F.floor(F.coalesce(F.nanvl(share, F.lit(0.0)), F.lit(0.0)) * bins), F.lit(bins - 1)))
    counts = met.groupBy(*keys, F.col("o.at").alias("at"), F.col("o.before").alias("base"), cell.cast("int").alias("cell")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    so_far = Window.partitionBy(*keys, "at").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("before", F.col("base") + F.coalesce(F.sum("n").over(so_far), F.lit(0)))
    return placed.where((F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("n"))).select(*keys, "at", "before", "lo", "hi")


def _joined(big: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """big with the columns of small by keys; null keys meet."""
    s = small.withColumnsRenamed({k: f"{k}_s" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}_s"))
    return big.join(s, on).drop(*[f"{k}_s" for k in keys])
