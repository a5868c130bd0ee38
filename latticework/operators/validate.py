"""Validation of joins against trusted measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Gaps that make a join suspect (percentage points, score points) and the least overlap.
RATE_GAP, LONE_RATE_GAP, SCORE_GAP, LEAST_YEARS = 20.0, 35.0, 250.0, 2


def median_gaps(df: DataFrame, entity: str, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Per entity, for each named pair of columns: `<name>_gap`, the exact median absolute difference, and `<name>_n`."""
    aggs = []
    for name, (a, b) in pairs.items():
        d = F.abs(F.col(a) - F.col(b))
        aggs += [F.median(d).alias(f"{name}_gap"), F.count(d).alias(f"{name}_n")]
    return df.groupBy(entity).agg(*aggs)


def verdict(rate_gap: Column, rate_n: Column, score_gap: Column) -> Column:
    """SUSPECT by the rate gap over two years or more, by a huge gap over one, or, without any, by the score gap."""
    bad = ((rate_n >= LEAST_YEARS) & (rate_gap > RATE_GAP)) | ((rate_n == 1) & (rate_gap > LONE_RATE_GAP)) | (rate_gap.isNull() & (score_gap > SCORE_GAP))
    return F.when(F.coalesce(bad, F.lit(False)), "SUSPECT").otherwise("OK")


def gap_order(gap: str, entity: str) -> list[Column]:
    """Largest gap first; no gap and a gap of zero come last together, then by entity."""
    return [F.when((F.col(gap) == 0) | F.col(gap).isNull(), -1.0).otherwise(F.col(gap)).desc(), F.col(entity).asc()]


def agreement(df: DataFrame, assigned: str, truth: str) -> DataFrame:
    """n, agree, disagree, unresolved and rate against a truth column."""
    known = df.where(F.col(truth).isNotNull())
    same = F.coalesce(F.col(assigned) == F.col(truth), F.lit(False))
    return known.agg(F.count("*").alias("n"), F.count_if(same).alias("agree"), F.count_if(F.col(assigned).isNotNull() & ~same).alias("disagree"), F.count_if(F.col(assigned).isNull()).alias("unresolved"), F.avg(same.cast("double")).alias("rate"))


def one_row_per_key(df: DataFrame, keys: Sequence[str]) -> bool:
    return not df.groupBy(*keys).count().where("count > 1").limit(1).collect()
