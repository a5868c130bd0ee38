"""Numbers along a global order, without one task that holds all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

#: monotonically_increasing_id counts a partition's rows in its lower 33 bits.
_ROW_BITS = 33


def numbered(df: DataFrame, order: Sequence[Column | str], out: str = "place") -> DataFrame:
    """df with out = 1..N along the order, as long.

    Rows are dealt out by ranges of the order and sorted within their partition, where each knows its own number; the
    table is written, so that numbers stay as they are. The sizes of the partitions before are then added: the driver
    sees one row a partition, never one a row. Rows that the order does not tell apart are numbered as they come.
    """
    own = _fresh(df, "id", "part", "before")
    kept = [c for c in df.columns if c != out]
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).select(*[F.col(f"`{c}`") for c in kept], F.monotonically_increasing_id().alias(own["id"])))
    rows = rows.withColumn(own["part"], F.shiftright(own["id"], _ROW_BITS))
    starts, before = [], 0
    for part, n in sorted(tuple(r) for r in rows.groupBy(own["part"]).count().collect()):
        starts.append((part, before))
        before += n
    offsets = df.sparkSession.createDataFrame(starts, f"{own['part']} long, {own['before']} long")
    at = F.col(own["before"]) + F.col(own["id"]).bitwiseAND((1 << _ROW_BITS) - 1) + 1
    # one row a partition at most
    return rows.join(F.broadcast(offsets), own["part"]).select(*[F.col(f"`{c}`") for c in kept], at.alias(out))


def ranked(df: DataFrame, order: Sequence[Column | str], ties: Sequence[str], out: str = "rank") -> DataFrame:
    """numbered, but rows of equal `ties` (the columns that decide) share the first number among them: 1, 2, 2, 4."""
    n = _fresh(df, "place")["place"]
    rows = numbered(df, order, n)
    return rows.withColumn(out, F.min(n).over(Window.partitionBy(*ties))).drop(n)


def rows_between(df: DataFrame, order: Sequence[Column | str], first: int, last: int, out: str = "place") -> DataFrame:
    """The rows whose numbers along the order are first..last: a page at any depth, without sorting into one task."""
    return numbered(df, order, out).where(F.col(out).between(first, last))


def _fresh(df: DataFrame, *names: str) -> dict[str, str]:
    """Names like these that df does not have."""
    out = {}
    for name in names:
        free = f"_{name}"
        while free in df.columns:
            free += "_"
        out[name] = free
    return out
