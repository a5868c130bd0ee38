"""Merging rows into a base table under a policy, as one full join on the keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POLICIES = ("fill", "overwrite", "overwrite_blank", "backfill", "update_only", "insert_only")


def upsert(base: DataFrame, delta: DataFrame, keys: Sequence[str], columns: Sequence[str], policy: str) -> DataFrame:
    """base with the delta's columns merged in, and `change`: filled, changed, unchanged, created or kept.

    fill and overwrite: known incoming values replace the old ones, missing rows are inserted.
    overwrite_blank: incoming values replace the old ones even where they are null; missing rows are inserted.
    backfill: only blanks are filled, nothing is inserted. update_only: as overwrite, nothing is inserted.
    insert_only: existing rows stay, missing rows are inserted.
    Keys must be unique in base; several delta rows of a new key are all inserted, as separate rows. Base rows with
    a null key are kept as they are.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    old = base.select(*base.columns, F.lit(True).alias("_old"))
    new = delta.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_n_{c}") for c in columns], F.lit(True).alias("_new"))
    on = [F.col(k) == F.col(f"_k_{k}") for k in keys]
    how = "full" if policy in ("fill", "overwrite", "overwrite_blank", "insert_only") else "left"
    both = old.join(new, on, how)
    hit, fresh = F.col("_old").isNotNull() & F.col("_new").isNotNull(), F.col("_old").isNull()
    out, differs, fills = [], F.lit(False), F.lit(False)
    for c in base.columns:
        if c in keys:
            out.append(F.coalesce(F.col(c), F.col(f"_k_{c}")).alias(c))
        elif c in columns:
            incoming, before = F.col(f"_n_{c}"), F.col(c)
            after = {
                "overwrite_blank": incoming,
                "backfill": F.coalesce(before, incoming),
                "insert_only": before,
            }.get(policy, F.coalesce(incoming, before))
            after = F.when(fresh, incoming).when(hit, after).otherwise(before)
            out.append(after.alias(c))
            differs = differs | ~after.eqNullSafe(before)
            fills = fills | (before.isNull() & after.isNotNull())
        else:
            out.append(F.col(c))
    change = F.when(fresh, "created").when(F.col("_new").isNull(), "kept").when(differs & fills, "filled").when(differs, "changed").otherwise("unchanged")
    return both.select(*out, change.alias("change"))


def change_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy("change").agg(F.count("*").alias("n"))


def suppress(df: DataFrame, suspects: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """df with the columns of suspect keys set to null."""
    marked = df.join(suspects.select(key).distinct().withColumn("_bad", F.lit(True)), key, "left")
    return marked.select(*[F.when(F.col("_bad").isNull(), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def without_resolved(queue: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Queue rows whose keys are not done."""
    return queue.join(done.select(*keys).distinct(), list(keys), "left_anti")


def disjoint(data: DataFrame, blocked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blocked rows without a data row."""
    return without_resolved(blocked, data, keys)


def append_missing(base: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """base and the delta rows whose key it lacks."""
    return base.unionByName(delta.join(base.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def keep_unmatched(matched: DataFrame, rows: DataFrame, row_key: str, entity: str) -> DataFrame:
    """Matched rows, and the other rows with a null entity and their original name."""
    rest = rows.join(matched.select(row_key), row_key, "left_anti").withColumn(entity, F.lit(None).cast(matched.schema[entity].dataType))
    return matched.unionByName(rest, allowMissingColumns=True)


def with_metric(df: DataFrame, metrics: str, name: str, value: str) -> DataFrame:
    """Map column with one entry set where the value is known."""
    old = F.map_filter(F.col(metrics), lambda k, _: k != name)
    return df.withColumn(metrics, F.when(F.col(value).isNotNull(), F.map_concat(old, F.create_map(F.lit(name), F.col(value)))).otherwise(F.col(metrics)))


def require(df: DataFrame, **conditions) -> None:
    """Raise unless every aggregate condition holds; to be called before writing."""
    row = df.agg(*[c.alias(n) for n, c in conditions.items()]).first().asDict()
    bad = [n for n, ok in row.items() if not ok]
    if bad:
        raise ValueError(f"refused to write: {', '.join(bad)}")
