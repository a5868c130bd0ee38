"""Panels of entities by year: melt, harmonise, coalesce with provenance, pivot, coverage, latest values.

Where order decides (first or last row wins), the caller names the column that holds the order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import numbered


def melt(df: DataFrame, keys: Sequence[str], values: Sequence[str], variable: str = "variable", value: str = "value") -> DataFrame:
    """Wide to long, without missing values."""
    return df.unpivot(list(keys), list(values), variable, value).where(F.col(value).isNotNull())


def drop_blank(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.trim(F.col(column).cast("string")) != "")


def harmonise(df: DataFrame, names: dict[str, str], variable: str = "variable", strict: bool = True) -> DataFrame:
    """Rename variables by a fixed map. strict: an unmapped name raises before anything is written.

    The check is an action of its own, because a raise inside an expression may be pruned with its column.
    """
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    out = df.withColumn("_canonical", F.try_element_at(table, F.col(variable)))
    if strict:
        bad = out.where(F.col("_canonical").isNull()).select(variable).limit(1).collect()
        if bad:
            raise ValueError(f"no canonical name for variable {bad[0][0]!r}")
    return out.where(F.col("_canonical").isNotNull()).withColumn(variable, F.col("_canonical")).drop("_canonical")


def last_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row of each key that comes last; one shuffle, combined before it."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def first_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row of each key that comes first."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def coalesce_sources(sources: Sequence[tuple[str, DataFrame]], keys: Sequence[str], value: str = "value") -> DataFrame:
    """keys, value, source: of each key the value of the first listed source that has one.

    A union and one grouped minimum, whatever the number of sources; blanks are dropped first, so that they
    never hide another source's value. Duplicate keys inside a source must be settled before (last_wins).
    """
    every = None
    for rank, (name, df) in enumerate(sources):
        part = drop_blank(df, value).select(*keys, F.col(value).alias("_v"), F.lit(name).alias("_s"), F.lit(rank).alias("_r"))
        every = part if every is None else every.unionByName(part)
    best = every.groupBy(*keys).agg(F.min_by(F.struct("_v", "_s"), "_r").alias("_b"))
    return best.select(*keys, F.col("_b._v").alias(value), F.col("_b._s").alias("source"))


def coverage(sources: Sequence[tuple[str, DataFrame]], entity: str, by: Sequence[str], universe: int) -> DataFrame:
    """Distinct entities per group for each source and for their union, and the union's share of a constant universe.

    Pre-aggregated to one row per entity and group, so the distinct counts are plain counts.
    """
    every = None
    for name, df in sources:
        part = df.select(*by, entity, F.lit(name).alias("_s"))
        every = part if every is None else every.unionByName(part)
    seen = every.groupBy(*by, entity).agg(*[F.max(F.when(F.col("_s") == n, 1).otherwise(0)).alias(f"n_{n}") for n, _ in sources])
    sums = [F.sum(f"n_{n}").cast("bigint").alias(f"n_{n}") for n, _ in sources]
    return seen.groupBy(*by).agg(*sums, F.count("*").alias("n_merged")).withColumn("pct", F.round(F.col("n_merged").cast("double") * 100 / universe, 2))


def widen(df: DataFrame, keys: Sequence[str], names: Sequence[str], variable: str = "variable", value: str = "value") -> DataFrame:
    """Long to wide with a fixed list of columns: no job to find them, one partial aggregation."""
    return df.groupBy(*keys).pivot(variable, list(names)).agg(F.first(value, ignorenulls=True))


def enrich(panel: DataFrame, directory: DataFrame, entity: str) -> DataFrame:
    """Panel rows with the directory's columns; Spark broadcasts the directory where its size allows."""
    return panel.join(directory, entity, "left")


def latest(df: DataFrame, entity: str, year: str, columns: Sequence[str], order: str) -> DataFrame:
    """Latest known value of each column by itself, with its year (`<column>_year`); of equal years the later row."""
    aggs = []
    for c in columns:
        known = F.col(c).isNotNull()
        at = F.struct(F.col(year), F.col(order))
        aggs += [F.max_by(F.when(known, F.col(c)), F.when(known, at)).alias(c), F.max(F.when(known, F.col(year))).alias(f"{c}_year")]
    return df.groupBy(entity).agg(*aggs)


def first_known(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str) -> DataFrame:
    """First known value of each column by itself, in row order."""
    return df.groupBy(*keys).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def richest(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str) -> DataFrame:
    """Per key the row with the most known columns, the first of equals."""
    filled = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in columns), F.lit(0))
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(-filled, F.col(order))).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def preferred_cohort(df: DataFrame, keys: Sequence[str], group: str, size: str, rate: str, order: str, prefer: Sequence) -> DataFrame:
    """Rate of the largest cohort of the first preferred group that has one; first of equal sizes, null size is 0."""
    picks = []
    for g in prefer:
        mine = (F.col(group) == g) & F.col(rate).isNotNull()
        picks.append(F.min_by(F.col(rate), F.when(mine, F.struct(-F.coalesce(F.col(size), F.lit(0)), F.col(order)))))
    return df.groupBy(*keys).agg(F.coalesce(*picks).alias(rate))


def remainder_rate(total: Column, total_hits: Column, part: Column, part_hits: Column) -> Column:
    """Rate of those in the total but not in the part, four decimals; null unless some are."""
    rest = total - part
    return F.when(rest > 0, F.round((total_hits - part_hits).cast("double") / rest, 4))


def shares(df: DataFrame, keys: Sequence[str], category: str, amount: str, codes: dict, total_code, outside: Sequence) -> DataFrame:
    """Share of each category in the total row, and 1 minus the shares of the categories in `outside` (missing: 0)."""
    of = lambda code: F.max(F.when(F.col(category) == code, F.col(amount)))
    base = df.groupBy(*keys).agg(of(total_code).alias("_total"), *[of(k).alias(f"_{n}") for k, n in codes.items()])
    base = base.where(F.col("_total") > 0)
    names = [codes[k] for k in outside]
    rest = 1 - sum((F.coalesce(F.col(f"_{n}"), F.lit(0)) for n in names), F.lit(0)) / F.col("_total")
    return base.select(*keys, *[F.round(F.col(f"_{n}") / F.col("_total"), 4).alias(n) for n in codes.values()], F.round(rest, 4).alias("rest"))


def canonical_keys(entity: str, year: str, variable: str, names: Sequence[str]) -> list[Column]:
    """Keys of the deterministic order: entity as text, year as number, position in the list of variables."""
    return [F.col(entity).cast("string"), F.col(year).cast("int"), F.array_position(F.array(*map(F.lit, names)), F.col(variable))]


def canonical_order(df: DataFrame, entity: str, year: str, variable: str, names: Sequence[str]) -> DataFrame:
    """df in the order of canonical_keys."""
    return df.orderBy(*canonical_keys(entity, year, variable, names))


def distinct_in_order(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys by first appearance."""
    return df.groupBy(key).agg(F.min(order).alias("first_row")).orderBy("first_row")


def numbered_batches(df: DataFrame, order: Sequence[Column | str] | str, size: int) -> DataFrame:
    """df with batch: rows in order, `size` to a batch from 0 on, for request planning (see order.numbered)."""
    rows = numbered(df, [order] if isinstance(order, str) else order, "batch")
    return rows.withColumn("batch", F.floor((F.col("batch") - 1) / size).cast("int"))


def nonblank_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, n, pct: non-blank cells of each column in one pass."""
    known = [F.count(F.when(F.trim(F.col(c).cast("string")) != "", 1)).alias(c) for c in columns]
    one = df.agg(F.count("*").alias("_n"), *known)
    return one.unpivot(["_n"], list(columns), "column", "n").select("column", "n", F.round(F.try_divide(F.col("n") * 100.0, F.col("_n")), 2).alias("pct"))


def field_summary(df: DataFrame, entity: str, year: str, field: str, value: str) -> DataFrame:
    """Per field: earliest year with a value, distinct entities, filled rows."""
    return df.where(F.col(value).isNotNull()).groupBy(field).agg(F.min(year).alias("first_year"), F.count_distinct(entity).alias("entities"), F.count("*").alias("filled"))


def joined_names(c: Column) -> Column:
    """Distinct values in order, as one text with bars."""
    return F.array_join(F.array_sort(F.collect_set(c)), " | ")


def drop_listed(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """df without the listed columns, and the listed names it does not have."""
    return df.drop(*[c for c in columns if c in df.columns]), [c for c in columns if c not in df.columns]


def first_column(df: DataFrame, names: Sequence[str], side: DataFrame | None = None, key: str | None = None, out: str = "value", required: bool = True) -> DataFrame:
    """df with `out` from the first of several column names it has, else from a side table by key, else null or an error."""
    for n in names:
        if n in df.columns:
            return df.withColumn(out, F.col(n))
    if side is not None and key:
        return df.join(side.select(key, F.col(side.columns[-1]).alias(out)), key, "left")
    if required:
        raise ValueError(f"none of the columns {', '.join(names)}")
    return df.withColumn(out, F.lit(None).cast("string"))


def newest_year(df: DataFrame, year: str = "year") -> int | None:
    """The newest year with a row."""
    return df.agg(F.max(year)).first()[0]


def grants(df: DataFrame, amount: str, percent: str) -> DataFrame:
    """Two facts of an aid file: rows without both go, a fraction of at least zero becomes a percentage of one decimal."""
    return df.where(F.col(amount).isNotNull() | F.col(percent).isNotNull()).withColumn(percent, F.when(F.col(percent) >= 0, F.round(F.col(percent) * 100, 1)))


def through_crosswalk(source: DataFrame, crosswalk: DataFrame, master: DataFrame, name: str, entity: str, also: Sequence[str] = ()) -> DataFrame:
    """Rows of a source by name, through a crosswalk of names to entities, to the master's rows; both must match.

    also: further columns, such as the year, on which source and master meet.
    """
    return source.join(crosswalk.select(name, entity), name).join(master, [entity, *also])


def with_fallbacks(base: DataFrame, sides: Sequence[tuple[str, DataFrame]], key: str, fields: dict[str, Sequence[str]]) -> DataFrame:
    """base with each field from the first of its sources that knows it; sources are "base" or names of the sides."""
    out = base.select(key, *[F.col(c).alias(f"base__{c}") for c in base.columns if c != key])
    for name, side in sides:
        out = out.join(side.select(key, *[F.col(c).alias(f"{name}__{c}") for c in side.columns if c != key]), key, "left")
    known = lambda f, order: F.coalesce(*[F.nullif(F.trim(F.col(f"{s}__{f}").cast("string")), F.lit("")) for s in order])
    return out.select(key, *[known(f, order).alias(f) for f, order in fields.items()])


def with_cost(index: DataFrame, cost: DataFrame, key: str, value: str, absent: str = "NA") -> DataFrame:
    """Index rows with their cost as text, or the mark of absence."""
    return index.join(cost.select(key, F.col(value).cast("string").alias(value)), key, "left").withColumn(value, F.coalesce(value, F.lit(absent)))


def by_vendor_id(rows: DataFrame, crosswalk: DataFrame, vendor: str, entity: str) -> DataFrame:
    """Rows with the entity of their vendor id, null where it is unknown; a vendor id names one entity."""
    return rows.join(crosswalk.groupBy(vendor).agg(F.min(entity).alias(entity)), vendor, "left")


def roster(flags: DataFrame, directory: DataFrame, key: str, flag: Column) -> DataFrame:
    """Flagged entities with the directory's columns, by id."""
    return flags.where(flag).select(key).distinct().join(directory, key, "left").orderBy(key)


def lookup(df: DataFrame, **at) -> DataFrame:
    """Rows at a point, such as an entity and a year."""
    for c, v in at.items():
        df = df.where(F.col(c) == v)
    return df


def non_negative_series(df: DataFrame, series: Sequence[str], variable: str = "variable", value: str = "value") -> DataFrame:
    """Rows without the negative values of the listed series; other series keep theirs."""
    return df.where(~F.col(variable).isin(*series) | (F.col(value) >= 0))


def within_coverage(df: DataFrame, covered: dict[str, tuple[int, int]], variable: str = "variable", year: str = "year") -> DataFrame:
    """Rows of the years that their series covers; a series without entry has no bounds."""
    keep = F.lit(True)
    for name, (low, high) in covered.items():
        keep = keep & ((F.col(variable) != name) | F.col(year).between(low, high))
    return df.where(keep)


def method_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows by method, confidence or flag."""
    return df.groupBy(*by).agg(F.count("*").alias("n"))
