"""Filtered, ranked, sorted and paged views of an entity snapshot."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FilterDef:
    """kind: select (value or list of values), range (low, high) or toggle (only active when true)."""

    id: str
    kind: str
    field: str
    equals: Any = True


def predicate(defs: Sequence[FilterDef], state: dict[str, Any]) -> Column:
    """One predicate from filter definitions and their state: unset filters pass everything, all others must hold."""
    terms = []
    for d in defs:
        v = state.get(d.id)
        if v is None or v == "" or (d.kind == "select" and isinstance(v, (list, tuple)) and not v):
            continue
        c = F.col(d.field)
        if d.kind == "select":
            many = v if isinstance(v, (list, tuple)) else [v]
            text = [str(x).lower() if isinstance(x, bool) else str(x) for x in many]
            # text comparison: a missing field compares as the word null
            terms.append(F.coalesce(c.cast("string"), F.lit("null")).isin(*text))
        elif d.kind == "range":
            terms.append(F.coalesce(c.between(v[0], v[1]), F.lit(False)))
        elif d.kind == "toggle" and v is True:
            terms.append(c.eqNullSafe(F.lit(d.equals)))
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def facets(selected: dict[str, Sequence]) -> Column:
    """Facet groups: any value within a facet, all facets together; a facet without a value empties the result."""
    terms = [F.coalesce(F.col(f).isin(*values), F.lit(False)) if values else F.lit(False) for f, values in selected.items()]
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def rank_window(c: Column, low: int | None = 1, high: int | None = 381) -> Column:
    """Rank between optional bounds (0 or none: unset); rows without rank fail an active bound."""
    terms = ([c >= low] if low else []) + ([c <= high] if high else [])
    return reduce(lambda a, b: a & b, [F.coalesce(t, F.lit(False)) for t in terms], F.lit(True))


def toggle_region(states: Column, region_states: Sequence[str]) -> Column:
    """Selected states after a click on a region: all of its states are added, or removed if all were there."""
    own = F.array(*map(F.lit, region_states))
    return F.when(F.size(F.array_except(own, states)) == 0, F.array_except(states, own)).otherwise(F.array_union(states, own))


def states_within(states: Column, region_states: Column) -> Column:
    """Selected states that belong to the region."""
    return F.array_intersect(states, region_states)


def contains(c: Column, query: str) -> Column:
    """Case-blind substring test without wildcards; an empty query passes everything."""
    q = query.strip().lower()
    return F.contains(F.lower(F.coalesce(c.cast("string"), F.lit(""))), F.lit(q)) if q else F.lit(True)


def search(df: DataFrame, query: str, columns: Sequence[str]) -> DataFrame:
    """Rows with the query in any of the columns."""
    return df.where(reduce(lambda a, b: a | b, [contains(F.col(c), query) for c in columns]))


def plottable(*columns: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def metric(df: DataFrame, name: str, known: Sequence[str]) -> Column:
    """Column of a metric chosen at run time."""
    if name not in known or name not in df.columns:
        raise ValueError(f"unknown metric {name!r}")
    return F.col(name)


def rank_then_filter(df: DataFrame, score: str, tie: str, population: Column, view: Column, by: Sequence[str] = ()) -> DataFrame:
    """1..N by falling score, missing scores last, within the population; the view is cut afterwards and keeps the ranks.

    Partition by columns wherever the population allows: without them the window sorts in one task.
    """
    w = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), F.col(tie))
    return df.where(population).withColumn("place", F.row_number().over(w)).where(view)


def series(df: DataFrame, national: Column, control: Column, names: dict[tuple[Any, Any], str]) -> DataFrame:
    """df with its series by two codes; rows of no series are dropped."""
    c = reduce(lambda acc, kv: acc.when((national == kv[0][0]) & (control == kv[0][1]), kv[1]), list(names.items())[1:], F.when((national == next(iter(names))[0]) & (control == next(iter(names))[1]), next(iter(names.values()))))
    return df.withColumn("series", c).where(F.col("series").isNotNull())


def table_order(column: str, descending: bool = False) -> Column:
    """Nulls last upwards, first downwards."""
    return F.col(column).desc_nulls_first() if descending else F.col(column).asc_nulls_last()


def legacy_order(column: str, descending: bool = False) -> Column:
    """By whole numbers, "NA" and other text last either way."""
    v = F.expr(f"try_cast(try_cast(`{column}` AS DOUBLE) AS BIGINT)")
    return v.desc_nulls_last() if descending else v.asc_nulls_last()


def picked_first(key: str, picked: Sequence, then: str) -> list[Column]:
    """Sort keys: picked rows in the order of picking, then the others by a column."""
    place = F.nullif(F.array_position(F.array(*map(F.lit, picked)), F.col(key)), F.lit(0)) if picked else F.lit(None)
    return [place.asc_nulls_last(), F.col(then).asc_nulls_last()]


def page(df: DataFrame, order: Sequence[Column], number: int, size: int, total: int | None = None) -> DataFrame:
    """Rows of a page (from 1), of the last page if the number is beyond it."""
    total = df.count() if total is None else total
    last = max(1, -(-total // size))
    return df.orderBy(*order).offset((min(max(number, 1), last) - 1) * size).limit(size)


def capped(df: DataFrame, order: Sequence[Column], cap: int = 100) -> tuple[DataFrame, int]:
    """The first rows up to a cap, and how many are beyond it."""
    return df.orderBy(*order).limit(cap), max(0, df.count() - cap)


def facet_index(df: DataFrame, region: str, state: str) -> DataFrame:
    """States of each region in order, as one text."""
    return df.where(plottable(region, state)).groupBy(region).agg(F.array_join(F.array_sort(F.collect_set(state)), ",").alias("states"))


def regions_per_state(df: DataFrame, region: str, state: str) -> DataFrame:
    """Regions of each state in order, as one text."""
    return facet_index(df, state, region)


def region_marks(states: Column, regions: dict[str, Sequence[str]]) -> Column:
    """struct of region -> whether all of its states are selected, and `all`: whether those of every region are."""
    own = {r: F.size(F.array_except(F.array(*map(F.lit, s)), states)) == 0 for r, s in regions.items()}
    return F.struct(*[c.alias(r) for r, c in own.items()], reduce(lambda a, b: a & b, own.values(), F.lit(True)).alias("all"))


def axis_values(df: DataFrame, bands: Sequence[str], chosen: str, key: str) -> DataFrame:
    """key, value, no_data: the chosen band's values as the axis; entities without a number are marked."""
    value = metric(df, chosen, bands).try_cast("double")
    return df.select(key, value.alias("value"), value.isNull().alias("no_data"))


def envelope(df: DataFrame, generated_at: str, query: str = "", columns: Sequence[str] = (), most: int = 100_000) -> DataFrame:
    """One JSON text {data, meta} of the rows with the query in one of the columns; more than `most` rows raise."""
    from ..sources.sinks import bounded

    df = bounded(search(df, query, columns) if query and columns else df, most)
    one = df.agg(F.collect_list(F.struct(*df.columns)).alias("data"), F.count("*").alias("n"))
    return one.select(F.to_json(F.struct("data", F.struct(F.col("n").alias("count"), F.lit(generated_at).alias("generatedAt")).alias("meta"))).alias("body"))


def with_entity(plotted: DataFrame, every: DataFrame, key: str, value) -> DataFrame:
    """Plotted rows and the row of one more entity, once."""
    return plotted.unionByName(every.where(F.col(key) == value).join(plotted.select(key), key, "left_anti").select(*plotted.columns))


def without_entity(plotted: DataFrame, key: str, value) -> DataFrame:
    return plotted.where(~F.col(key).eqNullSafe(F.lit(value)))


def no_data_first(df: DataFrame, metric_column: str, name: str) -> DataFrame:
    """df with has_data, rows with data first, then by name."""
    return df.withColumn("has_data", F.col(metric_column).isNotNull()).orderBy(*data_first_keys("has_data", name))


def data_first_keys(has_data: str, name: str) -> list[Column]:
    """Sort keys: rows with data first, then by name."""
    return [F.desc(has_data), F.asc(name)]


def deep_link(base: str, key: Column) -> Column:
    """Address of an entity's page."""
    return F.concat(F.lit(base), key.cast("string"))


def title(base: str, state: dict[str, Any]) -> str:
    """Title of a view from its active filters."""
    parts = []
    for name, v in state.items():
        if v is None or v == "" or v == [] or v is False:
            continue
        parts.append(name if v is True else f"{name}: {' to '.join(map(str, v)) if isinstance(v, tuple) else ', '.join(map(str, v)) if isinstance(v, list) else v}")
    return f"{base} ({'; '.join(parts)})" if parts else base
