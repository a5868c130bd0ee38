"""Statistics of entity tables: correlation, least squares, slopes, percentiles, colour positions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .percentiles import exact_percentiles


def pearson(df: DataFrame, x: str, y: str, least: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """n and r over rows with both values; r is null for fewer than `least` rows or without variance."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    spread = (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    return both.groupBy(*by).agg(F.count("*").alias("n"), F.when((F.count("*") >= least) & spread, F.corr(x, y)).alias("r"))


def rank_predictors(df: DataFrame, target: str, predictors: Sequence[str], top: int = 5, least: int = 10) -> DataFrame:
    """predictor, n, r, place, joint_r2, verdict of the `top` predictors by |r|.

    One pass over the data for all correlations, one for the joint fit of the best: joint_r2 and the verdict are those of
    all of them together, null and WEAK where no fit is possible.
    """
    aggs = []
    for p in predictors:
        both = F.col(p).isNotNull() & F.col(target).isNotNull()
        xs, ys = F.when(both, F.col(p).cast("double")), F.when(both, F.col(target).cast("double"))
        ok = (F.count(xs) >= least) & (F.stddev_pop(xs) > 0) & (F.stddev_pop(ys) > 0)
        aggs.append(F.struct(F.count(xs).alias("n"), F.when(ok, F.corr(xs, ys)).alias("r")).alias(p))
    one = df.agg(*aggs).first()
    found = [(p, one[p]["n"], one[p]["r"]) for p in predictors]
    found = sorted((x for x in found if x[2] is not None), key=lambda x: (-abs(x[2]), x[0]))[:top]
    fit = least_squares(df, target, [p for p, _, _ in found]) if found else None
    rows = [(p, n, r, i + 1, fit["r2"] if fit else None) for i, (p, n, r) in enumerate(found)]
    out = df.sparkSession.createDataFrame(rows, "predictor string, n long, r double, place int, joint_r2 double")
    return out.withColumn("verdict", verdict(F.col("joint_r2")))


def verdict(r2: Column) -> Column:
    """STRONG from 0.6, DECENT from 0.35, else WEAK."""
    return F.when(r2 >= 0.6, "STRONG").when(r2 >= 0.35, "DECENT").otherwise("WEAK")


def least_squares(df: DataFrame, target: str, predictors: Sequence[str]) -> dict | None:
    """n, intercept, coefficients and R2 of ordinary least squares on complete rows; null if they are too few
    (under k + 5 or 15) or the system is singular.

    One aggregate gathers the cross products; the driver solves a system of k + 1 unknowns.
    """
    cols = [*predictors, target]
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in cols]]
    m = len(x)
    sums = [F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(m) for j in range(i, m)]
    row = df.dropna(subset=cols).agg(*sums).first()
    s = np.zeros((m, m))
    for i in range(m):
        for j in range(i, m):
            s[i, j] = s[j, i] = row[f"s{i}_{j}"] or 0.0
    n, k = int(s[0, 0]), len(predictors)
    if n < max(k + 5, 15):
        return None
    a, b = s[:-1, :-1], s[:-1, -1]
    try:
        if np.linalg.matrix_rank(a) <= k:
            return None
        beta = np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return None
    total = s[-1, -1] - s[0, -1] ** 2 / n
    if total <= 0:
        return None
    return {"n": n, "intercept": float(beta[0]), "coefficients": dict(zip(predictors, map(float, beta[1:]), strict=True)), "r2": float(1 - (s[-1, -1] - beta @ b) / total)}


def slope_through_origin(x: Column, y: Column) -> Column:
    """Aggregate: sum(xy) / sum(xx), null if that is zero."""
    return F.try_divide(F.sum(x * y), F.nullif(F.sum(x * x), F.lit(0.0)))


def residuals(df: DataFrame, target: str, predictors: Sequence[str], out: str = "value_added") -> DataFrame:
    """df with actual minus fitted target (an extension: the reported scores come precomputed)."""
    fit = least_squares(df, target, predictors)
    if fit is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    fitted = sum((F.col(p) * b for p, b in fit["coefficients"].items()), F.lit(fit["intercept"]))
    return df.withColumn(out, F.col(target) - fitted)


def colour_domain(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """lo, mid, hi: interpolated 2nd percentile, median and interpolated 98th percentile, exact for groups of any size."""
    q = exact_percentiles(df, value, (0.02, 0.5, 0.98), by)
    return q.select(*by, F.col("percentiles")[0].alias("lo"), F.col("percentiles")[1].alias("mid"), F.col("percentiles")[2].alias("hi"))


def colour_position(value: Column, lo: Column, mid: Column, hi: Column, diverging: bool, reverse: bool = False) -> Column:
    """Position on the ramp: 0 at lo, 1 at hi, with diverging 0.5 at mid; 0.5 where bounds coincide."""
    if diverging:
        low = F.when(mid == lo, 0.5).otherwise(0.5 * (value - lo) / (mid - lo))
        high = F.when(hi == mid, 0.5).otherwise(0.5 + 0.5 * (value - mid) / (hi - mid))
        t = F.when(value <= mid, low).otherwise(high)
    else:
        t = F.when(hi == lo, 0.5).otherwise((value - lo) / (hi - lo))
    return 1 - t if reverse else t


# Stops of the ramps.
SEQUENTIAL = ("#0c6b61", "#e0a53b", "#9b3a2e")
DIVERGING = ("#0c6b61", "#cbb48f", "#9b3a2e")


def ramp(t: Column, stops: tuple[str, str, str] = SEQUENTIAL) -> Column:
    """Hex colour at a position of a three-stop ramp, saturated outside 0 to 1."""
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    parts = []
    for i in (1, 3, 5):
        a, b, c = (int(s[i : i + 2], 16) for s in stops)
        v = F.when(u < 0.5, a + (b - a) * u * 2).otherwise(b + (c - b) * (u - 0.5) * 2)
        parts.append(F.lpad(F.lower(F.hex(F.floor(v + 0.5).cast("bigint"))), 2, "0"))
    return F.concat(F.lit("#"), *parts)


def legend(domain: DataFrame, samples: int = 24, stops: tuple[str, str, str] = SEQUENTIAL) -> DataFrame:
    """position, value, colour of evenly spaced samples over each domain."""
    at = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: i / (samples - 1))
    out = domain.withColumn("position", F.explode(at))
    return out.withColumn("value", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("position")).withColumn("colour", ramp(F.col("position"), stops))


def padded_extent(df: DataFrame, value: str, pad: float = 0.04, default: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """lo and hi of a plot axis: extremes widened by a share of the span, by 1 for a single value; a default window if empty."""
    one = df.agg(F.min(value).cast("double").alias("a"), F.max(value).cast("double").alias("b"))
    span = F.col("b") - F.col("a")
    by = F.when(span > 0, span * pad).otherwise(F.lit(1.0))
    return one.select(F.coalesce(F.col("a") - by, F.lit(default[0])).alias("lo"), F.coalesce(F.col("b") + by, F.lit(default[1])).alias("hi"))


def nearest_point(df: DataFrame, x: Column, y: Column, at: tuple[float, float], radius: float) -> DataFrame:
    """The row nearest to a point if it lies within the radius; of equally near ones the first by the other columns."""
    d = F.hypot(x - at[0], y - at[1])
    return df.withColumn("distance", d).where(F.col("distance") <= radius).orderBy("distance", *df.columns).limit(1)


def nearest_points(points: DataFrame, clicks: DataFrame, point: str, click: str, radius: float, x: str = "x", y: str = "y") -> DataFrame:
    """click, point, distance: the point nearest to each click within the radius; of equally near ones the smallest.

    The plane is cut into squares of the radius's width. A click is sent to the nine squares around it and meets only the
    points there, by an equi-join; points of one place count as their smallest before that. Clicks without a point in
    reach, and rows without coordinates, have no row.
    """
    square = lambda c: F.floor(F.col(c) / radius).cast("long")
    known = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("_px"), F.col(y).cast("double").alias("_py")).agg(F.min(point).alias(point))
    known = known.withColumn("_i", square("_px")).withColumn("_j", square("_py"))
    around = F.array(*[F.lit(i).cast("long") for i in (-1, 0, 1)])
    asked = clicks.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(click, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    asked = asked.withColumn("_di", F.explode(around)).withColumn("_dj", F.explode(around)).withColumn("_i", square("_x") + F.col("_di")).withColumn("_j", square("_y") + F.col("_dj"))
    dx, dy = F.col("_px") - F.col("_x"), F.col("_py") - F.col("_y")
    met = asked.join(known, ["_i", "_j"]).withColumn("_d", F.sqrt(dx * dx + dy * dy)).where(F.col("_d") <= radius)
    best = met.groupBy(click).agg(F.min(F.struct(F.col("_d").alias("d"), F.col(point).alias("p"))).alias("_b"))
    return best.select(click, F.col("_b.p").alias(point), F.col("_b.d").alias("distance"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: weighted mean over rows with both."""
    both = value.isNotNull() & weight.isNotNull()
    return F.try_divide(F.sum(F.when(both, value * weight)), F.sum(F.when(both, weight)))


def legend_labels(domain: DataFrame) -> DataFrame:
    """position, label of a legend's ends and middle: smallest, median and largest value of the domain."""
    marks = F.array(*[F.struct(F.lit(p).alias("position"), F.format_string("%.1f", F.col(c)).alias("label")) for p, c in ((0.0, "lo"), (0.5, "mid"), (1.0, "hi"))])
    return domain.withColumn("_m", F.explode(marks)).select(*[c for c in domain.columns if c not in ("lo", "mid", "hi")], "_m.*")
