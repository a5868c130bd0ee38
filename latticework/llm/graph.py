"""Connected components of a link table, without collecting links or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

#: A node with more than one in HUB of all ends of links is a hub; there are HUB of them at most.
HUB = 256


def _with_smallest(rows: DataFrame, low: DataFrame, ends: int) -> DataFrame:
    """rows (u, v) with m, the smallest of u and its neighbours; low: (u, m, n), n links of u.

    Hubs, of which there are HUB at most, are looked up by a broadcast, so no task gets all links of one; the others go
    through a shuffle join whose keys are all light.
    """
    hub = F.col("n") > max(64, ends // HUB)
    known = rows.join(F.broadcast(low.where(hub).select("u", F.col("m").alias("_m"))), "u", "left")
    light = known.where("_m IS NULL").select("u", "v").join(low.where(~hub).select("u", "m"), "u")
    return known.where("_m IS NOT NULL").select("u", "v", F.col("_m").alias("m")).unionByName(light.select("u", "v", "m"))


def _large_star(e: DataFrame, links: int) -> DataFrame:
    """Every neighbour above u is linked to the smallest of u and its neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _with_smallest(both.where(F.col("v") > F.col("u")), low, 2 * links).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame, links: int) -> DataFrame:
    """u and its neighbours below it are linked to the smallest of them; e has u > v."""
    low = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    down = _with_smallest(e, low, links).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return down.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Alternates large-star and small-star steps until the links no longer change. Each step is a grouped minimum
    (combined before the shuffle) and a join that hubs bypass (see _with_smallest); each step is written to the shared
    folder. Links with a null end or equal ends are ignored; repeated links count once.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND {a} <> {b}").distinct()
    e, seen = materialize(e), None
    for _ in range(max_rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == seen:
            break
        seen = now
        large = materialize(_large_star(e, now[0]))
        release(e)
        e = materialize(_small_star(large, now[0]))
        release(large)
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
