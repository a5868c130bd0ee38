"""Filter, rank, sort, page and facet queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean as C
from ..operators import serve as V
from ..operators import stats as S
from ..operators.order import numbered
from .registry import Registry, table

R = Registry()


@R.query("""SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal BETWEEN 0 AND 5000 AND c_nationkey::VARCHAR = '7'""")
def filters_select_multi_range(spark, d):
    """Select, multi-select and range filters; unset ones pass."""
    defs = [V.FilterDef("seg", "select", "c_mktsegment"), V.FilterDef("bal", "range", "c_acctbal"), V.FilterDef("nat", "select", "c_nationkey"), V.FilterDef("none", "select", "c_name")]
    state = {"seg": ["BUILDING", "MACHINERY"], "bal": (0, 5000), "nat": "7", "none": []}
    return table(spark, d, "customer").where(V.predicate(defs, state)).select("c_custkey", "c_mktsegment")


@R.query("""SELECT c_custkey, rnk FROM (SELECT c_custkey, c_mktsegment, c_nationkey, CASE WHEN c_acctbal > 0 THEN floor(c_acctbal / 20)::INTEGER END rnk FROM customer)
WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE') AND c_nationkey IN (1, 2, 3, 4, 5) AND rnk BETWEEN 1 AND 381""")
def legacy_facet_filter(spark, d):
    """Facets with the default rank window."""
    c = table(spark, d, "customer").withColumn("rnk", F.when(F.col("c_acctbal") > 0, F.floor(F.col("c_acctbal") / 20).cast("int")))
    keep = V.facets({"c_mktsegment": ["BUILDING", "AUTOMOBILE"], "c_nationkey": [1, 2, 3, 4, 5]}) & V.rank_window(F.col("rnk"))
    return c.where(keep).select("c_custkey", "rnk")


@R.query("""SELECT c_custkey FROM customer WHERE false""")
def empty_facet(spark, d):
    """A facet without a value empties the result."""
    return table(spark, d, "customer").where(V.facets({"c_mktsegment": [], "c_nationkey": [1]})).select("c_custkey")


@R.query("""SELECT p_partkey, p_name FROM part WHERE contains(lower(coalesce(p_name, '')), '%') OR contains(lower(coalesce(p_name, '')), 're') OR contains(lower(coalesce(p_brand, '')), 're')""")
def search_contains(spark, d):
    return V.search(table(spark, d, "part"), " RE ", ["p_name", "p_brand"]).select("p_partkey", "p_name")


@R.query("""SELECT c_custkey, c_mktsegment, place FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY CASE WHEN c_acctbal > 0 THEN c_acctbal END DESC NULLS LAST, c_custkey) place FROM customer WHERE c_nationkey < 20) WHERE c_nationkey < 5""")
def rank_then_filter(spark, d):
    """Ranks of the whole population, shown for a part of it."""
    c = table(spark, d, "customer").withColumn("score", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))
    return V.rank_then_filter(c, "score", "c_custkey", F.col("c_nationkey") < 20, F.col("c_nationkey") < 5, ["c_mktsegment"]).select("c_custkey", "c_mktsegment", "place")


@R.query("""SELECT s_suppkey, row_number() OVER (ORDER BY v ASC NULLS LAST, s_suppkey) up, row_number() OVER (ORDER BY v DESC NULLS FIRST, s_suppkey) down FROM (SELECT s_suppkey, CASE WHEN s_acctbal > 1000 THEN s_acctbal END v FROM supplier)""")
def sort_null_order(spark, d):
    """Positions under the table order, upwards and downwards."""
    s = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") > 1000, F.col("s_acctbal")).alias("v"))
    up = numbered(s, [V.table_order("v"), "s_suppkey"], "up")
    return numbered(up, [V.table_order("v", True), "s_suppkey"], "down").select("s_suppkey", "up", "down")


@R.query("""SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 20""")
def page_slice(spark, d):
    """The third page of ten."""
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return V.page(rows, [F.desc("c_acctbal"), F.asc("c_custkey")], 3, 10)


@R.query("""SELECT c_custkey, greatest((SELECT count(*) FROM customer) - 100, 0) beyond FROM customer ORDER BY c_name, c_custkey LIMIT 100""")
def cap_overflow(spark, d):
    """The first hundred, and how many more there are."""
    rows, beyond = V.capped(table(spark, d, "customer").select("c_custkey", "c_name"), [F.asc("c_name"), F.asc("c_custkey")])
    return rows.select("c_custkey", F.lit(beyond).cast("bigint").alias("beyond"))


@R.query("""SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) states FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def facet_index(spark, d):
    j = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return V.facet_index(j, "r_name", "n_name")


@R.query("""SELECT c_custkey, CASE WHEN c_nationkey < 10 THEN CASE WHEN c_mktsegment = 'BUILDING' THEN 'near building' ELSE 'near machinery' END ELSE 'far building' END series FROM customer
WHERE (c_nationkey < 10 AND c_mktsegment IN ('BUILDING', 'MACHINERY')) OR (c_nationkey >= 10 AND c_mktsegment = 'BUILDING')""")
def series_buckets(spark, d):
    """Rows by series of two codes; others dropped."""
    names = {(True, "BUILDING"): "near building", (True, "MACHINERY"): "near machinery", (False, "BUILDING"): "far building"}
    return V.series(table(spark, d, "customer"), F.col("c_nationkey") < 10, F.col("c_mktsegment"), names).select("c_custkey", "series")


@R.query("""SELECT p_partkey, '#' || lpad(lower(hex(floor(r + 0.5)::BIGINT)), 2, '0') || lpad(lower(hex(floor(g + 0.5)::BIGINT)), 2, '0') || lpad(lower(hex(floor(b + 0.5)::BIGINT)), 2, '0') colour FROM (
SELECT p_partkey, CASE WHEN u < 0.5 THEN 12 + 212 * u * 2 ELSE 224 - 69 * (u - 0.5) * 2 END r, CASE WHEN u < 0.5 THEN 107 + 58 * u * 2 ELSE 165 - 107 * (u - 0.5) * 2 END g, CASE WHEN u < 0.5 THEN 97 - 38 * u * 2 ELSE 59 - 13 * (u - 0.5) * 2 END b
FROM (SELECT p_partkey, greatest(0.0, least(1.0, p_size / 64.0::DOUBLE)) u FROM part))""")
def colour_ramp(spark, d):
    return table(spark, d, "part").select("p_partkey", S.ramp(F.col("p_size") / 64.0).alias("colour"))


@R.query("""SELECT c_custkey, CASE WHEN c_nationkey = 1 THEN 'Public' WHEN c_nationkey = 2 THEN 'Private' END control, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name || ', ' || c_mktsegment END place FROM customer WHERE c_acctbal >= 0""")
def code_labels(spark, d):
    c = table(spark, d, "customer").where("c_acctbal >= 0")
    return c.select("c_custkey", C.code_label(F.col("c_nationkey"), {1: "Public", 2: "Private"}).alias("control"), C.place_label(F.col("c_name"), F.col("c_mktsegment")).alias("place"))


def _slot_sql(column: str, length: int) -> str:
    h = "0::BIGINT"
    for i in range(1, length + 1):
        h = f"(({h} * 31 + ascii(substr({column}, {i}, 1))) & 4294967295)"
    return h


@R.query(f"""SELECT c_custkey, (abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 12)::INTEGER slot FROM (SELECT c_custkey, {_slot_sql("k", 5)} h FROM (SELECT c_custkey, lpad(c_custkey::VARCHAR, 5, '0') k FROM customer))""")
def stable_slot(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", C.stable_slot(F.lpad(F.col("c_custkey").cast("string"), 5, "0")).alias("slot"))
