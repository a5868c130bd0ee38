"""Queries of operators that joins, orders and cleaning need besides the main ones; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions import names as N
from ..operators import extract as X
from ..operators import panel as P
from ..operators import resolve as M
from ..operators import serve as V
from ..operators import stats as S
from ..operators import upsert as U
from ..operators.order import numbered
from .registry import Registry, table

R = Registry()


@R.query("""SELECT c_custkey, o_orderkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def crosswalk_join(spark, d):
    """Source through a crosswalk to a master; both must match."""
    src = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    cross = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return P.through_crosswalk(src, cross, table(spark, d, "nation").select("n_nationkey", "n_name"), "c_custkey", "n_nationkey").select("c_custkey", "o_orderkey", "n_name")


@R.query("""SELECT c_custkey AS id, coalesce(nullif(trim(c_mktsegment), ''), s_name) AS "label", coalesce(s_name, nullif(trim(c_name), '')) AS "name" FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""")
def field_fallbacks(spark, d):
    """Each field from the first source that knows it, in an order of its own."""
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"), F.col("c_name").alias("name"))
    side = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"), F.col("s_name").alias("name"))
    return P.with_fallbacks(base, [("side", side)], "id", {"label": ["base", "side"], "name": ["side", "base"]})


@R.query("""SELECT c_custkey, coalesce(s_suppkey::VARCHAR, 'NA') AS cost FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""")
def index_with_cost(spark, d):
    """Index rows with a cost, or the mark of its absence."""
    cost = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_suppkey").alias("cost"))
    return P.with_cost(table(spark, d, "customer").select("c_custkey"), cost, "c_custkey", "cost").select("c_custkey", F.col("cost").cast("string").alias("cost"))


@R.query("""SELECT o_orderkey, entity FROM orders LEFT JOIN (SELECT s_suppkey, min(s_nationkey) entity FROM supplier GROUP BY 1) ON o_custkey = s_suppkey""")
def vendor_crosswalk(spark, d):
    """Rows with the entity of their vendor id, null where it is unknown."""
    cross = table(spark, d, "supplier").select(F.col("s_suppkey").alias("o_custkey"), F.col("s_nationkey").alias("entity"))
    return P.by_vendor_id(table(spark, d, "orders").select("o_orderkey", "o_custkey"), cross, "o_custkey", "entity").select("o_orderkey", "entity")


@R.query("""SELECT DISTINCT o_custkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'""")
def flagged_roster(spark, d):
    """Flagged entities with the directory's columns, by id."""
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return P.roster(table(spark, d, "orders"), names, "o_custkey", F.col("o_orderpriority") == "1-URGENT")


@R.query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'F'""")
def point_lookup(spark, d):
    """Rows of one entity at one point."""
    return P.lookup(table(spark, d, "orders"), o_custkey=7, o_orderstatus="F").select("o_orderkey", "o_totalprice")


@R.query("""SELECT l_orderkey, l_linenumber, year(l_shipdate)::INTEGER AS edition, (year(l_shipdate) - 2)::INTEGER AS cohort FROM lineitem WHERE l_linestatus = 'O'""")
def cohort_shift(spark, d):
    """Cohort year beside the edition, for rows whose id is digits only: those of closed lines carry a letter."""
    li = table(spark, d, "lineitem").withColumn("id", F.when(F.col("l_linestatus") == "O", F.col("l_partkey").cast("string")).otherwise(F.concat("l_linestatus", "l_partkey")))
    li = li.where(C.is_entity_id(F.col("id"))).withColumn("edition", F.year("l_shipdate"))
    return li.select("l_orderkey", "l_linenumber", "edition", C.cohort_year(F.col("edition")).alias("cohort"))


@R.query("""SELECT event_type, count(*) n FROM events WHERE (event_type <> 'view' OR day(ts) BETWEEN 2 AND 5) AND (event_type NOT IN ('click') OR value >= 0) GROUP BY 1""")
def series_coverage(spark, d):
    """Years (here days) that a series covers, and the series that may not be negative."""
    e = table(spark, d, "events").withColumn("day", F.dayofmonth("ts"))
    e = P.within_coverage(e, {"view": (2, 5)}, "event_type", "day")
    return P.method_counts(P.non_negative_series(e, ["click"], "event_type"), ["event_type"])


@R.query("""SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_nationkey < 5 THEN ' ' ELSE c_name END), ''), '(Unnamed)') AS shown, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS lat,
CASE c_nationkey WHEN 1 THEN 'Texas' WHEN 2 THEN 'Ohio' ELSE 'elsewhere' END AS state FROM customer""")
def names_states_places(spark, d):
    """Placeholders for names, coordinates from text, state names."""
    c = table(spark, d, "customer").withColumn("raw", F.when(F.col("c_nationkey") < 5, " ").otherwise(F.col("c_name")))
    code = F.when(F.col("c_nationkey") == 1, "tx").when(F.col("c_nationkey") == 2, "OH").otherwise("elsewhere")
    lat = F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_acctbal").cast("string"))
    return c.select("c_custkey", C.name_or(F.col("raw")).alias("shown"), C.coordinate(lat).alias("lat"), C.state_name(code).alias("state"))


@R.query("""SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) k FROM customer) WHERE k = 1""")
def first_row_wins(spark, d):
    """First row of each key."""
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey", F.col("c_custkey").alias("at"))
    return P.first_wins(c, ["c_nationkey"], "at").select("c_nationkey", "c_custkey")


@R.query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey::VARCHAR, year(o_orderdate), list_position(['F', 'O', 'P'], o_orderstatus), o_orderkey) AS place FROM orders""")
def canonical_places(spark, d):
    """Places of all orders: entity as text, year as number, position of the variable."""
    o = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    return numbered(o, [*P.canonical_keys("o_custkey", "year", "o_orderstatus", ["F", "O", "P"]), "o_orderkey"]).select("o_orderkey", "place")


@R.query("""SELECT p_partkey, 'https://x.example/parts/' || p_partkey AS link, CASE WHEN p_size < 10 THEN '20' || lpad((p_size + 10)::VARCHAR, 2, '0') || '-20' || (p_size + 11) END AS "year",
round(0.587::DOUBLE * p_size + 1.17::DOUBLE, 1) AS composite, coalesce(CASE WHEN p_size > 40 THEN p_retailprice END, CASE WHEN p_size > 20 THEN 1.0::DOUBLE END, 2.0::DOUBLE) AS price FROM part""")
def links_years_composites(spark, d):
    """Deep links, academic years, a linear composite, a chain of prices."""
    p, size = table(spark, d, "part"), F.col("p_size")
    year = C.academic_year(F.concat(F.lit("20"), (size + 10).cast("string")), (size + 11).cast("string"))
    price = C.composite_price(F.when(size > 40, F.col("p_retailprice")), F.when(size > 20, F.lit(1.0)), F.lit(2.0))
    return p.select("p_partkey", V.deep_link("https://x.example/parts/", F.col("p_partkey")).alias("link"), F.when(size < 10, year).alias("year"), C.weighted_composite(size, F.lit(None).cast("double")).alias("composite"), price.alias("price"))


@R.query("""SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (1, 2) AND c_custkey <> 30 UNION SELECT c_custkey, c_name FROM customer WHERE c_custkey = 11""")
def plotted_set(spark, d):
    """One entity more, one less."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    plotted = V.without_entity(c.where("c_nationkey IN (1, 2)"), "c_custkey", 30)
    return V.with_entity(plotted, c, "c_custkey", 11).select("c_custkey", "c_name")


@R.query("""SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS "value", c_acctbal < 0 AS no_data FROM customer""")
def band_axis(spark, d):
    """The chosen band as the axis, entities without a number marked."""
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("band1"), F.lit(0.0).alias("band2"))
    return V.axis_values(c, ["band1", "band2"], "band1", "c_custkey")


@R.query("""SELECT n_nationkey, string_agg(DISTINCT r_name, ',' ORDER BY r_name) AS states FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def regions_of_states(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return V.regions_per_state(n, "r_name", "n_nationkey")


@R.query("""SELECT event_id, (value > 50)::INTEGER + (user_id > 10)::INTEGER AS n, CASE WHEN value > 50 THEN value END AS gain FROM events""")
def injected_metric(spark, d):
    """One metric set in a nested record where it is known, and read back with a default of null."""
    e = table(spark, d, "events").withColumn("m", F.when(F.col("user_id") > 10, F.create_map(F.lit("a"), F.lit(1.0))).otherwise(F.expr("cast(map() as map<string,double>)")))
    e = e.withColumn("known", F.when(F.col("value") > 50, F.col("value")))
    out = U.with_metric(e, "m", "gain", "known")
    return out.select("event_id", F.size("m").alias("n"), C.nested_metric(F.col("m"), "gain").alias("gain"))


@R.query("""SELECT p_partkey, round(CASE WHEN least(a, b) > 0 THEN inter / least(a, b) ELSE 0 END, 6) AS overlap FROM (
SELECT p_partkey, len(list_distinct(string_split(p_name, ' '))) a, len(list_distinct(string_split(lower(p_type), ' '))) b, len(list_intersect(string_split(p_name, ' '), string_split(lower(p_type), ' '))) inter FROM part)""")
def word_overlap(spark, d):
    """Overlap coefficient of word sets."""
    return table(spark, d, "part").select("p_partkey", F.round(N.overlap(F.split("p_name", " "), F.split(F.lower("p_type"), " ")), 6).alias("overlap"))


@R.query("""WITH one AS (SELECT s_nationkey, min(s_suppkey) e FROM supplier GROUP BY 1 HAVING count(DISTINCT s_suppkey) = 1), o AS (SELECT s_nationkey, max(s_suppkey) e FROM supplier WHERE s_nationkey % 3 = 0 GROUP BY 1)
SELECT c_custkey, coalesce(o.e, one.e) AS before, coalesce(one.e, o.e) AS after FROM customer LEFT JOIN one ON one.s_nationkey = c_nationkey LEFT JOIN o ON o.s_nationkey = c_nationkey""")
def override_assignments(spark, d):
    """Unique keys assigned, and hand-made assignments for a third of the keys: before the automatic ones, and after them."""
    s = table(spark, d, "supplier")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("s_nationkey"))
    got = c.join(M.unique_by_key(s, ["s_nationkey"], "s_suppkey"), "s_nationkey", "left")
    made = s.where("s_nationkey % 3 = 0").groupBy("s_nationkey").agg(F.max("s_suppkey").alias("s_suppkey"))
    first = M.with_overrides(got, made, ["s_nationkey"], "s_suppkey", first=True).withColumnRenamed("s_suppkey", "before")
    return first.join(M.with_overrides(got, made, ["s_nationkey"], "s_suppkey", first=False).select("c_custkey", F.col("s_suppkey").alias("after")), "c_custkey").select("c_custkey", "before", "after")


@R.query("""SELECT l_returnflag, 0.0 AS position, printf('%.1f', quantile_cont(l_extendedprice, 0.02)) AS "label" FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 0.5, printf('%.1f', quantile_cont(l_extendedprice, 0.5)) FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 1.0, printf('%.1f', quantile_cont(l_extendedprice, 0.98)) FROM lineitem GROUP BY 1""")
def legend_marks(spark, d):
    """Labels of a legend's ends and middle."""
    return S.legend_labels(S.colour_domain(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"]))


@R.query("""SELECT page_id, CASE WHEN contains(lower(html), 'box.com') OR contains(lower(html), 'boxcdn') THEN 'box' WHEN contains(lower(html), 'tableau') THEN 'tableau'
WHEN contains(lower(html), 'just a moment') OR contains(lower(html), 'cf-browser-verification') OR contains(lower(html), 'challenge-platform') THEN 'cloudflare' END AS reason,
CASE WHEN contains(lower(substr(html, 1, 512)), '<html') OR contains(lower(substr(html, 1, 512)), '<!doctype html') THEN 'html' ELSE 'other' END AS kind FROM pages""")
def page_kinds(spark, d):
    """Kind of every page by its whole text, and why it is no document."""
    return table(spark, d, "pages").select("page_id", X.block_reason(F.col("html")).alias("reason"), X.file_kind(F.col("html"), F.lit(None).cast("string"), strict=True).alias("kind"))
