"""Panel, upsert and statistics queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean as C
from ..operators import panel as P
from ..operators import stats as S
from ..operators import upsert as U
from ..operators import validate as V
from .registry import Registry, table

R = Registry()


def _orders_long(spark: SparkSession, d: str) -> DataFrame:
    """First source: yearly facts of customers from their finished orders, under the source's own names."""
    o = table(spark, d, "orders").where("o_orderstatus <> 'O'")
    wide = o.groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("value_total"), F.count("*").cast("double").alias("orders"))
    return P.harmonise(P.melt(wide, ["entity", "year"], ["value_total", "orders"]), {"value_total": "total_price", "orders": "order_count"}, strict=False)


def _lines_long(spark: SparkSession, d: str) -> DataFrame:
    """Second source: the same from the lines of all orders, under canonical names."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice")
    wide = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("year"))
    wide = wide.agg(F.round(F.sum("l_extendedprice"), 2).alias("total_price"), F.count("*").cast("double").alias("line_count"))
    return P.melt(wide, ["entity", "year"], ["total_price", "line_count"])


_SOURCES = """
a AS (SELECT entity, year, variable, value FROM (
        SELECT o_custkey entity, year(o_orderdate) AS year, round(sum(o_totalprice), 2) total_price, count(*)::DOUBLE order_count
        FROM orders WHERE o_orderstatus <> 'O' GROUP BY ALL) UNPIVOT (value FOR variable IN (total_price, order_count))),
b AS (SELECT entity, year, variable, value FROM (
        SELECT o_custkey entity, year(o_orderdate) AS year, round(sum(l_extendedprice), 2) total_price, count(*)::DOUBLE line_count
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) UNPIVOT (value FOR variable IN (total_price, line_count)))
"""


@R.query(f"""WITH {_SOURCES}, u AS (SELECT *, 'o' s FROM a UNION ALL SELECT *, 'l' s FROM b)
SELECT variable, year, count(DISTINCT entity) FILTER (s = 'o') n_orders, count(DISTINCT entity) FILTER (s = 'l') n_lineitem,
       count(DISTINCT entity) n_merged, round(count(DISTINCT entity) * 100.0::DOUBLE / 1249, 2) pct
FROM u GROUP BY variable, year""")
def panel_coverage(spark, d):
    """Coverage of each (variable, year) by two sources and their union, over a constant universe."""
    return P.coverage([("orders", _orders_long(spark, d)), ("lineitem", _lines_long(spark, d))], "entity", ["variable", "year"], 1249)


@R.query(f"""WITH {_SOURCES} SELECT coalesce(a.entity, b.entity) entity, coalesce(a.year, b.year) AS year, coalesce(a.variable, b.variable) variable,
       round(coalesce(a.value, b.value), 1) AS value, CASE WHEN a.entity IS NULL THEN 'lineitem' ELSE 'orders' END AS source
FROM a FULL JOIN b ON a.entity = b.entity AND a.year = b.year AND a.variable = b.variable""")
def coalesce_sources(spark, d):
    """Two-source coalesce with provenance."""
    out = P.coalesce_sources([("orders", _orders_long(spark, d)), ("lineitem", _lines_long(spark, d))], ["entity", "year", "variable"])
    return out.withColumn("value", F.round("value", 1))


@R.query(f"""WITH {_SOURCES}, c AS (SELECT coalesce(a.entity, b.entity) entity, coalesce(a.year, b.year) AS year, coalesce(a.variable, b.variable) variable, coalesce(a.value, b.value) AS value
  FROM a FULL JOIN b ON a.entity = b.entity AND a.year = b.year AND a.variable = b.variable)
SELECT entity, year, round(max(value) FILTER (variable = 'total_price'), 1) total_price, max(value) FILTER (variable = 'order_count') order_count,
       max(value) FILTER (variable = 'line_count') line_count FROM c GROUP BY entity, year""")
def widen_panel(spark, d):
    """Long to wide with a fixed list of columns."""
    long = P.coalesce_sources([("orders", _orders_long(spark, d)), ("lineitem", _lines_long(spark, d))], ["entity", "year", "variable"])
    return P.widen(long, ["entity", "year"], ["total_price", "order_count", "line_count"]).withColumn("total_price", F.round("total_price", 1))


@R.query("""SELECT l_orderkey, l_linenumber, variable, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
UNPIVOT (value FOR variable IN (l_quantity, l_extendedprice, l_discount, l_tax))""")
def melt_lineitem(spark, d):
    return P.melt(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@R.query("""SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, """ + ", ".join(f"round(sum(value) FILTER (event_type = '{t}'), 4) AS {t}" for t in ("click", "view", "purchase")) + """
FROM events GROUP BY ALL""")
def pivot_events_daily(spark, d):
    e = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")).groupBy("user_id", "day", "event_type").agg(F.round(F.sum("value"), 4).alias("value"))
    return P.widen(e, ["user_id", "day"], ["click", "view", "purchase"], "event_type")


@R.query("""SELECT c_custkey, c_name, n_name, r_name, round(total, 2) total FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) total FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def master_enrich(spark, d):
    """Panel with a directory, and of duplicate facts the last."""
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    facts = P.last_wins(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice"), ["c_custkey"], "o_orderkey")
    out = P.enrich(P.enrich(table(spark, d, "customer"), nation, "c_nationkey"), facts, "c_custkey")
    return out.select("c_custkey", "c_name", "n_name", "r_name", F.round("o_totalprice", 2).alias("total"))


@R.query("""WITH e AS (SELECT user_id, year(ts) * 100 + month(ts) ym, event_id, CASE WHEN event_type = 'click' AND value >= 50 THEN value END a, CASE WHEN event_type = 'view' AND value >= 50 THEN value END b FROM events)
SELECT user_id, round(arg_max(a, (ym, event_id)) FILTER (a IS NOT NULL), 4) a, max(ym) FILTER (a IS NOT NULL) a_year,
       round(arg_max(b, (ym, event_id)) FILTER (b IS NOT NULL), 4) b, max(ym) FILTER (b IS NOT NULL) b_year FROM e GROUP BY user_id""")
def latest_nonnull(spark, d):
    """Latest known value per variable, with its period; equal periods: the later row."""
    known = lambda t: F.when((F.col("event_type") == t) & (F.col("value") >= 50), F.col("value"))
    e = table(spark, d, "events").select("user_id", "event_id", (F.year("ts") * 100 + F.month("ts")).alias("ym"), known("click").alias("a"), known("view").alias("b"))
    return P.latest(e, "user_id", "ym", ["a", "b"], "event_id").withColumns({c: F.round(c, 4) for c in "ab"})


@R.query("""SELECT user_id, round(arg_min(CASE WHEN event_type = 'click' THEN value END, event_id), 4) first_click, round(arg_min(CASE WHEN event_type = 'purchase' THEN value END, event_id), 4) first_purchase
FROM events GROUP BY user_id""")
def first_nonempty(spark, d):
    e = table(spark, d, "events").withColumns({f"first_{t}": F.when(F.col("event_type") == t, F.round("value", 4)) for t in ("click", "purchase")})
    return P.first_known(e, ["user_id"], ["first_click", "first_purchase"], "event_id")


@R.query("""WITH e AS (SELECT user_id, event_id, CASE WHEN value > 20 THEN 1 END x, CASE WHEN value > 60 THEN 1 END y, event_type FROM events)
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (x IS NOT NULL)::INT + (y IS NOT NULL)::INT DESC, event_id) n FROM e) WHERE n = 1""")
def richest_record(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("value") > 20, 1).alias("x"), F.when(F.col("value") > 60, 1).alias("y"), "event_type")
    return P.richest(e, ["user_id"], ["x", "y"], "event_id").select("user_id", "event_id", "event_type")


@R.query("""WITH o AS (SELECT o_custkey, o_orderstatus g, floor(o_totalprice / 1000) size, CASE WHEN o_totalprice > 1500 THEN round(o_totalprice, 2) END rate, o_orderkey FROM orders),
p AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, g ORDER BY size DESC, o_orderkey) n FROM o WHERE rate IS NOT NULL)
SELECT c.o_custkey, coalesce(max(rate) FILTER (g = 'F'), max(rate) FILTER (g = 'O')) rate FROM (SELECT DISTINCT o_custkey FROM orders) c LEFT JOIN p ON p.o_custkey = c.o_custkey AND n = 1 GROUP BY c.o_custkey""")
def subcohort_pick(spark, d):
    """Rate of the largest cohort of the preferred group, else of the fallback group."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", F.floor(F.col("o_totalprice") / 1000).alias("size"), F.when(F.col("o_totalprice") > 1500, F.round("o_totalprice", 2)).alias("rate"))
    return P.preferred_cohort(o, ["o_custkey"], "o_orderstatus", "size", "rate", "o_orderkey", ["F", "O"])


@R.query("""SELECT l_suppkey, round((sum(l_discount) - coalesce(sum(l_discount) FILTER (l_returnflag = 'R'), 0)) / (count(*) - count(*) FILTER (l_returnflag = 'R')), 4) rest_rate
FROM lineitem GROUP BY l_suppkey HAVING count(*) > count(*) FILTER (l_returnflag = 'R')""")
def derived_rest_rate(spark, d):
    """Rate of those outside a part, derived from total minus part."""
    part = F.col("l_returnflag") == "R"
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_discount").alias("h"), F.count_if(part).alias("pn"), F.coalesce(F.sum(F.when(part, F.col("l_discount"))), F.lit(0.0)).alias("ph"))
    return g.select("l_suppkey", P.remainder_rate(F.col("n"), F.col("h"), F.col("pn"), F.col("ph")).alias("rest_rate")).where("rest_rate IS NOT NULL")


@R.query("""WITH c AS (SELECT l_suppkey, sum(l_quantity) t, sum(l_quantity) FILTER (l_returnflag = 'A') a, sum(l_quantity) FILTER (l_returnflag = 'N') n, sum(l_quantity) FILTER (l_returnflag = 'R') r FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(a / t, 4) share_a, round(n / t, 4) share_n, round(r / t, 4) share_r, round(1 - (coalesce(a, 0) + coalesce(n, 0)) / t, 4) rest FROM c WHERE t > 0""")
def category_shares(spark, d):
    """Shares of categories in a total row, and the residual share."""
    li = table(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_returnflag").alias("flag")).agg(F.sum("l_quantity").alias("q"))
    total = li.groupBy("l_suppkey").agg(F.lit("total").alias("flag"), F.sum("q").alias("q"))
    return P.shares(li.unionByName(total), ["l_suppkey"], "flag", "q", {"A": "share_a", "N": "share_n", "R": "share_r"}, "total", ["A", "N"])


@R.query("""SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN s_acctbal END balance, round(CASE WHEN s_acctbal >= 0 THEN s_acctbal END + s_nationkey, 6) both_parts,
coalesce(CASE WHEN s_acctbal >= 5000 THEN s_acctbal END, CASE WHEN s_nationkey >= 10 THEN s_nationkey::DOUBLE END) first_of FROM supplier""")
def nullable_rate_filter(spark, d):
    s = table(spark, d, "supplier").withColumn("balance", C.non_negative(F.col("s_acctbal")))
    first = F.coalesce(F.when(F.col("s_acctbal") >= 5000, F.col("s_acctbal")), F.when(F.col("s_nationkey") >= 10, F.col("s_nationkey").cast("double")))
    return s.select("s_suppkey", "balance", C.both_sum(F.col("balance"), F.col("s_nationkey")).alias("both_parts"), first.alias("first_of"))


_RAW = "CASE WHEN p_size % 7 = 0 THEN 'N/A' WHEN p_size % 11 = 0 THEN 'about ' || p_size WHEN p_size % 5 = 0 THEN '$' || (p_size * 5) || '%' ELSE ' ' || (p_size * 3 - 10) || '%' END"


@R.query(f"""WITH r AS (SELECT p_partkey, {_RAW} raw FROM part), v AS (SELECT *, trim(regexp_replace(raw, '[,%$]', '', 'g')) bare, try_cast(trim(regexp_replace(raw, '[,%$]', '', 'g')) AS DOUBLE) x FROM r)
SELECT p_partkey, CASE WHEN x BETWEEN 0 AND 100 THEN 100 - x END AS value, CASE WHEN lower(bare) IN ('', 'na', 'n/a') THEN NULL WHEN x IS NULL THEN 'nonnumeric' WHEN x NOT BETWEEN 0 AND 100 THEN 'housing_pct_oor' END flag FROM v""")
def clean_flags(spark, d):
    """Range validation by kind with a flag."""
    out = table(spark, d, "part").select("p_partkey", C.checked(F.expr(_RAW), "inv_pct").alias("c"))
    return out.select("p_partkey", "c.value", "c.flag")


@R.query("""SELECT p_partkey, try_cast(nullif(regexp_extract(p_brand, '[0-9]+'), '') AS BIGINT) brand_no, try_cast(nullif(regexp_extract(o_orderpriority, '^\\s*([0-9]+)', 1), '') AS INTEGER) prio
FROM part LEFT JOIN orders ON o_orderkey = p_partkey""")
def parse_integers(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("p_partkey"), "o_orderpriority")
    j = table(spark, d, "part").select("p_partkey", "p_brand").join(o, "p_partkey", "left")
    return j.select("p_partkey", C.first_digits(F.col("p_brand")).try_cast("bigint").alias("brand_no"), C.leading_integer(F.col("o_orderpriority")).alias("prio"))


@R.query("""SELECT count(*) n, round(corr(l_quantity, l_extendedprice), 6) r, round(regr_r2(l_extendedprice, l_quantity), 6) r2, round(sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity), 6) slope FROM lineitem""")
def slope_and_correlation(spark, d):
    """Pearson correlation, R2 and the slope through the origin."""
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"), F.round(F.corr(x, y), 6).alias("r"), F.round(F.regr_r2(y, x), 6).alias("r2"), F.round(S.slope_through_origin(x, y), 6).alias("slope"))


_PRED = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@R.query("WITH p AS (" + " UNION ALL ".join(f"SELECT '{p}' predictor, count(*) n, round(corr({p}, l_extendedprice), 6) r FROM lineitem" for p in _PRED) + """)
SELECT predictor, n, r, row_number() OVER (ORDER BY abs(r) DESC, predictor) place, CASE WHEN r * r >= 0.6 THEN 'STRONG' WHEN r * r >= 0.35 THEN 'DECENT' ELSE 'WEAK' END verdict FROM p""")
def pearson_matrix(spark, d):
    """The best predictors with the verdict of each alone; joint_predictors has that of all together."""
    out = S.rank_predictors(table(spark, d, "lineitem"), "l_extendedprice", _PRED).drop("joint_r2")
    return out.withColumn("verdict", S.verdict(F.col("r") * F.col("r"))).withColumn("r", F.round("r", 6))


@R.query()
def joint_predictors(spark, d):
    """The best predictors with one verdict, from the joint fit of them all (no SQL: a fit of several predictors)."""
    return S.rank_predictors(table(spark, d, "lineitem"), "l_extendedprice", _PRED)


@R.query("""SELECT count(*)::BIGINT n, round(regr_intercept(l_extendedprice, l_quantity), 4) intercept, round(regr_slope(l_extendedprice, l_quantity), 4) slope, round(regr_r2(l_extendedprice, l_quantity), 6) r2 FROM lineitem""")
def ols_r2(spark, d):
    """Least squares by cross products; checked here with one predictor."""
    fit = S.least_squares(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])
    return spark.createDataFrame([(fit["n"], round(fit["intercept"], 4), round(fit["coefficients"]["l_quantity"], 4), round(fit["r2"], 6))], "n long, intercept double, slope double, r2 double")


_DOMAIN = "SELECT p_brand, quantile_cont(p_retailprice, 0.02) lo, quantile_cont(p_retailprice, 0.5) AS mid, quantile_cont(p_retailprice, 0.98) hi FROM part GROUP BY p_brand"


@R.query(f"SELECT p_brand, round(lo, 6) lo, round(mid, 6) AS mid, round(hi, 6) hi FROM ({_DOMAIN})")
def percentile_clamp(spark, d):
    return S.colour_domain(table(spark, d, "part"), "p_retailprice", ["p_brand"]).withColumns({c: F.round(c, 6) for c in ("lo", "mid", "hi")})


@R.query(f"""SELECT p_partkey, round(CASE WHEN p_retailprice <= mid THEN CASE WHEN mid = lo THEN 0.5 ELSE 0.5 * (p_retailprice - lo) / (mid - lo) END
ELSE CASE WHEN hi = mid THEN 0.5 ELSE 0.5 + 0.5 * (p_retailprice - mid) / (hi - mid) END END, 6) diverging, round(1 - CASE WHEN hi = lo THEN 0.5 ELSE (p_retailprice - lo) / (hi - lo) END, 6) reversed
FROM part JOIN ({_DOMAIN}) USING (p_brand)""")
def color_position(spark, d):
    p = table(spark, d, "part")
    j = p.join(S.colour_domain(p, "p_retailprice", ["p_brand"]), "p_brand")
    at = lambda dv, rv: F.round(S.colour_position(F.col("p_retailprice"), F.col("lo"), F.col("mid"), F.col("hi"), dv, rv), 6)
    return j.select("p_partkey", at(True, False).alias("diverging"), at(False, True).alias("reversed"))


@R.query("""SELECT round(min(p_retailprice) - (max(p_retailprice) - min(p_retailprice)) * 0.04, 4) lo, round(max(p_retailprice) + (max(p_retailprice) - min(p_retailprice)) * 0.04, 4) hi FROM part""")
def padded_extent(spark, d):
    return S.padded_extent(table(spark, d, "part"), "p_retailprice").withColumns({c: F.round(c, 4) for c in ("lo", "hi")})


@R.query("""WITH g AS (SELECT l_partkey, abs(l_extendedprice / l_quantity - p_retailprice) a, CASE WHEN l_returnflag = 'R' THEN abs(l_quantity * 20 - l_partkey % 700) END s FROM lineitem JOIN part ON l_partkey = p_partkey),
m AS (SELECT l_partkey, median(a) rate_gap, count(a) rate_n, median(s) score_gap, count(s) score_n FROM g GROUP BY 1)
SELECT l_partkey, round(rate_gap, 6) rate_gap, rate_n, round(score_gap, 6) score_gap, score_n, CASE WHEN (rate_n >= 2 AND rate_gap > 20) OR (rate_n = 1 AND rate_gap > 35) OR (rate_gap IS NULL AND score_gap > 250) THEN 'SUSPECT' ELSE 'OK' END verdict FROM m""")
def median_gap_verdict(spark, d):
    """Median absolute gaps per entity, and the verdict on its join."""
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    j = j.select("l_partkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("a"), "p_retailprice", F.when(F.col("l_returnflag") == "R", F.col("l_quantity") * 20).alias("s"), (F.col("l_partkey") % 700).alias("t"))
    g = V.median_gaps(j, "l_partkey", {"rate": ("a", "p_retailprice"), "score": ("s", "t")})
    g = g.withColumn("verdict", V.verdict(F.col("rate_gap"), F.col("rate_n"), F.col("score_gap")))
    return g.withColumns({c: F.round(c, 6) for c in ("rate_gap", "score_gap")})


def _base_delta(spark, d):
    """Base and delta of an upsert, of all users: slices by day that overlap."""
    e = table(spark, d, "events").groupBy("user_id", F.dayofweek("ts").alias("day"))
    base = e.agg(F.round(F.max(F.when(F.col("event_type") == "click", F.col("value"))), 4).alias("a"), F.round(F.max(F.when(F.col("event_type") == "purchase", F.col("value"))), 4).alias("b")).where("day <= 4")
    delta = e.agg(F.round(F.max(F.when(F.col("event_type") == "view", F.col("value"))), 4).alias("a"), F.round(F.min(F.when(F.col("value") > 90, F.col("value"))), 4).alias("b")).where("day >= 3")
    return base, delta


_E = "SELECT user_id, (dayofweek(ts) + 1)::INTEGER AS day, {} FROM events GROUP BY 1, 2"
_UPSERT = (
    "WITH o AS (SELECT * FROM (" + _E.format("round(max(value) FILTER (event_type = 'click'), 4) a, round(max(value) FILTER (event_type = 'purchase'), 4) b") + ") WHERE day <= 4), "
    "n AS (SELECT * FROM (" + _E.format("round(max(value) FILTER (event_type = 'view'), 4) a, round(min(value) FILTER (value > 90), 4) b") + ") WHERE day >= 3), "
    "j AS (SELECT coalesce(o.user_id, n.user_id) user_id, coalesce(o.day, n.day) AS day, o.user_id IS NULL fresh, n.user_id IS NOT NULL AND o.user_id IS NOT NULL hit, "
    "o.a oa, o.b ob, n.a na, n.b nb FROM o {how} JOIN n ON o.user_id = n.user_id AND o.day = n.day), "
    "m AS (SELECT user_id, day, fresh, hit, oa, ob, CASE WHEN fresh THEN na WHEN hit THEN {a} ELSE oa END a, CASE WHEN fresh THEN nb WHEN hit THEN {b} ELSE ob END b FROM j) "
    "SELECT user_id, day, a, b, CASE WHEN fresh THEN 'created' WHEN NOT hit THEN 'kept' WHEN (oa IS NULL AND a IS NOT NULL) OR (ob IS NULL AND b IS NOT NULL) THEN 'filled' "
    "WHEN a IS DISTINCT FROM oa OR b IS DISTINCT FROM ob THEN 'changed' ELSE 'unchanged' END AS change FROM m"
)


@R.query(_UPSERT.format(how="FULL", a="coalesce(na, oa)", b="coalesce(nb, ob)"))
def upsert_fill(spark, d):
    return U.upsert(*_base_delta(spark, d), ["user_id", "day"], ["a", "b"], "fill")


@R.query(_UPSERT.format(how="FULL", a="na", b="nb"))
def upsert_overwrite(spark, d):
    return U.upsert(*_base_delta(spark, d), ["user_id", "day"], ["a", "b"], "overwrite_blank")


@R.query(_UPSERT.format(how="LEFT", a="coalesce(na, oa)", b="coalesce(nb, ob)"))
def upsert_update_only(spark, d):
    return U.upsert(*_base_delta(spark, d), ["user_id", "day"], ["a", "b"], "update_only")


@R.query(_UPSERT.format(how="LEFT", a="coalesce(oa, na)", b="coalesce(ob, nb)"))
def backfill(spark, d):
    return U.upsert(*_base_delta(spark, d), ["user_id", "day"], ["a", "b"], "backfill")


#: Names that these had while the plain ones had a delta of even users only.
@R.query(_UPSERT.format(how="FULL", a="coalesce(na, oa)", b="coalesce(nb, ob)"))
def upsert_fill_all(spark, d):
    return upsert_fill(spark, d)


@R.query(_UPSERT.format(how="FULL", a="na", b="nb"))
def upsert_overwrite_all(spark, d):
    return upsert_overwrite(spark, d)


@R.query(_UPSERT.format(how="LEFT", a="coalesce(na, oa)", b="coalesce(nb, ob)"))
def upsert_update_only_all(spark, d):
    return upsert_update_only(spark, d)


@R.query(_UPSERT.format(how="LEFT", a="coalesce(oa, na)", b="coalesce(ob, nb)"))
def backfill_all(spark, d):
    return backfill(spark, d)


@R.query("""SELECT change, count(*) n FROM (""" + _UPSERT.format(how="FULL", a="coalesce(na, oa)", b="coalesce(nb, ob)") + """) GROUP BY 1""")
def upsert_audit_all(spark, d):
    return upsert_audit(spark, d)


@R.query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def anti_resume(spark, d):
    """Work that is not done yet."""
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return U.without_resolved(table(spark, d, "orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


@R.query("""SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 2000)""")
def semi_scope(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 2000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_semi")


@R.query("""SELECT event_type, count(*) n, min(user_id) lo FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 95) GROUP BY 1""")
def disjoint_merge(spark, d):
    e = table(spark, d, "events")
    rest = U.disjoint(e.where("event_type = 'purchase' AND value > 95"), e, ["user_id"])
    return rest.groupBy("event_type").agg(F.count("*").alias("n"), F.min("user_id").alias("lo"))


@R.query("""SELECT o_custkey, count(*) n FROM orders GROUP BY 1 HAVING count(*) > 1""")
def key_collisions(spark, d):
    from ..operators.resolve import key_collisions as collisions

    return collisions(table(spark, d, "orders"), ["o_custkey"])


@R.query("""SELECT * FROM (SELECT count(CASE WHEN lang <> '' THEN 1 END) n, round(count(CASE WHEN lang <> '' THEN 1 END) * 100.0::DOUBLE / count(*), 2) pct, 'lang' AS "column" FROM documents
UNION ALL SELECT count(CASE WHEN trim(source) <> '' THEN 1 END), round(count(CASE WHEN trim(source) <> '' THEN 1 END) * 100.0::DOUBLE / count(*), 2), 'source' FROM documents)""")
def nonblank_columns(spark, d):
    return P.nonblank_counts(table(spark, d, "documents"), ["lang", "source"])


@R.query("""SELECT o_orderpriority AS field, min(year(o_orderdate)) first_year, count(DISTINCT o_custkey) entities, count(*) filled FROM orders GROUP BY 1""")
def field_summary(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("field"), F.year("o_orderdate").alias("year"), "o_custkey", "o_totalprice")
    return P.field_summary(o, "o_custkey", "year", "field", "o_totalprice")


@R.query("""SELECT user_id, string_agg(DISTINCT event_type, ' | ' ORDER BY event_type) kinds FROM events GROUP BY 1""")
def joined_names(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(P.joined_names(F.col("event_type")).alias("kinds"))


@R.query("""SELECT user_id, min(event_id) first_row FROM events GROUP BY 1""")
def distinct_in_order(spark, d):
    return P.distinct_in_order(table(spark, d, "events"), "user_id", "event_id")


@R.query("""SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) weighted, round(avg(l_extendedprice), 4) plain FROM lineitem GROUP BY 1""")
def weighted_mean(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(S.weighted_mean(F.col("l_extendedprice"), F.col("l_quantity")), 4).alias("weighted"), F.round(F.avg("l_extendedprice"), 4).alias("plain"))


@R.query("""SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 4500) THEN NULL ELSE round(o_totalprice, 2) END price FROM orders""")
def suppress_suspects(spark, d):
    """Columns of suspect keys are blanked."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("price"))
    return U.suppress(o, table(spark, d, "orders").where("o_totalprice > 4500"), "o_custkey", ["price"]).select("o_orderkey", "price")


@R.query("""SELECT change, count(*) n FROM (""" + _UPSERT.format(how="FULL", a="coalesce(na, oa)", b="coalesce(nb, ob)") + """) GROUP BY 1""")
def upsert_audit(spark, d):
    """Counters of an upsert."""
    return U.change_counts(U.upsert(*_base_delta(spark, d), ["user_id", "day"], ["a", "b"], "fill"))


@R.query("""SELECT user_id, event_id FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, event_id FROM events e WHERE event_type = 'click' AND value > 99 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'view')""")
def append_missing(spark, d):
    e = table(spark, d, "events")
    return U.append_missing(e.where("event_type = 'view'"), e.where("event_type = 'click' AND value > 99"), ["user_id"]).select("user_id", "event_id")


@R.query(f"""WITH q AS ({_DOMAIN}) SELECT p_brand, (i::DOUBLE / 23) AS position, round(lo + (hi - lo) * i::DOUBLE / 23, 6) AS value FROM q, range(24) t(i)""")
def legend_samples(spark, d):
    return S.legend(S.colour_domain(table(spark, d, "part"), "p_retailprice", ["p_brand"])).select("p_brand", "position", F.round("value", 6).alias("value"))


@R.query("""SELECT p_partkey, round(sqrt((p_size - 25)^2 + (p_retailprice - 905)^2), 6) distance FROM part WHERE sqrt((p_size - 25)^2 + (p_retailprice - 905)^2) <= 500 ORDER BY distance LIMIT 1""")
def nearest_point(spark, d):
    p = S.nearest_point(table(spark, d, "part"), F.col("p_size"), F.col("p_retailprice"), (25, 905), 500)
    return p.select("p_partkey", F.round("distance", 6).alias("distance"))


@R.query("""SELECT l_returnflag, count(*) n, round(corr(l_quantity, l_extendedprice), 6) r FROM lineitem GROUP BY 1""")
def pearson_by_group(spark, d):
    return S.pearson(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", by=["l_returnflag"]).withColumn("r", F.round("r", 6))


@R.query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice - (SELECT regr_intercept(l_extendedprice, l_quantity) + regr_slope(l_extendedprice, l_quantity) * i.l_quantity FROM lineitem), 2) AS value_added FROM lineitem i""")
def residual_scores(spark, d):
    """Actual minus fitted values (an extension)."""
    out = S.residuals(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])
    return out.select("l_orderkey", "l_linenumber", F.round("value_added", 2).alias("value_added"))


@R.query("""SELECT count(*) n, count(*) FILTER (a = t) agree, count(*) FILTER (a IS NOT NULL AND a <> t) disagree, count(*) FILTER (a IS NULL) unresolved, round(avg((a IS NOT DISTINCT FROM t)::INT), 6) rate FROM (SELECT CASE WHEN p_size > 5 THEN p_size % 7 END a, CASE WHEN p_size > 2 THEN p_size % 14 END t FROM part) WHERE t IS NOT NULL""")
def match_agreement(spark, d):
    p = table(spark, d, "part").selectExpr("CASE WHEN p_size > 5 THEN p_size % 7 END a", "CASE WHEN p_size > 2 THEN p_size % 14 END t")
    return V.agreement(p, "a", "t").withColumn("rate", F.round("rate", 6))
