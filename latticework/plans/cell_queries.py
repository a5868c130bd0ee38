"""Queries over whole texts, of cell cleaning and display, of orders, and of tables written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions import names as N
from ..operators import extract as X
from ..operators import resolve as M
from ..operators import serve as V
from ..operators import upsert as U
from ..operators import validate as D
from ..operators.order import numbered
from ..sources import readers as I
from ..sources import sinks as K
from ..storage import shared_folder
from .registry import Registry, table

R = Registry()


def _folder(spark, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


# Normal forms in SQL, step by step. Letters beyond ASCII count as letters beside a word, as they do in the operators.
_KEEP = "regexp_replace({t}, '[\\x{{00aa}}\\x{{00b5}}\\x{{00ba}}\\x{{00c0}}-\\x{{00d6}}\\x{{00d8}}-\\x{{00f6}}\\x{{00f8}}-\\x{{024f}}]', '_', 'g')"


def _sub(t: str, *pairs: tuple[str, str]) -> str:
    for a, b in pairs:
        t = f"regexp_replace({t}, '{a}', '{b}', 'g')"
    return t


def _words_sql(t: str, stop: tuple[str, ...] = (), mapped: dict[str, str] | None = None) -> str:
    out = f"list_filter(string_split({t}, ' '), lambda w: w <> ''" + (f" AND w NOT IN ({', '.join(map(repr, stop))})" if stop else "") + ")"
    if mapped:
        cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in mapped.items())
        out = f"list_transform({out}, lambda w: CASE w {cases} ELSE w END)"
    return f"array_to_string({out}, ' ')"


_LOW = f"replace({_KEEP.format(t='trim(lower(x))')}, '&', ' and ')"
_LISTING = _sub("trim(" + _sub(_words_sql(_sub(_LOW, ("--|[–—]", " "), (r"\bat\b", " "), (r"\bst\.?\b", "saint"), (r"[^a-z0-9\s]", " "), (r"\s+", " ")), mapped=N.SYSTEMS), (r"\bmain campus\b", " "), ("^the\\b", " "), (r"\s+", " ")) + ")")
_EXPORT = _words_sql(_sub(_LOW, (r"\bst\.?\b", "saint"), ("-", " "), ("[^a-z0-9 ]", " ")), N.EXPORT_STOP)
_SECOND = "trim(" + _sub(_LOW, ("[-/]+", " "), ("[^a-z0-9 ]+", " "), (r"\bsaint\b", "st"), (r"\bagricultural and mechanical\b", "a and m"), (r"\buniv\b", "university"), (r"\s+", " ")) + ")"
_SCORE = "trim(" + _sub(_words_sql(_sub(f"replace(replace({_sub(_LOW, ('[‐-―/-]+', ' '), ('[^a-z0-9 ]+', ' '))}, 's d ', 'south dakota '), 'u s ', 'united states ')", (r"\bpenn state\b", "pennsylvania state"), (r"\bsaint\b", "st"), (r"\bthe\b", " ")), mapped=N.SCORE_ABBREVIATIONS), (r"\b[0-9]+\b$", ""), (r"\s+", " ")) + ")"
_PROXY = _words_sql(_sub("replace(lower(x), 'saint ', 'st ')", ("[^a-z0-9 ]", " ")), N.PROXY_STOP)
_FORMS = {"listing": _LISTING, "core": _words_sql(_LISTING, N.LISTING_NOISE), "export": _EXPORT, "second_pass": _SECOND, "score": _SCORE, "proxy": _PROXY}


@R.query(f"""WITH t AS (SELECT doc_id, coalesce("text", '') x FROM documents), f AS (SELECT doc_id, {', '.join(f'{sql} {n}' for n, sql in _FORMS.items())} FROM t)
SELECT doc_id, {', '.join(f'md5({n}) {n}' for n in _FORMS)}, length(listing)::INTEGER AS "length" FROM f""")
def name_forms(spark, d):
    """All normal forms of whole document texts, as digests."""
    t, form = F.col("text"), F.col("form")
    docs = table(spark, d, "documents").select("doc_id", "text", N.listing_form(t).alias("form"))
    made = {"listing": form, "core": N.core_of(form), "export": N.export_form(t), "second_pass": N.second_pass_form(t), "score": N.score_form(t), "proxy": N.proxy_form(t)}
    return docs.select("doc_id", *[F.md5(c).alias(n) for n, c in made.items()], F.length(form).alias("length"))


@R.query("""WITH k AS (SELECT lang, "text", min(doc_id) lo, count(DISTINCT doc_id) n FROM documents GROUP BY ALL)
SELECT doc_id asked, CASE WHEN n = 1 THEN lo END doc_id, CASE WHEN n = 1 THEN 'exact' WHEN n > 1 THEN 'ambiguous_exact' END AS method FROM documents d LEFT JOIN k USING (lang, "text")""")
def exact_unique_texts(spark, d):
    """Whole texts of every document looked up within their language: those of one document, and those of several."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    return M.exact_match(docs.withColumnRenamed("doc_id", "asked"), docs, ["lang", "text"], "doc_id").select("asked", "doc_id", "method")


_A = "1000 + doc_id % 9000"


def _data_set(spark, d):
    """Every document with the fields of a data-set file set between its whole text and its whole text once more."""
    fields = F.expr(f"""concat('Submitted GPA: ', doc_id % 5, '..', lpad(string(doc_id % 100), 2, '0'), '\\nTop tenth of high school graduating class ', doc_id % 100, '.5 %\\n',
        'live off campus or commute 11% ', doc_id % 90, '%\\n99% ', '\\nPercentage of need that was met ', doc_id % 97, ' %\\nAverage financial aid package $ ', doc_id % 90 + 10, ',', lpad(string(doc_id % 1000), 3, '0'),
        '\\nTotal scholarships / grants $', n_chars, ' $ 7,', lpad(string(doc_id % 1000), 3, '0'), '\\nDegree-seeking ', {_A}, ' 12 3\\nApplied for need-based aid 4 5 6\\nDetermined ', doc_id % 1000, ' 8 9\\n')""")
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.concat(text, F.lit("\nCommon Data Set 2019-20\n"), fields, text, F.lit("\nCOMMON DATA SET 2021/2022\n"), text).alias("t"), F.length(text).alias("n"))


@R.query(f"""SELECT doc_id, CASE WHEN doc_id % 5 > 0 OR doc_id % 100 > 0 THEN doc_id % 5 + (doc_id % 100) / 100.0::DOUBLE END hs_gpa, doc_id % 100 + 0.5::DOUBLE pct_top10_hs, (doc_id % 90)::DOUBLE pct_commuter, (doc_id % 97)::DOUBLE pct_need_met,
n_chars need_aid_total, 7000 + doc_id % 1000 merit_aid_total, (doc_id % 90 + 10) * 1000 + doc_id % 1000 avg_aid_package, CASE WHEN doc_id % 1000 <= {_A} THEN round(100.0::DOUBLE * (doc_id % 1000) / ({_A}), 2) END pct_demonstrated_need FROM documents""")
def data_set_fields(spark, d):
    """All anchored fields out of long texts: each lies between two whole documents."""
    return _data_set(spark, d).select("doc_id", *[c.alias(n) for n, c in X.document_fields(F.col("t")).items()])


@R.query("""SELECT doc_id, '2019-2020' before, '2019-2020' AS inside, '2021-2022' AS after, 2::INTEGER n FROM documents""")
def section_years_texts(spark, d):
    """Years of the sections of long texts: before the first header, inside the first section, in the second."""
    h = X.year_headers("t")
    at = {"before": F.lit(0), "inside": F.length("t") - F.col("n") - 40, "after": F.length("t")}
    t = _data_set(spark, d).withColumn("h", h)
    return t.select("doc_id", *[X.header_at(F.col("h"), c).alias(n) for n, c in at.items()], F.size("h").alias("n"))


@R.query("""WITH f AS (SELECT o_custkey, o_orderkey k, (year(o_orderdate) + 20) || '-' || (year(o_orderdate) + 21) y, CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice END hs_gpa, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END pct_top10_hs,
CASE WHEN o_orderpriority = '5-LOW' THEN (year(o_orderdate) + 21) || '-' || (year(o_orderdate) + 22) WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE (year(o_orderdate) + 20) || '-' || (year(o_orderdate) + 21) END gy FROM orders),
c AS (SELECT o_custkey, coalesce(arg_min(y, k) FILTER (y IN ('2015-2016', '2016-2017', '2017-2018') AND (hs_gpa IS NOT NULL OR pct_top10_hs IS NOT NULL)), max(y) FILTER (y IN ('2015-2016', '2016-2017', '2017-2018'))) cds_year FROM f GROUP BY 1)
SELECT o_custkey, cds_year, arg_min(hs_gpa, k) FILTER (hs_gpa IS NOT NULL AND coalesce(gy = cds_year, true)) hs_gpa, arg_min(pct_top10_hs, k) FILTER (pct_top10_hs IS NOT NULL AND y = cds_year) pct_top10_hs
FROM f JOIN c USING (o_custkey) WHERE cds_year IS NOT NULL GROUP BY ALL""")
def assembled_rows(spark, d):
    """One row of several files of an entity: its year, and the first value of each field that is not of another year."""
    y = F.year("o_orderdate") + 20
    year = F.concat_ws("-", y, y + 1)
    files = table(spark, d, "orders").select(
        "o_custkey", "o_orderkey", year.alias("file_year"), F.when(F.col("o_orderpriority") == "2-HIGH", F.col("o_totalprice")).alias("hs_gpa"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("pct_top10_hs"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.concat_ws("-", y + 1, y + 2)).when(F.col("o_orderpriority") != "1-URGENT", year).alias("hs_gpa_year"), year.alias("pct_top10_hs_year"),
    )
    return X.assemble_row(files, "o_custkey", "o_orderkey", ["hs_gpa", "pct_top10_hs"], ["2015-2016", "2016-2017", "2017-2018"])


_CELL = "CASE event_id % 6 WHEN 0 THEN ' 1,' || lpad((event_id % 1000)::VARCHAR, 3, '0') || ' ' WHEN 1 THEN '$' || (event_id % 700) || '.5' WHEN 2 THEN 'n/a' WHEN 3 THEN 'about ' || event_id WHEN 4 THEN (event_id % 90) || '%' ELSE NULL END"
_POINT = "CASE event_id % 4 WHEN 0 THEN (event_id % 5) || '..' || (event_id % 10) WHEN 1 THEN (event_id % 8) || '.25' WHEN 2 THEN '.' || (event_id % 6) ELSE 'none' END"


@R.query(f"""WITH t AS (SELECT event_id, value, {_CELL} cell, {_POINT} gpa FROM events)
SELECT event_id, CASE event_id % 6 WHEN 0 THEN '1' || lpad((event_id % 1000)::VARCHAR, 3, '0') WHEN 1 THEN (event_id % 700) || '.5' WHEN 3 THEN cell WHEN 4 THEN (event_id % 90)::VARCHAR END AS stripped,
event_id % 6 IN (2, 5) AS lacking, nullif(CASE event_id % 4 WHEN 0 THEN event_id % 5 + (event_id % 10) / 10.0::DOUBLE WHEN 1 THEN CASE WHEN event_id % 8 < 5 THEN event_id % 8 + 0.25::DOUBLE END WHEN 2 THEN (event_id % 6)::DOUBLE END, 0) AS gpa,
CASE WHEN value <= 1 THEN value * 100 ELSE value END AS rate, CASE WHEN value = floor(value) THEN value::BIGINT::VARCHAR ELSE regexp_replace(regexp_replace(printf('%.4f', value), '0+$', ''), '[.]$', '') END AS compact FROM t""")
def cell_cleaning(spark, d):
    """Text cells stripped where that gives a number, missing marks, grade points, scales of rates, compact numbers."""
    e = table(spark, d, "events").select("event_id", "value", F.expr(_CELL.replace("::VARCHAR", "")).alias("cell"), F.expr(_POINT).alias("point"))
    return e.select("event_id", C.strip_if_number(F.col("cell")).alias("stripped"), C.contains_na(F.col("cell")).alias("lacking"), C.grade_point(F.col("point")).alias("gpa"), C.rate_percent(F.col("value")).alias("rate"), C.compact_number(F.col("value")).alias("compact"))


@R.query("""SELECT o_orderkey, CASE WHEN o_custkey % 200 < 10 THEN printf('%.1f', (o_custkey % 200)::DOUBLE) ELSE (o_custkey % 200)::VARCHAR END || '%' AS share, '$' || format('{:,}', o_orderkey * 1234) AS cost, '#' || (o_orderkey % 900) AS place,
CASE WHEN o_orderkey % 4 = 0 THEN format('{:,}', o_orderkey) ELSE printf('%.1f', o_orderkey + 0.3) END AS plain, round_even(o_custkey % 1000 / 10.0::DOUBLE, 1) AS points FROM orders""")
def displayed_values(spark, d):
    """Values as shown: percentages of fractions, currency, ranks, plain numbers; fractions as percentage points."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    plain = F.when(k % 4 == 0, k.cast("double")).otherwise(k + 0.3)
    return o.select("o_orderkey", C.display((F.col("o_custkey") % 200) / 100, "percent").alias("share"), C.display(k * 1234, "currency").alias("cost"), C.display(k % 900, "rank").alias("place"), C.display(plain, "number").alias("plain"), C.percent_points((F.col("o_custkey") % 1000) / F.lit(1000.0)).alias("points"))


@R.query("""SELECT p_partkey, array_to_string([p_name, p_brand || '  ' || p_type], ';') AS bars, array_to_string([p_name, p_brand, p_type], ';') AS gaps FROM part""")
def alias_parts(spark, d):
    """Aliases split at bars alone, and at wide gaps too; blank parts go."""
    p = table(spark, d, "part").withColumn("a", F.concat("p_name", F.lit(" | |"), "p_brand", F.lit("  "), "p_type", F.lit("|")))
    return p.select("p_partkey", F.array_join(C.aliases(F.col("a")), ";").alias("bars"), F.array_join(C.aliases(F.col("a"), True), ";").alias("gaps"))


@R.query("""WITH w AS (SELECT p_partkey, string_split(lower(p_name || ' ' || p_type), ' ') q, string_split(lower(p_name || ' of ' || p_brand), ' ') e FROM part)
SELECT p_partkey, round(len(list_intersect(q, e))::DOUBLE / len(list_distinct(q)), 6) AS recall, len(list_filter(list_distinct(q), lambda x: length(x) >= 3 AND NOT list_contains(e, x))) AS missing FROM w""")
def word_recall(spark, d):
    """Share of a query's words that a candidate has, and how many longer ones it lacks."""
    split = lambda *c: F.split(F.lower(F.concat_ws(" ", *c)), " ")
    q, e = split("p_name", "p_type"), split("p_name", F.lit("of"), "p_brand")
    return table(spark, d, "part").select("p_partkey", F.round(N.recall(q, e), 6).alias("recall"), F.size(N.missing(q, e)).cast("long").alias("missing"))


_RANK_TEXT = "CASE WHEN o_orderpriority = '5-LOW' THEN 'NA' ELSE (o_orderkey % 500)::VARCHAR END"


@R.query(f"""WITH t AS (SELECT o_orderkey, try_cast({_RANK_TEXT} AS BIGINT) v FROM orders) SELECT o_orderkey, row_number() OVER (ORDER BY v NULLS LAST, o_orderkey) up, row_number() OVER (ORDER BY v DESC NULLS LAST, o_orderkey) down FROM t""")
def legacy_places(spark, d):
    """Places by a rank column with NA marks, which stay last both ways."""
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderpriority") == "5-LOW", "NA").otherwise((F.col("o_orderkey") % 500).cast("string")).alias("rank"))
    up = numbered(o, [V.legacy_order("rank"), "o_orderkey"], "up").select("o_orderkey", "up")
    return up.join(numbered(o, [V.legacy_order("rank", True), "o_orderkey"], "down").select("o_orderkey", "down"), "o_orderkey")


@R.query("""SELECT c_custkey, row_number() OVER (ORDER BY list_position([7, 3, 11], c_custkey) NULLS LAST, c_name) AS place FROM customer""")
def picked_places(spark, d):
    """Picked entities in the order of picking, then the others by name."""
    return numbered(table(spark, d, "customer").select("c_custkey", "c_name"), V.picked_first("c_custkey", [7, 3, 11], "c_name")).select("c_custkey", "place")


@R.query("""WITH g AS (SELECT o_custkey, CASE WHEN max(o_orderkey) % 5 = 0 THEN NULL WHEN max(o_orderkey) % 5 = 1 THEN 0.0::DOUBLE ELSE max(o_totalprice) END gap FROM orders GROUP BY 1)
SELECT o_custkey, row_number() OVER (ORDER BY CASE WHEN coalesce(gap, 0) = 0 THEN -1 ELSE gap END DESC, o_custkey) AS place FROM g""")
def gap_places(spark, d):
    """Places by falling gap, where a gap of zero is as good as none."""
    top = F.max("o_orderkey") % 5
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.when(top == 0, None).when(top == 1, F.lit(0.0)).otherwise(F.max("o_totalprice")).alias("gap"))
    return numbered(g, D.gap_order("gap", "o_custkey")).select("o_custkey", "place")


@R.query("""WITH s AS (SELECT c_custkey, c_nationkey FROM customer), c AS (SELECT o_custkey, year(o_orderdate) y, count(*) FILTER (o_orderstatus = 'F') a, count(*) FILTER (o_orderstatus <> 'F') b, CASE WHEN max(o_totalprice) > 200000 THEN round(max(o_totalprice)) END v FROM orders GROUP BY ALL)
SELECT c_custkey, CASE WHEN count(*) FILTER (a = 1 AND b = 1) > 0 THEN arg_max(struct_pack(v := v), y) FILTER (a = 1 AND b = 1).v ELSE arg_max(v, y) FILTER (v IS NOT NULL) END AS "value", count(*) FILTER (a = 1 AND b = 1) > 0 AS matched FROM s LEFT JOIN c ON o_custkey = c_custkey GROUP BY 1""")
def matched_bands(spark, d):
    """The year whose two counts equal the stored pair, and its value; else the newest year with a value."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("year")).agg(
        F.array(F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_orderstatus") != "F")).alias("bands"), F.max("o_totalprice").alias("top"))
    o = o.select("c_custkey", "year", "bands", F.when(F.col("top") > 200000, F.round("top")).alias("value"))
    stored = table(spark, d, "customer").select("c_custkey", F.expr("array(1L, 1L)").alias("stored"))
    return M.match_bands(stored, o, "c_custkey", "stored", "bands", "year", "value")


@R.query("""SELECT o_orderkey::VARCHAR o_orderkey, nullif(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority || ', "x"' END, '') note, year(o_orderdate)::VARCHAR AS "year" FROM orders""")
def csv_cells(spark, d):
    """Rows written as CSV in canonical order, blanks for nulls, and read back as text cells; quotes and commas survive."""
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.concat("o_orderpriority", F.lit(', "x"'))).alias("note"), F.year("o_orderdate").alias("year"))
    path = _folder(spark, "csv")
    K.write_csv(o, path, [F.col("year"), F.col("o_orderkey")], ["o_orderkey", "note", "year"])
    return I.csv_text(spark, path, ["o_orderkey", "note", "year"])


@R.query("""SELECT c_custkey, c_name FROM customer""")
def json_shapes(spark, d):
    """Landed JSON of all three shapes (a list, or a list under a name), a file for each thousand of rows."""
    rows = table(spark, d, "customer").select("c_custkey", "c_name", F.floor(F.col("c_custkey") / 1000).alias("file"))
    body = F.to_json(F.collect_list(F.struct("c_custkey", "c_name")))
    k = F.col("file") % 3
    text = F.when(k == 0, F.col("b")).when(k == 1, F.concat(F.lit('{"rows":'), "b", F.lit("}"))).otherwise(F.concat(F.lit('{"meta":1,"data":'), "b", F.lit("}")))
    path = _folder(spark, "json")
    rows.groupBy("file").agg(body.alias("b")).select("file", text.alias("value")).repartition("file").write.partitionBy("file").text(path)
    return I.json_records(spark, f"{path}/file=*", "c_custkey bigint, c_name string")


@R.query("""SELECT s_suppkey, s_name FROM supplier""")
def script_tables(spark, d):
    """Tables embedded in scripts, as plain arrays and inside JSON.parse, read back whole."""
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", F.floor(F.col("s_suppkey") / 500).alias("file"))
    b = F.to_json(F.collect_list(F.struct("s_suppkey", "s_name")))
    text = F.when(F.col("file") % 2 == 0, F.concat(F.lit("var a = 1;\nconst rows = "), "b", F.lit(";\n"))).otherwise(F.concat(F.lit("const rows = JSON.parse(`"), "b", F.lit("`);\n")))
    path = _folder(spark, "script")
    rows.groupBy("file").agg(b.alias("b")).select("file", text.alias("value")).repartition("file").write.partitionBy("file").text(path)
    return I.embedded_json(spark, f"{path}/file=*", "rows", "s_suppkey bigint, s_name string")


_YEARS = (1993, 1994, 1995, 1996)


@R.query(f"""WITH n AS (SELECT o_custkey, year(o_orderdate)::INTEGER y, count(*) c FROM orders GROUP BY ALL) SELECT o_custkey::VARCHAR id, 'Name ' || o_custkey AS "name", y AS "year", c::INTEGER AS "rank", 'National' AS category FROM n WHERE y IN {_YEARS} AND o_custkey % 3 > 0""")
def sheet_ranks(spark, d):
    """A wide sheet of ranks, its header found among the leading rows, in long form; tied ranks and rows without an id."""
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    wide = o.groupBy("o_custkey").agg(*[F.count_if(F.col("y") == y).alias(f"n{y}") for y in _YEARS])
    ident = F.when(F.col("o_custkey") % 3 > 0, F.concat(F.lit("id "), "o_custkey"))
    cells = F.array(F.concat(F.lit(" Name "), "o_custkey"), ident, *[F.when(F.col(f"n{y}") > 0, F.concat(F.col(f"n{y}"), F.lit("T"))) for y in _YEARS])
    head = spark.createDataFrame([(0, ["Ranks", None]), (1, ["School name", "IPEDS id", *map(str, _YEARS)])], "row long, cells array<string>")
    rows = head.unionByName(wide.select((F.col("o_custkey") + 2).alias("row"), cells.alias("cells")))
    at = I.header_row(rows, "cells", "row")
    header = rows.where(F.col("row") == at).first()["cells"]
    return I.sheet_history(rows.where(F.col("row") > at), "cells", "row", I.header_columns(header), "National")


@R.query("""SELECT year(o_orderdate)::INTEGER AS "year", count(*) n, round(sum(CASE WHEN year(o_orderdate) = 1995 THEN 2 * o_totalprice ELSE o_totalprice END), 2) total FROM orders GROUP BY 1""")
def replaced_slices(spark, d):
    """Slices by year, one replaced (twice, to the same effect), the others untouched; written only past a quality gate."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    U.require(o, keyed=F.count_if(F.col("o_orderkey").isNull()) == 0, filled=F.count("*") > 0)
    path = _folder(spark, "slices")
    K.replace_slices(o, path, ["year"])
    for _ in range(2):
        K.replace_slices(o.where("year = 1995").withColumn("o_totalprice", 2 * F.col("o_totalprice")), path, ["year"])
    back = K.write_version(spark.read.parquet(path), _folder(spark, "versions"), 1)
    return spark.read.parquet(back).groupBy("year").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@R.query("""SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment IN ('FURNITURE', 'MACHINERY') AND c_nationkey = 3""")
def toggled_customers(spark, d):
    """A toggle that is on, one that is off, a choice of several values and a choice of none."""
    defs = [V.FilterDef("home", "toggle", "c_nationkey", 3), V.FilterDef("broke", "toggle", "c_acctbal", 0.0), V.FilterDef("segment", "select", "c_mktsegment"), V.FilterDef("name", "select", "c_name")]
    on = V.predicate(defs, {"home": True, "broke": False, "segment": ["FURNITURE", "MACHINERY"], "name": []})
    return table(spark, d, "customer").where(on).select("c_custkey", "c_acctbal")


@R.query("""WITH s AS (SELECT o_custkey, list(DISTINCT o_orderstatus) st FROM orders GROUP BY 1) SELECT o_custkey, list_has_all(st, ['F', 'O']) AS "first", list_has_all(st, ['P']) AS "second", list_has_all(st, ['F', 'O', 'P']) AS "every" FROM s""")
def region_ticks(spark, d):
    """Which regions have all of their members selected, and whether all have."""
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("st"))
    marks = V.region_marks(F.col("st"), {"first": ["F", "O"], "second": ["P"]})
    return s.select("o_custkey", marks.alias("m")).select("o_custkey", "m.first", "m.second", F.col("m.all").alias("every"))


@R.query("""SELECT c_custkey AS c_name, c_name AS c_name_2, c_mktsegment AS c_name_3, c_acctbal AS col FROM customer""")
def unique_columns(spark, d):
    """Columns under clean names of their headers, which clash."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    return c.toDF(*I.unique_names(["C Name", "c-name", " C  name! ", "%"]))


@R.query("""SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority || ' é' END AS note FROM orders""")
def json_lines(spark, d):
    """Rows written as JSON lines in UTF-8, nulls kept, and read back."""
    path = _folder(spark, "lines")
    o = table(spark, d, "orders")
    K.write_json(o.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.concat("o_orderpriority", F.lit(" é"))).alias("note")), path)
    return spark.read.schema("o_orderkey bigint, note string").json(path)


@R.query("""SELECT count(*) said, count(*)::INTEGER held, '2024-01-01' AS at FROM nation WHERE contains(lower(n_name), '_1')""")
def envelopes(spark, d):
    """An answer {data, meta} of the rows that a search finds, parsed back."""
    body = V.envelope(table(spark, d, "nation").select("n_nationkey", "n_name"), "2024-01-01", "_1", ["n_name"])
    got = body.select(F.from_json("body", "data array<struct<n_nationkey:bigint,n_name:string>>, meta struct<count:bigint,generatedAt:string>").alias("b"))
    return got.select(F.col("b.meta.count").alias("said"), F.size("b.data").alias("held"), F.col("b.meta.generatedAt").alias("at"))
