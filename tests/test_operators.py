"""Operators on literal rows: the cases that are easiest to get wrong."""

import difflib

import pytest
from pyspark.sql import functions as F

from latticework.functions import clean as C
from latticework.functions import names as N
from latticework.operators import extract as X
from latticework.operators import panel as P
from latticework.operators import resolve as M
from latticework.operators import serve as V
from latticework.operators import stats as S
from latticework.operators import upsert as U
from latticework.operators import validate as W
from latticework.plans import variables


def one(spark, column, *values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r["o"] for r in df.select("i", column(F.col("c")).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("fn", "cases"),
    [
        (C.lenient_number, {" $1,234.5 ": 1234.5, "12%": 12.0, "n/a": None, "-": None, "nan": None, "5d": None, "": None, None: None, "x": None, "1e3": 1000.0}),
        (C.leading_integer, {"12T": 12, " 7": 7, "T12": None, "": None}),
        (C.first_digits, {"ab123c4": "123", "": None}),
        (C.grade_point, {"3..71": 3.71, "0": None, "5": 5.0, "6.1": None, "4.512": 4.51}),
        (C.percentage, {".75": 75.0, "75%": 75.0, "101": None, "-1": None, "1": 1.0, "none": None}),
        (C.money, {"$1,234": 1234, "about 12.5": 12, "": None}),
        (C.strip_if_number, {"$1,200": "1200", "Yes, $5": "Yes, $5", "N/A": None, "--": None}),
        (C.aliases, {"a | b||c": ["a", "b", "c"], None: []}),
        (C.decode_entities, {"a&amp;lt;&nbsp;b": "a&lt; b"}),
        (C.year_from_url, {"cds_2023-2024.pdf": "2023-2024", "x/2023_24": "2023-2024", "2019/09/cds_2022-23": "2022-2023", "y2021z": "2021-2022", "none": None}),
    ],
    ids=lambda x: getattr(x, "__name__", ""),
)
def test_clean(spark, fn, cases):
    assert one(spark, fn, *cases) == list(cases.values())


def test_numbers(spark):
    assert one(spark, C.compact_number, 3.0, 3.25, 0.12345, -2.0, kind="double") == ["3", "3.25", "0.1235", "-2"]
    assert one(spark, lambda c: C.display(c, "percent"), 0.05, 0.5, kind="double") == ["5.0%", "50%"]
    assert one(spark, lambda c: C.display(c, "currency"), 12345.0, kind="double") == ["$12,345"]
    assert one(spark, C.rate_percent, 0.5, 1.0, 50.0, kind="double") == [50.0, 100.0, 50.0]
    rows = one(spark, lambda c: C.checked(c, "inv_pct"), "30", "130", "x", "NA")
    assert [tuple(r) for r in rows] == [(70.0, None), (None, "housing_pct_oor"), (None, "nonnumeric"), (None, None)]
    assert [tuple(r) for r in one(spark, C.split_last_comma, "San Jose, CA", "A, B, C", "X")] == [("San Jose", "CA"), ("A, B", "C"), ("X", None)]

    def slot(s):
        h = 0
        for ch in s:
            h = (h * 31 + ord(ch)) & 0xFFFFFFFF
        h = h - 2**32 if h >= 2**31 else h
        return abs(h) % 12

    keys = ["186131", "168342", "zzzzzzzzzzzz", "a"]
    assert one(spark, C.stable_slot, *keys) == [slot(k) for k in keys]


@pytest.mark.parametrize(
    ("fn", "cases"),
    [
        (N.listing_form, {"The University of St. Thomas": "university of saint thomas", "Binghamton University--SUNY": "binghamton university state university of new york", "Purdue University-Main Campus": "purdue university", "A & M at X": "a and m x", None: ""}),
        (N.listing_core, {"University of Colorado Denver": "colorado denver"}),
        (N.export_form, {"St. John's College, School of X": "saint john s x", "Art Institute at Main": "art"}),
        (N.second_pass_form, {"Saint Mary's / Agricultural and Mechanical Univ": "st mary s a and m university"}),
        (N.score_form, {"Penn State U.–Harrisburg 2": "pennsylvania state university harrisburg", "The S D Sch. of Tech": "south dakota sch of technology"}),
        (N.proxy_form, {"Saint Xavier University": "st xavier"}),
    ],
    ids=lambda x: getattr(x, "__name__", ""),
)
def test_names(spark, fn, cases):
    assert one(spark, fn, *cases) == list(cases.values())


def test_ratio_is_difflib(spark):
    pairs = [("college of x", "x college"), ("", ""), ("abc", "abd"), (None, "a")]
    got = [r["r"] for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").withColumn("r", N.gestalt_ratio("a", "b")).orderBy("i").collect()]
    assert got[:3] == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs[:3]] and got[3] is None


def test_panel(spark):
    long = spark.createDataFrame([("a", 1, "x", "1"), ("a", 1, "y", " "), ("b", 1, "x", "2")], "e string, year int, variable string, value string")
    other = spark.createDataFrame([("a", 1, "x", "9"), ("a", 1, "y", "8")], long.schema)
    got = {(r["e"], r["variable"]): (r["value"], r["source"]) for r in P.coalesce_sources([("first", long), ("second", other)], ["e", "year", "variable"]).collect()}
    assert got == {("a", "x"): ("1", "first"), ("a", "y"): ("8", "second"), ("b", "x"): ("2", "first")}
    with pytest.raises(ValueError):
        P.harmonise(long, {"x": "xx"})
    cover = P.coverage([("p", P.drop_blank(long, "value")), ("q", other)], "e", ["variable"], 4).orderBy("variable").collect()
    assert [tuple(r) for r in cover] == [("x", 2, 1, 2, 50.0), ("y", 0, 1, 1, 25.0)]
    rows = spark.createDataFrame([("a", 2020, 1, 5.0, None), ("a", 2021, 2, None, 7.0), ("a", 2021, 3, None, 8.0), ("b", 2020, 4, None, None)], "e string, y int, n int, p double, q double")
    assert [tuple(r) for r in P.latest(rows, "e", "y", ["p", "q"], "n").orderBy("e").collect()] == [("a", 5.0, 2020, 8.0, 2021), ("b", None, None, None, None)]
    assert P.richest(rows, ["e"], ["p", "q"], "n").where("e = 'a'").first()["n"] == 1
    assert P.last_wins(rows, ["e"], "n").where("e = 'a'").first()["q"] == 8.0
    cohort = spark.createDataFrame([(1, 99, 50, 0.5, 1), (1, 2, 10, 0.2, 2), (1, 2, 10, 0.3, 3), (1, 2, None, None, 4), (2, 99, None, 0.9, 5)], "e int, g int, size int, rate double, n int")
    assert [r["rate"] for r in P.preferred_cohort(cohort, ["e"], "g", "size", "rate", "n", [2, 99]).orderBy("e").collect()] == [0.2, 0.9]
    enrol = spark.createDataFrame([(1, 1, 50), (1, 8, 10), (1, 99, 100), (2, 1, 5), (3, 99, 0)], "e int, race int, n int")
    assert [tuple(r) for r in P.shares(enrol, ["e"], "race", "n", {1: "white", 8: "intl", 9: "unk"}, 99, [1, 8, 9]).collect()] == [(1, 0.5, 0.1, None, 0.4)]


def test_upsert(spark):
    schema = "k int, a int, b int"
    base = spark.createDataFrame([(1, 1, None), (2, 2, 2), (None, 7, 7)], schema)
    delta = spark.createDataFrame([(1, None, 5), (2, 9, None), (3, 3, None), (3, 4, None)], schema)
    got = {p: sorted((tuple(r) for r in U.upsert(base, delta, ["k"], ["a", "b"], p).collect()), key=repr) for p in U.POLICIES}
    kept, new = (None, 7, 7, "kept"), [(3, 3, None, "created"), (3, 4, None, "created")]
    assert got["fill"] == got["overwrite"] == sorted([(1, 1, 5, "filled"), (2, 9, 2, "changed"), *new, kept], key=repr)
    assert got["overwrite_blank"] == sorted([(1, None, 5, "filled"), (2, 9, None, "changed"), *new, kept], key=repr)
    assert got["backfill"] == sorted([(1, 1, 5, "filled"), (2, 2, 2, "unchanged"), kept], key=repr)
    assert got["update_only"] == sorted([(1, 1, 5, "filled"), (2, 9, 2, "changed"), kept], key=repr)
    assert got["insert_only"] == sorted([(1, 1, None, "unchanged"), (2, 2, 2, "unchanged"), *new, kept], key=repr)
    assert {r["k"]: r["a"] for r in U.suppress(base, spark.createDataFrame([(2,)], "k int"), "k", ["a"]).collect()} == {1: 1, 2: None, None: 7}
    with pytest.raises(ValueError, match="rows"):
        U.require(base, rows=F.count("*") > 5, keys=F.count("k") == 2)


def test_verdict(spark):
    rows = [(25.0, 2, None, "SUSPECT"), (25.0, 1, 999.0, "OK"), (36.0, 1, None, "SUSPECT"), (None, 0, 251.0, "SUSPECT"), (10.0, 3, 999.0, "OK"), (None, 0, None, "OK")]
    df = spark.createDataFrame(rows, "g double, n int, s double, want string")
    assert df.where(W.verdict(F.col("g"), F.col("n"), F.col("s")) != F.col("want")).count() == 0
    order = spark.createDataFrame([(1, 0.0), (2, None), (3, 5.0)], "e int, g double").orderBy(*W.gap_order("g", "e"))
    assert [r["e"] for r in order.collect()] == [3, 1, 2]


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", 5.0, True), (2, "b", None, False), (3, None, 7.0, None)], "i int, s string, v double, f boolean")
    defs = [V.FilterDef("s", "select", "s"), V.FilterDef("v", "range", "v"), V.FilterDef("f", "toggle", "f"), V.FilterDef("b", "select", "f")]
    ids = lambda **state: [r["i"] for r in df.where(V.predicate(defs, state)).orderBy("i").collect()]
    assert ids() == ids(s="", v=None) == ids(s=[]) == [1, 2, 3]
    assert ids(s=["a", "b"]) == [1, 2] and ids(v=(5, 6)) == [1] and ids(f=True) == [1] and ids(f=False) == [1, 2, 3] and ids(b="true") == [1] and ids(s="null") == [3]
    assert df.where(V.facets({"s": [], "i": [1]})).count() == 0 and df.where(V.facets({"s": ["a"]})).count() == 1
    assert df.where(V.rank_window(F.col("v"), 1, 6)).count() == 1 and df.where(V.rank_window(F.col("v"), 0, 0)).count() == 3
    text = spark.createDataFrame([("100% A",), ("100x",), (None,)], "t string")
    assert V.search(text, "0% ", ["t"]).count() == 1 and V.search(text, " ", ["t"]).count() == 3
    legacy = spark.createDataFrame([("12",), ("NA",), ("3.9",), (None,)], "c string")
    assert [r["c"] for r in legacy.orderBy(V.legacy_order("c", True)).collect()][:2] == ["12", "3.9"]
    picked = df.orderBy(*V.picked_first("i", [3, 1], "i"))
    assert [r["i"] for r in picked.collect()] == [3, 1, 2]
    assert [r["i"] for r in V.page(df, [F.asc("i")], 9, 2).collect()] == [3]


def test_statistics(spark):
    df = spark.createDataFrame([(float(x), float(2 * x + (x % 3)), float(x * x % 11), 3 * x) for x in range(30)], "x double, z double, w double, i int").withColumn("y", F.col("x") * 2 - F.col("w") * 0.5 + 4)
    fit = S.least_squares(df, "y", ["x", "w"])
    assert abs(fit["intercept"] - 4) < 1e-6 and abs(fit["coefficients"]["w"] + 0.5) < 1e-6 and abs(fit["r2"] - 1) < 1e-9
    assert S.least_squares(df, "y", ["x", "i"]) is None and S.least_squares(df.limit(9), "y", ["x"]) is None
    assert S.pearson(df.limit(9), "x", "y").first()["r"] is None
    assert df.agg(S.slope_through_origin(F.lit(0.0), F.col("y")).alias("k")).first()["k"] is None
    colours = [r[0] for r in spark.createDataFrame([(-1.0,), (0.5,), (2.0,)], "t double").select(S.ramp(F.col("t"))).collect()]
    assert colours == list(S.SEQUENTIAL)
    ext = S.padded_extent(df.where("false"), "x").first()
    assert (ext["lo"], ext["hi"]) == (0.0, 1.0)
    assert S.legend(S.colour_domain(df, "x")).count() == 24


def test_resolution(spark):
    d = spark.createDataFrame([(1, "North College", "TX", "Austin", None), (2, "South College", "TX", "Dallas", ["Southern University"]), (3, "North College", "NY", "Troy", None), (4, "Penn State Scranton", "PA", "Scranton", None)], "id int, name string, state string, city string, aliases array<string>")
    q = spark.createDataFrame([(10, "South College", "TX", "Dallas"), (11, "Southern Univ", "TX", "Dallas"), (12, "Unheard Of Place", "TX", "Waco"), (13, "North College", None, "Troy")], "q int, name string, state string, city string")
    pairs = M.fuzzy_candidates(q, d, "q", "id", "state")
    got = {r["q"]: (r["id"], r["confidence"], r["method"]) for r in M.listing_tiers(pairs, "q", "id").collect()}
    assert got[10][:2] == (2, "high") and got[11][0] == 2 and got[12] == (None, None, "low_fuzzy")
    asked = spark.createDataFrame([("North College", "Troy"), ("North College", "x"), ("South College", "x"), ("Z", "z")], "name string, q_city string")
    hits = {(r["name"], r["q_city"]): (r["id"], r["method"]) for r in M.exact_match(asked, d, ["name"], "id", "q_city", "city").collect()}
    assert hits == {("North College", "Troy"): (3, "exact_city"), ("North College", "x"): (None, "ambiguous_exact"), ("South College", "x"): (2, "exact"), ("Z", "z"): (None, None)}
    cases = [(5, None, True, 5, None), (5, 5, False, 5, "truth_confirmed"), (5, 6, True, 5, "exact_location_over_truth"), (5, 6, False, 6, "truth_override_disagree"), (None, 6, True, 6, "truth_only")]
    decided = spark.createDataFrame(cases, "e int, t int, x boolean, want int, why string").withColumn("d", M.truth_decision(F.col("e"), F.col("t"), F.col("x")))
    assert decided.where(~F.col("d.entity").eqNullSafe(F.col("want")) | ~F.col("d.method").eqNullSafe(F.col("why"))).count() == 0
    truth = spark.createDataFrame([("wheaton", 149781, 50), ("wheaton", 168281, 80)], "name string, id int, rnk int")
    asked = spark.createDataFrame([("wheaton", 50), ("wheaton", 76)], "name string, rnk int")
    assert {r["rnk"]: r["id"] for r in M.nearest_rank(asked, truth, ["name"], "rnk", "id").collect()} == {50: 149781, 76: 168281}
    words = spark.createDataFrame([(1, 7, ["a", "b", "c"], ["a", "b", "c", "d"]), (1, 8, ["a", "b", "c"], ["a", "x"]), (2, 7, ["a"], ["a"]), (3, 7, ["p", "q"], ["p", "q"]), (3, 8, ["p", "q"], ["p", "q"])], "q int, e int, qw array<string>, ew array<string>")
    assert [tuple(r)[:2] for r in M.jaccard_match(words.where("q = 1"), "q", "e", "qw", "ew").collect()] == [(1, 7)]
    assert M.jaccard_match(words.where("q = 3"), "q", "e", "qw", "ew").count() == 0
    assert [tuple(r) for r in M.containment(words, "q", "e", "qw", "ew").collect()] == [(1, 7)]
    bands = spark.createDataFrame([(1, [1, 2]), (2, [9, 9])], "k int, stored array<int>")
    cols = spark.createDataFrame([(1, 0, [1, 2], 10), (1, 1, [3, 4], 11), (2, 0, [5, 6], 20), (2, 1, [7, 8], None)], "k int, pos int, bands array<int>, avg int")
    assert {r["k"]: (r["avg"], r["matched"]) for r in M.match_bands(bands, cols, "k", "stored", "bands", "pos", "avg").collect()} == {1: (10, True), 2: (20, False)}


def test_extraction(spark):
    after = "A) enrolled students 210 900 40\nwho applied for need-based financial aid 199 800 30\nwho were determined to have need 184 700 20"
    text = f"Common Data Set 2023-24 x Submitted GPA: 3..71 y Common Data Set 2024-2025\nPercent in top tenth of high school graduating class: 87% z\nlive off campus or commute 5% 12%\n{after}\nTotal Scholarships/Grants $ 1 48,278,012 $5\nAverage financial aid package $12,000"
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    rows = df.select(*[c.alias(n) for n, c in X.document_fields(F.col("t")).items()]).collect()
    want = {"hs_gpa": 3.71, "pct_top10_hs": 87.0, "pct_commuter": 12.0, "need_aid_total": 148278012, "merit_aid_total": 5, "avg_aid_package": 12000, "pct_demonstrated_need": 87.62}
    assert {k: rows[0][k] for k in want} == want
    assert all(v is None for r in rows[1:] for v in r)
    heads = df.limit(1).withColumn("h", X.year_headers("t")).select(X.header_at(F.col("h"), F.lit(0)).alias("a"), X.header_at(F.col("h"), F.lit(60)).alias("b")).first()
    assert tuple(heads) == ("2023-2024", "2024-2025")
    page = '<a href="news-2019.pdf">n</a><a class="x" href=\'/cds/2023-24.pdf\'>CDS</a><a href="../CDS_2024-25.xlsx">cds</a><script>var a="<b>";</script><p>5 &lt; 6 &amp; 7</p>'
    p = spark.createDataFrame([(page, "https://u.example/ir/index.html")], "h string, u string")
    r = p.select(X.links(F.col("h")).alias("l"), X.html_text(F.col("h")).alias("t"), F.transform(X.links(F.col("h")), lambda x: X.absolute_url(F.col("u"), x)).alias("a")).first()
    assert r["l"] == ["news-2019.pdf", "/cds/2023-24.pdf", "../CDS_2024-25.xlsx"] and r["t"].endswith("5 < 6 & 7") and "var a" not in r["t"]
    assert r["a"][:2] == ["https://u.example/ir/news-2019.pdf", "https://u.example/cds/2023-24.pdf"]
    bands = "".join(f"<tr><td>{label}</td><td>${v:,}</td><td>${v + 1:,}</td></tr>" for label, v in zip(X.BAND_LABELS, (15193, 16339, 20608, 28285, 33797), strict=True))
    table = f"<h3>Average Net Price for Full-Time Beginning</h3><tr><td>Average net price</td><td>$24,000</td><td>$25,310</td></tr><h3>Average net price by Income</h3>{bands}"
    got = spark.createDataFrame([(table,), ("none",)], "h string").select(X.price_table(F.col("h")).alias("p")).collect()
    assert [c["avg"] for c in got[0]["p"]] == [24000, 25310] and got[0]["p"][1]["bands"] == [15194, 16340, 20609, 28286, 33798] and got[1]["p"] in (None, [])


def test_row_assembly(spark):
    files = spark.createDataFrame([(1, 0, "2021-2022", 3.5, "2021-2022", None, None), (1, 1, "2024-2025", None, None, 50.0, "2024-2025"), (1, 2, "2023-2024", 3.7, "2023-2024", 40.0, "2022-2023"), (2, 0, "2010-2011", 3.0, "2010-2011", None, None)], "e int, n int, file_year string, hs_gpa double, hs_gpa_year string, pct_top10_hs double, pct_top10_hs_year string")
    got = [tuple(r) for r in X.assemble_row(files, "e", "n", ["hs_gpa", "pct_top10_hs"], ["2023-2024", "2024-2025"]).collect()]
    assert got == [(1, "2024-2025", None, 50.0)]


def test_variables():
    assert len(variables.CANONICAL) == 36 and set(variables.first_source_map().values()) <= set(variables.CANONICAL) and len(variables.first_source_map()) == 35
    assert len(variables.second_source_map()) == 21
