"""Operators with a mechanism of their own, against plain Python: pages, percentiles, grids, lines, rounds, pointers."""

import json
import math
import random
import re
import threading
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.operators import extract as X
from latticework.operators import gestalt as G
from latticework.operators import resolve as M
from latticework.operators import stats as S
from latticework.operators.order import numbered, ranked, rows_between
from latticework.operators.percentiles import exact_percentiles
from latticework.sources import paged as P
from latticework.sources import readers as I
from latticework.sources import sinks as K


# --- paged source -----------------------------------------------------------------------------------------------


def land(root, batch, year, page, *answers):
    folder = root / f"batch={batch}" / f"year={year}" / f"page={page}"
    folder.mkdir(parents=True)
    (folder / "part-0.txt").write_text("\n".join(json.dumps(a) for a in answers))
    (folder / "_SUCCESS").write_text("")


def ok(ids, **more):
    return {"status": 200, "body": {"results": [{"id": i} for i in ids], **more}}


def test_pages_of_every_kind(spark, tmp_path):
    later = {"status": 503, "retry_after": "5"}
    land(tmp_path, 0, 2020, 0, ok([1, 2], metadata={"total": 3}))
    land(tmp_path, 0, 2020, 1, later, {"status": 429}, ok([3], metadata={"total": 3}))
    land(tmp_path, 1, 2020, 0, {"results": [{"id": 4}], "next": "b"})  # a bare body
    land(tmp_path, 1, 2020, "b", ok([5], next="0"))  # back to a page met before
    land(tmp_path, 2, 2020, 0, ok([6], metadata={"total": 9}))  # the second page is missing
    land(tmp_path, 3, 2020, 0, ok([]))
    waits = tmp_path / "waits"
    waits.mkdir()

    def wait(seconds):
        (waits / f"{seconds}").write_text("")

    pages = P.read_pages(spark, [(0, 2020), (1, 2020), (2, 2020), (3, 2020), (4, 2020)], P.landed_answers(str(tmp_path)), wait)
    assert pages.rdd.getNumPartitions() == 5
    assert sorted((r["batch"], r["id"]) for r in P.page_rows(pages, "id int").collect()) == [(0, 1), (0, 2), (0, 3), (1, 4), (1, 5), (2, 6)]
    got = {(r["batch"], r["page"]): (r["attempts"], r["waited"], r["results"]) for r in P.page_status(pages).collect()}
    assert got == {(0, "0"): (1, 0, 2), (0, "1"): (3, 7 + 60, 1), (1, "0"): (1, 0, 1), (1, "b"): (1, 0, 1), (2, "0"): (1, 0, 1), (2, "1"): (1, 0, 0), (3, "0"): (1, 0, 0), (4, "0"): (1, 0, 0)}
    assert {x.name for x in waits.iterdir()} == {"7", "60"}


def test_pages_that_fail(spark, tmp_path):
    land(tmp_path, 0, 2020, 0, {"status": 503})
    land(tmp_path, 1, 2020, 0, {"status": 500})
    for batch, why in ((0, "after 8 attempts"), (1, "status 500")):
        with pytest.raises(Exception, match=why):
            P.read_pages(spark, [(batch, 2020)], P.landed_answers(str(tmp_path))).collect()
    assert [P.waiting_time(*a) for a in ((0, None), (3, ""), (20, "x"), (0, "10"), (0, "99999"))] == [30, 120, 300, 12, 3700]


# --- order and percentiles --------------------------------------------------------------------------------------


def test_ranks_and_pages(spark):
    rows = [(i, i % 7) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(5)
    want = {i: 1 + sum(w < v for _, w in rows) for i, v in rows}
    assert {r["id"]: r["rank"] for r in ranked(df, ["v", "id"], ["v"]).collect()} == want
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    assert [tuple(r)[:2] for r in sorted(rows_between(df, ["v", "id"], 41, 60).collect(), key=lambda r: r["place"])] == order[40:60]
    assert numbered(df, ["id"], "v").columns == ["id", "v"]


@pytest.mark.parametrize("bins", [2, 3, 1024])
def test_percentiles_against_numpy(spark, bins):
    rng = random.Random(bins)
    groups = {
        "one": [3.5], "same": [2.0] * 40, "two": [1.0, 2.0], "hot": [7.0] * 300 + [rng.random() for _ in range(50)],
        "near": [1.0, math.nextafter(1, 2), math.nextafter(1, 0)] * 3, "wide": [-1.7e308, 1.7e308, 0.0, 5e-324, -1e-300], "any": [rng.gauss(0, 1e3) for _ in range(400)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [(None, 1.0), (None, 3.0), ("none", None)]
    groups = groups | {None: [1.0, 3.0]}
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    p = (0.0, 0.02, 0.5, 0.9, 1.0)
    got = {r["g"]: r["percentiles"] for r in exact_percentiles(df, "v", p, ["g"], bins).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        vs = sorted(vs)
        for q, v in zip(p, got[g], strict=True):
            r = q * (len(vs) - 1)
            a, b = vs[math.floor(r)], vs[math.ceil(r)]
            assert v == pytest.approx(a if a == b else a + (b - a) * (r - math.floor(r)), rel=1e-12, abs=0)
    whole = exact_percentiles(df.where("g = 'any'"), "v", (0.5,), (), bins).collect()
    assert [r["percentiles"] for r in whole] == [[pytest.approx(float(np.median(groups["any"])))]]
    assert exact_percentiles(df.where("g = 'none'"), "v", (0.5,), ["g"], bins).count() == 0


# --- grid -------------------------------------------------------------------------------------------------------


def test_nearest_points_against_all_pairs(spark):
    rng = random.Random(3)
    spot = lambda: (rng.uniform(-9, 9), rng.choice([0.0, -2.5, rng.uniform(-9, 9)]))
    points = [(i, *spot()) for i in range(120)]
    points += [(500 + i, x, y) for i, x, y in points[:9]] + [(900, 2.0, 0.0), (901, -2.0, 0.0), (902, None, 1.0)]
    clicks = [(i, *spot()) for i in range(80)] + [(100, 0.0, 0.0), (101, 90.0, 90.0), (102, 1.0, None), (103, *points[0][1:])]
    for radius in (0.3, 2.0):
        got = {r["c"]: (r["distance"], r["p"]) for r in S.nearest_points(spark.createDataFrame(points, "p long, x double, y double"), spark.createDataFrame(clicks, "c long, x double, y double"), "p", "c", radius).collect()}
        want = {}
        for c, x, y in clicks:
            near = [(math.sqrt((a - x) ** 2 + (b - y) ** 2), p) for p, a, b in points if None not in (a, b, x, y)]
            if near and min(near)[0] <= radius:
                want[c] = min(near)
        assert {c: p for c, (_, p) in got.items()} == {c: p for c, (_, p) in want.items()}
        assert all(d == pytest.approx(want[c][0]) for c, (d, _) in got.items())


# --- extraction -------------------------------------------------------------------------------------------------


def test_match_positions_against_re(spark):
    texts = ["", "abab", "xabyABz", "no", "ab", "é漢ab😀ab", "aab" * 50]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.match_positions(F.col("t"), "(?i)a+b").alias("m")).collect()
    assert {r["t"]: [(m["pos"], m["match"]) for m in r["m"]] for r in got} == {t: [(m.start(), m[0]) for m in re.finditer("(?i)a+b", t)] for t in texts}
    years = spark.createDataFrame([("Common Data Set 2020-21 .. common data set2021/2022",), (None,)], "t string").select(X.year_headers("t").alias("h"))
    assert [[tuple(h) for h in r["h"]] for r in years.collect()] == [[(0, "2020-2021"), (27, "2021-2022")], []]
    assert "Python" not in years._jdf.queryExecution().executedPlan().toString()


def test_values_beside_labels(spark):
    boxes = [
        (1, 10.0, 100.0, "Submitted"), (1, 60.0, 101.5, "GPA"), (1, 99.0, 99.0, "3.61"), (1, 10.0, 120.0, "9.99"),  # right of it, askew
        (2, 10.0, 10.0, "Submitted"), (2, 60.0, 10.0, "gpa"), (2, 80.0, 10.0, "(avg)"), (2, 30.0, 24.0, "x"), (2, 50.0, 25.0, "3.2"),  # below
        (3, 5.0, 10.0, "2.0"), (3, 10.0, 10.0, "Submitted"), (3, 60.0, 10.0, "GPA"), (3, 10.0, 90.0, "none"),  # left of it only
        (4, 5.0, 10.0, "Other"), (4, 9.0, 10.0, "4"),
        (5, 10.0, 10.0, "submitted"), (5, 20.0, 10.0, "gpa"), (5, 30.0, 10.0, "1.5"), (5, 10.0, 50.0, "submitted"), (5, 20.0, 50.0, "gpa"), (5, 30.0, 50.0, "4.0"),
        (6, None, 10.0, "submitted"), (6, 1.0, 10.0, None),
    ]
    lines = X.text_lines(spark.createDataFrame(boxes, "page long, x double, y double, text string"), ["page"])
    assert [(r["line"], r["line_text"]) for r in lines.where("page = 1").orderBy("line").collect()] == [(1, "Submitted GPA 3.61"), (2, "9.99")]
    got = {r["page"]: (r["line"], r["text"]) for r in X.beside_label(lines, ["page"], "submitted gpa").collect()}
    assert got == {1: (1, "3.61"), 2: (1, "3.2"), 3: (1, None), 5: (1, "1.5")}
    # boxes that each lie a little lower than the one before stay one line
    slope = spark.createDataFrame([(1, float(i), 2.9 * i, f"w{i}") for i in range(9)], "page long, x double, y double, text string")
    assert X.text_lines(slope, ["page"]).count() == 1


# --- rounds -----------------------------------------------------------------------------------------------------


def test_rounds_settle_and_stay(spark, tmp_path):
    """Each round sees only what is left; decisions are final; a rerun writes nothing; a longer queue goes on."""
    folder, seen = str(tmp_path / "q"), []
    queue = spark.createDataFrame([(i,) for i in range(12)] + [(None,)], "qid long")

    def decide(name, keep):
        def step(left):
            seen.append((name, sorted(r["qid"] for r in left.collect())))
            return left.where(keep).select("qid", F.lit(name).alias("method"))

        return step

    def neighbours(left):  # an id is decided once the one before it is
        seen.append(("next", None))
        done = [spark.read.parquet(str(p)) for p in sorted((tmp_path / "q").glob("round=*"))]
        known = done[0].select("qid") if done else left.limit(0)
        for d in done[1:]:
            known = known.unionByName(d.select("qid"))
        return left.join(known.select((F.col("qid") + 1).alias("qid")), "qid", "left_semi").where("qid < 8").select("qid", F.lit("next").alias("method"))

    steps = [decide("even", "qid % 4 = 0"), neighbours]
    got = {r["qid"]: (r["method"], r["round"]) for r in M.settle(queue, steps, folder).collect()}
    assert {k: v[0] for k, v in got.items()} == {0: "even", 4: "even", 8: "even"} | dict.fromkeys((1, 2, 3, 5, 6, 7), "next")
    assert got[1][1] < got[2][1] < got[3][1] and max(r for _, r in got.values()) == len(list((tmp_path / "q").iterdir())) - 1
    files = sorted(str(p) for p in (tmp_path / "q").rglob("*"))
    again = {r["qid"]: (r["method"], r["round"]) for r in M.settle(queue, steps, folder).collect()}
    assert again == got and sorted(str(p) for p in (tmp_path / "q").rglob("*")) == files
    assert seen[-2][1] == [9, 10, 11] or seen[-1][1] == [9, 10, 11]
    longer = queue.unionByName(spark.createDataFrame([(16,)], "qid long"))
    more = {r["qid"]: (r["method"], r["round"]) for r in M.settle(longer, steps, folder).collect()}
    assert more == got | {16: ("even", max(r for _, r in got.values()) + 1)}
    assert M.settle(queue.limit(0), steps, str(tmp_path / "empty")).count() == 0


def test_second_pass_rejects_by_gap(spark):
    d = spark.createDataFrame([(1, "Alpha Univ", ["A. College"]), (2, "Beta State University Main Campus", []), (3, "Mills College", []), (4, "Twin", []), (5, "Twin", [])], "unitid long, name string, aliases array<string>")
    q = spark.createDataFrame([(1, "alpha university"), (2, "A College"), (3, "Beta State University"), (4, "Miles College"), (5, "Twin"), (6, None)], "qid long, name string")
    assert {tuple(r) for r in M.second_pass(q, d).collect()} == {(1, 1, "exact_alias"), (2, 1, "exact_alias"), (3, 2, "loose_nocampus")}
    gaps = spark.createDataFrame([(1, 1, 40.0), (2, 1, 5.0), (3, 9, 99.0)], "qid long, unitid long, gap double")
    assert {r["qid"] for r in M.second_pass(q, d, gaps).collect()} == {2, 3}


def test_close_names_without_a_block(spark):
    rng = random.Random(5)
    stems = ["becker college", "eckerd college", "macmurray college", "mcmurry university", "mills", "miles", "ab", "a", "", "aaaaaaaaaaaa", "north central technical"]
    names = [s for s in stems] + ["".join(c if rng.random() > 0.07 else rng.choice("abce") for c in rng.choice(stems)) for _ in range(120)]
    q, d = [(i, n) for i, n in enumerate(names[::2])] + [(999, None)], [(i, n) for i, n in enumerate(names[1::2])] + [(998, "becker college")]
    qs, ds = spark.createDataFrame(q, "q long, name string"), spark.createDataFrame(d, "e long, name string")
    for least in (0.75, 0.92):
        want = {(i, j): r for i, a in q for j, b in d if a is not None and (r := SequenceMatcher(None, a, b).ratio()) >= least}
        assert {(r["q"], r["e"]): r["ratio"] for r in G.close_names(qs, ds, "q", "e", "name", least).collect()} == want
    with pytest.raises(ValueError, match="2/3"):
        G.close_names(qs, ds, "q", "e", "name", 0.6)


# --- sources and sinks ------------------------------------------------------------------------------------------


def test_readers_never_miss_a_published_table(spark, tmp_path):
    root, failed, read, stop = str(tmp_path / "t"), [], [], threading.Event()
    K.publish(spark.range(1), root)

    def reader():
        while not stop.is_set():
            try:
                read.append(K.current(spark, root).count())
            except Exception as e:  # any failure is what the test is about
                failed.append(str(e))

    t = threading.Thread(target=reader)
    t.start()
    try:
        for n in range(2, 11):
            K.publish(K.current(spark, root).unionByName(spark.range(1)), root)
    finally:
        stop.set()
        t.join()
    assert not failed and read == sorted(read) and K.current(spark, root).count() == 10
    with pytest.raises(Exception):  # noqa: B017, PT011
        K.publish(spark.range(2).select(F.raise_error(F.lit("no"))), root)
    assert K.current(spark, root).count() == 10
    K.prune(spark, root, keep=2)
    assert len([p for p in (tmp_path / "t").iterdir() if p.is_dir()]) <= 3 and K.current(spark, root).count() == 10


def test_assignments_with_semicolons_in_texts():
    for value in ('"x;y"', "'x;\\';y'", "`a;\nb`", "[1, 2]", '{"a": "b;c"}'):
        assert K.replace_assignment(f"let q = 1; a = {value}; b = 2;", "a", "[3]") == "let q = 1; a = [3]; b = 2;"


def test_manifests_and_first_ids(spark):
    files = spark.createDataFrame([("/d/12_a.pdf",), ("/d/7b.pdf",), ("/d/x.pdf",)], "path string")
    side = spark.createDataFrame([(12, "t")], "id long, title string")
    assert {tuple(r) for r in I.with_manifest(files, side, "path").select("id", "title").collect()} == {("12", "t"), ("7", None), (None, None)}
    df = spark.createDataFrame([(i % 5, 2000 + i) for i in range(20)] + [(None, 2000)], "unitid long, year long")
    assert {r["unitid"] for r in I.scope(df, first=2).collect()} == {0, 1} and I.scope(df, first=2).count() == 8
