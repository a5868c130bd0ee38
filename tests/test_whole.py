"""Registered queries that run over whole tables, and the names that the whole ones had before."""

import re

from latticework.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_percent_and_money(spark):
    got = {r["p_partkey"]: (r["pct"], r["whole"]) for r in catalogue.queries()["percent_and_money"](spark, SF).collect()}
    assert set(got) == {r[0] for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey").collect()}
    assert got[1] == (50.0, 5) and got[3] == (1.5, 15) and got[2] == (1.0, 10)


def test_words_of_any_length(spark, tmp_path):
    """Short words count for score and containment, and items of short words alone have candidates."""
    items = {0: "to be or not", 1: "extraordinary circumstances of it", 2: "Alpha", 3: "", 4: None, 5: "red fox, red fox"}
    docs = {10: "to be or not to be", 11: "extraordinary circumstances", 12: "it is of extraordinary circumstances", 13: "alpha beta", 14: "a red-fox", 15: "the fox is Red!", 16: None}
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    q, c = ({k: set(re.sub("[^a-z0-9]+", " ", (t or "").lower()).split()) for k, t in x.items()} for x in (items, docs))
    near = {i: [len(a & b) / len(a | b) for b in c.values() if a & b] for i, a in q.items()}
    holds = {i: [j for j, b in c.items() if len(a) >= 2 and a <= b] for i, a in q.items()}
    got = {r["item_id"]: (r["score"], r["candidates"]) for r in catalogue.queries()["token_jaccard"](spark, str(tmp_path)).collect()}
    assert got == {i: (round(max(s), 6), len(s)) for i, s in near.items() if s}
    got = {r["item_id"]: r["doc_id"] for r in catalogue.queries()["token_containment"](spark, str(tmp_path)).collect()}
    assert got == {i: x[0] for i, x in holds.items() if len(x) == 1} == {0: 10, 1: 12}


def test_upserts_meet_odd_users(spark):
    whole = catalogue.queries()
    rows = whole["upsert_fill"](spark, SF).where("user_id % 2 = 1")
    assert {r["change"] for r in rows.select("change").distinct().collect()} > {"created", "kept", "changed"}
    for name in ("upsert_overwrite", "upsert_update_only", "backfill"):
        assert whole[name](spark, SF).where("user_id % 2 = 1 AND change NOT IN ('created', 'kept')").count() > 0
    n = whole["upsert_fill"](spark, SF).count()
    assert sum(r["n"] for r in whole["upsert_audit"](spark, SF).collect()) == n
