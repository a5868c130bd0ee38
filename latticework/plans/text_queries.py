"""Name resolution, extraction and scalar text queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions import names as N
from ..operators import extract as X
from ..operators import gestalt as G
from ..operators import resolve as M
from ..operators import similarity as J
from ..operators.order import numbered
from .registry import Registry, table

R = Registry()

_FORM = "trim(regexp_replace(regexp_replace(regexp_replace(replace(trim(lower({c})), '&', ' and '), '--|[–—]', ' ', 'g'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@R.query("""SELECT p_partkey, array_to_string(list_filter(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9 ]', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ('university', 'college', 'the', 'of', 'at', 'and', 'for', 'school', 'institute', 'main', 'campus')), ' ') form FROM part""")
def normalize_names(spark, d):
    return table(spark, d, "part").select("p_partkey", N.export_form(F.col("p_name")).alias("form"))


@R.query("""WITH k AS (SELECT p_brand, p_name, min(p_partkey) lo, count(DISTINCT p_partkey) n FROM part GROUP BY ALL)
SELECT DISTINCT p_brand, p_name, CASE WHEN n = 1 THEN lo END p_partkey, CASE WHEN n = 1 THEN 'exact' ELSE 'ambiguous_exact' END AS method FROM k""")
def exact_unique_match(spark, d):
    """Names that resolve to one entity within a block, and those that do not."""
    p = table(spark, d, "part")
    return M.exact_match(p.select("p_brand", "p_name").distinct(), p, ["p_brand", "p_name"], "p_partkey")


_ALL_WORDS = "list_distinct(list_filter(string_split(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''))"
_SHARED = f"""WITH b AS (SELECT item_id, {_ALL_WORDS.format(c="text")} q FROM benchmark), x AS (SELECT doc_id, {_ALL_WORDS.format(c="text")} c FROM documents),
s AS (SELECT item_id, doc_id, nq, nc, count(*) n FROM (SELECT item_id, len(q) nq, unnest(q) w FROM b) JOIN (SELECT doc_id, len(c) nc, unnest(c) w FROM x) USING (w) GROUP BY ALL)"""


_BEST_SQL = f"{_SHARED} SELECT item_id, round(max(n::DOUBLE / (nq + nc - n)), 6) score, count(*) candidates FROM s GROUP BY item_id"
_INSIDE_SQL = f"{_SHARED} SELECT item_id, min(doc_id) doc_id FROM s WHERE nq >= 2 AND n = nq GROUP BY item_id HAVING count(DISTINCT doc_id) = 1"


def _benchmark_words(spark, d):
    words = F.array_distinct(N.words(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")))
    return [table(spark, d, t).select(k, words.alias("words")) for t, k in (("benchmark", "item_id"), ("documents", "doc_id"))]


@R.query(_BEST_SQL)
def token_jaccard(spark, d):
    """Best Jaccard similarity of each item over all documents, and how many share a word with it."""
    items, docs = _benchmark_words(spark, d)
    sides = J.word_sides(items, docs, "item_id", "doc_id")
    best = J.most_similar(sides, levels=())
    dense = numbered(sides.directory.select("k", "shared"), ["k"], "i").withColumn("i", F.col("i") - 1)
    sharing = J.sharing(sides.queries.select(F.col("k").alias("item_id"), "shared"), dense, "item_id", "i", "shared")
    return best.select("item_id", F.round("score", 6).alias("score")).join(sharing.withColumnRenamed("n", "candidates"), "item_id")


@R.query(_BEST_SQL)
def token_jaccard_all(spark, d):
    """The same as token_jaccard, under the name it had while that one took long words only."""
    return token_jaccard(spark, d)


@R.query(_INSIDE_SQL)
def token_containment(spark, d):
    """Items whose words all occur in exactly one document: documents are looked up by an item's rarest word."""
    inside = J.containing(J.word_sides(*_benchmark_words(spark, d), "item_id", "doc_id"), 2)
    return M.unique_by_key(inside, ["item_id"], "doc_id")


@R.query(_INSIDE_SQL)
def token_containment_all(spark, d):
    """The same as token_containment, under the name it had while that one took long words only."""
    return token_containment(spark, d)


@R.query(f"{_SHARED} SELECT item_id, doc_id, round(n::DOUBLE / (nq + nc - n), 6) score FROM s WHERE 10 * n >= nq + nc - n")
def similar_documents(spark, d):
    """All documents with a Jaccard similarity of 0.1 or more to an item, by prefixes of rare words."""
    pairs = J.similar(J.word_sides(*_benchmark_words(spark, d), "item_id", "doc_id"), 0.1)
    return pairs.select("item_id", "doc_id", F.round("score", 6).alias("score"))


@R.query("""WITH q AS (SELECT o_orderkey, o_custkey, floor(o_totalprice)::BIGINT rnk FROM orders WHERE o_orderstatus = 'P'), t AS (SELECT o_custkey, o_orderkey e, floor(o_totalprice)::BIGINT r FROM orders WHERE o_orderstatus = 'F')
SELECT o_orderkey, q.o_custkey, rnk, arg_min(e, (abs(r - rnk), e)) e FROM q JOIN t ON q.o_custkey = t.o_custkey GROUP BY ALL""")
def nearest_rank(spark, d):
    """Of several entities under one key the one of nearest rank."""
    o = table(spark, d, "orders").withColumn("rnk", F.floor("o_totalprice").cast("bigint"))
    q = o.where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey", "rnk")
    t = o.where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("e"), "rnk")
    return M.nearest_rank(q, t, ["o_custkey"], "rnk", "e").where("e IS NOT NULL")


def _name_pairs(spark, d):
    """Different names of a brand, in their normal form."""
    p = table(spark, d, "part").select("p_brand", "p_name").distinct().select(F.xxhash64("p_brand", "p_name").alias("id"), "p_brand", N.export_form(F.col("p_name")).alias("form"))
    q = p.select(F.col("id").alias("q"), "p_brand", F.col("form").alias("q_form"))
    return q.join(p, "p_brand").where("q <> id").select("q", "id", "q_form", "form")


@R.query()
def fuzzy_ratio_match(spark, d):
    """Gestalt similarity of names within a block, by tiers (no SQL form; tested against difflib)."""
    return M.export_tiers(G.top_ratios(_name_pairs(spark, d), "q", "id", "q_form", "form", 2, "score"), "q", "id")


@R.query()
def near_miss_names(spark, d):
    """The two nearest names of a brand from 0.92 on, to be reported only (no SQL form; tested against difflib)."""
    close = G.ratios_from(_name_pairs(spark, d), "q_form", "form", 0.92)
    return M.near_misses(close, "q", "id", "ratio").select("q", "id", "ratio", "place")


_LANDED = "SELECT o_custkey q, o_orderkey e, round(o_totalprice * 100)::BIGINT % 4001 / 4000.0::DOUBLE score"


@R.query(f"""WITH s AS ({_LANDED} FROM orders), r AS (SELECT *, row_number() OVER w n, coalesce(lead(score) OVER w, 0) s2 FROM s WINDOW w AS (PARTITION BY q ORDER BY score DESC, e))
SELECT q, CASE WHEN score >= 0.86 AND score - s2 >= 0.03 THEN e END e, CASE WHEN score >= 0.92 AND score - s2 >= 0.03 THEN 'high' WHEN score >= 0.86 AND score - s2 >= 0.03 THEN 'medium' ELSE 'low' END confidence,
CASE WHEN score >= 0.86 AND score - s2 >= 0.03 THEN 'fuzzy' WHEN score - s2 < 0.03 THEN 'ambiguous' ELSE 'low' END AS method FROM r WHERE n = 1""")
def export_tiers_landed(spark, d):
    """The export matcher's tiers on scores that were landed with the orders."""
    score = (F.round(F.col("o_totalprice") * 100).cast("bigint") % 4001) / F.lit(4000.0)
    return M.export_tiers(table(spark, d, "orders").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("e"), score.alias("score")), "q", "e")


@R.query("""WITH s AS (SELECT l_orderkey q, l_linenumber e, round(l_extendedprice * 100)::BIGINT % 101 / 100.0::DOUBLE score, l_linenumber % 2 = 1 same_city, l_partkey % 11 / 10.0::DOUBLE ratio, l_suppkey % 5 / 4.0::DOUBLE recall, l_partkey % 3 n_missing FROM lineitem),
r AS (SELECT *, row_number() OVER w n, score - coalesce(lead(score) OVER w, 0) gap FROM s WINDOW w AS (PARTITION BY q ORDER BY score DESC, same_city DESC, ratio DESC, n_missing, e)),
t AS (SELECT q, e, CASE WHEN score >= 0.93 AND gap >= 0.04 THEN 1 WHEN score >= 0.93 AND same_city AND ratio >= 0.84 THEN 2 WHEN score >= 0.84 AND (gap >= 0.04 OR same_city) THEN 3 WHEN score >= 0.55 AND n_missing = 0 OR same_city AND recall >= 0.5 AND ratio >= 0.55 THEN 4 ELSE 5 END k FROM r WHERE n = 1)
SELECT q, CASE WHEN k < 5 THEN e END e, CASE k WHEN 1 THEN 'high' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' WHEN 4 THEN 'low' END confidence, CASE k WHEN 1 THEN 'fuzzy_state' WHEN 2 THEN 'fuzzy_state_city' WHEN 3 THEN 'fuzzy_state' WHEN 4 THEN 'fuzzy_state_weak' ELSE 'low_fuzzy' END AS method FROM t""")
def listing_tiers_landed(spark, d):
    """The listing matcher's tiers on scores, ratios, recalls and missing words that were landed with the line items."""
    li = table(spark, d, "lineitem")
    pairs = li.select(
        F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("e"), ((F.round(F.col("l_extendedprice") * 100).cast("bigint") % 101) / F.lit(100.0)).alias("score"), (F.col("l_linenumber") % 2 == 1).alias("same_city"),
        ((F.col("l_partkey") % 11) / F.lit(10.0)).alias("ratio"), ((F.col("l_suppkey") % 5) / F.lit(4.0)).alias("recall"), (F.col("l_partkey") % 3).alias("n_missing"),
    )
    return M.listing_tiers(pairs, "q", "e")


_ASKED = """CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' Main Campus' WHEN 2 THEN lower(p_type) || ' ' || p_name ELSE p_type END"""


@R.query(f"""WITH d AS (SELECT p_partkey e, p_brand st, trim(p_name) f FROM part), a AS (SELECT p_partkey q, p_brand st, {_ASKED} "name", lower({_ASKED}) f FROM part),
o AS (SELECT p_brand st, {_ASKED} "name", min(p_partkey) e FROM part WHERE p_size = 7 GROUP BY ALL),
l AS (SELECT *, trim(regexp_replace(f, ' *main campus', '')) lf FROM a), x AS (SELECT st, f, min(e) e FROM d GROUP BY ALL HAVING count(DISTINCT e) = 1),
k AS (SELECT st, f, min(e) lo, max(e) hi, list_distinct(string_split(f, ' ')) w FROM d GROUP BY st, f), kq AS (SELECT q, st, list_distinct(string_split(f, ' ')) w FROM a),
s AS (SELECT q, lo, hi, list_sort(k.w) ks, len(list_intersect(kq.w, k.w))::DOUBLE / len(list_distinct(list_concat(kq.w, k.w))) score FROM kq JOIN k USING (st)),
g AS (SELECT q, ks, max(score) score, min(lo) lo, max(hi) hi FROM s GROUP BY q, ks),
r AS (SELECT *, row_number() OVER w n, lead(score) OVER w s2 FROM g WINDOW w AS (PARTITION BY q ORDER BY score DESC, hi DESC)),
j AS (SELECT q, lo e FROM r WHERE n = 1 AND score >= 0.6 AND lo = hi AND (s2 IS NULL OR score - s2 >= 0.12))
SELECT l.q, coalesce(o.e, x.e, y.e, j.e) e, CASE WHEN o.e IS NOT NULL THEN 'manual' WHEN x.e IS NOT NULL THEN 'exact' WHEN y.e IS NOT NULL THEN 'loose' WHEN j.e IS NOT NULL THEN 'jaccard' ELSE 'unmatched' END AS method
FROM l LEFT JOIN o ON o.st = l.st AND o.name = l.name LEFT JOIN x ON x.st = l.st AND x.f = l.f LEFT JOIN x y ON y.st = l.st AND y.f = l.lf LEFT JOIN j ON j.q = l.q""")
def score_cascade(spark, d):
    """The score list's whole cascade over all parts: names as they are, with a campus, with more words, or of another kind;
    overrides by name and brand for one size."""
    p = table(spark, d, "part")
    asked = p.select(F.col("p_partkey").alias("qid"), F.expr(_ASKED).alias("name"), F.col("p_brand").alias("state"), "p_size")
    known = p.select(F.col("p_partkey").alias("unitid"), F.col("p_name").alias("name"), F.array().cast("array<string>").alias("aliases"), F.col("p_brand").alias("state"))
    manual = asked.where("p_size = 7").groupBy("name", "state").agg(F.min("qid").alias("unitid"))
    return M.resolve_scores(asked.drop("p_size"), known, manual).select(F.col("qid").alias("q"), F.col("unitid").alias("e"), "method")


@R.query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'gs'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\\s+', ' ', 'g')) AS txt FROM pages""")
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", X.html_text(F.col("html")).alias("txt"))


@R.query("""SELECT page_id, len(regexp_extract_all(html, '(?i)<a[^>]+href=["'']([^"'']+)["'']', 1)) n_links, array_to_string(regexp_extract_all(html, '(?i)<a[^>]+href=["'']([^"'']+)["'']', 1), ' ') links FROM pages""")
def extract_links(spark, d):
    p = table(spark, d, "pages").withColumn("l", X.links(F.col("html")))
    return p.select("page_id", F.size("l").cast("bigint").alias("n_links"), F.array_join("l", " ").alias("links"))


@R.query("""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a[^>]+href=["'']([^"'']+)["'']', 1)) link FROM pages)
SELECT page_id, count(*) n, min(CASE WHEN regexp_matches(link, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN link WHEN link LIKE '/%' THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || link ELSE link END) lo
FROM l WHERE link LIKE '/%' OR regexp_matches(link, '^[a-zA-Z][a-zA-Z0-9+.-]*:') GROUP BY 1""")
def absolute_links(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", F.explode(X.links(F.col("html"))).alias("link"))
    p = p.where(F.col("link").startswith("/") | F.col("link").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"))
    return p.groupBy("page_id").agg(F.count("*").alias("n"), F.min(X.absolute_url(F.col("url"), F.col("link"))).alias("lo"))


@R.query("""WITH t AS (SELECT item_id, 'Average financial aid package $ 1 ' || (item_id * 7 % 900 + 100) || ',' || lpad((item_id * 13 % 1000)::VARCHAR, 3, '0') || ' $' || item_id AS txt FROM benchmark)
SELECT item_id, regexp_replace(regexp_extract(txt, '[$]([ 0-9,]+)', 1), '[ ,]', '', 'g')::BIGINT amount, len(regexp_extract_all(txt, '[$]')) n FROM t""")
def anchored_values(spark, d):
    """Dollar amounts after an anchor."""
    t = F.expr("concat('Average financial aid package $ 1 ', item_id * 7 % 900 + 100, ',', lpad(string(item_id * 13 % 1000), 3, '0'), ' $', item_id)")
    a = X.dollar_amounts(X.after_anchor(t, "average financial aid package", 320), 2)
    return table(spark, d, "benchmark").select("item_id", F.try_element_at(a, F.lit(1)).alias("amount"), F.size(a).cast("bigint").alias("n"))


@R.query("""SELECT conv_id, turn, (SELECT max(u.turn) FROM conversations u WHERE u.conv_id = c.conv_id AND u.role = 'user' AND u.turn <= c.turn) header FROM conversations c WHERE role = 'assistant'""")
def nearest_header(spark, d):
    """The last user turn at or before each answer."""
    c = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.withColumn("header", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w)).where("role = 'assistant'").select("conv_id", "turn", "header")


@R.query("""SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) k FROM events""")
def json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@R.query("""SELECT page_id, nullif(regexp_extract(url, '^(.*)/', 1), '') AS head, nullif(regexp_extract(url, '([0-9]+)', 1), '') digits FROM pages""")
def url_parts(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", F.nullif(F.regexp_extract("url", "^(.*)/", 1), F.lit("")).alias("head"), C.first_digits(F.col("url")).alias("digits"))


@R.query("""SELECT p_partkey, trim(regexp_extract(t, '^(.*),', 1)) city, trim(regexp_extract(t, '^.*,(.*)$', 1)) state FROM (SELECT p_partkey, p_name || ', ' || p_brand || ', ' || p_type t FROM part)""")
def split_last_comma(spark, d):
    t = F.concat_ws(", ", "p_name", "p_brand", "p_type")
    return table(spark, d, "part").select("p_partkey", C.split_last_comma(t).alias("s")).select("p_partkey", "s.city", "s.state")


@R.query("""SELECT p_partkey, y || '-' || (y + 1) AS academic FROM (SELECT p_partkey, 2000 + p_size % 25 y FROM part)""")
def year_from_url(spark, d):
    """Consecutive pair of years in a link, short or long."""
    url = F.expr("concat('https://x.example/cds_', 2000 + p_size % 25, '-', CASE WHEN p_size % 2 = 0 THEN lpad(string((p_size % 25 + 1) % 100), 2, '0') ELSE string(2001 + p_size % 25) END, '.pdf')")
    return table(spark, d, "part").select("p_partkey", C.year_from_url(url).alias("academic"))


_PERCENT_SQL = """SELECT p_partkey, CASE WHEN v > 0 AND v < 1.0 THEN round(v * 100, 2) WHEN v BETWEEN 0 AND 100 THEN round(v, 2) END pct, (v * 10)::BIGINT AS whole FROM (SELECT p_partkey, (p_partkey % 300) / 2.0::DOUBLE v FROM part)"""


@R.query(_PERCENT_SQL)
def percent_and_money(spark, d):
    """Percentages and amounts of all parts: whole and half values, those out of range, and the branch of fractions."""
    p = table(spark, d, "part").withColumn("v", F.expr("(p_partkey % 300) / 2.0D"))
    return p.select("p_partkey", C.percentage(F.concat(F.col("v").cast("string"), F.lit("%"))).alias("pct"), C.money(F.concat(F.lit("$"), (F.col("v") * 10).cast("string"))).alias("whole"))


@R.query(_PERCENT_SQL)
def percent_and_money_all(spark, d):
    """The same as percent_and_money, under the name it had while that one took even keys only."""
    return percent_and_money(spark, d)


@R.query("""WITH t AS (SELECT p_partkey, 2000 + p_size % 25 y, p_size FROM part) SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN (y + 1) || '-' || (y + 2) ELSE y || '-' || (y + 1) END section, 2::BIGINT n FROM t""")
def section_years(spark, d):
    """Year of the section that a position lies in; before the first header the first one's year."""
    text = F.expr("concat('x Common Data Set ', 2000 + p_size % 25, '-', lpad(string((p_size % 25 + 1) % 100), 2, '0'), ' body common data set ', 2001 + p_size % 25, '/', 2002 + p_size % 25, ' tail')")
    p = table(spark, d, "part").select("p_partkey", "p_size", text.alias("t")).withColumn("h", X.year_headers("t"))
    at = F.when(F.col("p_size") % 3 == 0, F.length("t")).when(F.col("p_size") % 3 == 1, F.lit(0)).otherwise(F.lit(10))
    return p.select("p_partkey", X.header_at(F.col("h"), at).alias("section"), F.size("h").cast("bigint").alias("n"))


@R.query("""SELECT p_partkey, 1000 + p_size AS avg_new, 3000 + p_size AS second_band, 2::BIGINT n FROM part""")
def price_tables(spark, d):
    """Average and income bands from a net-price table's text."""
    rows = "".join(f"<tr><td>{label}</td><td>${1000 * (i + 1)},</td><td>$', {1000 * (i + 2)} + p_size, '</td></tr>" for i, label in enumerate(X.BAND_LABELS))
    html = F.expr(f"concat('<h3>Average Net Price for Full-Time Beginning</h3><td>Average net price</td><td>$900</td><td>$', 1000 + p_size, '</td><b>Average net price by Income</b>{rows}')")
    p = table(spark, d, "part").select("p_partkey", X.price_table(html).alias("c"))
    return p.select("p_partkey", F.col("c")[1]["avg"].cast("int").alias("avg_new"), F.col("c")[1]["bands"][1].cast("int").alias("second_band"), F.size("c").cast("bigint").alias("n"))


@R.query("""SELECT CASE WHEN starts_with(url, 'https') THEN 'pdf' WHEN starts_with(url, 'http://m.') THEN 'xlsx' WHEN page_id % 2 = 0 THEN 'html' ELSE 'other' END kind, count(*) n FROM pages GROUP BY 1""")
def file_kinds(spark, d):
    """Kinds of landed files by leading bytes and declared type."""
    body = F.expr("CASE WHEN url LIKE 'https%' THEN '%PDF-1.4' WHEN url LIKE 'http://m.%' THEN 'PK..' WHEN page_id % 2 = 0 THEN html ELSE 'plain' END")
    return table(spark, d, "pages").groupBy(X.file_kind(body, F.lit("text/plain")).alias("kind")).agg(F.count("*").alias("n"))


@R.query("""WITH w AS (SELECT p_partkey, p_brand, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) w FROM part), s AS (
SELECT a.p_partkey q, b.p_partkey e, len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) score FROM w a JOIN w b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, e DESC) n, lead(score) OVER (PARTITION BY q ORDER BY score DESC, e DESC) s2 FROM s)
SELECT q, e, round(score, 6) score FROM r WHERE n = 1 AND score >= 0.6 AND (s2 IS NULL OR score - s2 >= 0.12)""")
def token_jaccard_match(spark, d):
    """Best match by Jaccard similarity within a block, if clearly ahead of the second."""
    w = table(spark, d, "part").select("p_brand", F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("words"), F.col("p_partkey").alias("e"))
    return M.word_match(w.withColumnRenamed("e", "q"), w, "q", "e", block="p_brand", itself=False).withColumn("score", F.round("score", 6))


@R.query("""SELECT c_name AS city, p_type AS state, min(p_partkey) p_partkey FROM (SELECT lower(p_name) c_name, p_type, p_partkey FROM part) GROUP BY ALL HAVING count(*) = 1""")
def location_unique(spark, d):
    """Places that name exactly one entity."""
    p = table(spark, d, "part").select(F.lower("p_name").alias("city"), F.col("p_type").alias("state"), "p_partkey")
    return M.unique_by_key(p, ["city", "state"], "p_partkey").select("city", "state", "p_partkey")


@R.query("""SELECT form, arg_min(id, (priority, ord)) id FROM (SELECT lower(p_name) form, p_partkey id, 0 priority, p_partkey ord FROM part WHERE p_size < 20 UNION ALL SELECT lower(p_name), p_partkey, 1, p_partkey FROM part) GROUP BY 1""")
def first_name_index(spark, d):
    """First writer of a name wins: the primary source before the secondary one."""
    p = table(spark, d, "part")
    both = p.where("p_size < 20").withColumn("priority", F.lit(0)).unionByName(p.withColumn("priority", F.lit(1)))
    rows = both.select(F.lower("p_name").alias("form"), F.col("p_partkey").alias("id"), "priority")
    return M.first_name_index(rows, "form", "id", "priority", "id")
