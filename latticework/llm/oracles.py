"""SQL for DuckDB that gives the results of the training-data queries SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = """
WITH conv AS (SELECT conv_id, list(t ORDER BY t.turn, t.role, t.text) c FROM (SELECT DISTINCT conv_id, struct_pack(turn := turn, role := role, text := text) t FROM conversations WHERE conv_id IS NOT NULL) GROUP BY 1),
last AS (SELECT conv_id, c, coalesce(list_max(list_filter(range(1, len(c) + 1), lambda i: c[i].role = 'assistant')), 0) l FROM conv),
pair AS (SELECT a.conv_id, a.c, CASE WHEN a.l = 0 THEN a.c WHEN b.l > 0 THEN list_concat(a.c[1:a.l - 1], [b.c[b.l]]) ELSE a.c[1:a.l - 1] END r
         FROM last a LEFT JOIN last b ON xor(b.conv_id, 1) = a.conv_id),
same AS (SELECT *, coalesce(list_position(list_transform(range(1, greatest(len(c), len(r)) + 1), lambda i: i <= len(c) AND i <= len(r) AND c[i].role IS NOT DISTINCT FROM r[i].role AND c[i].text IS NOT DISTINCT FROM r[i].text), false), 0) p FROM pair),
cut AS (SELECT conv_id, c, r, CASE WHEN p > 0 THEN p - 1 ELSE len(c) END n FROM same),
parts AS (SELECT conv_id, n, c[1:n] head, c[n + 1:len(c)] c, r[n + 1:len(r)] r FROM cut),
said AS (SELECT conv_id, n, list_transform(head, lambda t: '<|' || coalesce(t.role, 'none') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10)) head, c, r,
  list_transform(c, lambda t: '<|' || coalesce(t.role, 'none') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10)) cs,
  list_transform(r, lambda t: '<|' || coalesce(t.role, 'none') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10)) rs FROM parts)
SELECT conv_id, n::INTEGER prompt_turns, array_to_string(head, '') prompt, array_to_string(cs, '') chosen_text, array_to_string(rs, '') rejected_text,
  array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: c[i].role = 'assistant'), lambda i: (length(array_to_string(cs[1:i - 1], '')) + 14)::VARCHAR || '-' || (length(array_to_string(cs[1:i], '')) - 1)::VARCHAR), ',') chosen_spans,
  array_to_string(list_transform(list_filter(range(1, len(r) + 1), lambda i: r[i].role = 'assistant'), lambda i: (length(array_to_string(rs[1:i - 1], '')) + 14)::VARCHAR || '-' || (length(array_to_string(rs[1:i], '')) - 1)::VARCHAR), ',') rejected_spans
FROM said
"""

_COMPONENTS = """
reach AS (SELECT id AS node, id AS seen FROM nodes UNION SELECT l.b, r.seen FROM reach r JOIN links l ON l.a = r.node),
component AS (SELECT node, min(seen) component_id FROM reach GROUP BY node)
"""

OP3 = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END s FROM words),
shingles AS (SELECT doc_id, len(s) n, unnest(s) x FROM sets),
common AS (SELECT p.doc_id a, q.doc_id b, p.n na, q.n nb, count(*) i FROM shingles p JOIN shingles q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * i >= 85 * (na + nb - i)),
nodes AS (SELECT DISTINCT doc_id id FROM documents), {_COMPONENTS}
SELECT doc_id, len(s)::BIGINT n_shingles, component_id, doc_id = component_id kept FROM sets JOIN component ON node = doc_id
"""


def op4(rules, sites) -> str:
    """Verdicts by the rules; the list holds the canonical urls of the sites."""
    values = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in rules)
    names = ", ".join(f"'{s}'" for s in sites)
    return rf"""
WITH rules(verdict, h, p) AS (VALUES {values}),
a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) q FROM a),
c AS (SELECT *, host || regexp_replace(path, '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END canonical FROM b),
listed AS (SELECT DISTINCT canonical FROM c WHERE list_has_any(string_split(host, '.'), [{names}])),
fits AS (SELECT c.page_id, c.host, c.path, arg_max(struct_pack(rule := h || p, verdict := verdict), length(h || p)) best FROM c JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
SELECT c.page_id, c.host, c.path, best.rule AS rule, coalesce(best.verdict, CASE WHEN c.canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) verdict
FROM c LEFT JOIN fits ON fits.page_id = c.page_id
"""


OP9 = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (SELECT p.vec_id a, q.vec_id b FROM ok p JOIN ok q ON p.vec_id <> q.vec_id AND list_dot_product(p.e, q.e) / sqrt(list_dot_product(p.e, p.e)) / sqrt(list_dot_product(q.e, q.e)) >= 0.9),
nodes AS (SELECT DISTINCT vec_id id FROM embeddings), {_COMPONENTS}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) n_links, component_id, vec_id = component_id kept FROM v JOIN component ON node = vec_id
"""


OP11 = """
WITH t AS (SELECT doc_id, coalesce(text, '') x, sha256('1:' || coalesce(doc_id::VARCHAR, '')) h FROM documents),
u AS (SELECT doc_id, x, length(x) n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) h FROM t),
c AS (SELECT doc_id, x, n, least(h[1] % (n + 1), h[2] % (n + 1)) a, greatest(h[1] % (n + 1), h[2] % (n + 1)) b,
  CASE WHEN n = 0 OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END form FROM u),
p AS (SELECT *, left(x, a) pre, substr(x, a + 1, b - a) mid, substr(x, b + 1) suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END prefix_chars, CASE WHEN form <> 'plain' THEN b - a END middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) output_sha256, sha256(x) restored_sha256
FROM p
"""
