"""DuckDB SQL that checks the core queries: written from the definitions, independent of the Spark plans."""

from __future__ import annotations

AT, NOW, YEAR, MASK, SPLIT = 1_750_000_000, 1_790_000_000, 365 * 86_400, 5, "TIMESTAMP '2026-01-01'"
MAX = 9223372036854775807

_PLAIN = r"regexp_replace(regexp_replace(lower({0}), '^\s+|\s+$', '', 'g'), '[\s_-]+', '-', 'g')"
_OBJ = """CASE WHEN object_node IS NOT NULL THEN 'node:' || object_node WHEN object_int IS NOT NULL THEN 'int:' || object_int
 WHEN object_float IS NOT NULL THEN 'float:' || CAST(object_float AS VARCHAR) WHEN object_text IS NOT NULL THEN 'text:' || object_text
 WHEN object_bool IS NOT NULL THEN 'bool:' || object_bool END"""

F = f"""f0 AS (SELECT fact_id AS ok, subject, {_PLAIN.format('predicate')} AS predicate, {_OBJ} AS object, object_node AS node, object_int AS i, object_text AS t,
 coalesce(valid_from, 0) AS vf, valid_to AS vt, {_PLAIN.format('source')} AS source, props, arrived_at FROM fact_rows WHERE subject IS NOT NULL),
f AS (SELECT f0.*, d.card, d.domain, d.range_type, d.range_value FROM f0 JOIN pred_defs d ON d.name = f0.predicate WHERE object IS NOT NULL)"""
ONE = "one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, predicate ORDER BY ok DESC) AS r FROM f WHERE card = 'one') WHERE r = 1)"
MANY = "many AS (SELECT subject, predicate, object, arg_max(node, ok) AS node, arg_max(t, ok) AS t, max(ok) AS ok FROM f WHERE card = 'many' GROUP BY ALL)"
EDGES = "edges AS (SELECT subject AS s, predicate AS p, node AS o FROM one WHERE node IS NOT NULL UNION SELECT subject, predicate, node FROM many WHERE node IS NOT NULL)"
ATTRS = """attrs AS (SELECT id AS node, arg_max(type, node_seq) FILTER (WHERE type IS NOT NULL) AS type, arg_max(label, node_seq) FILTER (WHERE label IS NOT NULL) AS label
 FROM node_rows WHERE op = 'declare' AND id IS NOT NULL GROUP BY id)"""
VIS = f"(label IS NULL OR ({MASK} >> label) & 1 = 1)"
HIDDEN = f"hidden AS (SELECT node FROM attrs WHERE NOT {VIS})"
ALL = ", ".join([F, ONE, MANY, EDGES, ATTRS, HIDDEN])

FEED = f"""c0 AS (SELECT DISTINCT tx, source, seq, (tx, source, seq) AS ok, kind, subject, predicate, observed, coalesce(valid_from, 0) AS vf, valid_to AS vt, object_int, object_text,
 CASE WHEN object_node IS NOT NULL THEN 'node:' || object_node WHEN object_int IS NOT NULL THEN 'int:' || object_int WHEN object_text IS NOT NULL THEN 'text:' || object_text END AS object
 FROM record_feed),
fl AS (SELECT subject, predicate, max(ok) AS floor FROM c0 WHERE kind = 'HardDelete' GROUP BY ALL),
c AS (SELECT c0.* FROM c0 LEFT JOIN fl USING (subject, predicate) WHERE fl.floor IS NULL OR c0.ok > fl.floor),
tomb AS (SELECT DISTINCT subject, predicate, unnest(observed) AS seq FROM c WHERE kind = 'RemoveMany'),
oneh AS (SELECT * REPLACE (CASE WHEN kind = 'SetOne' THEN object END AS object, CASE WHEN kind = 'SetOne' THEN vt END AS vt) FROM c WHERE kind IN ('SetOne', 'CloseOne')),
manyh AS (SELECT * REPLACE (CASE WHEN kind = 'AddMany' THEN vt END AS vt) FROM c WHERE object IS NOT NULL AND (kind = 'CloseMany' OR kind = 'AddMany' AND (subject, predicate, seq) NOT IN (SELECT subject, predicate, seq FROM tomb))),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, predicate ORDER BY ok DESC) AS r FROM oneh) WHERE r = 1),
many AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, predicate, object ORDER BY ok DESC) AS r FROM manyh) WHERE r = 1)"""


def timeline_ctes(src: str, out: str, keys: str = "subject, predicate") -> str:
    """CTE ``out`` (keys, value, f, t) from rows (keys, vf, vt, ok, object): boundaries, winners, islands."""
    k = keys.split(", ")
    on = lambda a, b: " AND ".join(f"{a}.{x} = {b}.{x}" for x in k)
    return f"""{out}_b AS (SELECT {keys}, vf AS f, coalesce(vt, {MAX}) AS t, ok AS o, object AS v FROM {src} WHERE vt IS NULL OR vf < vt),
{out}_x AS (SELECT {keys}, f AS x FROM {out}_b UNION SELECT {keys}, t FROM {out}_b),
{out}_e AS (SELECT {keys}, x AS f, lead(x) OVER (PARTITION BY {keys} ORDER BY x) AS t FROM {out}_x),
{out}_w AS (SELECT {', '.join('e.' + x for x in k)}, e.f, e.t, arg_max(g.v, (g.f, g.o)) AS v FROM {out}_e e JOIN {out}_b g ON {on('e', 'g')} AND g.f <= e.f AND e.f < g.t WHERE e.t IS NOT NULL GROUP BY ALL),
{out}_m AS (SELECT *, CASE WHEN lag(t) OVER p = f AND lag(v) OVER p = v THEN 0 ELSE 1 END AS n FROM {out}_w WINDOW p AS (PARTITION BY {keys} ORDER BY f)),
{out}_i AS (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY f) AS k FROM {out}_m),
{out} AS (SELECT {keys}, v AS value, min(f) AS f, max(t) AS t FROM {out}_i GROUP BY {keys}, v, k)"""


def hop_ctes(left: str, line: str, predicate: str, out: str) -> str:
    return f"""{out}_j AS (SELECT a.subject, greatest(a.f, b.f) AS f, least(a.t, b.t) AS t, b.value AS v FROM {left} a JOIN {line} b
 ON a.value LIKE 'node:%' AND b.subject = CAST(substr(a.value, 6) AS BIGINT) AND b.predicate = '{predicate}' AND a.f < b.t AND b.f < a.t),
{out}_m AS (SELECT *, CASE WHEN lag(t) OVER p = f AND lag(v) OVER p = v THEN 0 ELSE 1 END AS n FROM {out}_j WINDOW p AS (PARTITION BY subject ORDER BY f)),
{out}_i AS (SELECT *, sum(n) OVER (PARTITION BY subject ORDER BY f) AS k FROM {out}_m),
{out} AS (SELECT subject, v AS value, min(f) AS f, max(t) AS t FROM {out}_i GROUP BY subject, v, k)"""


OPEN = f"CASE WHEN t < {MAX} THEN t END"
SUBJ = f"subj AS (SELECT node AS subject FROM attrs WHERE type = 'Issue' AND {VIS})"


def verdict_ctes(rows: str, out: str) -> str:
    """CTE ``out``: verdicts of the handover rule over the fact rows in ``rows``."""
    cur = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, predicate ORDER BY ok DESC) AS r FROM {rows} WHERE card = 'one') WHERE r = 1)"
    v = lambda p: f"(SELECT * FROM {out}_one WHERE predicate = '{p}')"
    then = lambda p, who: f"(SELECT arg_max(h.node, (h.vf, h.ok)) FROM {rows} h WHERE h.predicate = '{p}' AND h.subject = {who} AND h.vf <= p.anchor AND (h.vt IS NULL OR p.anchor < h.vt))"
    ever = lambda p, who: f"EXISTS (SELECT 1 FROM {rows} h WHERE h.predicate = '{p}' AND h.subject = {who} AND h.node = p.actual_node)"
    return f"""{out}_one AS {cur},
{out}_o AS (SELECT s.subject, ab.node AS n1, ap.i AS anchor, ac.object AS actual, ac.node AS actual_node, sc.object AS scope, st.object AS status FROM subj s
 LEFT JOIN {v('approved-by')} ab ON ab.subject = s.subject LEFT JOIN {v('approved-at')} ap ON ap.subject = s.subject
 LEFT JOIN {v('assigned-to')} ac ON ac.subject = s.subject LEFT JOIN {v('component')} sc ON sc.subject = s.subject LEFT JOIN {v('status')} st ON st.subject = s.subject),
{out}_p AS (SELECT p.*, {then('member-of', 'p.n1')} AS n2 FROM {out}_o p),
{out}_r AS (SELECT p.*, {then('manager-of', 'p.n2')} AS required, CASE WHEN n2 IS NOT NULL THEN {ever('manager-of', 'p.n2')} ELSE {ever('member-of', 'p.n1')} END AS held FROM {out}_p p),
{out} AS (SELECT subject, CASE WHEN scope IS DISTINCT FROM 'text:billing' THEN 'NOT_APPLICABLE' WHEN actual IS NULL THEN CASE WHEN status = 'text:blocked' THEN 'ABSENT' ELSE 'OK' END
  WHEN required IS DISTINCT FROM actual_node OR required IS NULL THEN 'MISMATCH' ELSE 'OK' END AS verdict,
 CASE WHEN scope = 'text:billing' AND actual IS NOT NULL AND (required IS DISTINCT FROM actual_node OR required IS NULL) THEN CASE WHEN held THEN 'stale' ELSE 'wrong' END END AS kind,
 CASE WHEN scope = 'text:billing' THEN required END AS required, CAST(NULL AS BIGINT) AS distinct_value, CASE WHEN scope = 'text:billing' THEN actual END AS actual,
 CASE WHEN scope = 'text:billing' AND n1 IS NOT NULL THEN anchor END AS as_of FROM {out}_r)"""


def _knn(where: str = "", itself: bool = True, k: int = 10) -> str:
    return f"""WITH r AS (SELECT *, vec_id % 4 AS ab FROM embeddings), q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0),
p AS (SELECT q.vec_id AS query, r.vec_id AS id, list_sum(list_transform(list_zip(q.embedding, r.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS d FROM q, r
 WHERE true {where} {'' if itself else 'AND q.vec_id <> r.vec_id'}),
o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, id) AS rank FROM p)
SELECT query, id, round(d, 4) AS dist, round(1 / (1 + d), 4) AS score, rank FROM o WHERE rank <= {k}"""


NODE_VECTORS = """nv AS (SELECT node AS id, arg_max(vector, vector_id) AS x FROM vector_rows WHERE node IS NOT NULL AND len(vector) = 32
 AND len(list_filter(vector, lambda e: e IS NULL OR isnan(e))) = 0 AND len(list_filter(vector, lambda e: e <> 0)) > 0 GROUP BY node)"""
SIMILAR = f"""{NODE_VECTORS}, q AS (SELECT * FROM nv WHERE id = (SELECT min(id) FROM nv)),
d AS (SELECT nv.id, list_sum(list_transform(list_zip(q.x, nv.x), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS d FROM nv, q WHERE nv.id <> q.id AND nv.id NOT IN (SELECT node FROM hidden)),
near AS (SELECT id, round(1 / (1 + d), 4) AS score, row_number() OVER (ORDER BY d, id) AS ord FROM d QUALIFY ord <= 25)"""


def _tag(offset: int = 32400, at: int = 1_750_000_000) -> str:
    """CTEs y and z: rows of x (node, date, text) with the calendar stamp of date."""
    return f"""y AS (SELECT *, make_timestamp((date + {offset}) * 1000000) AS l, ({at} + {offset}) // 86400 - (date + {offset}) // 86400 AS d FROM x),
z AS (SELECT *, CASE WHEN date IS NOT NULL THEN strftime(l, '%Y-%m-%d %H:%M') || ' +09:00 (' || left(dayname(l), 3) || ', ' || CASE WHEN d = 0 THEN 'same day' WHEN d > 0 THEN d || ' days before' ELSE -d || ' days after' END
 || CASE WHEN isodow(l) < 6 AND hour(l) >= 9 AND hour(l) < 18 THEN ', business hours' ELSE '' END || ', FY' || (year(l) - (month(l) < 4)::INT) || ' Q' || ((month(l) + 8) % 12 // 3 + 1) || ')' END AS stamp FROM y)"""


LINE = "CASE WHEN stamp IS NULL THEN '- ' ELSE '- [' || stamp || '] ' END || coalesce(text, '') AS line"


def _suppress(card: str) -> str:
    seen = (
        "SELECT subject, predicate, object, vf, vt, source FROM (SELECT *, row_number() OVER (PARTITION BY subject, predicate ORDER BY ok DESC) AS r FROM base) WHERE r = 1"
        if card == "one"
        else "SELECT DISTINCT subject, predicate, object, vf, vt, source FROM base"
    )
    return f"""WITH {F}, base AS (SELECT * FROM f WHERE card = '{card}' AND arrived_at < {SPLIT}), tail AS (SELECT * FROM f WHERE card = '{card}' AND arrived_at >= {SPLIT}), seen AS ({seen}),
m AS (SELECT t.ok, t.subject, t.predicate, EXISTS (SELECT 1 FROM seen s WHERE s.subject = t.subject AND s.predicate = t.predicate AND s.object = t.object AND s.vf = t.vf AND s.vt IS NOT DISTINCT FROM t.vt AND s.source IS NOT DISTINCT FROM t.source) AS dup FROM tail t),
w AS (SELECT *, coalesce(bool_or(NOT dup) OVER (PARTITION BY subject, predicate ORDER BY ok ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS dirty FROM m)
SELECT ok AS line, subject, predicate FROM w WHERE NOT dup OR dirty"""


_NEAR = f"""e AS (SELECT s, p, o FROM edges WHERE s NOT IN (SELECT node FROM hidden) AND o NOT IN (SELECT node FROM hidden)),
u AS (SELECT s AS a, o AS b FROM e UNION SELECT o, s FROM e),
n1 AS (SELECT DISTINCT b AS node FROM u WHERE a = 7 AND b <> 7), n2 AS (SELECT DISTINCT u.b AS node FROM u JOIN n1 ON u.a = n1.node WHERE u.b <> 7 AND u.b NOT IN (SELECT node FROM n1)),
nn AS (SELECT 7::BIGINT AS node, 0 AS depth UNION ALL SELECT node, 1 FROM n1 UNION ALL SELECT node, 2 FROM n2)"""

_WALK = """WITH RECURSIVE e AS (SELECT c_custkey AS s, c_custkey // 3 AS o FROM customer WHERE c_custkey >= 3 UNION SELECT c_custkey, c_custkey * 9 FROM customer WHERE c_custkey <= 5),
w(subject, node, depth) AS (SELECT c.c_custkey, e.o, 1 FROM customer c JOIN e ON e.s = c.c_custkey UNION SELECT w.subject, e.o, w.depth + 1 FROM w JOIN e ON e.s = w.node WHERE w.depth < 16)
SELECT subject, node, min(depth) AS depth FROM w GROUP BY ALL"""

_FNV = """list_reduce(list_prepend(172505283306277::HUGEINT, list_transform(range(1, octet_length(encode({0})) + 1), lambda i: ('0x' || substr(hex(encode({0})), 2 * i - 1, 2))::HUGEINT)),
 lambda h, x: ((xor(h, x) * 435) + ((xor(h, x) & 255::HUGEINT) << 40)) & 281474976710655::HUGEINT)::BIGINT"""

SQL = {
    "fold_one_lww": f"WITH {FEED} SELECT subject, predicate, object, seq FROM one",
    "fold_one_history": f"WITH {FEED} SELECT subject, predicate, object, seq, vf AS valid_from, vt AS valid_to FROM oneh",
    "fold_close_one": f"WITH {FEED} SELECT subject, predicate, seq, vf AS closed_from FROM one WHERE object IS NULL",
    "fold_many_present": f"WITH {FEED} SELECT subject, predicate, object, seq FROM many WHERE kind = 'AddMany'",
    "fold_close_many": f"WITH {FEED} SELECT subject, predicate, object, seq, vf AS closed_from FROM many WHERE kind = 'CloseMany'",
    "fold_retract": f"WITH {FEED} SELECT subject, predicate, object, seq FROM manyh WHERE kind = 'AddMany'",
    "fold_hard_delete": f"WITH {FEED} SELECT DISTINCT subject, predicate, seq, kind AS op FROM c WHERE kind IN ('SetOne', 'CloseOne', 'AddMany', 'CloseMany')",
    "fold_multi_source": f"WITH {FEED} SELECT subject, predicate, object, seq FROM one",
    "fold_idempotent": f"WITH {FEED} SELECT subject, predicate, object, seq FROM many WHERE kind = 'AddMany'",
    "compacted_state": f"WITH {FEED} SELECT subject, predicate, object, seq FROM one WHERE object IS NOT NULL UNION ALL SELECT subject, predicate, object, seq FROM many WHERE kind = 'AddMany'",
    "stream_fold": f"WITH {FEED} SELECT subject, predicate, object, seq FROM one WHERE object IS NOT NULL UNION ALL SELECT subject, predicate, object, seq FROM many WHERE kind = 'AddMany'",
    "edge_props_lww": f"WITH {F} SELECT subject, predicate, object, 'role' AS key, arg_max(json_extract_string(props, '$.role.text'), ok) AS value FROM f WHERE props IS NOT NULL GROUP BY ALL",
    "edge_props_lookup": f"WITH {F} SELECT subject, predicate, object, 'role' AS key, arg_max(json_extract_string(props, '$.role.text'), ok) AS value FROM f WHERE props IS NOT NULL AND predicate = 'works-on' GROUP BY ALL",
    "node_attrs_lww": f"WITH {FEED} SELECT subject AS node, arg_max(object_text, ok) FILTER (WHERE kind = 'SetNodeType') AS type, arg_max(object_int, ok) FILTER (WHERE kind = 'SetNodeLabel') AS label FROM c0 WHERE kind IN ('SetNodeType', 'SetNodeLabel') GROUP BY ALL",
    "read_merge": f"WITH {F}, {ONE} SELECT subject, predicate, object, ok FROM one",
    "observe_incremental": f"WITH {F}, {ONE} SELECT subject, predicate, object, ok FROM one",
    "late_arrival": f"WITH {F}, {ONE}, n AS (SELECT subject, predicate, max(vf) AS newest FROM f WHERE card = 'one' GROUP BY ALL) SELECT subject, predicate, object, vf AS valid_from, newest FROM one JOIN n USING (subject, predicate) WHERE vf < newest",
    "suppress_noop": _suppress("one"),
    "suppress_noop_many": _suppress("many"),
    "point_one": f"WITH {F}, {ONE} SELECT subject, predicate, object, vf AS valid_from, source FROM one",
    "point_asof": f"WITH {F}, w AS (SELECT *, row_number() OVER (PARTITION BY subject, predicate ORDER BY vf DESC, ok DESC) AS r FROM f WHERE card = 'one' AND vf <= {AT} AND (vt IS NULL OR {AT} < vt)) SELECT subject, predicate, object, vf AS valid_from FROM w WHERE r = 1",
    "point_many": f"WITH {F}, {MANY} SELECT subject, predicate, object FROM many",
    "point_many_asof": f"WITH {FEED}, w AS (SELECT *, row_number() OVER (PARTITION BY subject, predicate, object ORDER BY vf DESC, ok DESC) AS r FROM manyh WHERE vf <= {AT} AND (vt IS NULL OR {AT} < vt)) SELECT subject, predicate, object FROM w WHERE r = 1 AND kind = 'AddMany'",
    "closed_from": f"WITH {FEED} SELECT subject, predicate, CASE WHEN object IS NULL THEN vf END AS closed_from FROM one",
    "confidence_tier": f"""WITH {F}, {ONE}, s AS (SELECT o.subject, o.predicate, o.object, count(DISTINCT f.source) AS corroboration, {NOW} - any_value(o.vf) AS age
 FROM one o JOIN f ON f.subject = o.subject AND f.predicate = o.predicate AND f.object = o.object AND f.card = 'one' GROUP BY o.subject, o.predicate, o.object)
SELECT subject, predicate, object, corroboration, age, CASE WHEN corroboration = 0 OR age > {YEAR} THEN 'low' WHEN corroboration >= 2 THEN 'high' ELSE 'medium' END AS tier FROM s""",
    "timeline": f"WITH {F}, h AS (SELECT * FROM f WHERE card = 'one'), {timeline_ctes('h', 'l')} SELECT subject, predicate, value, f AS valid_from, {OPEN} AS valid_to FROM l",
    "timeline_derived": f"WITH {F}, h AS (SELECT * FROM f WHERE predicate IN ('assigned-to', 'member-of', 'manager-of')), {timeline_ctes('h', 'l')}, s0 AS (SELECT * FROM l WHERE predicate = 'assigned-to'), {hop_ctes('s0', 'l', 'member-of', 's1')}, {hop_ctes('s1', 'l', 'manager-of', 's2')} SELECT subject, value, f AS valid_from, {OPEN} AS valid_to FROM s2",
    "timeline_confidence": f"""WITH {F}, {ONE}, t AS (SELECT o.subject, o.predicate, any_value(o.node) AS node, CASE count(DISTINCT f.source) WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS tier
 FROM one o JOIN f ON f.subject = o.subject AND f.predicate = o.predicate AND f.object = o.object AND f.card = 'one' GROUP BY o.subject, o.predicate),
a AS (SELECT subject, node FROM t WHERE predicate = 'assigned-to' AND node IS NOT NULL),
s AS (SELECT a.subject, a.subject AS node, 'assigned-to' AS predicate FROM a UNION ALL SELECT a.subject, a.node, 'member-of' FROM a JOIN t ON t.subject = a.node AND t.predicate = 'member-of' AND t.node IS NOT NULL),
w AS (SELECT s.subject, s.node, s.predicate, t.tier, row_number() OVER (PARTITION BY s.subject ORDER BY t.tier, s.node, s.predicate) AS r FROM s JOIN t ON t.subject = s.node AND t.predicate = s.predicate)
SELECT subject, ['low', 'medium', 'high'][tier] AS tier, node AS weakest_node, predicate AS weakest_predicate FROM w WHERE r = 1""",
    "asof_join": f"""WITH {F}, {ONE}, p AS (SELECT subject, 'status' AS predicate, i AS at FROM one WHERE predicate = 'approved-at' AND i IS NOT NULL)
SELECT p.subject, p.predicate, p.at, (SELECT arg_max(h.object, (h.vf, h.ok)) FROM f h WHERE h.subject = p.subject AND h.predicate = 'status' AND h.vf <= p.at AND (h.vt IS NULL OR p.at < h.vt)) AS value FROM p""",
    "describe_node": f"""WITH {ALL}, {NODE_VECTORS}, c AS (SELECT o.subject, o.predicate, count(DISTINCT f.source) AS n FROM one o JOIN f ON f.subject = o.subject AND f.predicate = o.predicate AND f.object = o.object AND f.card = 'one' GROUP BY ALL),
v AS (SELECT o.subject AS node, o.predicate, o.object AS value, o.source, CASE WHEN c.n = 0 OR {NOW} - o.vf > {YEAR} THEN 'low' WHEN c.n >= 2 THEN 'high' ELSE 'medium' END AS tier FROM one o JOIN c USING (subject, predicate)
 UNION ALL SELECT subject, predicate, object, NULL, NULL FROM many)
SELECT coalesce(v.node, a.node) AS node, predicate, value, source, tier, a.type, a.label, coalesce(v.node, a.node) IN (SELECT id FROM nv) AS embedded FROM v FULL JOIN attrs a ON a.node = v.node""",
    "schema_inventory": f"""WITH {ATTRS} SELECT 'predicate' AS kind, name, card, domain, coalesce(range_type, range_value) AS range FROM pred_defs
UNION ALL SELECT DISTINCT 'label', CAST(label AS VARCHAR), NULL, NULL, NULL FROM attrs WHERE label IS NOT NULL UNION ALL VALUES ('rule', 'handover', NULL, NULL, NULL), ('rule', 'self-approval', NULL, NULL, NULL)""",
    "filter_has_type": f"WITH {ATTRS} SELECT node FROM attrs WHERE type = 'Issue'",
    "filter_has_value": f"WITH {ALL} SELECT node FROM attrs WHERE node IN (SELECT subject FROM one WHERE predicate = 'priority')",
    "filter_int_cmp": f"WITH {F}, {ONE} SELECT subject AS node, i AS value FROM one WHERE predicate = 'estimate' AND i >= 13",
    "filter_int_cmp_asof": f"WITH {F}, w AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY vf DESC, ok DESC) AS r FROM f WHERE predicate = 'priority' AND vf <= {AT} AND (vt IS NULL OR {AT} < vt)) SELECT subject AS node, i AS value FROM w WHERE r = 1 AND i < 3",
    "authz_scope": f"WITH {ATTRS} SELECT node, label FROM attrs WHERE {VIS}",
    "authz_point": f"WITH {ALL} SELECT subject, predicate, object FROM one WHERE subject NOT IN (SELECT node FROM hidden) AND (node IS NULL OR node NOT IN (SELECT node FROM hidden))",
    "find_text": f"""WITH {ALL}, h AS (SELECT subject AS node, predicate, t, 0 AS pass FROM one UNION ALL SELECT subject, predicate, t, 1 FROM many),
w AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY pass, predicate, t) AS r FROM h WHERE contains(lower(t), 'audit')) SELECT node, predicate, t AS value FROM w WHERE r = 1 AND node NOT IN (SELECT node FROM hidden)""",
    "find_limited": f"""WITH {ALL}, h AS (SELECT subject AS node, predicate, t, 0 AS pass FROM one UNION ALL SELECT subject, predicate, t, 1 FROM many),
w AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY pass, predicate, t) AS r FROM h WHERE contains(lower(t), 'release')), k AS (SELECT * FROM w WHERE r = 1 AND node NOT IN (SELECT node FROM hidden))
SELECT node, predicate, t AS value, (SELECT count(*) FROM k) > 20 AS truncated FROM k ORDER BY node LIMIT 20""",
    "find_excerpt": """WITH t AS (SELECT doc_id, max(text) AS t FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id), h AS (SELECT doc_id, t, length(t) AS n, instr(lower(t), 'harbour') - 1 AS p FROM t WHERE contains(lower(t), 'harbour'))
SELECT doc_id AS node, 'text' AS predicate, CASE WHEN n <= 160 THEN t ELSE CASE WHEN p > 80 THEN '…' ELSE '' END || substr(t, greatest(p - 80, 0) + 1, least(p + 87, n) - greatest(p - 80, 0)) || CASE WHEN p + 87 < n THEN '…' ELSE '' END END AS value FROM h""",
    "display_name": f"WITH {F}, {ONE} SELECT subject AS node, arg_min(t, CASE predicate WHEN 'name' THEN 0 ELSE 1 END) AS name FROM one WHERE predicate IN ('name', 'title') AND t IS NOT NULL GROUP BY subject",
    "expand_1hop": f"WITH {ALL} SELECT s AS subject, o AS node FROM edges WHERE p = 'assigned-to' AND s IN (SELECT node FROM attrs WHERE type = 'Issue')",
    "expand_asof": f"WITH {ALL}, w AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY vf DESC, ok DESC) AS r FROM f WHERE predicate = 'assigned-to' AND vf <= {AT} AND (vt IS NULL OR {AT} < vt)) SELECT subject, node FROM w WHERE r = 1 AND node IS NOT NULL AND subject IN (SELECT node FROM attrs WHERE type = 'Issue')",
    "expand_2hop": f"WITH {ALL} SELECT DISTINCT a.s AS subject, b.o AS node FROM edges a JOIN edges b ON b.s = a.o AND b.p = 'member-of' WHERE a.p = 'assigned-to' AND a.s IN (SELECT node FROM attrs WHERE type = 'Issue')",
    "expand_reverse": f"WITH {ALL} SELECT o AS subject, s AS node FROM edges WHERE p = 'member-of' AND o IN (SELECT node FROM attrs WHERE type = 'Department')",
    "expand_symmetric": f"WITH {ALL}, e AS (SELECT s, o FROM edges WHERE p = 'works-on' UNION SELECT o, s FROM edges WHERE p = 'works-on') SELECT s AS subject, o AS node FROM e WHERE s IN (SELECT node FROM attrs)",
    "expand_inverse": f"WITH {ALL}, e AS (SELECT s, o FROM edges WHERE p = 'manager-of' UNION SELECT o, s FROM edges WHERE p = 'member-of') SELECT s AS subject, o AS node FROM e WHERE s IN (SELECT node FROM attrs WHERE type = 'Department')",
    "expand_transitive": _WALK,
    "neighbors": f"WITH {ALL} SELECT DISTINCT s AS subject, o AS node FROM edges WHERE s IN (SELECT node FROM attrs WHERE type = 'Issue')",
    "neighborhood_khop": f"WITH {ALL}, {_NEAR} SELECT node, depth FROM nn",
    "neighborhood_edges": f"""WITH {ALL}, {_NEAR}, st AS (SELECT least(s, o) AS a, greatest(s, o) AS b, count(DISTINCT p) AS strength FROM e WHERE s <> o GROUP BY 1, 2)
SELECT DISTINCT st.a, st.b, st.strength FROM st JOIN nn x ON x.node = st.a JOIN nn y ON y.node = st.b WHERE least(x.depth, y.depth) < 2""",
    "edge_strength": f"WITH {ALL} SELECT least(s, o) AS a, greatest(s, o) AS b, count(DISTINCT p) AS strength FROM edges WHERE s <> o GROUP BY 1, 2",
    "graph_induced": f"WITH {ALL}, n AS (SELECT node FROM attrs WHERE {VIS} ORDER BY node LIMIT 3000) SELECT DISTINCT least(s, o) AS a, greatest(s, o) AS b FROM edges WHERE s IN (SELECT node FROM n) AND o IN (SELECT node FROM n)",
    "overview_types": f"WITH {ATTRS} SELECT coalesce(type, '(untyped)') AS type, count(*) AS n, min(node) AS sample FROM attrs WHERE {VIS} GROUP BY 1",
    "overview_edges": f"""WITH {ALL}, j AS (SELECT coalesce(a.type, '(untyped)') AS x, coalesce(b.type, '(untyped)') AS y FROM edges LEFT JOIN attrs a ON a.node = s LEFT JOIN attrs b ON b.node = o
 WHERE s NOT IN (SELECT node FROM hidden) AND o NOT IN (SELECT node FROM hidden)) SELECT least(x, y) AS type_a, greatest(x, y) AS type_b, count(*) AS n FROM j WHERE x <> y GROUP BY 1, 2""",
    "label_histogram": f"WITH {ATTRS} SELECT label, count(*) AS n FROM attrs WHERE label IS NOT NULL GROUP BY label",
    "sources_inventory": f"WITH {F} SELECT DISTINCT source FROM f WHERE source IS NOT NULL",
    "knn_exact": _knn(),
    "knn_typed": _knn("AND r.label = 3"),
    "knn_authz": _knn(f"AND ({MASK} >> r.ab) & 1 = 1"),
    "knn_strict": _knn("AND r.vec_id < (SELECT max(vec_id) * 4 // 5 FROM embeddings)"),
    "knn_fresh": _knn(itself=False),
    "topk_score": "SELECT event_id AS id, value AS score FROM events ORDER BY value DESC, event_id LIMIT 100",
    "search_expand": """WITH q AS (SELECT embedding AS x FROM embeddings WHERE vec_id = 0),
p AS (SELECT vec_id, list_sum(list_transform(list_zip(q.x, embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS d FROM embeddings, q WHERE label = 3 AND (5 >> vec_id % 4) & 1 = 1),
h AS (SELECT vec_id, row_number() OVER (ORDER BY d, vec_id) AS ord FROM p ORDER BY d, vec_id LIMIT 10)
SELECT c_custkey + 1000000 AS id, 1.0::DOUBLE AS score, row_number() OVER (ORDER BY ord, c_custkey) AS ord FROM customer JOIN h ON vec_id = c_custkey % 500 ORDER BY 3 LIMIT 100""",
    "ann_complete": _knn(),
    "ann_recall": "SELECT 'ann_ivf' AS search, true AS reached UNION ALL SELECT 'ann_rerank', true",
    "ann_budget": "SELECT vec_id AS query, true AS within, true AS left_out, 10::BIGINT AS n FROM embeddings WHERE vec_id % 50 = 0",
    "ann_reuse": "SELECT 'a few more' AS rows, false AS trained_anew UNION ALL SELECT 'twice as many', true",
    "pipeline_similar": f"WITH {ALL}, {SIMILAR} SELECT id, score, ord FROM near",
    "pipeline_compose": f"""WITH {ALL}, i AS (SELECT node, row_number() OVER (ORDER BY node) AS ord FROM (SELECT node FROM attrs WHERE type = 'Issue') WHERE node NOT IN (SELECT node FROM hidden)),
k AS (SELECT node FROM i WHERE node IN (SELECT subject FROM one WHERE predicate = 'title') AND node IN (SELECT subject FROM one WHERE predicate = 'priority' AND i <= 2))
SELECT DISTINCT o AS id, 1.0::DOUBLE AS score FROM edges WHERE p = 'assigned-to' AND s IN (SELECT node FROM k) AND o NOT IN (SELECT node FROM hidden) AND o IN (SELECT node FROM attrs WHERE type = 'Person')""",
    "pipeline_cap": f"""WITH {ALL}, i AS (SELECT node, row_number() OVER (ORDER BY node) AS ord FROM attrs WHERE type = 'Issue' ORDER BY node LIMIT 100),
x AS (SELECT o, min(ord) AS ord FROM edges JOIN i ON i.node = s WHERE p = 'in-project' GROUP BY o) SELECT o AS id, row_number() OVER (ORDER BY ord, o) AS ord FROM x ORDER BY 2 LIMIT 10""",
    "retrieve_context": f"""WITH {ALL}, {SIMILAR}, nm AS (SELECT subject, arg_min(t, CASE predicate WHEN 'name' THEN 0 ELSE 1 END) AS name FROM one WHERE predicate IN ('name', 'title') AND t IS NOT NULL GROUP BY subject),
x AS (SELECT near.id AS node, near.score, nm.name AS text, o.i AS date FROM near LEFT JOIN nm ON nm.subject = near.id LEFT JOIN one o ON o.subject = near.id AND o.predicate = 'approved-at'), {_tag()}
SELECT row_number() OVER (ORDER BY date ASC NULLS LAST, score DESC, node) AS place, node, date, stamp, {LINE} FROM z""",
    "context_lines": f"WITH x AS (SELECT doc_id AS node, text, CAST(floor(epoch(crawled_at)) AS BIGINT) AS date FROM documents), {_tag()} SELECT node, date, stamp, {LINE} FROM z",
    "calendar_stamp": """WITH x AS (SELECT o_orderkey, CAST(floor(epoch(o_orderdate)) AS BIGINT) + o_orderkey % 86400 AS t FROM orders), y AS (SELECT *, make_timestamp((t - 12600) * 1000000) AS l FROM x)
SELECT o_orderkey, t, strftime(l, '%Y-%m-%d %H:%M') || ' -03:30' AS iso, left(dayname(l), 3) AS weekday, isodow(l) < 6 AND hour(l) * 60 + minute(l) >= 540 AND hour(l) * 60 + minute(l) < 1080 AS business,
 (year(l) - (month(l) < 4)::INT)::BIGINT AS fiscal_year, ((month(l) + 8) % 12 // 3 + 1)::INT AS fiscal_quarter, (datediff('day', l::DATE, make_timestamp(899987400000000)::DATE))::BIGINT AS rel_days FROM y""",
    "conformance_verdicts": f"WITH {ALL}, {SUBJ}, {verdict_ctes('f', 'v')} SELECT * FROM v",
    "conformance_incremental": f"WITH {ALL}, {SUBJ}, {verdict_ctes('f', 'v')} SELECT * FROM v",
    "conformance_changes": f"""WITH {ALL}, {SUBJ}, b AS (SELECT * FROM f WHERE arrived_at < {SPLIT}), {verdict_ctes('f', 'v')}, {verdict_ctes('b', 'u')}
SELECT subject, concat_ws('/', u.verdict, u.kind) AS old_verdict, concat_ws('/', v.verdict, v.kind) AS new_verdict FROM u JOIN v USING (subject)
WHERE (u.verdict, u.kind, u.required, u.actual, u.as_of) IS DISTINCT FROM (v.verdict, v.kind, v.required, v.actual, v.as_of)""",
    "conformance_distinct": f"""WITH {ALL}, {SUBJ}, p AS (SELECT s.subject, a.node AS d, ac.object AS actual, ac.node AS an, sc.object AS scope, st.object AS status FROM subj s
 LEFT JOIN one a ON a.subject = s.subject AND a.predicate = 'assigned-to' LEFT JOIN one ac ON ac.subject = s.subject AND ac.predicate = 'approved-by'
 LEFT JOIN one sc ON sc.subject = s.subject AND sc.predicate = 'issue-type' LEFT JOIN one st ON st.subject = s.subject AND st.predicate = 'status')
SELECT subject, CASE WHEN scope IS DISTINCT FROM 'text:change' THEN 'NOT_APPLICABLE' WHEN actual IS NULL THEN CASE WHEN status = 'text:closed' THEN 'ABSENT' ELSE 'OK' END WHEN d = an THEN 'MISMATCH' ELSE 'OK' END AS verdict,
 CASE WHEN scope = 'text:change' AND d = an THEN 'wrong' END AS kind, CAST(NULL AS BIGINT) AS required, CASE WHEN scope = 'text:change' THEN d END AS distinct_value, CASE WHEN scope = 'text:change' THEN actual END AS actual, CAST(NULL AS BIGINT) AS as_of FROM p""",
    "completeness": f"""WITH {ALL}, {SUBJ}, r AS (SELECT unnest(['title', 'status', 'assigned-to', 'component']) AS p, unnest([1, 2, 3, 4]) AS n)
SELECT s.subject AS node, string_agg(r.p, ',' ORDER BY r.n) AS missing FROM subj s, r WHERE NOT EXISTS (SELECT 1 FROM one o WHERE o.subject = s.subject AND o.predicate = r.p) GROUP BY s.subject""",
    "live_completeness": f"""WITH {ALL}, {SUBJ}, r AS (SELECT unnest(['title', 'status', 'assigned-to', 'component']) AS p, unnest([1, 2, 3, 4]) AS n)
SELECT s.subject AS node, string_agg(r.p, ',' ORDER BY r.n) AS missing FROM subj s, r WHERE NOT EXISTS (SELECT 1 FROM one o WHERE o.subject = s.subject AND o.predicate = r.p) GROUP BY s.subject""",
    "live_diff": f"""WITH {F}, w AS (SELECT subject, predicate, object, row_number() OVER (PARTITION BY subject, predicate ORDER BY vf DESC, ok DESC) AS r FROM f WHERE card = 'one' AND vf <= {AT} AND (vt IS NULL OR {AT} < vt)),
o AS (SELECT subject, predicate, object, row_number() OVER (PARTITION BY subject, predicate ORDER BY vf DESC, ok DESC) AS r FROM f WHERE card = 'one' AND arrived_at < {SPLIT} AND vf <= {AT} AND (vt IS NULL OR {AT} < vt)),
a AS (SELECT subject, predicate, object FROM w WHERE r = 1), b AS (SELECT subject, predicate, object FROM o WHERE r = 1)
SELECT *, 'added' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "csv_facts": f"""WITH x AS (SELECT {_FNV.format("'Customer' || chr(0) || c_custkey")} AS subject, c_name, c_mktsegment, {_FNV.format("'Nation' || chr(0) || c_nationkey")} AS n FROM customer)
SELECT subject, 'c_name' AS predicate, 'text:' || c_name AS object FROM x UNION ALL SELECT subject, 'c_mktsegment', 'text:' || c_mktsegment FROM x UNION ALL SELECT subject, 'c_nationkey', 'node:' || n FROM x""",
    "store_stats": f"""WITH {F}, {ATTRS}, {NODE_VECTORS} SELECT 'rows' AS name, count(*) AS n FROM f UNION ALL SELECT 'subjects', count(DISTINCT subject) FROM f UNION ALL SELECT 'predicates', count(DISTINCT predicate) FROM f
UNION ALL SELECT 'sources', count(DISTINCT source) FROM f UNION ALL SELECT 'head', max(ok) FROM f UNION ALL SELECT 'label:' || label, count(*) FROM attrs WHERE label IS NOT NULL GROUP BY label UNION ALL SELECT 'embeddings', count(*) FROM nv""",
    "validate_facts": f"""WITH {ALL}, p AS (SELECT f.ok, f.predicate, CASE WHEN a.type <> f.domain THEN 'domain' WHEN f.range_type IS NOT NULL AND f.node IS NULL THEN 'class' WHEN b.type <> f.range_type THEN 'range'
 WHEN f.range_value IS NOT NULL AND split_part(f.object, ':', 1) <> f.range_value THEN 'class' END AS problem FROM f LEFT JOIN attrs a ON a.node = f.subject LEFT JOIN attrs b ON b.node = f.node) SELECT * FROM p WHERE problem IS NOT NULL""",
}
