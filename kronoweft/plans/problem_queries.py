"""The queries of the general data problems (1, 2, 4, 5, 6) and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kronoweft.operators import changefeed, history, intervals, orphans, widen
from kronoweft.sources.tables import table

ISSUE = [
    widen.Attribute("title", "title", "text"),
    widen.Attribute("issue-type", "issue_type", "text"),
    widen.Attribute("status", "status", "text"),
    widen.Attribute("component", "component", "text"),
    widen.Attribute("priority", "priority", "int"),
    widen.Attribute("estimate", "estimate", "int"),
    widen.Attribute("approved-at", "approved_at", "instant"),
]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.current_values(table(spark, d, "record_feed"))


#: Instants of the snapshots that p2_snapshots merges: March and December 2024, October 2025.
SNAPSHOTS = [1_710_000_000, 1_735_000_000, 1_760_000_000]


def _memberships(spark: SparkSession, d: str) -> tuple[DataFrame, Column]:
    facts = table(spark, d, "fact_rows").where(F.col("predicate").isin("member-of", "manager-of", "role"))
    return facts, F.coalesce(F.col("object_node").cast("string"), F.nullif(widen.strip(F.col("object_text")), F.lit("")), F.col("object_int").cast("string"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return history.type2_history(*_memberships(spark, d))


def p2_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The dimension that three periodic snapshots leave, each merged into what the ones before it left."""
    facts, value = _memberships(spark, d)
    rows = facts.select(*history.KEYS, F.coalesce("valid_from", F.lit(0)).alias("f"), "valid_to", "fact_id", value.alias("value")).where("value IS NOT NULL AND subject IS NOT NULL")
    dim = spark.createDataFrame([], "subject bigint, predicate string, value string, valid_from bigint, valid_to bigint")
    for at in SNAPSHOTS:
        held = rows.where((F.col("f") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))
        held = held.groupBy(*history.KEYS).agg(F.max_by("value", F.struct("f", "fact_id")).alias("value"))
        dim = history.merge_type2(dim, held, history.KEYS, ["value"], at)
    return dim


def _references(spark: SparkSession, d: str) -> DataFrame:
    return orphans.references(table(spark, d, "fact_rows"), "fact_rows", "fact_id", "object_node").unionByName(
        orphans.references(table(spark, d, "vector_rows"), "vector_rows", "vector_id", "node")
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = orphans.orphans(_references(spark, d), table(spark, d, "node_rows"))
    return found.select("table_name", F.col("period").alias("arrived_month"), "row_id", "reason")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    found = orphans.orphans(_references(spark, d), table(spark, d, "node_rows"))
    return orphans.orphan_report(found).withColumnRenamed("period", "arrived_month")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return widen.wide(table(spark, d, "fact_rows"), ISSUE, block=4)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.periods_and_gaps(table(spark, d, "segment_rows"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_snapshots": p2_snapshots, "p4_found": p4_found, "p4_report": p4_report, "p5_found": p5_found, "p6_found": p6_found}

_P4 = """WITH r AS (
  SELECT 'fact_rows' AS table_name, fact_id AS row_id, object_node AS node, arrived_at FROM fact_rows WHERE object_node IS NOT NULL
  UNION ALL SELECT 'vector_rows', vector_id, node, arrived_at FROM vector_rows WHERE node IS NOT NULL),
k AS (SELECT id, min(arrived_at) AS first, count(*) FILTER (WHERE op = 'declare') AS declares FROM node_rows GROUP BY id),
l AS (SELECT r.table_name, r.row_id, r.node, r.arrived_at,
  (SELECT arg_max(n.op, (n.arrived_at, n.node_seq)) FROM node_rows n WHERE n.id = r.node AND n.arrived_at <= r.arrived_at) AS state FROM r),
f AS (SELECT l.table_name, strftime(l.arrived_at, '%Y-%m') AS arrived_month, l.row_id,
  CASE WHEN coalesce(k.declares, 0) = 0 THEN 'missing' WHEN l.arrived_at < k.first THEN 'late' WHEN l.state = 'drop' THEN 'deleted' END AS reason
  FROM l LEFT JOIN k ON k.id = l.node)
"""

SQL = {
    "p1_found": """WITH c AS (SELECT DISTINCT tx, coalesce(source, 0) AS source, seq, kind, subject, predicate, observed,
    CASE WHEN object_node IS NOT NULL THEN 'node:' || object_node WHEN object_int IS NOT NULL THEN 'int:' || object_int
         WHEN object_text IS NOT NULL THEN 'text:' || object_text END AS object
  FROM record_feed WHERE subject IS NOT NULL AND predicate IS NOT NULL),
f AS (SELECT subject, predicate, max((tx, source, seq)) AS fl FROM c WHERE kind = 'HardDelete' GROUP BY ALL),
a AS (SELECT c.* FROM c LEFT JOIN f USING (subject, predicate) WHERE f.fl IS NULL OR (c.tx, c.source, c.seq) > f.fl),
t AS (SELECT DISTINCT subject, predicate, unnest(observed) AS seq FROM a WHERE kind = 'RemoveMany'),
v AS (SELECT subject, predicate, NULL AS element, tx, source, seq, kind, object FROM a WHERE kind IN ('SetOne', 'CloseOne')
  UNION ALL SELECT subject, predicate, object, tx, source, seq, kind, object FROM a
    WHERE object IS NOT NULL AND (kind = 'CloseMany' OR kind = 'AddMany' AND NOT EXISTS (SELECT 1 FROM t WHERE t.seq = a.seq AND t.subject = a.subject AND t.predicate = a.predicate))),
h AS (SELECT *, row_number() OVER (PARTITION BY subject, predicate, element ORDER BY tx DESC, source DESC, seq DESC) AS r FROM v)
SELECT subject, predicate, object, seq FROM h WHERE r = 1 AND kind IN ('SetOne', 'AddMany') AND object IS NOT NULL""",
    "p2_found": """WITH b AS (SELECT subject, predicate, coalesce(valid_from, 0) AS f, coalesce(valid_to, 9223372036854775807) AS t, fact_id AS o,
    coalesce(CAST(object_node AS VARCHAR), nullif(trim(object_text), ''), CAST(object_int AS VARCHAR)) AS v
  FROM fact_rows WHERE predicate IN ('member-of', 'manager-of', 'role')),
g AS (SELECT * FROM b WHERE v IS NOT NULL AND f < t AND subject IS NOT NULL),
x AS (SELECT subject, predicate, f AS x FROM g UNION SELECT subject, predicate, t FROM g),
e AS (SELECT subject, predicate, x AS f, lead(x) OVER (PARTITION BY subject, predicate ORDER BY x) AS t FROM x),
w AS (SELECT e.subject, e.predicate, e.f, e.t, arg_max(g.v, (g.f, g.o)) AS v FROM e JOIN g ON g.subject = e.subject AND g.predicate = e.predicate AND g.f <= e.f AND e.f < g.t
  WHERE e.t IS NOT NULL GROUP BY ALL),
m AS (SELECT *, CASE WHEN lag(t) OVER p = f AND lag(v) OVER p = v THEN 0 ELSE 1 END AS n FROM w WINDOW p AS (PARTITION BY subject, predicate ORDER BY f)),
i AS (SELECT *, sum(n) OVER (PARTITION BY subject, predicate ORDER BY f) AS k FROM m)
SELECT subject, predicate, v AS value, min(f) AS valid_from, CASE WHEN max(t) = 9223372036854775807 THEN -1 ELSE max(t) END AS valid_to FROM i GROUP BY subject, predicate, v, k""",
    "p2_snapshots": f"""WITH b AS (SELECT subject, predicate, coalesce(valid_from, 0) AS f, valid_to AS t, fact_id AS o,
    coalesce(CAST(object_node AS VARCHAR), nullif(trim(object_text), ''), CAST(object_int AS VARCHAR)) AS v
  FROM fact_rows WHERE predicate IN ('member-of', 'manager-of', 'role') AND subject IS NOT NULL),
i AS (SELECT unnest({SNAPSHOTS}) AS x),
s AS (SELECT subject, predicate, x, arg_max(v, (f, o)) AS v FROM b JOIN i ON f <= x AND (t IS NULL OR x < t) WHERE v IS NOT NULL GROUP BY ALL),
g AS (SELECT k.subject, k.predicate, i.x, s.v, lag(s.v) OVER (PARTITION BY k.subject, k.predicate ORDER BY i.x) AS u
  FROM (SELECT DISTINCT subject, predicate FROM s) k CROSS JOIN i LEFT JOIN s ON s.subject = k.subject AND s.predicate = k.predicate AND s.x = i.x),
c AS (SELECT *, lead(x) OVER (PARTITION BY subject, predicate ORDER BY x) AS y FROM g WHERE v IS DISTINCT FROM u)
SELECT subject, predicate, v AS value, x AS valid_from, coalesce(y, -1) AS valid_to FROM c WHERE v IS NOT NULL""",
    "p4_found": _P4 + "SELECT table_name, arrived_month, row_id, reason FROM f WHERE reason IS NOT NULL",
    "p4_report": _P4 + "SELECT table_name, arrived_month, reason, count(*) AS orphans FROM f WHERE reason IS NOT NULL GROUP BY ALL",
    "p5_found": r"""WITH a AS (SELECT *, regexp_replace(lower(trim(predicate)), '[\s_-]+', '-', 'g') AS p, trim(object_text, E' \t\n\r') AS x FROM fact_rows WHERE subject IS NOT NULL),
b AS (SELECT subject, p, coalesce(valid_from, 0) AS f, fact_id AS o,
  CASE WHEN p IN ('title', 'issue-type', 'status', 'component') THEN coalesce(nullif(x, ''), CAST(object_int AS VARCHAR)) END AS s,
  CASE WHEN p IN ('priority', 'estimate', 'approved-at') THEN coalesce(object_int, CASE WHEN object_float = floor(object_float) THEN CAST(object_float AS BIGINT) END,
    CASE WHEN regexp_full_match(x, '[+-]?[0-9]+(\.0*)?') THEN TRY_CAST(regexp_replace(x, '\..*$', '') AS BIGINT) END, object_node,
    CASE WHEN p = 'approved-at' THEN CAST(epoch(TRY_CAST(replace(x, '/', '-') AS TIMESTAMP)) AS BIGINT) END) END AS n
  FROM a WHERE p IN ('title', 'issue-type', 'status', 'component', 'priority', 'estimate', 'approved-at')),
c AS (SELECT subject, p, arg_max(s, (f, o)) FILTER (WHERE s IS NOT NULL) AS s, arg_max(n, (f, o)) FILTER (WHERE n IS NOT NULL) AS n FROM b GROUP BY subject, p)
SELECT subject, coalesce(max(s) FILTER (WHERE p = 'title'), '') AS title, coalesce(max(s) FILTER (WHERE p = 'issue-type'), '') AS issue_type,
  coalesce(max(s) FILTER (WHERE p = 'status'), '') AS status, coalesce(max(s) FILTER (WHERE p = 'component'), '') AS component,
  coalesce(max(n) FILTER (WHERE p = 'priority'), -1) AS priority, coalesce(max(n) FILTER (WHERE p = 'estimate'), -1) AS estimate,
  coalesce(max(n) FILTER (WHERE p = 'approved-at'), -1) AS approved_at FROM c GROUP BY subject""",
    "p6_found": """WITH b AS (SELECT subject, coalesce(valid_from, 0) AS f, coalesce(valid_to, 9223372036854775807) AS t FROM segment_rows WHERE subject IS NOT NULL),
g AS (SELECT * FROM b WHERE f < t),
m AS (SELECT *, max(t) OVER (PARTITION BY subject ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR f > before THEN 1 ELSE 0 END) OVER (PARTITION BY subject ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS k FROM m),
p AS (SELECT subject, k, min(f) AS f, max(t) AS t FROM i GROUP BY subject, k)
SELECT subject, 'period' AS kind, f AS valid_from, CASE WHEN t = 9223372036854775807 THEN -1 ELSE t END AS valid_to FROM p
UNION ALL SELECT subject, 'gap', before, f FROM (SELECT subject, f, lag(t) OVER (PARTITION BY subject ORDER BY f) AS before FROM p) WHERE before IS NOT NULL""",
}
