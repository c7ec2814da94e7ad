"""The queries of the problems tagged llm (3, 7, 8, 9, 10) and the SQL that checks them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kronoweft.llm import abuse, leakage, neighbours, survivor, tokenizer
from kronoweft.sources.tables import table

MASTER = ["name", "email", "phone", "office", "job-title"]
DIM = 32


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return survivor.candidates(table(spark, d, "fact_rows"), table(spark, d, "source_defs"), MASTER)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.best_representative(_candidates(spark, d))


def p3_currency(spark: SparkSession, d: str) -> DataFrame:
    rows = _candidates(spark, d)
    return survivor.best_representative(rows, survivor.learn_currency(rows), missing="learned")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbour_pairs(neighbours.nearest(neighbours.usable_vectors(table(spark, d, "vector_rows"), DIM), DIM, k=5))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_column(table(spark, d, "documents"), tokenizer.MergeAutomaton.from_file(tokenizer.vocabulary_path()))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def _grammar(spark: SparkSession, d: str) -> abuse.Grammar:
    return abuse.fit(table(spark, d, "documents"), table(spark, d, "rater_labels"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scored(table(spark, d, "documents"), _grammar(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_scores(spark, d).where(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(abuse.scored(table(spark, d, "documents"), _grammar(spark, d), keep=("source",)))


def p10_heldout(spark: SparkSession, d: str) -> DataFrame:
    """How a grammar fitted to the ratings of half of the rated documents agrees with the raters of the other half."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "rater_labels")
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))
    other = labels.where(half == 1)
    grammar = abuse.fit(docs, labels.where(half == 0))
    return abuse.agreement(abuse.scored(docs.join(other.select("doc_id").distinct(), "doc_id", "left_semi"), grammar), other)


QUERIES = {
    "p3_found": p3_found, "p3_currency": p3_currency, "p7_found": p7_found, "p8_ids": p8_ids, "p9_found": p9_found,
    "p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates, "p10_heldout": p10_heldout,
}

SQL = {
    "p3_found": r"""WITH s AS (SELECT regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS s, max(trust) AS trust FROM source_defs GROUP BY 1),
f AS (SELECT subject, predicate, fact_id, coalesce(valid_from, 0) AS f, trim(object_text, E' \t\n\r') AS v, regexp_replace(lower(source), '[^a-z0-9]+', '', 'g') AS s
  FROM fact_rows WHERE predicate IN ('name', 'email', 'phone', 'office', 'job-title') AND subject IS NOT NULL),
g AS (SELECT f.*, coalesce(s.trust, 0) AS trust,
  v IS NOT NULL AND NOT regexp_matches(v, '(\.\.+|…)$') AND regexp_replace(lower(v), '[^\p{L}\p{N}]+', '', 'g') NOT IN ('', 'null', 'none', 'na', 'tbd', 'unknown', 'ka', 'notset', 'xxx', 'x', 'xx', 'nil', 'no') AS good
  FROM f LEFT JOIN s USING (s))
SELECT subject, predicate, arg_max(fact_id, (trust, f, fact_id)) FILTER (WHERE good) AS fact_id FROM g GROUP BY subject, predicate HAVING count(*) >= 2 AND bool_or(good)""",
    "p7_found": """WITH u AS (SELECT node, arg_max(vector, vector_id) AS x FROM vector_rows
  WHERE node IS NOT NULL AND len(vector) = 32 AND len(list_filter(vector, lambda e: e IS NULL OR isnan(e))) = 0 AND len(list_filter(vector, lambda e: e <> 0)) > 0 GROUP BY node),
p AS (SELECT a.node AS a, b.node AS b, row_number() OVER (PARTITION BY a.node ORDER BY list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))), b.node) AS r
  FROM u a JOIN u b ON a.node <> b.node)
SELECT DISTINCT least(a, b) AS node_a, greatest(a, b) AS node_b FROM p WHERE r <= 5""",
}
