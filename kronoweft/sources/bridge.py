"""Projections of the Parquet tables into change logs, node attributes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kronoweft.model import first_object, int_, node_, text_
from kronoweft.operators.widen import plain_name
from kronoweft.sources.tables import table

LOG = ["ok", "op", "subject", "predicate", "object", "valid_from", "valid_to", "source"]


def facts(spark: SparkSession, d: str) -> DataFrame:
    """fact_rows as SetOne and AddMany changes in the order of arrival; facts without an object say nothing."""
    defs = table(spark, d, "pred_defs").select(F.col("name").alias("predicate"), "card")
    rows = table(spark, d, "fact_rows").withColumn("predicate", plain_name(F.col("predicate")))
    rows = rows.join(defs, "predicate").withColumn("object", first_object(*[F.col(f"object_{x}") for x in ("node", "int", "float", "text", "bool")]))
    op = F.when(F.col("card") == "one", "SetOne").otherwise("AddMany")
    none = F.lit(None).cast("array<bigint>")
    return rows.where("object IS NOT NULL AND subject IS NOT NULL").select(
        F.col("fact_id").alias("ok"), op.alias("op"), "subject", "predicate", "object", F.coalesce("valid_from", F.lit(0)).alias("valid_from"), "valid_to",
        plain_name(F.col("source")).alias("source"), none.alias("observed"), "props", "arrived_at",
    )


def feed(spark: SparkSession, d: str) -> DataFrame:
    """record_feed as a change log with the order key (tx, source, seq)."""
    kind, rows = F.col("kind"), table(spark, d, "record_feed")
    obj = F.when(F.col("object_node").isNotNull(), node_(F.col("object_node"))).when(F.col("object_int").isNotNull(), int_(F.col("object_int"))).when(F.col("object_text").isNotNull(), text_(F.col("object_text")))
    return rows.select(
        F.struct("tx", "source", "seq").alias("ok"), kind.alias("op"), "subject", "predicate", obj.alias("object"), F.coalesce("valid_from", F.lit(0)).alias("valid_from"), "valid_to",
        F.when(F.col("source") != 0, F.col("source").cast("string")).alias("source"), "observed", "seq",
        F.when(kind == "SetNodeType", F.col("object_text")).alias("type"), F.when(kind == "SetNodeLabel", F.col("object_int")).alias("label"),
    )


def attrs(spark: SparkSession, d: str) -> DataFrame:
    """node, type, label: the last stated type and the last stated label of each declared node."""
    rows = table(spark, d, "node_rows").where("op = 'declare' AND id IS NOT NULL")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("node_seq"))).alias(c)
    return rows.groupBy(F.col("id").alias("node")).agg(last("type"), last("label"))


def edge_props(spark: SparkSession, d: str) -> DataFrame:
    """The properties of facts as SetEdgeProp changes: one row per key of the JSON object, with the value's text."""
    rows = facts(spark, d).where("props IS NOT NULL")
    pairs = F.explode(F.from_json("props", "map<string,map<string,string>>"))
    return rows.select("ok", F.lit("SetEdgeProp").alias("op"), "subject", "predicate", "object", pairs.alias("key", "v")).withColumn("value", F.map_values("v")[0]).drop("v")


def customer_tree(spark: SparkSession, d: str) -> DataFrame:
    """s, o: each customer's parent, the customer of a third of its key, and a few back edges that make cycles."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("s"))
    tree = c.where("s >= 3").select("s", F.floor(F.col("s") / 3).cast("long").alias("o"))
    back = c.where("s <= 5").select("s", (F.col("s") * 9).alias("o"))
    return tree.unionByName(back).distinct()
