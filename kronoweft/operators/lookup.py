"""Free-word search over text values, display names, node descriptions and dated context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kronoweft.functions import calendar
from kronoweft.model import object_text, visible
from kronoweft.operators import confidence

CONTEXT = 80
NAMES = ["name", "title", "display_name", "full_name"]


def excerpt(text: Column, needle: str, context: int = CONTEXT) -> Column:
    """The text around the first hit, with … where something is left out; short texts are given whole."""
    n = F.char_length(text)
    at = F.greatest(F.instr(F.lower(text), needle) - 1, F.lit(0))
    start = F.greatest(at - context, F.lit(0))
    end = F.least(at + len(needle) + context, n)
    body = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < n, "…").otherwise(""))
    return F.when(n <= 2 * context, text).otherwise(body)


def find(one: DataFrame, many: DataFrame, needle: str, attrs: DataFrame | None = None, mask: int | None = None) -> DataFrame:
    """node, predicate, value: the first text value of each visible node that contains needle, whatever the case.

    One-valued predicates come before many-valued ones, then names in order, then values.
    """
    needle = needle.strip().lower()
    if not needle:
        raise ValueError("text required")
    rows = one.select("subject", "predicate", "object", F.lit(0).alias("pass")).unionByName(many.select("subject", "predicate", "object", F.lit(1).alias("pass")))
    hits = rows.where(F.contains(F.lower("object.t"), F.lit(needle)))
    best = hits.groupBy(F.col("subject").alias("node")).agg(F.min(F.struct("pass", "predicate", F.col("object.t").alias("t"))).alias("b"))
    out = best.select("node", "b.predicate", excerpt(F.col("b.t"), needle).alias("value"))
    if attrs is not None and mask is not None:
        out = out.join(attrs.where(~visible(F.col("label"), mask)).select("node"), "node", "left_anti")
    return out


def first_found(found: DataFrame, limit: int) -> DataFrame:
    """found with ``truncated``: the first ``limit`` nodes, and whether there are more."""
    few = found.orderBy("node").limit(limit + 1)
    w = Window.orderBy("node")  # sees limit + 1 rows
    few = few.withColumn("__r", F.row_number().over(w)).withColumn("truncated", F.max("__r").over(Window.partitionBy(F.lit(1))) > limit)
    return few.where(F.col("__r") <= limit).drop("__r")


def display_name(one: DataFrame, display: list[str] = ()) -> DataFrame:
    """node, name: the text of a declared display predicate, else of the first usual name predicate."""
    order = [*sorted(display), *[n for n in NAMES if n not in display]]
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("predicate"))
    rows = one.where(F.col("predicate").isin(order) & F.col("object.t").isNotNull())
    return rows.groupBy(F.col("subject").alias("node")).agg(F.min_by("object.t", rank).alias("name"))


def describe(history: DataFrame, many: DataFrame, attrs: DataFrame, embeddings: DataFrame | None = None, now: int | None = None, max_age: int | None = None) -> DataFrame:
    """node, predicate, value, source, tier, type, label, embedded: every current value of each node, with what is known of the node.

    Nodes without a value have one row with a NULL predicate.
    """
    a = confidence.signals(history, now, max_age).where("object IS NOT NULL").select(F.col("subject").alias("node"), "predicate", object_text("object").alias("value"), "source", "tier")
    none = F.lit(None).cast("string")
    values = a.unionByName(many.select(F.col("subject").alias("node"), "predicate", object_text("object").alias("value"), none.alias("source"), none.alias("tier")))
    out = values.join(attrs.select("node", "type", "label"), "node", "full")
    if embeddings is None:
        return out.withColumn("embedded", F.lit(False))
    has = embeddings.select(F.col("id").alias("node"), F.lit(True).alias("__has"))
    return out.join(has, "node", "left").withColumn("embedded", F.coalesce("__has", F.lit(False))).drop("__has")


def context(hits: DataFrame, as_of: Column | int | None = None, **frame: int) -> DataFrame:
    """hits (node, score, date, content) with ``stamp`` and ``line``; as_of defaults to the latest date among the hits."""
    if as_of is None:
        hits = hits.join(F.broadcast(hits.agg(F.coalesce(F.max("date"), F.lit(0)).alias("as_of"))))
    else:
        hits = hits.withColumn("as_of", F.lit(as_of) if isinstance(as_of, int) else as_of)
    stamp = F.when(F.col("date").isNotNull(), calendar.tag(F.col("date"), F.col("as_of"), **frame))
    text = F.coalesce("content", F.lit(""))
    return hits.withColumn("stamp", stamp).withColumn("line", F.when(stamp.isNotNull(), F.concat(F.lit("- ["), stamp, F.lit("] "), text)).otherwise(F.concat(F.lit("- "), text)))


def in_order(hits: DataFrame) -> list[Column]:
    """The order of a context block: oldest first, undated last, then by score and node."""
    return [F.col("date").asc_nulls_last(), F.col("score").desc(), F.col("node")]


def context_block(lines: list[str]) -> str:
    return "\n".join(["(excerpts oldest→newest)", *lines])
