"""Provenance of current values, and the tiers of confidence that follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kronoweft.operators.fold import KEY

TIERS = ["low", "medium", "high"]


def tier(corroboration: Column, stale: Column) -> Column:
    """low if no source states the value or it is stale, high from two sources, else medium."""
    return F.when((corroboration == 0) | stale, "low").when(corroboration >= 2, "high").otherwise("medium")


def signals(history: DataFrame, now: int | None = None, max_age: int | None = None) -> DataFrame:
    """subject, predicate, object, valid_from, source, corroboration, age, stale, tier of every current head.

    Corroboration: distinct sources over all live version rows that state the head's object. Stale: older than
    max_age at now, where both are given.
    """
    # first per value: a key's rows are never brought together, only its values
    each = history.groupBy(*KEY, "object").agg(F.size(F.collect_set("source")).cast("long").alias("corroboration"), F.max_by(F.struct("valid_from", "source"), "ok").alias("h"), F.max("ok").alias("ok"))
    out = each.groupBy(*KEY).agg(F.max_by(F.struct("object", "h.valid_from", "h.source", "corroboration"), "ok").alias("x")).select(*KEY, "x.*")
    age = F.lit(now).cast("long") - F.col("valid_from")
    stale = (age > max_age) if now is not None and max_age is not None else F.lit(False)
    return out.withColumn("age", age).withColumn("stale", stale).withColumn("tier", tier(F.col("corroboration"), F.col("stale")))


def weakest(support: DataFrame, known: DataFrame) -> DataFrame:
    """subject, tier and the weakest key behind each derived value; of equal tiers the first by (node, predicate).

    support: subject, node, predicate (the keys that were read); known: as ``signals`` gives it. A key without a head
    is low.
    """
    s = support.join(known.select(F.col("subject").alias("node"), "predicate", "tier"), ["node", "predicate"], "left")
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier")), F.lit(1))
    w = s.groupBy("subject").agg(F.min(F.struct(rank.alias("rank"), "node", "predicate")).alias("w"))
    return w.select("subject", F.element_at(F.array(*map(F.lit, TIERS)), F.col("w.rank").cast("int")).alias("tier"), F.col("w.node").alias("weakest_node"), F.col("w.predicate").alias("weakest_predicate"))
