"""Reads in valid time: as-of values, timelines, timelines through chains of hops, and as-of joins.

In effect at T is, of the version rows that cover T (valid_from <= T < valid_to), the one with the greatest
(valid_from, ok); if that is a close, nothing is. "Current" is another question: fold.one answers it by order key alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kronoweft.model import object_text
from kronoweft.operators import history as h
from kronoweft.operators.fold import KEY
from kronoweft.operators.scans import celled, last_before
from kronoweft.session import cut

OPEN = h.OPEN
CLOSED = "\x00"


def covers(at: Column) -> Column:
    return (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (at < F.col("valid_to")))


def asof_one(history: DataFrame, at: int) -> DataFrame:
    """subject, predicate, object, valid_from, source in effect at an instant; keys without a value are left out."""
    w = history.where(covers(F.lit(at))).groupBy(*KEY).agg(F.max_by(F.struct("object", "valid_from", "source"), F.struct("valid_from", "ok")).alias("w"))
    return w.select(*KEY, "w.*").where("object IS NOT NULL")


def asof_many(history: DataFrame, at: int) -> DataFrame:
    """subject, predicate, object of the elements in effect at an instant."""
    w = history.where(covers(F.lit(at))).groupBy(*KEY, "object").agg(F.max_by("is_add", F.struct("valid_from", "ok")).alias("is_add"))
    return w.where("is_add").drop("is_add")


def timeline(history: DataFrame, most: int | None = None) -> DataFrame:
    """subject, predicate, value (kind:value), valid_from, valid_to (NULL = open) of every value in turn.

    Equal values that adjoin are one segment. A close is a version of its own that is left out at the end, so it
    ends what was before it. Needs a long ``ok``.
    """
    facts = history.select(*KEY, "valid_from", "valid_to", "ok", F.coalesce(object_text("object"), F.lit(CLOSED)).alias("v"))
    out = h.type2_history(facts, F.col("v"), order="ok", most=most).where(F.col("value") != CLOSED)
    return out.withColumn("valid_to", F.when(F.col("valid_to") != -1, F.col("valid_to")))


def hop(segments: DataFrame, predicate: str, timelines: DataFrame, most: int | None = None) -> DataFrame:
    """One step of a derived timeline: segments' node values looked up in the timeline of a predicate.

    segments and timelines as ``timeline`` gives them; intervals are intersected, and equal values joined again.
    """
    left = segments.select("subject", F.substring_index("value", ":", -1).cast("long").alias("node"), F.col("valid_from").alias("f1"), F.coalesce("valid_to", F.lit(OPEN)).alias("t1")).where(F.col("value").startswith("node:"))
    right = timelines.where(F.col("predicate") == predicate).select(F.col("subject").alias("node"), "value", F.col("valid_from").alias("f2"), F.coalesce("valid_to", F.lit(OPEN)).alias("t2"))
    met = left.join(right, "node").where("f1 < t2 AND f2 < t1")
    rows = met.select("subject", F.lit(predicate).alias("predicate"), F.greatest("f1", "f2").alias("f"), F.least("t1", "t2").alias("t"), F.lit(0).cast("long").alias("o"), F.col("value").alias("v"))
    out = h.settle(cut(rows, "hop"), most)
    return out.select(*KEY, F.col("v").alias("value"), F.col("f").alias("valid_from"), F.when(F.col("t") != OPEN, F.col("t")).alias("valid_to"))


def derived_timeline(timelines: DataFrame, hops: list[str], most: int | None = None) -> DataFrame:
    """The timeline of the value at the end of a chain of hops, for every subject of the first hop's predicate."""
    out = timelines.where(F.col("predicate") == hops[0])
    for p in hops[1:]:
        out = hop(out, p, timelines, most)
    return out.select("subject", "value", "valid_from", "valid_to")


def asof_join(probes: DataFrame, timelines: DataFrame, most: int | None = None) -> DataFrame:
    """probes (subject, predicate, at and any other columns) with ``value`` in effect at each probe's instant, or NULL.

    A merge in time, cell by cell: neither a key's probes nor its segments are paired with each other.
    """
    extra = [c for c in probes.columns if c not in (*KEY, "at")]
    line = timelines.select(*KEY, F.col("valid_from").alias("at"), F.lit(0).alias("side"), F.struct("value", F.coalesce("valid_to", F.lit(OPEN)).alias("t")).alias("seg"))
    ask = probes.where("at IS NOT NULL").select(*KEY, "at", F.lit(1).alias("side"), F.struct(*extra).alias("row") if extra else F.lit(1).alias("row"))
    both = celled(cut(line.unionByName(ask, allowMissingColumns=True), "asof"), KEY, "at", most)
    seen = last_before(both, KEY, "cell", [F.col("at"), F.col("side")], "seg", F.col("at"), "was").where("side = 1")
    value = F.when(F.col("at") < F.col("was.t"), F.col("was.value"))
    out = seen.select(*KEY, "at", *([f"row.{c}" for c in extra]), value.alias("value"))
    return out.unionByName(probes.where("at IS NULL").withColumn("value", F.lit(None).cast("string")).select(*out.columns))


#: Pairs of a probe and a version row, per row of both, up to which they are joined directly.
PAIRS = 8


def asof_lookup(probes: DataFrame, history: DataFrame, row: str, most: int | None = None) -> DataFrame:
    """row, value in effect at each probe's instant. probes: subject, predicate, at and a unique ``row``; history: fold.one_history.

    Where keys have few versions or few probes, probes are joined with the versions that cover them; how many pairs
    that makes is counted first, and beyond PAIRS per row of both sides they are merged in time (asof_join).
    """
    probes = cut(probes.select(*KEY, "at", row).where("at IS NOT NULL"), "probes")
    history = cut(history, "asked")
    each = probes.select(*KEY, F.lit(1).alias("p"), F.lit(0).alias("h")).unionByName(history.select(*KEY, F.lit(0).alias("p"), F.lit(1).alias("h"))).groupBy(*KEY).agg(F.sum("p").alias("p"), F.sum("h").alias("h"))
    n = each.agg(F.sum(F.col("p") * F.col("h")).alias("pairs"), F.sum(F.col("p") + F.col("h")).alias("rows")).first()
    if (n["pairs"] or 0) > PAIRS * (n["rows"] or 0):
        return asof_join(probes, timeline(history, most), most).select(row, "value")
    met = probes.join(history, KEY).where(covers(F.col("at")))
    best = met.groupBy(row).agg(F.max_by(object_text("object"), F.struct("valid_from", "ok")).alias("value"))
    return probes.select(row).join(best, row, "left")


def ever_held(history: DataFrame) -> DataFrame:
    """subject, predicate, object of everything ever stated."""
    return history.where("object IS NOT NULL").select(*KEY, "object").distinct()
