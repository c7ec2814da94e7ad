"""A stream of inserts, updates and deletes folded into the current state.

The fold is commutative and idempotent: every rule below is a maximum of (tx, source, seq) or a set union, so
changes may come repeated, late and in any order, in one batch or many.

* HardDelete puts a floor under its subject and predicate; changes up to the floor are gone.
* SetOne / CloseOne compete per (subject, predicate); AddMany / CloseMany per (subject, predicate, object).
* RemoveMany takes out the adds whose ``seq`` it observed. These tombstones stay in the state, so that an add
  that is delivered after its removal does not come back.

Defined cases: rows without subject or predicate, adds and closes of many without an object and unknown kinds are
ignored; a SetOne without an object holds nothing (as a close); NULL source counts as 0 and NULL tx or seq sorts
first; NULL ``observed`` observes nothing; an empty feed gives an empty state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kronoweft.operators.scans import SALTS, salted
from kronoweft.session import cut

FEED = ["tx", "source", "seq", "kind", "subject", "predicate", "object_node", "object_int", "object_text", "observed"]
KINDS = ["SetOne", "CloseOne", "AddMany", "CloseMany", "RemoveMany", "HardDelete"]


def object_text() -> Column:
    """``node:``, ``int:`` or ``text:`` and the value; NULL without an object."""
    return F.coalesce(
        F.concat(F.lit("node:"), F.col("object_node").cast("string")),
        F.concat(F.lit("int:"), F.col("object_int").cast("string")),
        F.concat(F.lit("text:"), F.col("object_text")),
    )


def _changes(feed: DataFrame) -> DataFrame:
    return feed.where(F.col("kind").isin(KINDS) & F.col("subject").isNotNull() & F.col("predicate").isNotNull()).select(
        "subject", "predicate", "kind", "seq", "observed", object_text().alias("object"),
        F.struct("tx", F.coalesce("source", F.lit(0)).alias("source"), "seq").alias("ok"),
    )


def _floors(changes: DataFrame) -> DataFrame:
    return changes.where("kind = 'HardDelete'").groupBy("subject", "predicate").agg(F.max("ok").alias("floor"))


def above_floor(rows: DataFrame, floors: DataFrame, spread: Column, salts: int = SALTS) -> DataFrame:
    """rows whose ``ok`` is above the floor of their subject and predicate.

    Rows are salted by ``spread`` and each floor (one row per key) is copied to every salt, so a key that holds a
    large share of the rows is joined by ``salts`` tasks.
    """
    return salted(rows, floors, ["subject", "predicate"], spread, salts=salts).where("floor IS NULL OR ok > floor").drop("floor")


def _live_adds(changes: DataFrame, tombs: DataFrame) -> DataFrame:
    """One row per add that no removal observed. Redelivered copies collapse on the map side."""
    adds = changes.where("kind = 'AddMany' AND object IS NOT NULL")
    both = adds.select("subject", "predicate", "seq", F.struct("ok", "object").alias("add"), F.lit(False).alias("gone")).unionByName(
        tombs.select("subject", "predicate", "seq", F.lit(None).cast("struct<ok:struct<tx:bigint,source:int,seq:bigint>,object:string>").alias("add"), F.lit(True).alias("gone"))
    )
    alive = both.groupBy("subject", "predicate", "seq").agg(F.max("add").alias("add"), F.max("gone").alias("gone"))
    return alive.where("add IS NOT NULL AND NOT gone").select("subject", "predicate", "add.ok", "add.object")


def _tombs(changes: DataFrame, floors: DataFrame) -> DataFrame:
    removes = changes.where("kind = 'RemoveMany'").select("subject", "predicate", "ok", "observed")
    return above_floor(removes, floors, F.col("ok.seq")).select("subject", "predicate", F.explode("observed").alias("seq"))


def current_values(feed: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """subject, predicate, object, seq: one row per value held after all changes of feed (and base).

    ``base`` is an earlier state as ``compact`` gives it; its rows are changes like any other.
    """
    if base is not None:
        feed = feed.select(*FEED).unionByName(base.select(*FEED))
    changes = _changes(feed)
    floors = _floors(changes)
    one = changes.where("kind IN ('SetOne', 'CloseOne')").select(
        "subject", "predicate", F.lit(None).cast("string").alias("element"), "ok", F.when(F.col("kind") == "SetOne", F.col("object")).alias("object")
    )
    closes = changes.where("kind = 'CloseMany' AND object IS NOT NULL").select("subject", "predicate", F.col("object").alias("element"), "ok", F.lit(None).cast("string").alias("object"))
    adds = _live_adds(changes, _tombs(changes, floors)).select("subject", "predicate", F.col("object").alias("element"), "ok", "object")
    heads = one.unionByName(closes).unionByName(adds).groupBy("subject", "predicate", "element").agg(F.max(F.struct("ok", "object")).alias("head"))
    heads = heads.select("subject", "predicate", "element", "head.ok", "head.object")
    return above_floor(heads, floors, F.coalesce("element", F.lit(""))).where("object IS NOT NULL").select("subject", "predicate", "object", F.col("ok.seq").alias("seq"))


def compact(feed: DataFrame) -> DataFrame:
    """The changes that can still matter, in the feed's own columns (FEED).

    Dropped: copies, everything up to a floor, beaten SetOne / CloseOne and CloseMany, adds below a close of their
    element and removed adds. Kept: all other adds (a later removal may uncover them), all removals above the floor
    and the floors. For any feeds A, B: current_values(B, base=compact(A)) = current_values(A union B).
    The state is written to the shared folder, so that plans do not grow from batch to batch.
    """
    raw = feed.select(*FEED).where(F.col("kind").isin(KINDS) & F.col("subject").isNotNull() & F.col("predicate").isNotNull())
    raw = raw.withColumn("ok", F.struct("tx", F.coalesce("source", F.lit(0)).alias("source"), "seq")).withColumn("object", object_text())
    floors = _floors(raw)
    kept = above_floor(raw.where("kind <> 'HardDelete'").withColumn("row", F.struct(*FEED)), floors, F.col("seq"))
    one = kept.where("kind IN ('SetOne', 'CloseOne')").groupBy("subject", "predicate").agg(F.max_by("row", "ok").alias("row"))
    close = kept.where("kind = 'CloseMany' AND object IS NOT NULL").groupBy("subject", "predicate", "object").agg(F.max("ok").alias("closed"), F.max_by("row", "ok").alias("row"))
    removes = kept.where("kind = 'RemoveMany'").groupBy("seq", "ok").agg(F.first("row").alias("row"))
    adds = kept.where("kind = 'AddMany' AND object IS NOT NULL").groupBy("subject", "predicate", "object", "seq", "ok").agg(F.first("row").alias("row"))
    gone = removes.select(F.col("row.subject").alias("subject"), F.col("row.predicate").alias("predicate"), F.explode("row.observed").alias("seq")).distinct()
    adds = adds.join(gone, ["subject", "predicate", "seq"], "left_anti").join(close.drop("row"), ["subject", "predicate", "object"], "left").where("closed IS NULL OR ok > closed")
    floor_rows = raw.where("kind = 'HardDelete'").withColumn("row", F.struct(*FEED)).groupBy("subject", "predicate").agg(F.max_by("row", "ok").alias("row"))
    parts = [one, close, removes, adds, floor_rows]
    out = parts[0].select("row.*")
    for p in parts[1:]:
        out = out.unionByName(p.select("row.*"))
    return cut(out, "compact")
