"""A change log folded into state: current values, history, sets, edge properties and node attributes.

Every fold is a maximum by order key per register, so copies and order of delivery do not matter. ``ok`` may be a
long or a struct; removals name adds by ``seq``, the last part of the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kronoweft.operators.changefeed import above_floor

KEY = ["subject", "predicate"]
ONE, MANY = ["SetOne", "CloseOne"], ["AddMany", "CloseMany"]


def floors(log: DataFrame) -> DataFrame:
    """subject, predicate, floor: the greatest hard delete of each key."""
    return log.where("op = 'HardDelete'").groupBy(*KEY).agg(F.max("ok").alias("floor"))


def live(log: DataFrame, ops: list[str], plain: bool = False) -> DataFrame:
    """Rows of the given operations above the floors.

    ``plain`` says that the log's source cannot hold hard deletes or removals, which saves the joins with them.
    """
    rows = log.where(F.col("op").isin(ops))
    return rows if plain else above_floor(rows, floors(log), F.col("ok"))


def one_history(log: DataFrame, plain: bool = False) -> DataFrame:
    """Version rows of one-valued predicates; object NULL is a close, which is always open-ended."""
    close = F.col("op") == "CloseOne"
    return live(log, ONE, plain).select(
        *KEY, "ok", F.when(~close, F.col("object")).alias("object"), F.coalesce("valid_from", F.lit(0)).alias("valid_from"),
        F.when(~close, F.col("valid_to")).alias("valid_to"), "source",
    )


def heads(history: DataFrame, by: list[str] = KEY) -> DataFrame:
    """The row with the greatest order key of each register, with its columns."""
    rest = [c for c in history.columns if c not in by]
    return history.groupBy(*by).agg(F.max_by(F.struct(*rest), "ok").alias("h")).select(*by, "h.*")


def one(log: DataFrame, plain: bool = False) -> DataFrame:
    """Current head per key: the last change by order key, whatever its valid time; object NULL if that is a close."""
    return heads(one_history(log, plain))


def tombstones(log: DataFrame) -> DataFrame:
    """subject, predicate, seq of the adds that removals above the floor observed."""
    return live(log, ["RemoveMany"]).select(*KEY, F.explode("observed").alias("seq")).distinct()


def many_history(log: DataFrame, seq: Column | None = None, plain: bool = False) -> DataFrame:
    """Version rows of many-valued predicates per element: adds (without removed ones) and closes."""
    seq = F.col("ok") if seq is None else seq
    rows = live(log, MANY, plain).where("object IS NOT NULL").withColumn("seq", seq).withColumn("is_add", F.col("op") == "AddMany")
    if not plain:
        gone = tombstones(log).withColumn("gone", F.lit(True))
        rows = rows.join(gone, [*KEY, "seq"], "left").where("NOT is_add OR gone IS NULL")
    return rows.select(*KEY, "ok", "object", "is_add", F.coalesce("valid_from", F.lit(0)).alias("valid_from"), F.when(F.col("is_add"), F.col("valid_to")).alias("valid_to"), "source")


def many(log: DataFrame, seq: Column | None = None, plain: bool = False) -> DataFrame:
    """Elements present: the greatest live row of the element is an add."""
    return heads(many_history(log, seq, plain), [*KEY, "object"]).where("is_add")


def edge_props(log: DataFrame) -> DataFrame:
    """subject, predicate, object, key, value: the last value of each property of each edge."""
    rows = log.where("op = 'SetEdgeProp'").groupBy(*KEY, "object", "key").agg(F.max_by("value", "ok").alias("value"))
    return rows.where("value IS NOT NULL")


def node_attrs(log: DataFrame) -> DataFrame:
    """node, type, label: two independent registers, each by its own last change."""
    t, n = F.col("op") == "SetNodeType", F.col("op") == "SetNodeLabel"
    rows = log.where(t | n).groupBy(F.col("subject").alias("node"))
    return rows.agg(F.max_by("type", F.when(t, F.col("ok"))).alias("type"), F.max_by("label", F.when(n, F.col("ok"))).alias("label"))


def merge(*logs: DataFrame) -> DataFrame:
    """The least upper bound of several logs: folding the union equals merging the folds in any order."""
    out = logs[0]
    for x in logs[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def touched(tail: DataFrame) -> DataFrame:
    return tail.where("predicate IS NOT NULL").select(*KEY).distinct()


def observe_incremental(before: DataFrame, base: DataFrame, tail: DataFrame, plain: bool = False) -> DataFrame:
    """``one`` after the tail: keys it touches are folded anew from base and tail, all others kept from ``before``."""
    keys = touched(tail)
    fresh = one(merge(base, tail).join(keys, KEY, "left_semi"), plain)
    return before.join(keys, KEY, "left_anti").unionByName(fresh)


def suppress_one(batch: DataFrame, head: DataFrame) -> DataFrame:
    """Rows of a batch that change something. batch: line, subject, predicate, object, valid_from, valid_to, source.

    A row equal to the current head is dropped as long as no earlier row of the batch wrote to its key; from the
    first row that does, all rows of the key are kept. A key with very many rows of the batch is left to AQE, which
    splits the batch's side of a left join; salting would copy every head of the table instead.
    """
    h = head.select(*KEY, F.struct("object", "valid_from", "valid_to", "source").alias("__head"))
    same = F.coalesce(F.struct("object", "valid_from", "valid_to", "source").eqNullSafe(F.col("__head")), F.lit(False))
    return _leading(batch.join(h, KEY, "left").withColumn("__dup", same)).drop("__head")


def suppress_many(batch: DataFrame, live_adds: DataFrame) -> DataFrame:
    """As suppress_one for sets: a row is a copy if a live add has the same element, interval and source."""
    on = [*KEY, "object", "valid_from", "valid_to", "source"]
    seen = live_adds.select(*on).distinct()
    match = [batch[c].eqNullSafe(seen[c]) for c in on]
    hit = batch.join(seen, match, "left_semi").select("line").withColumn("__hit", F.lit(True))
    return _leading(batch.join(hit, "line", "left").withColumn("__dup", F.coalesce("__hit", F.lit(False)))).drop("__hit")


def _leading(rows: DataFrame) -> DataFrame:
    """Drop the copies before a key's first row that is none: the first such line per key, then a comparison."""
    first = rows.where("NOT __dup").groupBy(*KEY).agg(F.min("line").alias("__first"))
    return rows.join(first, KEY, "left").where("NOT __dup OR line > __first").drop("__dup", "__first")


def suppress_rows(batch: DataFrame, state: DataFrame, on: list[str]) -> DataFrame:
    """Closes, edge properties and node records: rows whose boundary, value or attributes are not yet in the state."""
    return batch.join(state.select(*on).distinct(), [batch[c].eqNullSafe(state[c]) for c in on], "left_anti")


def collect_garbage(log: DataFrame, seq: Column | None = None) -> DataFrame:
    """The log without rows that no read can see: rows up to a floor and removed adds. Floors and removals stay."""
    seq = F.col("ok") if seq is None else seq
    kept = live(log, [*ONE, *MANY, "RemoveMany"]).withColumn("seq", seq)
    gone = tombstones(log).withColumn("gone", F.lit(True))
    kept = kept.join(gone, [*KEY, "seq"], "left").where("gone IS NULL OR op <> 'AddMany'").drop("gone", "seq")
    w = Window.partitionBy(*KEY).orderBy(F.col("ok").desc())
    top = log.where("op = 'HardDelete'").withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    other = log.where(F.col("op").isin("SetEdgeProp", "SetNodeType", "SetNodeLabel"))
    return kept.select(*log.columns).unionByName(top.select(*log.columns)).unionByName(other)
