"""References to records that do not exist: missing, late or deleted at the time of the reference.

Skew-aware split: references are counted per key and period on the map side. Keys with many references are looked
up in a broadcast of their own few summary rows, whose number is checked first; all others go through a shuffled
join. Both parts are united, so every orphan is found once. A second, two-level scan over time (scans.last_before)
decides the references to records that were dropped at some time, without gathering a key's rows in one task.

Defined cases: NULL references are no cases; NULL instants of references cannot be late or deleted, only missing,
and have a NULL period; node rows without id are ignored and node rows without instant count as declarations only; of
node rows at one instant the one with the greatest sequence is last; repeated rows change nothing; with empty
node rows every reference is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kronoweft.operators.scans import celled, last_before
from kronoweft.session import cut

#: References to one key from which it counts as heavy.
HEAVY = 50_000
#: Heavy keys that are broadcast at most (16 to 40 bytes each); beyond it, the join is left to the planner.
MOST_BROADCAST = 100_000


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def references(df: DataFrame, name: str, row_id: str, node: str, at: str = "arrived_at") -> DataFrame:
    """table_name, row_id, node, at (microseconds), period (yyyy-MM) of the rows of df that refer to something."""
    return df.where(F.col(node).isNotNull()).select(
        F.lit(name).alias("table_name"), F.col(row_id).cast("long").alias("row_id"), F.col(node).cast("long").alias("node"),
        micros(F.col(at)).alias("at"), F.date_format(at, "yyyy-MM").alias("period"),
    )


def heavy_keys(refs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Keys with at least ``heavy`` references, from counts per key and period."""
    counts = refs.groupBy("node", "period").agg(F.count("*").alias("n"))
    return counts.groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") >= heavy).select("node")


def orphans(refs: DataFrame, nodes: DataFrame, heavy: int = HEAVY, most: int | None = None, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """table_name, period, row_id, reason of each reference to a record that was not there.

    nodes: id, op (declare, drop), arrived_at, node_seq. most: references to a dropped record above which they are cut
    into cells of time.
    """
    events = nodes.where(F.col("id").isNotNull()).select(F.col("id").cast("long").alias("node"), "op", micros(F.col("arrived_at")).alias("at"), F.col("node_seq").alias("seq"))
    known = events.groupBy("node").agg(
        F.min("at").alias("first"), F.sum(F.when(F.col("op") == "declare", 1).otherwise(0)).alias("declares"), F.sum(F.when(F.col("op") == "drop", 1).otherwise(0)).alias("drops")
    )
    big = cut(heavy_keys(refs, heavy), "heavy")
    few = big.count() <= most_broadcast
    small = F.broadcast if few else (lambda d: d)
    info = big.join(known, "node", "left")
    looked = refs.join(small(info), "node").unionByName(refs.join(small(big), "node", "left_anti").join(known, "node", "left"))
    verdict = F.when(F.coalesce("declares", F.lit(0)) == 0, "missing").when(F.col("at") < F.col("first"), "late")
    looked = looked.select("table_name", "period", "row_id", "node", "at", verdict.alias("reason"), "drops")
    open_ = cut(looked.where("reason IS NOT NULL OR (drops > 0 AND at IS NOT NULL)"), "orphans")
    sure = open_.where("reason IS NOT NULL").select("table_name", "period", "row_id", "reason")

    dropped = events.where("at IS NOT NULL").join(known.where("drops > 0 AND declares > 0").select("node"), "node", "left_semi")
    none = lambda t: F.lit(None).cast(t)
    # at one instant the events come first: a reference sees what arrived up to and including its own arrival
    line = dropped.select("node", "at", F.lit(0).alias("side"), "seq", "op", none("string").alias("table_name"), none("string").alias("period"), none("long").alias("row_id")).unionByName(
        open_.where("reason IS NULL").select("node", "at", F.lit(1).alias("side"), none("long").alias("seq"), none("string").alias("op"), "table_name", "period", "row_id")
    )
    line = celled(cut(line, "timeline"), ["node"], "at", most)
    seen = last_before(line, ["node"], "cell", [F.col("at"), F.col("side"), F.col("seq")], "op", F.struct("at", "seq"), "state")
    deleted = seen.where("side = 1 AND state = 'drop'").select("table_name", "period", "row_id", F.lit("deleted").alias("reason"))
    return sure.unionByName(deleted)


def orphan_report(found: DataFrame) -> DataFrame:
    """Counts per table, period and reason."""
    return found.groupBy("table_name", "period", "reason").agg(F.count("*").alias("orphans"))
