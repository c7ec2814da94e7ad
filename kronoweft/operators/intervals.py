"""Overlapping and gapped intervals per entity: continuous periods and the gaps between them.

A mergeable aggregate whose state is a sorted list of disjoint intervals (``Disjoint``, for a block of entities at
once). Lists are combined by linear merge in a reduction tree:

1. Leaves: every task folds its rows into lists before anything is shuffled.
2. Cells: the lists of an entity meet in one task and are merged. Those of an entity with very many intervals are first
   cut at instants of their own (scans.key_bounds), and each cell merges its piece.
3. Top: of each cell only (start of the first interval, greatest end) goes on; merged in order they say which intervals
   at the start of a cell were absorbed by earlier cells, and how far the last interval of a cell reaches.

Lists and their complements (the gaps) are then given out row by row. Merging is associative, commutative and
idempotent, so order of arrival, repeated rows and repeated tasks do not matter.

Defined cases: rows without entity are ignored; NULL start is 0; NULL end is open and comes out as -1; rows whose
end is not after their start are ignored; intervals that touch are one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kronoweft.operators.scans import cell_in, key_bounds, with_bounds
from kronoweft.session import cut, ship

OPEN = (1 << 63) - 1
#: Intervals that a task folds at once.
BLOCK = 200_000


@dataclass
class Disjoint:
    """Sorted lists of disjoint intervals, one after the other: group (ascending numbers), start and end."""

    group: np.ndarray
    f: np.ndarray
    t: np.ndarray

    @classmethod
    def of(cls, group: np.ndarray, f: np.ndarray, t: np.ndarray) -> Disjoint:
        """The lists of intervals in any order. Runs that are sorted already, as lists are, merge in linear time."""
        order = np.argsort(f, kind="stable")
        order = order[np.argsort(group[order], kind="stable")]
        group, f, t = group[order], f[order], t[order]
        n = len(f)
        if not n:
            return cls(group, f, t)
        # the greatest end so far within each group: ends as ranks, so that a later group always outranks an earlier
        by_end = np.argsort(t, kind="stable")
        rank = np.empty(n, np.int64)
        rank[by_end] = np.arange(n)
        upto = np.maximum.accumulate(group.astype(np.int64) * n + rank)
        reach = t[by_end[upto - group.astype(np.int64) * n]]
        head = np.ones(n, bool)
        head[1:] = (group[1:] != group[:-1]) | (f[1:] > reach[:-1])
        last = np.append(np.flatnonzero(head)[1:], n) - 1
        return cls(group[head], f[head], reach[last])

    def merge(self, other: Disjoint) -> Disjoint:
        return Disjoint.of(*(np.concatenate(x) for x in ((self.group, other.group), (self.f, other.f), (self.t, other.t))))

    def before(self) -> tuple[np.ndarray, np.ndarray]:
        """The end of the interval before each one of its list, where a gap begins, and whether there is one."""
        there = np.zeros(len(self.f), bool)
        there[1:] = self.group[1:] == self.group[:-1]
        return np.roll(self.t, 1), there


def _blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= size:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def fold_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """entity, f, t: the lists of each block of rows."""
    for x in _blocks(batches):
        names = x.column("entity").combine_chunks().dictionary_encode()
        d = Disjoint.of(np.asarray(names.indices), x.column("f").to_numpy(), x.column("t").to_numpy())
        yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(d.group)), pa.array(d.f), pa.array(d.t)], ["entity", "f", "t"])


def merge_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """entity, cell, f, t, before (end of the interval before it in the cell; NULL at the first), from lists in order of (entity, cell)."""
    rest: pa.Table | None = None
    for x in _blocks(batches):
        x = pa.concat_tables([rest, x]) if rest is not None else x
        group = _numbered(x)
        # the last list may go on in the next block; what there is of it is merged already
        whole = group < group[-1]
        yield from _merged(x.filter(pa.array(whole)), group[whole])
        tail = _lists(x.filter(pa.array(~whole)))
        rest = pa.table([pa.repeat(x.column("entity")[-1], len(tail.f)), pa.repeat(x.column("cell")[-1], len(tail.f)), pa.array(tail.f), pa.array(tail.t)], schema=x.schema)
    if rest is not None:
        yield from _merged(rest, _numbered(rest))


def _numbered(x: pa.Table) -> np.ndarray:
    new = np.zeros(x.num_rows, bool)
    for c in ("entity", "cell"):
        v = x.column(c).combine_chunks()
        new[1:] |= pc.not_equal(v[1:], v[:-1]).to_numpy(zero_copy_only=False)
    return np.cumsum(new)


def _lists(x: pa.Table, group: np.ndarray | None = None) -> Disjoint:
    return Disjoint.of(np.zeros(x.num_rows, np.int64) if group is None else group, x.column("f").to_numpy(), x.column("t").to_numpy())


def _merged(x: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not x.num_rows:
        return
    d = _lists(x, group)
    first = np.searchsorted(group, d.group)
    before, there = d.before()
    yield pa.RecordBatch.from_arrays(
        [x.column("entity").combine_chunks().take(pa.array(first)), x.column("cell").combine_chunks().take(pa.array(first)), pa.array(d.f), pa.array(d.t), pa.array(before, mask=~there)],
        ["entity", "cell", "f", "t", "before"],
    )


def _across(lists: DataFrame) -> DataFrame:
    """entity, f, t, before of entities of several cells: the top of the tree. lists: as merge_lists gives them."""
    by = Window.partitionBy("entity").orderBy("cell")
    tops = lists.groupBy("entity", "cell").agg(F.max("t").alias("top"))
    tops = tops.select("entity", "cell", F.max("top").over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("carry"), F.max("top").over(Window.partitionBy("entity")).alias("total"))
    left = lists.join(tops, ["entity", "cell"]).where("carry IS NULL OR f > carry").withColumn("before", F.greatest("before", "carry"))
    left = cut(left, "openings")
    # a cell's last interval ends where the gap before the next cell that has any begins
    ends = left.groupBy("entity", "cell").agg(F.max("f").alias("f"), F.min_by("before", "f").alias("b"), F.first("total").alias("total"))
    ends = ends.select("entity", "cell", "f", F.coalesce(F.lead("b").over(by), "total").alias("end"))
    return left.drop("total", "carry").join(ends, ["entity", "cell", "f"], "left").select("entity", "f", F.coalesce("end", "t").alias("t"), "before")


def periods_and_gaps(rows: DataFrame, entity: str = "subject", start: str = "valid_from", end: str = "valid_to", most: int | None = None) -> DataFrame:
    """entity, kind (period or gap), start, end (-1 = open) over all intervals of an entity.

    rows is read twice. most: intervals of an entity above which they are cut into cells.
    """
    ship(rows.sparkSession)
    base = rows.where(F.col(entity).isNotNull()).select(
        F.col(entity).alias("entity"), F.coalesce(F.col(start), F.lit(0)).cast("long").alias("f"), F.coalesce(F.col(end), F.lit(OPEN)).cast("long").alias("t")
    ).where("f < t")
    bounds, n = key_bounds(base, ["entity"], ["f"], most)
    kind = base.schema["entity"].dataType.simpleString()
    leaves = with_bounds(base.mapInArrow(fold_leaves, f"entity {kind}, f long, t long"), bounds, n, ["entity"])
    leaves = leaves.select("entity", F.when(F.col("bounds").isNotNull(), cell_in(F.col("bounds"), F.col("f"))).otherwise(-1).alias("cell") if n else F.lit(-1).alias("cell"), "f", "t")
    lists = leaves.repartition("entity", "cell").sortWithinPartitions("entity", "cell").mapInArrow(merge_lists, f"entity {kind}, cell int, f long, t long, before long")
    if n:
        lists = cut(lists, "lists")
        out = lists.where("cell = -1").select("entity", "f", "t", "before").unionByName(_across(lists.where("cell >= 0")))
    else:
        out = lists.select("entity", "f", "t", "before")
    period, gap = F.struct(F.lit("period").alias("kind"), "f", "t"), F.when(F.col("before").isNotNull(), F.struct(F.lit("gap").alias("kind"), F.col("before").alias("f"), F.col("f").alias("t")))
    out = out.select("entity", F.explode(F.array(period, gap)).alias("x")).where("x IS NOT NULL")
    return out.select(F.col("entity").alias(entity), "x.kind", F.col("x.f").alias(start), F.when(F.col("x.t") == OPEN, F.lit(-1)).otherwise(F.col("x.t")).alias(end))
