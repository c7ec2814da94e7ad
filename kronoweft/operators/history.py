"""History of changing attributes: a type-two dimension with the period each version was valid.

``type2_history`` rebuilds the dimension from facts with valid times. In effect at an instant is, of the facts that
cover it, the one with the greatest (start, order). It takes two steps:

1. Updates: the facts of a key are swept in order; each stretch in which one fact is in effect is an update of the
   attribute.
2. Merge (``merge_updates``): each update is compared by attribute hash with the version that is current just before
   it. An equal one continues the version; otherwise the version is closed at its end date and a new one is opened.

``merge_type2`` makes the same merge between a dimension and a periodic snapshot, all keys at once.

Keys of few rows are swept whole, and their updates are merged within the row of the key, without a shuffle of their
own. The rows of a hotter key are cut into cells at instants of its own rows (scans.key_bounds):

1. Equal intervals collapse to the greatest order (map side).
2. A fact that covers whole cells is handed to the O(log cells) dyadic ranges that make them up, and of each range the
   best fact is kept (map side). The background of a cell is the best of the ranges that hold it.
3. Per (key, cell) a sweep over the facts that start there, the best fact for each end there, and the background, gives
   the cell's updates.
4. The merge reads each update's predecessor in its own or an earlier cell (scans.shift_across).

Defined cases: facts without key or value are ignored; NULL start is 0; NULL end is open (-1 in the result); a fact
whose end is not after its start covers nothing; equal intervals and repeated rows are settled by the order column;
no rows where nothing covers; an empty table gives an empty history. Facts of one key that start at one instant with
different ends share a cell, however many they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kronoweft.operators.scans import BITS, MOST_BOUNDS, cell_in, key_bounds, shift_across, with_bounds
from kronoweft.session import cut, ship

OPEN = (1 << 63) - 1
KEYS = ["subject", "predicate"]


def sweep(rows: list[tuple]) -> list[tuple]:
    """Segments (start, end, row) of the row with the greatest priority at each instant.

    rows: (start, end, ...) in ascending priority, with starts that never decrease. A new row outranks all before it,
    so those that end no later than it never show again and leave the stack; each row is pushed and popped once.
    """
    out: list[tuple] = []
    stack: list[tuple] = []

    def advance(now: int, to: int) -> None:
        while stack and now < to:
            top = stack[-1]
            if top[1] <= now:
                stack.pop()
                continue
            stop = min(top[1], to)
            out.append((now, stop, top))
            now = stop
        while stack and stack[-1][1] <= to:
            stack.pop()

    now = None
    for r in rows:
        if now is not None and r[0] > now:
            advance(now, r[0])
        now = r[0]
        while stack and stack[-1][1] <= r[1]:
            stack.pop()
        stack.append(r)
    if now is not None:
        advance(now, OPEN)
    return out


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows with the same first ``width`` columns, across batches."""
    key, rows = None, []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            k = r[:width]
            if k != key:
                if rows:
                    yield key, rows
                key, rows = k, []
            rows.append(r)
    if rows:
        yield key, rows


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    buf: list[tuple] = []
    for r in rows:
        buf.append(r)
        if len(buf) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*buf), schema.types)], schema=schema)
            buf = []
    if buf:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*buf), schema.types)], schema=schema)


SEGMENT_SCHEMA = pa.schema([("subject", pa.int64()), ("predicate", pa.string()), ("cell", pa.int32()), ("f", pa.int64()), ("t", pa.int64()), ("v", pa.string())])
_SEGMENT = pa.struct([("f", pa.int64()), ("t", pa.int64()), ("v", pa.string())])


def whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each key with the list of its updates, from its rows (subject, predicate, f, o, t, v) in order of (f, o)."""

    def packed(keys: list[tuple], lists: list[list[tuple]]) -> pa.RecordBatch:
        flat, at = [x for u in lists for x in u], [0]
        for u in lists:
            at.append(at[-1] + len(u))
        parts = [pa.array([x[i] for x in flat], _SEGMENT.field(i).type) for i in range(3)]
        updates = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(_SEGMENT)))
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.string()), updates], ["subject", "predicate", "updates"])

    keys, lists, n = [], [], 0
    for k, rows in _groups(batches, 2):
        keys.append(k)
        lists.append([(f, t, r[2][5]) for f, t, r in sweep([(r[2], r[4], r) for r in rows])])
        n += len(lists[-1])
        if n > 20_000:
            yield packed(keys, lists)
            keys, lists, n = [], [], 0
    if keys:
        yield packed(keys, lists)


def cell_updates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Updates of each (key, cell), from rows (subject, predicate, cell, f, o, t, v, low, high) in order of (f, o)."""

    def of(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        for f, t, r in sweep([(max(r[3], r[7]), min(r[5], r[8]), r) for r in rows]):
            yield (*key, f, t, r[2][6])

    yield from _batched((x for k, g in _groups(batches, 3) for x in of(k, g)), SEGMENT_SCHEMA)


def _ranges(lo: Column, hi: Column) -> Column:
    """The dyadic ranges (level, n) that make up the cells lo to hi - 1."""

    def at(level: Column) -> Column:
        width = F.pow(F.lit(2), level).cast("int")
        a, b = F.ceil(lo / width).cast("int"), F.floor(hi / width).cast("int")
        take = lambda odd, n: F.when((a < b) & (F.pmod(odd, F.lit(2)) == 1), F.struct(level.alias("level"), n.alias("n")))
        return F.array(take(a, a), take(b, b - 1))

    return F.array_distinct(F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(BITS)), at)), lambda x: x.isNotNull()))


def hot_updates(facts: DataFrame, bounds: DataFrame, n: int) -> DataFrame:
    """subject, predicate, cell, f, t, v: updates of keys with bounds. facts: subject, predicate, f, o, t, v with f < t."""
    best = facts.groupBy(*KEYS, "f", "t").agg(F.max(F.struct("o", "v")).alias("x")).select(*KEYS, "f", "t", "x.o", "x.v")
    cells = F.size("bounds") + 1
    best = with_bounds(best, bounds, n, KEYS).withColumn("cell", cell_in(F.col("bounds"), F.col("f")))
    best = cut(best.withColumn("last", F.when(F.col("t") == OPEN, cells).otherwise(cell_in(F.col("bounds"), F.col("t")))).drop("bounds"), "facts")
    over = best.where("last > cell + 1").select(*KEYS, "f", "o", "t", "v", F.explode(_ranges(F.col("cell") + 1, F.col("last"))).alias("r"))
    over = over.groupBy(*KEYS, "r.level", "r.n").agg(F.max(F.struct("f", "o", "t", "v")).alias("x"))
    each = bounds.select(*KEYS, F.explode(F.sequence(F.lit(0), F.size("bounds"))).alias("cell"))
    each = each.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(BITS)))).withColumn("n", F.floor(F.col("cell") / F.pow(F.lit(2), F.col("level"))).cast("int"))
    back = each.join(over, [*KEYS, "level", "n"]).groupBy(*KEYS, "cell").agg(F.max("x").alias("x")).select(*KEYS, "cell", "x.f", "x.o", "x.t", "x.v")
    # of the facts that end in a cell at one instant, only the best can show in it
    ends = best.where("last > cell").groupBy(*KEYS, F.col("last").alias("cell"), "t").agg(F.max(F.struct("f", "o", "v")).alias("x")).select(*KEYS, "cell", "x.f", "x.o", "t", "x.v")
    ends = ends.where(F.col("t") != OPEN)
    rows = best.select(*KEYS, "cell", "f", "o", "t", "v").unionByName(ends).unionByName(back)
    edge = bounds.select(*KEYS, F.posexplode(F.concat(F.array(F.lit(-OPEN)), "bounds")).alias("cell", "low"), "bounds")
    edge = edge.select(*KEYS, "cell", "low", F.coalesce(F.try_element_at("bounds", F.col("cell") + 1), F.lit(OPEN)).alias("high"))
    rows = rows.join(F.broadcast(edge) if n <= MOST_BOUNDS else edge, [*KEYS, "cell"])
    rows = rows.select(*KEYS, "cell", "f", "o", "t", "v", "low", "high").repartition(*KEYS, "cell").sortWithinPartitions(*KEYS, "cell", "f", "o")
    return rows.mapInArrow(cell_updates, "subject long, predicate string, cell int, f long, t long, v string")


def _continues(before: Column, f: Column, digest: Column, v: Column) -> Column:
    """Whether an update from f on continues the version before it: it adjoins, and the attribute hashes are equal."""
    return F.coalesce((before["t"] == f) & (F.xxhash64(before["v"]) == digest) & (before["v"] == v), F.lit(False))


def merge_updates(keys: DataFrame) -> DataFrame:
    """subject, predicate, v, f, t: versions, from keys with the list ``updates`` (f, t, v) in order of time.

    Every update is compared by hash with the one that is current just before it. The updates that open a version are
    kept, each with the end date at which the version is closed.
    """
    u = F.col("updates")
    number = F.sequence(F.lit(0), F.size(u) - 1)
    opens = F.filter(number, lambda i: (i == 0) | ~_continues(F.get(u, i - 1), F.get(u, i)["f"], F.xxhash64(F.get(u, i)["v"]), F.get(u, i)["v"]))
    out = keys.where(F.size(u) > 0).withColumn("opens", opens)
    at = F.col("opens")
    closed = lambda i, j: F.get(u, F.coalesce(F.get(at, j + 1), F.size(u)) - 1)["t"]
    rows = F.transform(at, lambda i, j: F.struct(F.get(u, i)["v"].alias("v"), F.get(u, i)["f"].alias("f"), closed(i, j).alias("t")))
    return out.select(*KEYS, F.explode(rows).alias("r")).select(*KEYS, "r.v", "r.f", "r.t")


def merge_across(updates: DataFrame) -> DataFrame:
    """As merge_updates for updates of (key, cell), each a row."""
    updates = cut(updates, "updates").withColumn("hash", F.xxhash64("v"))
    seen = shift_across(updates, KEYS, "cell", "f", F.struct("t", "v"), "prev")
    last = updates.groupBy(*KEYS).agg(F.max("t").alias("total"))
    opened = cut(seen.where(~_continues(F.col("prev"), F.col("f"), F.col("hash"), F.col("v"))).select(*KEYS, "cell", "f", "v", F.coalesce("prev.t", F.lit(OPEN)).alias("closed")), "versions")
    after = shift_across(opened, KEYS, "cell", "f", F.struct("closed"), "next", back=False)
    done, final = after.where("next IS NOT NULL"), after.where("next IS NULL").join(last, KEYS)
    return done.select(*KEYS, "v", "f", F.col("next.closed").alias("t")).unionByName(final.select(*KEYS, "v", "f", F.col("total").alias("t")))


def settle(rows: DataFrame, most: int | None = None) -> DataFrame:
    """subject, predicate, v, f, t: versions of each key from intervals subject, predicate, f, o, t, v with f < t.

    rows is read twice. most: rows of a key above which it is cut into cells.
    """
    ship(rows.sparkSession)
    rows = rows.select(*KEYS, "f", "o", "t", "v")
    bounds, n = key_bounds(rows, KEYS, ["f", "t"], most)
    cold = rows
    if n:
        hot = with_bounds(rows, bounds, n, KEYS)
        cold, hot = hot.where("bounds IS NULL").drop("bounds"), hot.where("bounds IS NOT NULL").drop("bounds")
    lists = cold.repartition(*KEYS).sortWithinPartitions(*KEYS, "f", "o").mapInArrow(whole_keys, "subject long, predicate string, updates array<struct<f:bigint,t:bigint,v:string>>")
    out = merge_updates(lists)
    return out.unionByName(merge_across(hot_updates(hot, bounds, n))) if n else out


def type2_history(facts: DataFrame, value: Column, start: str = "valid_from", end: str = "valid_to", order: str = "fact_id", most: int | None = None) -> DataFrame:
    """subject, predicate, value, valid_from, valid_to (-1 = open) of every version of each subject's attribute."""
    base = facts.select(*KEYS, F.coalesce(F.col(start), F.lit(0)).cast("long").alias("f"), F.coalesce(F.col(end), F.lit(OPEN)).cast("long").alias("t"), F.col(order).cast("long").alias("o"), value.cast("string").alias("v"))
    base = base.where("subject IS NOT NULL AND predicate IS NOT NULL AND v IS NOT NULL AND f < t").withColumn("subject", F.col("subject").cast("long"))
    out = settle(base, most)
    return out.select(*KEYS, F.col("v").alias("value"), F.col("f").alias("valid_from"), F.when(F.col("t") == OPEN, F.lit(-1)).otherwise(F.col("t")).alias("valid_to"))


def merge_type2(dim: DataFrame, snapshot: DataFrame, keys: list[str], attributes: list[str], at: int) -> DataFrame:
    """The dimension after a periodic snapshot: one shuffle by key.

    dim: keys, attributes, valid_from, valid_to (-1 = current); snapshot: keys and attributes, one row per key (of
    repeated keys the greatest attributes count). Closed versions pass through untouched. A current version whose
    attribute hash differs, or whose key is no longer in the snapshot, is closed at ``at`` (dropped if it began
    at ``at``); changed and new keys get an open version from ``at``. NULL keys are compared as values.
    """
    digest = F.xxhash64(*attributes)
    # NULL and a missing attribute hash alike in xxhash64, so the NULL pattern is hashed with it
    digest = F.xxhash64(digest, *[F.col(a).isNull() for a in attributes])
    closed = dim.where("valid_to <> -1").select(*keys, *attributes, "valid_from", "valid_to")
    cur = dim.where("valid_to = -1").select(*keys, *attributes, "valid_from", digest.alias("h"), F.lit(0).alias("new"))
    new = snapshot.groupBy(*keys).agg(F.max(F.struct(*attributes)).alias("a")).select(*keys, "a.*").select(*keys, *attributes, F.lit(at).cast("long").alias("valid_from"), digest.alias("h"), F.lit(1).alias("new"))
    both = cur.unionByName(new).groupBy(*keys).agg(
        F.max(F.when(F.col("new") == 0, F.struct("h", "valid_from", *attributes))).alias("o"), F.max(F.when(F.col("new") == 1, F.struct("h", "valid_from", *attributes))).alias("n")
    )
    same = F.col("o.h") == F.col("n.h")
    row = lambda s, f, t: F.struct(*[F.col(f"{s}.{a}").alias(a) for a in attributes], f.cast("long").alias("valid_from"), F.lit(t).cast("long").alias("valid_to"))
    keep = F.when(F.col("o").isNotNull(), F.when(F.coalesce(same, F.lit(False)), row("o", F.col("o.valid_from"), -1)).when(F.col("o.valid_from") < at, row("o", F.col("o.valid_from"), at)))
    start = F.when(F.col("n").isNotNull() & ~F.coalesce(same, F.lit(False)), row("n", F.lit(at), -1))
    out = both.select(*keys, F.explode(F.array(keep, start)).alias("r")).where("r IS NOT NULL").select(*keys, "r.*")
    return closed.unionByName(out)
