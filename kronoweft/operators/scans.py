"""Ordered scans over a key's rows that never bring a whole hot key into one task.

Rows of a hot key are cut into cells at instants sampled from the key's own rows (``key_bounds``), so that a cell holds
about the same number of rows however they are spread over time; a key of few rows is one cell. Inside a cell a window
or a sweep does the work; between cells only one summary row per cell is exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kronoweft.session import cut

#: Rows of a key that make a cell, sampled rows in each, and bounds of all keys together that are broadcast at most.
MOST, SAMPLED, MOST_BOUNDS = 20_000, 16, 1_000_000
#: Pieces that one row per key is copied to where a hot key's rows are joined with it.
SALTS = 16
#: Cells of a key are numbered in so many bits.
BITS = 20


def salted(rows: DataFrame, one: DataFrame, keys: list[str], spread: Column, how: str = "left", salts: int = SALTS) -> DataFrame:
    """rows joined with ``one`` (one row per key): a key that holds a large share of the rows is joined by ``salts`` tasks."""
    copies = one.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(copies, [*keys, "__salt"], how).drop("__salt")


def key_bounds(df: DataFrame, keys: list[str], instants: list[str], most: int | None = None) -> tuple[DataFrame, int]:
    """(keys, bounds: array<bigint> of the instants at which a hot key's rows are cut; keys that are not hot are left out), and how many.

    One row in (most / SAMPLED) is looked at, chosen by the hash of its columns, and every SAMPLED-th of a key's is a
    bound: a cell holds about ``most`` rows. What is sampled decides where rows are worked on, never what comes out.
    """
    most = MOST if most is None else most
    step = max(1, min(SAMPLED, most))
    picked = df.where(F.pmod(F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")]), F.lit(max(1, most // step))) == 0)
    at = F.col(instants[0]) if len(instants) == 1 else F.explode(F.array(*instants))
    points = picked.select(*keys, at.alias("__at")).where(F.col("__at") < (1 << 63) - 1).groupBy(*keys, "__at").agg(F.count("*").alias("__n"))
    if points.groupBy(*keys).agg(F.sum("__n").alias("__n")).where(F.col("__n") >= step).isEmpty():
        return picked.select(*keys, F.lit(None).cast("array<bigint>").alias("bounds")).limit(0), 0
    upto = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__at"))
    marked = points.withColumn("__u", upto).where(F.floor(F.col("__u") / step) > F.floor((F.col("__u") - F.col("__n")) / step))
    bounds = cut(marked.groupBy(*keys).agg(F.sort_array(F.collect_list("__at")).alias("bounds")), "bounds")
    return bounds, bounds.agg(F.sum(F.size("bounds"))).first()[0] or 0


def cell_in(bounds: Column, at: Column) -> Column:
    """How many bounds are at or before an instant (binary search); 0 without bounds."""
    steps = F.array(*[F.lit(1 << b) for b in range(BITS - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda p, s: F.when(F.coalesce(F.try_element_at(bounds, p + s) <= at, F.lit(False)), p + s).otherwise(p))


def with_bounds(df: DataFrame, bounds: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """df with ``bounds`` (NULL for keys that are not hot). n: bounds in all; few are broadcast, many joined in salted pieces."""
    if not n:
        return df.withColumn("bounds", F.lit(None).cast("array<bigint>"))
    if n <= MOST_BOUNDS:
        return df.join(F.broadcast(bounds), keys, "left")
    return salted(df, bounds, keys, F.struct(*[c for c, t in df.dtypes if not t.startswith("map")]))


def celled(df: DataFrame, keys: list[str], at: str, most: int | None = None) -> DataFrame:
    """df with ``cell``. df is read twice."""
    bounds, n = key_bounds(df, keys, [at], most)
    if not n:
        return df.withColumn("cell", F.lit(0))
    return with_bounds(df, bounds, n, keys).withColumn("cell", cell_in(F.col("bounds"), F.col(at))).drop("bounds")


def shift_across(df: DataFrame, keys: list[str], cell: str, order: str, value: Column, out: str, back: bool = True) -> DataFrame:
    """Add ``out``: ``value`` of the previous (back) or next row of the key by (cell, order); NULL at the end.

    ``value`` must not be NULL, and (cell, order) unique within a key. Keys must not be NULL.
    df is read twice: pass one that is written or cheap (see session.cut).
    """
    side, best = (F.lag, F.max_by) if back else (F.lead, F.min_by)
    inner = Window.partitionBy(*keys, cell).orderBy(order)
    edge = df.groupBy(*keys, cell).agg(best(value, F.col(order)).alias("__edge"))
    edge = edge.select(*keys, cell, side("__edge").over(Window.partitionBy(*keys).orderBy(cell)).alias("__over"))
    own = df.withColumn("__in", side(value).over(inner))
    return own.join(edge, [*keys, cell]).withColumn(out, F.coalesce("__in", "__over")).drop("__in", "__over")


def last_before(df: DataFrame, keys: list[str], cell: str, order: list[Column], value: str, rank: Column, out: str) -> DataFrame:
    """Add ``out``: the last non-NULL ``value`` at or before each row by (cell, order); NULL if there is none.

    ``rank`` orders the non-NULL values within a cell as ``order`` does. df is read twice.
    """
    inner = Window.partitionBy(*keys, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    by_key = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    ends = df.groupBy(*keys, cell).agg(F.max_by(F.col(value), F.when(F.col(value).isNotNull(), rank)).alias("__last"))
    ends = ends.select(*keys, cell, F.last("__last", ignorenulls=True).over(by_key).alias("__carry"))
    own = df.withColumn("__in", F.last(value, ignorenulls=True).over(inner))
    return own.join(ends, [*keys, cell]).withColumn(out, F.coalesce("__in", "__carry")).drop("__in", "__carry")
