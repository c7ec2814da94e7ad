"""Entity, attribute, value rows into one wide row per entity.

Column-block pivoting: the best row per (entity, attribute) is chosen with a map-side combine, the chosen rows are
hash-partitioned by entity once, and blocks of attributes are pivoted over that same partitioning (the exchange is
reused) and joined without further shuffles. Thousands of attributes thus cost one shuffle, and no single aggregate
gets wider than a block.

Defined cases: rows without entity are ignored; attribute names are matched without regard to case, outer white
space and - _ or blank between words; NULL start is 0; an entity all of whose rows are unusable still gets a row;
repeated rows are settled by (start, order); attributes that are not asked for are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Attributes pivoted by one aggregate.
BLOCK = 64


@dataclass(frozen=True)
class Attribute:
    name: str  # as in the definition
    column: str  # in the wide row
    kind: str  # text, int or instant


def plain_name(c: Column) -> Column:
    """Lower case, without outer white space, words joined by a hyphen. Names that are so already are only looked at."""
    return F.when(c.rlike("^[a-z]+(-[a-z]+)*$"), c).otherwise(_plain_name(c))


def _plain_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", ""), r"(?U)[\s_-]+", "-")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def as_text() -> Column:
    """The text without outer white space, or an integer's digits; NULL if blank."""
    return F.coalesce(F.nullif(strip(F.col("object_text")), F.lit("")), F.col("object_int").cast("string"))


def _whole_text(t: Column) -> Column:
    """A whole number written as text: sign, leading zeros and a zero fraction are allowed."""
    return F.when(t.rlike(r"^[+-]?[0-9]+(\.0*)?$"), F.regexp_replace(t, r"\..*$", "").try_cast("long"))


def _whole_float(f: Column) -> Column:
    return F.when((f == F.floor(f)) & (F.abs(f) < 9.0e15), f.cast("long"))


def as_int() -> Column:
    """Whatever clearly states a whole number, under whichever tag; else NULL."""
    f = F.when(~F.isnan("object_float"), F.col("object_float"))
    return F.coalesce(F.col("object_int"), _whole_float(f), _whole_text(strip(F.col("object_text"))), F.col("object_node"))


def as_instant() -> Column:
    """as_int, or a date or a date with time (UTC) in seconds since the epoch."""
    t = F.regexp_replace(F.regexp_replace(strip(F.col("object_text")), "/", "-"), r"(?i)\s*(z|utc)$", "")
    t = F.regexp_replace(t, r"^(\d{4}-\d{1,2}-\d{1,2})[Tt ]+", "$1 ")
    # read as UTC wall time whatever the session's time zone is
    stamp = F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}( \d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?$"), t.try_cast("timestamp_ntz"))
    return F.coalesce(as_int(), F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), stamp))


def wide(facts: DataFrame, attributes: list[Attribute], entity: str = "subject", start: str = "valid_from", order: str = "fact_id", block: int = BLOCK) -> DataFrame:
    """One row per entity with at least one row of the attributes: entity and a column per attribute.

    Per attribute the usable row with the greatest (start, order) counts; '' or -1 where there is none.
    """
    kind = F.create_map(*[F.lit(x) for a in attributes for x in (a.name, a.kind)])
    rows = facts.withColumn("__name", plain_name(F.col("predicate"))).where(F.col("__name").isin([a.name for a in attributes]) & F.col(entity).isNotNull())
    rows = rows.select(
        F.col(entity).alias("__entity"), "__name", F.coalesce(F.col(start), F.lit(0)).alias("__start"), F.col(order).alias("__order"),
        F.when(kind[F.col("__name")] == "text", as_text()).alias("__text"),
        F.when(kind[F.col("__name")] == "int", as_int()).when(kind[F.col("__name")] == "instant", as_instant()).alias("__int"),
    )
    usable = F.when(F.col("__text").isNotNull() | F.col("__int").isNotNull(), F.struct("__start", "__order", "__text", "__int"))
    best = rows.groupBy("__entity", "__name").agg(F.max(usable).alias("__best")).repartition("__entity")
    blocks = []
    for i in range(0, len(attributes), block):
        cols = []
        for a in attributes[i : i + block]:
            value, none = ("__text", "") if a.kind == "text" else ("__int", -1)
            cols.append(F.coalesce(F.max(F.when(F.col("__name") == a.name, F.col(f"__best.{value}"))), F.lit(none)).alias(a.column))
        blocks.append(best.groupBy("__entity").agg(*cols))
    return reduce(lambda x, y: x.join(y, "__entity"), blocks).withColumnRenamed("__entity", entity)
