"""CSV tables compiled into facts: column roles, type detection, dates and deterministic node ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kronoweft.model import OBJECT, double_, int_, node_, text_

DATE = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2})?)?$"


@dataclass(frozen=True)
class Role:
    kind: str  # id, valid_from, valid_to, edge, literal or skip
    target: str | None = None  # an edge's node type
    name: str | None = None  # the predicate, by default the column


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header, quoted fields with doubled quotes and line breaks; all columns as text, empty rows dropped."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return df.dropna(how="all")


def node_id(node_type: str, raw: Column) -> Column:
    """48 low bits of FNV-1a over type, a zero byte and the raw id.

    The multiplier 2**40 + 435 is split, so that nothing exceeds 63 bits; bytes come from the hex form of the text.
    """
    hexed = F.hex(F.encode(F.concat(F.lit(node_type + "\x00"), raw), "UTF-8"))
    at = F.sequence(F.lit(1), F.length(hexed).cast("int"), F.lit(2))
    data = F.transform(at, lambda i: F.conv(F.substring(hexed, i, F.lit(2)), 16, 10).cast("long"))
    mask = (1 << 48) - 1
    seed = 0xCBF29CE484222325 & mask

    def step(h: Column, x: Column) -> Column:
        v = h.bitwiseXOR(x)
        return (v * F.lit(435) + F.shiftleft(v.bitwiseAND(F.lit(255).cast("long")), 40)).bitwiseAND(F.lit(mask).cast("long"))

    return F.aggregate(data, F.lit(seed).cast("long"), step)


def date_seconds(c: Column) -> Column:
    """y-m-d or y/m/d, with an optional time, as UTC seconds; impossible dates are NULL."""
    t = F.regexp_replace(F.regexp_replace(c, "/", "-"), "T", " ")
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.when(c.rlike(DATE), t.try_cast("timestamp_ntz")))


def column_types(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """int, float, date or text of each column, from all its non-blank values in one pass; empty columns are text."""
    aggs = []
    for n, c in enumerate(columns):
        v = F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
        for kind, ok in (("int", v.try_cast("bigint").isNotNull()), ("float", v.try_cast("double").isNotNull()), ("date", date_seconds(v).isNotNull())):
            aggs.append(F.bool_and(F.when(v.isNotNull(), ok)).alias(f"{kind}_{n}"))
    r = df.agg(*aggs).first() if columns else {}
    return {c: next((k for k in ("int", "float", "date") if r[f"{k}_{n}"]), "text") for n, c in enumerate(columns)}


def compile_facts(df: DataFrame, node_type: str, roles: dict[str, Role]) -> DataFrame:
    """subject, predicate, object, valid_from, valid_to of each filled cell. Blank cells say nothing; a blank id is an error."""
    the_id = next(c for c, r in roles.items() if r.kind == "id")
    blank = F.nullif(F.trim(F.col(f"`{the_id}`")), F.lit("")).isNull()
    key = F.when(blank, F.raise_error(F.lit(f"blank id in column {the_id}")).cast("string")).otherwise(F.trim(F.col(f"`{the_id}`")))
    times = {k: next((date_seconds(F.col(f"`{c}`")) for c, r in roles.items() if r.kind == k), F.lit(d).cast("long")) for k, d in (("valid_from", 0), ("valid_to", None))}
    kinds = column_types(df, [c for c, r in roles.items() if r.kind == "literal"])
    cells = []
    for c, r in roles.items():
        v = F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
        if r.kind == "edge":
            o = node_(node_id(r.target or c, v))
        elif r.kind == "literal":
            o = {"int": lambda v: int_(v.try_cast("bigint")), "float": lambda v: double_(v.try_cast("double")), "date": lambda v: int_(date_seconds(v)), "text": text_}[kinds[c]](v)
        else:
            continue
        cells.append(F.struct(F.lit(r.name or c).alias("predicate"), F.when(v.isNotNull(), o).cast(OBJECT).alias("object")))
    rows = df.select(node_id(node_type, key).alias("subject"), times["valid_from"].alias("valid_from"), times["valid_to"].alias("valid_to"), F.explode(F.array(*cells)).alias("c"))
    return rows.where("c.object IS NOT NULL").select("subject", "c.predicate", "c.object", F.coalesce("valid_from", F.lit(0)).alias("valid_from"), "valid_to")
