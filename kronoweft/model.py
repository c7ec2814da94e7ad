"""The data model: typed objects of facts and the columns of a change log.

An object is a struct (kind, node, i, f, t, b); ``kind`` comes first so that structs order by class, then value.
A change log has the columns: ok (order key: a long or a struct, greater is later), op, subject, predicate, object,
valid_from, valid_to (NULL = open), source, observed (order numbers an observed removal saw), key and value (edge
properties), type and label (node records).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODE, INT, FLOAT, TEXT, BOOL = range(5)
OBJECT = "struct<kind:int,node:bigint,i:bigint,f:double,t:string,b:boolean>"
#: Labels are bit numbers in a mask of 32 bits.
ALL_LABELS = (1 << 32) - 1


def _object(kind: int, **value: Column) -> Column:
    parts = {"node": "bigint", "i": "bigint", "f": "double", "t": "string", "b": "boolean"}
    return F.struct(F.lit(kind).alias("kind"), *[value.get(n, F.lit(None)).cast(t).alias(n) for n, t in parts.items()])


def node_(c: Column) -> Column:
    return _object(NODE, node=c)


def int_(c: Column) -> Column:
    return _object(INT, i=c)


def float_(c: Column) -> Column:
    """Floats go through single precision, as received embeddings and literals do."""
    return _object(FLOAT, f=c.cast("float").cast("double"))


def double_(c: Column) -> Column:
    return _object(FLOAT, f=c)


def text_(c: Column) -> Column:
    return _object(TEXT, t=c)


def bool_(c: Column) -> Column:
    return _object(BOOL, b=c)


def first_object(node: Column, i: Column, f: Column, t: Column, b: Column) -> Column:
    """The object of a row with a column per class; NULL if all are NULL."""
    return F.when(node.isNotNull(), node_(node)).when(i.isNotNull(), int_(i)).when(f.isNotNull(), double_(f)).when(t.isNotNull(), text_(t)).when(b.isNotNull(), bool_(b))


def float_text(f: Column) -> Column:
    """All digits of a float, without an exponent from 0.001 to 10**15."""
    t = f.cast("string")
    whole = F.regexp_replace(F.regexp_replace(t.try_cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", ".0")
    return F.when(t.contains("E") & F.abs(f).between(1e-3, 1e15), whole).otherwise(t)


def object_text(o: str | Column) -> Column:
    """``kind:value`` of an object; NULL for NULL. Different objects have different texts: floats have all their digits."""
    c = F.col(o) if isinstance(o, str) else o
    kinds = [("node:", c["node"]), ("int:", c["i"]), ("float:", float_text(c["f"])), ("text:", c["t"]), ("bool:", c["b"])]
    return F.coalesce(*[F.when(c["kind"] == k, F.concat(F.lit(p), v.cast("string"))) for k, (p, v) in enumerate(kinds)])


def visible(label: Column, mask: int) -> Column:
    """Whether a node is in scope: it has no label, or the mask has the label's bit."""
    bit = F.when(label.between(0, 31), label.cast("int"))
    return label.isNull() | F.coalesce(F.getbit(F.lit(mask).cast("long"), bit) == 1, F.lit(False))
