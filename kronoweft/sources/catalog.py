"""Declared types, predicates, sources and rules; opt-in validation of facts against them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kronoweft.model import BOOL, FLOAT, INT, NODE, TEXT
from kronoweft.operators.graph import Relation

KINDS = {"node": NODE, "int": INT, "float": FLOAT, "text": TEXT, "bool": BOOL}


@dataclass
class Predicate:
    name: str
    cardinality: str = "many"
    domain: str | None = None
    range: str | None = None  # a node type
    range_value: str | None = None  # a class of values
    symmetric: bool = False
    transitive: bool = False
    inverse: str | None = None
    display: bool = False

    @property
    def relation(self) -> Relation:
        return Relation(self.symmetric, self.transitive, self.inverse)


@dataclass
class Catalog:
    types: set[str] = field(default_factory=set)
    sources: set[str] = field(default_factory=set)
    predicates: dict[str, Predicate] = field(default_factory=dict)
    rules: dict[str, dict] = field(default_factory=dict)

    def define(self, spec: dict) -> bool:
        """Take in a definition record; False if the record is none. A predicate's cardinality cannot change."""
        if "type_def" in spec:
            self.types.add(_name(spec["type_def"]))
        elif "source_def" in spec:
            self.sources.add(_name(spec["source_def"]))
        elif "rule_def" in spec:
            self.rules[_name(spec["rule_def"])] = spec["rule_def"]["rule"]
        elif "pred_def" in spec:
            p = spec["pred_def"]
            card = p.get("cardinality", "many")
            if card not in ("one", "many"):
                raise ValueError(f"unknown cardinality: {card}")
            old = self.predicates.get(_name(p))
            if old and old.cardinality != card:
                raise ValueError(f"cardinality of {p['name']} is {old.cardinality} and cannot change")
            value = None if p.get("range") else p.get("range_value", "text")
            self.predicates[p["name"]] = Predicate(p["name"], card, p.get("domain"), p.get("range"), value, p.get("symmetric", False), p.get("transitive", False), p.get("inverse"), p.get("display", False))
        else:
            return False
        return True

    def predicate(self, name: str) -> Predicate:
        if name not in self.predicates:
            raise ValueError(f"unknown predicate: {name}")
        return self.predicates[name]


def _name(spec: dict) -> str:
    if not spec.get("name"):
        raise ValueError("name required")
    return spec["name"]


def inventory(defs: DataFrame, attrs: DataFrame, rules: list[str]) -> DataFrame:
    """kind (predicate, label, rule), name, card, domain, range: what a schema declares, and the labels in use.

    defs: name, card, domain, range_type, range_value.
    """
    none = F.lit(None).cast("string")
    preds = defs.select(F.lit("predicate").alias("kind"), "name", "card", "domain", F.coalesce("range_type", "range_value").alias("range"))
    labels = attrs.where("label IS NOT NULL").select(F.lit("label").alias("kind"), F.col("label").cast("string").alias("name"), none.alias("card"), none.alias("domain"), none.alias("range")).distinct()
    out = preds.unionByName(labels)
    if rules:
        out = out.unionByName(attrs.sparkSession.createDataFrame([("rule", n, None, None, None) for n in rules], "kind string, name string, card string, domain string, range string"))
    return out


def violations(facts: DataFrame, defs: DataFrame, attrs: DataFrame) -> DataFrame:
    """facts with ``problem``: domain, range type or class of value differ from the definition.

    defs: name, domain, range_type, range_value. Nodes without a known type pass.
    """
    d = defs.select(F.col("name").alias("predicate"), "domain", "range_type", "range_value")
    s, o = attrs.select(F.col("node").alias("subject"), F.col("type").alias("__st")), attrs.select(F.col("node").alias("__o"), F.col("type").alias("__ot"))
    j = facts.join(d, "predicate").join(s, "subject", "left")
    j = j.withColumn("__on", F.col("object.node")).join(o, F.col("__on") == F.col("__o"), "left")
    kind = F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v)])
    problem = (
        F.when(F.col("__st") != F.col("domain"), "domain")
        .when(F.col("range_type").isNotNull() & (F.col("object.kind") != NODE), "class")
        .when(F.col("__ot") != F.col("range_type"), "range")
        .when(F.col("range_value").isNotNull() & (F.col("object.kind") != kind[F.col("range_value")]), "class")
    )
    return j.withColumn("problem", problem).where("problem IS NOT NULL").drop("domain", "range_type", "range_value", "__st", "__o", "__ot", "__on")
