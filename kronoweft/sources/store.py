"""A store of facts in a folder: an append-only change log in Parquet, definitions, and received vectors.

Lines of JSON are parsed, validated as a whole and appended as one batch: if a line is bad, nothing of the batch is
written. Order numbers grow with the lines and from batch to batch, and need not be consecutive. Definitions, rules and
errors are few and handled at the driver; facts never leave the executors.
"""

from __future__ import annotations

import json
from dataclasses import asdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kronoweft.model import OBJECT, bool_, double_, float_, int_, node_, object_text, text_
from kronoweft.operators import fold
from kronoweft.operators.snapshot import Snapshot
from kronoweft.operators.vectors import Ivf, fit, refresh
from kronoweft.session import Files, cut, ship
from kronoweft.sources.catalog import Catalog

_OBJ = "struct<node:bigint,int:bigint,float:double,text:string,bool:boolean>"
_FACT = f"struct<subject:bigint,predicate:string,object:{_OBJ},valid_from:bigint,valid_to:bigint,source:string,props:map<string,variant>>"
LINE = f"""type_def string, source_def string, pred_def string, rule_def string, node struct<id:bigint,type:string,label:int>,
fact {_FACT}, close {_FACT}, retract {_FACT}"""
LOG = f"""ok bigint, batch bigint, op string, subject bigint, predicate string, object {OBJECT}, valid_from bigint, valid_to bigint, source string,
observed array<bigint>, key string, value {OBJECT}, type string, label int"""


def typed(o: Column) -> Column:
    """The object of a parsed {"node" | "int" | "float" | "text" | "bool": value}."""
    return (
        F.when(o["node"].isNotNull(), node_(o["node"])).when(o["int"].isNotNull(), int_(o["int"])).when(o["float"].isNotNull(), float_(o["float"]))
        .when(o["text"].isNotNull(), text_(o["text"])).when(o["bool"].isNotNull(), bool_(o["bool"]))
    )


def literal(v: Column) -> Column:
    """The object of an edge property: a bare scalar or a typed value, but no node."""
    kind = F.schema_of_variant(v)
    get = lambda path, t: F.try_variant_get(v, path, t)
    return (
        F.when(kind.startswith("OBJECT"), F.when(get("$.int", "bigint").isNotNull() & ~kind.contains("text"), int_(get("$.int", "bigint"))).when(get("$.float", "double").isNotNull(), float_(get("$.float", "double")))
               .when(get("$.text", "string").isNotNull(), text_(get("$.text", "string"))).when(get("$.bool", "boolean").isNotNull(), bool_(get("$.bool", "boolean"))))
        .when(kind == "BIGINT", int_(get("$", "bigint"))).when(kind == "STRING", text_(get("$", "string"))).when(kind == "BOOLEAN", bool_(get("$", "boolean")))
        .otherwise(double_(get("$", "double")))
    )


class Store:
    def __init__(self, spark: SparkSession, folder: str, max_rows: int | None = None):
        ship(spark)
        self.spark, self.folder, self.max_rows = spark, folder.rstrip("/"), max_rows
        self.files = Files(spark, self.folder)
        self.catalog = Catalog()
        self.batches: list[str] = []
        self.head, self.vectors, self.dim, self.indexed, self.removals = 0, [], None, 0, False
        self.ivf: Ivf | None = None
        self.index: DataFrame | None = None
        self._load()

    # the newest manifest names the committed batches; a batch that is not named was never written
    def _load(self) -> None:
        named = [n for n in self.files.names() if n.startswith("manifest-")]
        self._number = int(named[-1].split("-")[1]) if named else 0
        if named:
            m = json.loads(self.files.read(named[-1]))
            self.batches, self.head, self.vectors, self.dim, self.indexed, self.removals = m["batches"], m["head"], m["vectors"], m["dim"], m["indexed"], m["removals"]
            for d in m["defs"]:
                self.catalog.define(d)

    def _commit(self) -> None:
        defs = [{"type_def": {"name": n}} for n in sorted(self.catalog.types)] + [{"source_def": {"name": n}} for n in sorted(self.catalog.sources)]
        defs += [{"pred_def": {k: v for k, v in asdict(p).items() if v is not None}} for p in self.catalog.predicates.values()]
        defs += [{"rule_def": {"name": n, "rule": r}} for n, r in self.catalog.rules.items()]
        self._number += 1
        self.files.write(f"manifest-{self._number:012d}", json.dumps({"batches": self.batches, "head": self.head, "vectors": self.vectors, "dim": self.dim, "indexed": self.indexed, "removals": self.removals, "defs": defs}))
        for n in self.files.names():
            if n.startswith("manifest-") and n < f"manifest-{self._number - 1:012d}":
                self.files.delete(n)

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(*self.batches) if self.batches else self.spark.createDataFrame([], LOG)

    def embeddings(self) -> DataFrame:
        """id, seqno, x: the last vector of each node; seqno is the vector's place in the order of receipt."""
        if not self.vectors:
            return self.spark.createDataFrame([], "id bigint, seqno bigint, x array<float>")
        rows = self.spark.read.parquet(*self.vectors)
        return rows.groupBy("id").agg(F.max("seqno").alias("seqno"), F.max_by("x", "seqno").alias("x"))

    def snapshot(self) -> Snapshot:
        return Snapshot(self.log(), embeddings=self.embeddings(), plain=not self.removals)

    def ingest(self, lines: str | DataFrame, source: str | None = None) -> dict[str, int]:
        """Append lines of JSON (text, or a DataFrame with a column ``value``); source is put where a fact has none."""
        if isinstance(lines, str):
            rows = [(n, s) for n, s in enumerate(lines.splitlines()) if s.strip()]
            df = self.spark.createDataFrame(rows, "line bigint, value string")
        else:
            df = lines.withColumn("line", F.monotonically_increasing_id()).select("line", "value").where("trim(value) <> ''")
        # read once: line numbers of a file must not change between the steps below
        parsed = cut(df.withColumn("j", F.from_json("value", LINE)), "lines")
        kinds = ["type_def", "source_def", "pred_def", "rule_def", "node", "fact", "close", "retract"]
        bad = parsed.where(F.coalesce(*[F.col(f"j.{k}").cast("string") if "def" in k else F.when(F.col(f"j.{k}").isNotNull(), "x") for k in kinds]).isNull())
        # what the lines hold decides which parts of the log have to be folded
        node, said = F.col("j.node"), lambda c: F.coalesce(F.bool_or(c), F.lit(False))
        self._has = parsed.agg(
            *[said(F.col(f"j.{k}").isNotNull()).alias(k) for k in kinds[4:]], said(F.col("j.fact.props").isNotNull()).alias("props"), said(node["type"].isNotNull()).alias("type"), said(node["label"].isNotNull()).alias("label"),
            said(F.coalesce(*[F.col(f"j.{k}") for k in kinds[:4]]).isNotNull()).alias("defs"),
        ).first()
        self._bad = [bad.select("line", F.concat(F.lit("not a known record: "), F.substring("value", 1, 100)).alias("problem"))]
        defs = parsed.where(F.coalesce(*[F.col(f"j.{k}") for k in kinds[:4]]).isNotNull()).orderBy("line").select("value").collect() if self._has["defs"] else []
        catalog = Catalog(set(self.catalog.types), set(self.catalog.sources), dict(self.catalog.predicates), dict(self.catalog.rules))
        for r in defs:
            catalog.define(json.loads(r["value"]))
        new = self._changes(parsed, catalog, source)
        told = [] if new is None else new.groupBy("op").agg(F.count("*").alias("n"), F.max("ok").alias("ok"), F.collect_set("source").alias("sources")).collect()
        counts = {r["op"]: r["n"] for r in told}
        asked = {r["op"]: r["n"] for r in (self._asked.groupBy("op").agg(F.count("*").alias("n")).collect() if self._asked is not None else [])}
        if self.max_rows is not None and sum(counts.values()) > self.max_rows:
            raise RuntimeError(f"backpressure: {sum(counts.values())} rows, at most {self.max_rows} a batch")
        if counts:
            path = f"{self.folder}/batch-{len(self.batches):06d}-{self.head}"
            new.write.mode("overwrite").parquet(path)
            self.batches = [*self.batches, path]
            self.head = max(r["ok"] for r in told)
            self.removals = self.removals or bool({"RemoveMany", "HardDelete"} & set(counts))
            catalog.sources |= {x for r in told for x in r["sources"]}
        self.catalog = catalog
        self._commit()
        total = lambda d, *ops: sum(d.get(o, 0) for o in ops)
        return {
            "defs": len(defs), "nodes": total(asked, "SetNodeType", "SetNodeLabel"), "facts": total(counts, "SetOne", "AddMany"), "closes": total(counts, "CloseOne", "CloseMany"),
            "retracts": total(counts, "RemoveMany"), "suppressed": sum(asked.values()) - sum(counts.values()), "durable_head": self.head,
        }

    def _changes(self, parsed: DataFrame, catalog: Catalog, source: str | None) -> DataFrame | None:
        base = self.head + 1
        none = lambda t: F.lit(None).cast(t)
        cols = {"observed": none("array<bigint>"), "key": none("string"), "value": none(OBJECT), "type": none("string"), "label": none("int"), "batch": F.lit(len(self.batches)).cast("bigint")}
        card = F.create_map(*[F.lit(x) for p in catalog.predicates.values() for x in (p.name, p.cardinality)]) if catalog.predicates else F.create_map(F.lit(""), F.lit(""))
        parts = []
        for kind, ops in (("fact", ("SetOne", "AddMany")), ("close", ("CloseOne", "CloseMany")), ("retract", (None, "RemoveMany"))):
            r = F.col(f"j.{kind}")
            if not self._has[kind]:
                parts.append(None)
                continue
            rows = parsed.where(r.isNotNull()).withColumn("card", card[r["predicate"]]).withColumn("object", typed(r["object"]))
            problem = F.when(r["subject"].isNull(), "subject required").when(F.col("card").isNull(), F.concat(F.lit("unknown predicate: "), F.coalesce(r["predicate"], F.lit("")))).when(r["subject"] < 0, "node ids are not negative")
            if kind == "fact":
                problem = problem.when(F.col("object").isNull(), "object required")
            elif kind == "close":
                problem = problem.when((F.col("card") == "one") & F.col("object").isNotNull(), "a close of a one-valued predicate has no object").when((F.col("card") == "many") & F.col("object").isNull(), "a close of a many-valued predicate needs an object")
            else:
                problem = problem.when(F.col("card") == "one", "retract needs a many-valued predicate").when(F.col("object").isNull(), "object required")
            self._bad.append(rows.withColumn("problem", problem).where("problem IS NOT NULL").select("line", "problem"))
            src = F.coalesce(r["source"], F.lit(source)) if source else r["source"]
            op = F.when(F.col("card") == "one", ops[0]).otherwise(ops[1])
            parts.append(rows.select("line", op.alias("op"), r["subject"].alias("subject"), r["predicate"].alias("predicate"), "object", F.coalesce(r["valid_from"], F.lit(0)).alias("valid_from"), r["valid_to"].alias("valid_to"), src.alias("source"), r["props"].alias("props")))
        facts, closes, retracts = parts
        node = F.col("j.node")
        nodes = parsed.where(node.isNotNull())
        odd = nodes.where(node["id"].isNull() | (node["id"] < 0) | ~F.coalesce(node["label"].between(0, 31), F.lit(True)))
        if self._has["node"]:
            self._bad.append(odd.select("line", F.lit("a node needs an id, and a label from 0 to 31 if any").alias("problem")))
        if e := reduce(DataFrame.unionByName, self._bad).orderBy("line").first():
            raise ValueError(f"line {e['line'] + 1}: {e['problem']}")
        snap = self.snapshot()
        number = (F.lit(base) + F.col("line")).alias("ok")
        asked, new, many = [], [], None
        # what is already so is not written again
        if facts is not None:
            asked.append(facts.select("op"))
            many = fold.suppress_many(facts.where("op = 'AddMany'").drop("props"), snap.many_history.where("is_add"))
            new += [fold.suppress_one(facts.where("op = 'SetOne'").drop("props"), snap.one.where("object IS NOT NULL")), many]
        if self._has["props"]:
            props = facts.where("props IS NOT NULL").select("line", F.lit("SetEdgeProp").alias("op"), "subject", "predicate", "object", "source", F.explode("props").alias("key", "v")).withColumn("value", literal(F.col("v"))).drop("v")
            new.append(fold.suppress_rows(props, fold.edge_props(snap.log), ["subject", "predicate", "object", "key", "value"]))
        if closes is not None:
            asked.append(closes.select("op"))
            done = snap.one.where("object IS NULL").select("subject", "predicate", "object", "valid_from").unionByName(
                fold.heads(snap.many_history, [*fold.KEY, "object"]).where("NOT is_add").select("subject", "predicate", "object", "valid_from")
            )
            new.append(fold.suppress_rows(closes.drop("props"), done, ["subject", "predicate", "object", "valid_from"]))
        if retracts is not None:
            # a retract observes the adds of its element that were written before it, in the log or in this batch
            asked.append(retracts.select("op"))
            before = snap.many_history.where("is_add").select("subject", "predicate", "object", F.col("ok").alias("seen"))
            if many is not None:
                before = before.unionByName(many.select("subject", "predicate", "object", number.alias("seen")))
            gone = retracts.drop("props").withColumn("ok", number).join(before, ["subject", "predicate", "object"]).where("seen < ok")
            new.append(gone.groupBy("line", "op", "subject", "predicate", "object", "source").agg(F.collect_set("seen").alias("observed")))
        attrs = snap.attrs.withColumnRenamed("node", "subject")
        for what, op in (("type", "SetNodeType"), ("label", "SetNodeLabel")):
            if self._has[what]:
                rows = nodes.where(node[what].isNotNull()).select("line", F.lit(op).alias("op"), node["id"].alias("subject"), node[what].alias(what))
                asked.append(rows.select("op"))
                new.append(fold.suppress_rows(rows, attrs, ["subject", what]))
        whole = lambda df: df.withColumns({k: v for k, v in cols.items() if k not in df.columns}).withColumns({c: none(t) for c, t in (("subject", "bigint"), ("predicate", "string"), ("object", OBJECT), ("valid_from", "bigint"), ("valid_to", "bigint"), ("source", "string")) if c not in df.columns}).drop("props")
        self._asked = reduce(DataFrame.unionByName, asked) if asked else None
        if not new:
            return None
        names = "ok batch op subject predicate object valid_from valid_to source observed key value type label".split()
        return cut(reduce(DataFrame.unionByName, [whole(p).withColumn("ok", number).select(*names) for p in new]), "batch")

    def embed(self, lines: str | DataFrame) -> int:
        """Append {node, vector} lines (text, or a DataFrame with a column ``value``); all must have the dimension of the first vector ever received.

        Lines are parsed and checked in the executors; of a batch with a bad line nothing is written.
        """
        if isinstance(lines, str):
            df = self.spark.createDataFrame([(n, s) for n, s in enumerate(lines.splitlines()) if s.strip()], "line bigint, value string")
        else:
            df = lines.withColumn("line", F.monotonically_increasing_id()).select("line", "value").where("trim(value) <> ''")
        parsed = cut(df.select("line", F.from_json("value", "node bigint, vector array<float>").alias("j")).select("line", "j.node", "j.vector"), "vectors")
        first = parsed.where("vector IS NOT NULL").orderBy("line").select(F.size("vector")).first()
        dim = self.dim or (first[0] if first else None)
        bad = parsed.where(F.col("node").isNull() | F.col("vector").isNull() | (F.size("vector") != F.lit(dim)) | (F.size("vector") == 0) | F.exists("vector", lambda v: v.isNull())).orderBy("line").first()
        if bad:
            raise ValueError(f"line {bad['line'] + 1}: vector of node {bad['node']} has {len(bad['vector'] or [])} numbers, not {dim}")
        n = parsed.count()
        if n:
            start = self.embedded()
            path = f"{self.folder}/vectors-{len(self.vectors):06d}"
            parsed.select(F.col("node").alias("id"), (F.col("line") + start).alias("seqno"), F.col("vector").alias("x")).write.mode("overwrite").parquet(path)
            self.vectors, self.dim = [*self.vectors, path], dim
            self._commit()
        return n

    def embedded(self) -> int:
        """The order number that the next vector gets."""
        return (self.spark.read.parquet(*self.vectors).agg(F.max("seqno")).first()[0] + 1) if self.vectors else 0

    def build_index(self) -> dict:
        """Index the vectors received so far; trained quantizers are kept as long as they fit. Strict reads see what is indexed."""
        rows = self.embeddings()
        if not self.vectors:
            return {"rows": 0, "trained": False}
        self.ivf, self.index, trained = refresh(rows, self.ivf)
        self.indexed = self.embedded()
        self._commit()
        return {"rows": self.index.count(), "trained": trained}

    def compact(self) -> dict[str, int]:
        """Rewrite the log as one batch without rows that no read can see; history stays and reads do not change."""
        if self.batches:
            old, path = self.batches, f"{self.folder}/compact-{self.head}-{len(self.batches)}"
            fold.collect_garbage(self.log()).write.mode("overwrite").parquet(path)
            self.batches = [path]
            self._commit()
            for b in old:
                if b != path:
                    self.files.delete(b.rsplit("/", 1)[1])
        return {"covered": self.head}

    def reset(self) -> None:
        """Forget everything: an empty manifest is written first, then the files of old batches are removed."""
        old = [*self.batches, *self.vectors]
        self.batches, self.head, self.vectors, self.dim, self.indexed, self.removals, self.catalog = [], 0, [], None, 0, False, Catalog()
        self.ivf = self.index = None
        self._commit()
        for b in old:
            self.files.delete(b.rsplit("/", 1)[1])

    def stats(self) -> dict:
        got = {r["name"]: r["n"] for r in log_stats(self.snapshot(), self.embeddings()).collect()}
        index = None
        if self.ivf is not None and self.index is not None:
            trained, live, ratio = fit(self.index, self.ivf)
            index = {"rows": self.index.count(), "cells": len(self.ivf.centres), "fit_trained": trained, "fit_live": live, "drift": ratio}
        return {
            "durable_head": self.head, "rows": got["rows"], "subjects": got["subjects"], "types": len(self.catalog.types), "predicates": len(self.catalog.predicates), "rules": sorted(self.catalog.rules),
            "sources": sorted(self.catalog.sources), "labels": {int(k[6:]): n for k, n in got.items() if k.startswith("label:")}, "embeddings": got["embeddings"], "dim": self.dim, "bytes": self.files.bytes(), "index": index,
        }


def log_stats(snap: Snapshot, embeddings: DataFrame) -> DataFrame:
    """name, n: how much a snapshot holds, in one row per figure; labels in use are label:<number>."""
    log = snap.log.agg(F.count("*").alias("rows"), F.count_distinct("subject").alias("subjects"), F.count_distinct("predicate").alias("predicates"), F.count_distinct("source").alias("sources"), F.max("ok").alias("head"))
    figures = log.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("n")) for c in log.columns])).alias("x")).select("x.*")
    labels = snap.attrs.where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n")).select(F.concat(F.lit("label:"), F.col("label").cast("string")).alias("name"), "n")
    return figures.unionByName(labels).unionByName(embeddings.agg(F.lit("embeddings").alias("name"), F.count("*").alias("n")))


__all__ = ["LOG", "Store", "literal", "object_text", "typed"]
