"""The engine's operations as dictionaries: {"op": ..., ...} in, plain values out.

Each operation builds a DataFrame over the current snapshot and collects a result that its request bounds (one
subject, a limit or a cap of nodes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kronoweft.model import ALL_LABELS, object_text, visible
from kronoweft.operators import confidence, graph, lookup, rules, temporal
from kronoweft.operators.graph import Relation
from kronoweft.operators.snapshot import Pipeline
from kronoweft.sources.store import Store
from kronoweft.streaming.live import Watch

KINDS = ["node", "int", "float", "text", "bool"]


def value(o) -> dict | None:
    """An object as {kind: value}."""
    return None if o is None else {KINDS[o["kind"]]: o[["node", "i", "f", "t", "b"][o["kind"]]]}


class Engine:
    def __init__(self, store: Store, scope: int = ALL_LABELS):
        self.store, self.scope = store, scope
        self.refresh()
        self.watches: dict[str, Watch] = {}

    def refresh(self) -> None:
        self.snap = self.store.snapshot()

    def ingest(self, lines: str, source: str | None = None) -> dict:
        before = self.store.head
        out = self.store.ingest(lines, source)
        self.refresh()
        if self.watches and self.store.head > before:
            new = self.snap.log.where(F.col("ok") > before)
            keys = new.where("predicate IS NOT NULL").select("subject", "predicate").distinct()
            for w in self.watches.values():
                w.apply(keys, self.store.head)
        return out

    def embed(self, lines: str) -> int:
        n = self.store.embed(lines)
        self.refresh()
        return n

    def query(self, req: dict):
        op = req.get("op", "")
        fn = getattr(self, f"_op_{op}", None)
        if fn is None:
            raise ValueError(f"unknown op: {op}")
        return fn(req, req.get("allowed_labels", ALL_LABELS) & self.scope)

    # --- helpers

    def _predicate(self, name: str | None):
        if not name:
            raise ValueError("predicate required")
        return self.store.catalog.predicate(name)

    def _relation(self, name: str) -> Relation:
        r = self._predicate(name).relation
        if r.inverse is None:
            back = next((p.name for p in self.store.catalog.predicates.values() if p.inverse == name), None)
            r = Relation(r.symmetric, r.transitive, back)
        return r

    def _hidden(self, mask: int) -> DataFrame:
        return self.snap.attrs.where(~visible(F.col("label"), mask)).select("node")

    def _denied(self, node: int, mask: int) -> bool:
        return not self._hidden(mask).where(F.col("node") == node).isEmpty()

    def _names(self) -> DataFrame:
        return lookup.display_name(self.snap.one, [p.name for p in self.store.catalog.predicates.values() if p.display])

    def _start(self, node: int) -> DataFrame:
        return self.store.spark.createDataFrame([(node,)], "subject long")

    # --- reads

    def _op_point(self, req, mask):
        s, p, at = req["subject"], self._predicate(req.get("predicate")), req.get("valid_at")
        if self._denied(s, mask):
            return {"denied": True}
        here = (F.col("subject") == s) & (F.col("predicate") == p.name)
        shown = lambda o: o is not None and (o["kind"] != 0 or not self._denied(o["node"], mask))
        if p.cardinality == "one":
            hist = self.snap.one_history.where(here)
            if at is not None:
                r = temporal.asof_one(hist, at).first()
                return {"one": value(r["object"]) if r and shown(r["object"]) else None, "valid_at": at}
            r = confidence.signals(hist, req.get("now"), req.get("max_age")).first()
            if r is None:
                return {"one": None}
            if r["object"] is None:
                return {"one": None, "closed_from": r["valid_from"]}
            if not shown(r["object"]):
                return {"one": None}
            out = {"one": value(r["object"]), "valid_from": r["valid_from"], "confidence": {"tier": r["tier"], "corroboration": r["corroboration"], "age": r["age"]}}
            return out | ({"provenance": r["source"]} if r["source"] else {})
        rows = self.snap.many.where(here) if at is None else temporal.asof_many(self.snap.many_history.where(here), at)
        found = [value(r["object"]) for r in rows.orderBy("object").collect() if shown(r["object"])]
        return {"many": found} | ({"valid_at": at} if at is not None else {})

    def _op_expand(self, req, mask):
        s, at, p = req["subject"], req.get("valid_at"), self._predicate(req.get("predicate"))
        if self._denied(s, mask):
            return {"denied": True}
        e = self.snap.edges if at is None else self.snap.edges_at(at)
        found = graph.expand(self._start(s), e, p.name, self._relation(p.name), req.get("max_depth", 16)).join(self._hidden(mask), "node", "left_anti")
        return {"nodes": sorted({r["node"] for r in found.select("node").collect()})} | ({"valid_at": at} if at is not None else {})

    def _op_timeline(self, req, mask):
        hops = [self._predicate(h).name for h in req.get("hops") or []]
        if not hops:
            raise ValueError("hops required")
        if self._denied(req["subject"], mask):
            return {"denied": True}
        lines = temporal.timeline(self.snap.one_history.where(F.col("predicate").isin(hops)))
        first = lines.where((F.col("predicate") != hops[0]) | (F.col("subject") == req["subject"]))
        out = temporal.derived_timeline(first, hops).where(F.col("subject") == req["subject"]).orderBy("valid_from").collect()
        hidden = {r[0] for r in self._hidden(mask).where(F.col("node").isin([int(r["value"][5:]) for r in out if r["value"].startswith("node:")])).collect()}
        segs = [{"value": self._parsed(r["value"]), "valid_from": r["valid_from"], "valid_to": r["valid_to"]} for r in out if not (r["value"].startswith("node:") and int(r["value"][5:]) in hidden)]
        return {"segments": segs}

    @staticmethod
    def _parsed(text: str) -> dict:
        kind, _, v = text.partition(":")
        return {kind: {"node": int, "int": int, "float": float, "bool": lambda x: x == "true"}.get(kind, str)(v)}

    def _op_edge_props(self, req, mask):
        from kronoweft.operators import fold

        node = req["object"]["node"] if isinstance(req["object"], dict) else req["object"]
        rows = fold.edge_props(self.snap.log).where((F.col("subject") == req["subject"]) & (F.col("predicate") == req["predicate"]) & (F.col("object.node") == node))
        return {"props": {r["key"]: value(r["value"]) for r in rows.collect()}}

    def _search(self, req, mask) -> Pipeline:
        p = Pipeline(self.snap, mask=mask, max_nodes=req.get("max_nodes", 100))
        # a strict search sees what was indexed, a fresh one (the default) all vectors
        p = p.similar_to(req["vector"], req["type"], req.get("k", 10), self.store.indexed if req.get("strict") else None)
        return p.expand(req["expand"], self._relation(req["expand"])) if req.get("expand") else p

    def _as_of(self) -> dict:
        return {"changelog": self.store.head, "vector": self.snap.embeddings.count()}

    def _op_search(self, req, mask):
        rows = self._search(req, mask).df.orderBy("ord").collect()
        return {"ids": [r["id"] for r in rows], "scores": [r["score"] for r in rows], "as_of": self._as_of()}

    def _op_retrieve_context(self, req, mask):
        content, date = self._predicate(req.get("content")).name, self._predicate(req["date"]).name if req.get("date") else None
        hits = self._search(req, mask).df.select(F.col("id").alias("node"), "score")
        text = self.snap.one.where(F.col("predicate") == content).select(F.col("subject").alias("node"), F.col("object.t").alias("content"))
        when = self.snap.one.where(F.col("predicate") == date).select(F.col("subject").alias("node"), F.col("object.i").alias("date"))
        frame = {"offset_min": req.get("tz_offset_min", 0), "start_min": req.get("business_start_min", 540), "end_min": req.get("business_end_min", 1080), "start_month": req.get("fiscal_year_start_month", 1)}
        lines = lookup.context(hits.join(text, "node", "left").join(when, "node", "left"), req.get("as_of"), **frame)
        rows = lines.orderBy(*lookup.in_order(lines)).collect()
        shown = [{"node": r["node"], "score": r["score"], "date": r["date"], "stamp": r["stamp"], "content": r["content"] or ""} for r in rows]
        return {"context": lookup.context_block([r["line"] for r in rows]), "hits": shown, "as_of": rows[0]["as_of"] if rows else req.get("as_of", 0)}

    def _op_find(self, req, mask):
        limit = req.get("limit", 20)
        rows = lookup.find(self.snap.one, self.snap.many, req.get("text", ""), self.snap.attrs, mask).join(self._names(), "node", "left").join(self.snap.attrs.select("node", "type"), "node", "left")
        got = lookup.first_found(rows, limit).orderBy("node").collect()
        return {"nodes": [{"id": r["node"], "name": r["name"], "type": r["type"], "matched": {"predicate": r["predicate"], "value": r["value"]}} for r in got], "truncated": bool(got) and got[0]["truncated"]}

    def _op_neighborhood(self, req, mask):
        if self._denied(req["subject"], mask):
            return {"nodes": [], "edges": []}
        e = graph.scoped(self.snap.edges, self.snap.attrs, mask)
        if req.get("predicate"):
            e = e.where(F.col("predicate") == self._predicate(req["predicate"]).name)
        nodes, edges = graph.neighbourhood(self._start(req["subject"]), e, req.get("hops", 2), req.get("max_nodes", 3000))
        rows = nodes.join(self._names(), "node", "left").orderBy("depth", "node").collect()
        return {"nodes": [{"id": r["node"], "depth": r["depth"], "name": r["name"]} for r in rows], "edges": sorted([r["a"], r["b"], r["strength"]] for r in edges.collect()), "focus": req["subject"]}

    def _op_node(self, req, mask):
        s = req["subject"]
        if self._denied(s, mask):
            return {"id": s, "denied": True}
        a = self.snap.attrs.where(F.col("node") == s).first()
        hidden = self._hidden(mask)
        one = confidence.signals(self.snap.one_history.where(F.col("subject") == s)).where("object IS NOT NULL").withColumn("n", F.col("object.node")).join(hidden.withColumnRenamed("node", "n"), "n", "left_anti")
        many = self.snap.many.where(F.col("subject") == s).withColumn("n", F.col("object.node")).join(hidden.withColumnRenamed("node", "n"), "n", "left_anti")
        props: dict = {r["predicate"]: {"one": value(r["object"]), "source": r["source"], "tier": r["tier"]} for r in one.collect()}
        for r in many.orderBy("predicate", "object").collect():
            props.setdefault(r["predicate"], {"many": []})["many"].append(value(r["object"]))
        v = self.snap.embeddings.where(F.col("id") == s).first()
        return {"id": s, "type": a and a["type"], "label": a and a["label"], "props": props, "embedding": v is not None, "dim": self.store.dim}

    def _op_graph(self, req, mask):
        nodes, edges, cut_off = graph.induced(self.snap.edges, self.snap.attrs, mask, req.get("max_nodes", 3000))
        rows = nodes.join(self._names(), "node", "left").join(self.snap.attrs.select("node", "type"), "node", "left").orderBy("node").collect()
        return {"nodes": [{"id": r["node"], "name": r["name"], "type": r["type"]} for r in rows], "edges": sorted([r["a"], r["b"]] for r in edges.collect()), "truncated": cut_off}

    def _op_overview(self, req, mask):
        types = graph.overview_types(self.snap.attrs, mask).orderBy("type").collect()
        edges = graph.overview_edges(self.snap.edges, self.snap.attrs, mask).collect()
        return {"nodes": [{"id": n, "name": r["type"], "count": r["n"], "sample": r["sample"]} for n, r in enumerate(types)], "edges": sorted([r["type_a"], r["type_b"], r["n"]] for r in edges), "overview": True}

    def _op_schema(self, req, mask):
        c = self.store.catalog
        preds = [{"name": p.name, "card": p.cardinality, "domain": p.domain, "range": p.range or p.range_value, "display": p.display} for p in sorted(c.predicates.values(), key=lambda p: p.name)]
        return {"predicates": preds, "labels": sorted(r[0] for r in self.snap.attrs.where("label IS NOT NULL").select("label").distinct().collect()), "rules": sorted(c.rules)}

    def _op_pipeline(self, req, mask):
        p = Pipeline(self.snap, mask=mask, max_nodes=req.get("max_nodes", 3000))
        src = req["source"]
        if "nodes" in src:
            p = p.nodes(src["nodes"])
        elif "similar" in src:
            p = p.similar(src["similar"]["node"], src["similar"].get("k", 10))
        else:
            a = src["type_ann"]
            p = p.similar_to(a["vector"], a["type"], a.get("k", 10))
        for step in req.get("steps") or []:
            (name, arg), = step.items()
            if name == "expand":
                p = p.expand(arg, self._relation(arg))
            elif name in ("filter_type", "has_value", "top_k"):
                p = getattr(p, name)(arg)
            elif name == "int_cmp":
                p = p.int_cmp(arg["predicate"], arg["cmp"], arg["value"], arg.get("valid_at"))
            else:
                raise ValueError(f"unknown step: {name}")
        rows = p.df.join(self._names().withColumnRenamed("node", "id"), "id", "left").orderBy("ord").collect()
        return {"ids": [r["id"] for r in rows], "nodes": [{"id": r["id"], "name": r["name"]} for r in rows]}

    # --- rules

    def _rule(self, req) -> rules.Rule:
        spec = req.get("rule")
        if spec is None:
            name = req.get("rule_name")
            if name not in self.store.catalog.rules:
                raise ValueError(f"unknown rule: {name}")
            spec = self.store.catalog.rules[name]
        rule = rules.Rule.parse(spec)
        names = {rule.actual, *(h.predicate for h in [*rule.required, *rule.distinct_from]), *(h.as_of for h in [*rule.required, *rule.distinct_from] if h.as_of), *(c.predicate for c in (rule.scope, rule.absent_when) if c)}
        for n in names:
            self._predicate(n)
        if rule.subject_type not in self.store.catalog.types:
            raise ValueError(f"unknown type: {rule.subject_type}")
        return rule

    @staticmethod
    def _verdicts(df: DataFrame) -> list[dict]:
        return [r.asDict() for r in df.orderBy("subject").collect()]

    def _op_conformance(self, req, mask):
        rule = self._rule(req)
        return {"verdicts": self._verdicts(rules.conformance(rule, self.snap.one_history, rules.subjects(self.snap.attrs, rule.subject_type, mask)))}

    def _op_completeness(self, req, mask):
        need = [self._predicate(p).name for p in req["required"]]
        rows = rules.completeness(rules.subjects(self.snap.attrs, req["type"], mask), self.snap.one, graph.edges(self.snap.many), need)
        return {"incomplete": [{"node": r["node"], "missing": r["missing"].split(",")} for r in rows.orderBy("node").collect()]}

    def _op_conformance_watch(self, req, mask):
        name, rule = req["rule_name"], self._rule(req)
        if name not in self.watches:
            self.watches[name] = Watch(rule, lambda: self.snap.one_history, lambda: rules.subjects(self.snap.attrs, rule.subject_type, ALL_LABELS), head=self.store.head)
        w = self.watches[name]
        seen = w.verdicts.join(self._hidden(mask).withColumnRenamed("node", "subject"), "subject", "left_anti")
        return {"verdicts": self._verdicts(seen), "cursor": w.head}

    def _op_conformance_changes(self, req, mask):
        if req["rule_name"] not in self.watches:
            raise ValueError(f"rule is not watched: {req['rule_name']}")
        out = self.watches[req["rule_name"]].changes(req["cursor"], self._hidden(mask))
        if "resync" in out:
            return out
        rows = out["changes"].orderBy("head", "subject").collect() if out["changes"] is not None else []
        return {"changes": [{"subject": r["subject"], "old": r["old_verdict"], "new": r["new_verdict"]} for r in rows], "cursor": out["cursor"]}

    # --- upkeep

    def _op_stats(self, req, mask):
        return self.store.stats()

    def _op_index(self, req, mask):
        return self.store.build_index()

    def _op_compact(self, req, mask):
        out = self.store.compact()
        self.refresh()
        return out

    def _op_reset(self, req, mask):
        self.store.reset()
        self.watches.clear()
        self.refresh()
        return {}


__all__ = ["Engine", "object_text"]
