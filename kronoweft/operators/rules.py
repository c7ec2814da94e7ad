"""Declared audit rules: conformance verdicts, their incremental maintenance, and completeness.

A rule is compiled into one aggregate over the subjects' own predicates and a join per further hop, one verdict row per
subject. An as-of hop is an as-of join at the subject's anchor instant.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kronoweft.model import object_text, visible
from kronoweft.operators import fold, temporal
from kronoweft.operators.fold import KEY, heads
from kronoweft.session import cut


@dataclass(frozen=True)
class Hop:
    predicate: str
    as_of: str | None = None  # an integer predicate of the subject


@dataclass(frozen=True)
class Condition:
    predicate: str
    equals: str  # kind:value


@dataclass(frozen=True)
class Rule:
    subject_type: str
    actual: str
    required: list[Hop] = field(default_factory=list)
    distinct_from: list[Hop] = field(default_factory=list)
    scope: Condition | None = None
    absent_when: Condition | None = None

    @classmethod
    def parse(cls, spec: dict) -> Rule:
        """A rule from its JSON form."""
        value = lambda v: next(f"{k}:{str(x).lower() if isinstance(x, bool) else x}" for k, x in (v.items() if isinstance(v, dict) else [("bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "text", v)]))
        cond = lambda c: Condition(c["predicate"], value(c["equals"])) if c else None
        hops = lambda hs: [Hop(h, None) if isinstance(h, str) else Hop(h["predicate"], h.get("as_of")) for h in hs or []]
        return cls(spec["subject"], spec["actual"], hops(spec.get("required")), hops(spec.get("distinct_from")), cond(spec.get("scope")), cond(spec.get("absent_when")))


def _paths(rule: Rule) -> list[tuple[str, list[Hop]]]:
    return [("required", rule.required), ("distinct_value", rule.distinct_from)]


def _own(rule: Rule) -> list[str]:
    """The predicates of the subject itself that a verdict reads, first hops left out."""
    conditions = [c.predicate for c in (rule.scope, rule.absent_when) if c]
    return sorted({rule.actual, *conditions, *(h.as_of for _, hops in _paths(rule) for h in hops if h.as_of)})


def _walked(rule: Rule, history: DataFrame, over: DataFrame) -> DataFrame:
    """For each subject its own current objects (own:<predicate>) and along each path the nodes that its hops start at and end in.

    The subject's own predicates are folded in one aggregate. A hop folds only the rows of the nodes it starts at, so
    judging few subjects reads few keys. For path p and hop i: p:<i> is the node it starts at, p the end, p_asof the
    instant of the last as-of hop, and p_probe the key of the last hop if that is an as-of hop.
    """
    firsts = {hops[0].predicate for _, hops in _paths(rule) if hops and hops[0].as_of is None}
    names = sorted({*_own(rule), *firsts})
    mine = history.where(F.col("predicate").isin(names)).join(over.select("subject").distinct(), "subject", "left_semi")
    heads_ = mine.groupBy("subject").agg(*[F.max_by("object", F.when(F.col("predicate") == n, F.col("ok"))).alias(f"own:{n}") for n in names])
    df = over.join(heads_, "subject", "left")
    none = F.lit(None)
    further = {h.predicate for _, hops in _paths(rule) for i, h in enumerate(hops) if i or h.as_of}
    if further:  # read once, however many hops there are
        history = cut(history.where(F.col("predicate").isin(sorted(further))).select(*KEY, "ok", "object", "valid_from", "valid_to", "source"), "hops")
    for name, hops in _paths(rule):
        node, asof, probe = name, f"{name}_asof", f"{name}_probe"
        df = df.withColumn(node, F.col("subject") if hops else none.cast("long")).withColumn(asof, none.cast("long")).withColumn(probe, none.cast("struct<subject:bigint,predicate:string>"))
        for i, h in enumerate(hops):
            df = df.withColumn(f"{name}:{i}", F.col(node))
            alive = F.col(node).isNotNull()
            if h.as_of is None and i == 0:
                df = df.withColumn(probe, F.when(~alive, F.col(probe))).withColumn(node, F.col(f"own:{h.predicate}.node"))
                continue
            df = cut(df, "walk") if h.as_of else df
            rows = history.where(F.col("predicate") == h.predicate).join(df.select(F.col(node).alias("subject")).where("subject IS NOT NULL").distinct(), "subject", "left_semi")
            if h.as_of is None:
                step = heads(rows).select(F.col("subject").alias("__n"), F.col("object.node").alias("__next"))
                df = df.join(step, df[node] == step["__n"], "left").drop("__n").withColumn(probe, F.when(~alive, F.col(probe)))
            else:
                at = F.col(f"own:{h.as_of}.i")
                df = df.withColumn(asof, F.when(alive, at).otherwise(F.col(asof)))
                df = df.withColumn(probe, F.when(alive, F.struct(F.col(node).alias("subject"), F.lit(h.predicate).alias("predicate"))).otherwise(F.col(probe)))
                asks = df.where(alive & at.isNotNull()).select(F.col(node).alias("subject"), F.lit(h.predicate).alias("predicate"), at.alias("at"), F.col("subject").alias("__s"))
                found = temporal.asof_lookup(asks, rows, "__s").select("__s", F.when(F.col("value").startswith("node:"), F.substring("value", 6, 30).cast("long")).alias("__next"))
                df = df.join(found, df["subject"] == found["__s"], "left").drop("__s")
            df = df.withColumn(node, F.col("__next")).drop("__next")
    return cut(df, "walk")


def subjects(attrs: DataFrame, node_type: str, mask: int) -> DataFrame:
    return attrs.where((F.col("type") == node_type) & visible(F.col("label"), mask)).select(F.col("node").alias("subject"))


def conformance(rule: Rule, history: DataFrame, over: DataFrame) -> DataFrame:
    """subject, verdict, kind, required, distinct_value, actual, as_of of each subject in ``over``.

    history: fold.one_history. Subjects out of scope are NOT_APPLICABLE; without an actual value they are ABSENT if the
    absence condition holds, else OK; an actual value that is not the required one is a MISMATCH (stale if the last,
    as-of hop ever held it, else wrong), as is one that equals the value it must differ from (wrong).
    """
    return _verdicts(rule, history, _walked(rule, history, over))


def judge(rule: Rule, history: DataFrame, over: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conformance and supports of the same subjects, from one walk."""
    walked = _walked(rule, history, over)
    return _verdicts(rule, history, walked), _supports(rule, walked)


def _verdicts(rule: Rule, history: DataFrame, df: DataFrame) -> DataFrame:
    df = df.withColumn("actual", F.col(f"own:{rule.actual}"))
    probes = df.where("required_probe IS NOT NULL AND actual.node IS NOT NULL").select("required_probe.subject", "required_probe.predicate", F.col("actual.node").alias("__v")).distinct()
    held = history.select("subject", "predicate", F.col("object.node").alias("__v")).join(probes, ["subject", "predicate", "__v"], "left_semi").distinct()
    held = held.select(F.struct("subject", "predicate").alias("__k"), "__v", F.lit(True).alias("__held"))
    df = df.join(held, (df["required_probe"] == held["__k"]) & (df["actual.node"] == held["__v"]), "left")
    test = lambda c, out: df.withColumn(out, object_text(f"own:{c.predicate}") if c else F.lit(None).cast("string"))
    df = test(rule.scope, "__scope")
    df = test(rule.absent_when, "__absent")
    in_scope = F.coalesce(F.col("__scope") == rule.scope.equals, F.lit(False)) if rule.scope else F.lit(True)
    gap = F.coalesce(F.col("__absent") == rule.absent_when.equals, F.lit(False)) if rule.absent_when else F.lit(False)
    present = F.col("actual").isNotNull()
    wrong = present & ~F.coalesce(F.col("actual.node") == F.col("required"), F.lit(False)) if rule.required else F.lit(False)
    clash = present & F.coalesce(F.col("actual.node") == F.col("distinct_value"), F.lit(False))
    verdict = F.when(~in_scope, "NOT_APPLICABLE").when(~present, F.when(gap, "ABSENT").otherwise("OK")).when(wrong | clash, "MISMATCH").otherwise("OK")
    kind = F.when(in_scope & wrong, F.when(F.coalesce("__held", F.lit(False)), "stale").otherwise("wrong")).when(in_scope & clash, "wrong")
    show = lambda c: F.when(in_scope, c)
    return df.select(
        "subject", verdict.alias("verdict"), kind.alias("kind"), show(F.col("required")).alias("required"), show(F.col("distinct_value")).alias("distinct_value"),
        show(object_text("actual")).alias("actual"), show(F.coalesce("required_asof", "distinct_value_asof")).alias("as_of"),
    )


def supports(rule: Rule, history: DataFrame, over: DataFrame) -> DataFrame:
    """subject, node, predicate: the keys that each subject's verdict reads (or would read next)."""
    return _supports(rule, _walked(rule, history, over))


def _supports(rule: Rule, df: DataFrame) -> DataFrame:
    own = F.transform(F.array(*map(F.lit, _own(rule))), lambda p: F.struct(F.col("subject").alias("node"), p.alias("predicate")))
    hops = [F.struct(F.col(f"{name}:{i}").alias("node"), F.lit(h.predicate).alias("predicate")) for name, hs in _paths(rule) for i, h in enumerate(hs)]
    return df.select("subject", F.explode(F.concat(own, F.array(*hops)) if hops else own).alias("k")).select("subject", "k.*").where("node IS NOT NULL").distinct()


def maintain(rule: Rule, before: DataFrame, support: DataFrame, history: DataFrame, over: DataFrame, touched: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(verdicts, diffs, support) after a write: only subjects whose support was touched, or without a verdict, are judged anew.

    before: verdicts so far; support: as ``supports`` gave it for them; touched: subject, predicate of written keys;
    history and over: after the write. diffs: subject, old_verdict, new_verdict where any part of the verdict changed.
    Of the history only the rows that the candidates' verdicts read are folded (``_walked``).
    """
    hit = support.join(touched.select(F.col("subject").alias("node"), "predicate"), ["node", "predicate"], "left_semi").select("subject").distinct()
    fresh = over.join(before.select("subject"), "subject", "left_anti")
    again = cut(hit.join(over, "subject", "left_semi").unionByName(fresh).distinct(), "candidates")
    new, rests = judge(rule, history, again)
    new = cut(new, "verdicts")
    gone = before.join(over, "subject", "left_anti").select("subject")
    keep = before.join(again, "subject", "left_anti").join(gone, "subject", "left_anti")
    left = support.join(again, "subject", "left_anti").join(gone, "subject", "left_anti").unionByName(rests)
    return keep.unionByName(new), diff(before.join(again.unionByName(gone), "subject", "left_semi"), new), left


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """subject, old_verdict, new_verdict where the verdict or its parts differ; NULL where there is none."""
    cols = ["verdict", "kind", "required", "distinct_value", "actual", "as_of"]
    a = old.select("subject", F.struct(*cols).alias("o"))
    b = new.select("subject", F.struct(*cols).alias("n"))
    j = a.join(b, "subject", "full").where(~F.col("o").eqNullSafe(F.col("n")))
    show = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws("/", F.col(f"{c}.verdict"), F.col(f"{c}.kind")))
    return j.select("subject", show("o").alias("old_verdict"), show("n").alias("new_verdict"))


def completeness(over: DataFrame, one: DataFrame, many_edges: DataFrame, required: list[str]) -> DataFrame:
    """node, missing (names in the order asked, joined by commas) of subjects without some required predicate.

    Present is a current value of a one-valued predicate, or a node-valued element of a many-valued one.
    """
    have = one.where(F.col("predicate").isin(required) & F.col("object").isNotNull()).select("subject", "predicate").unionByName(many_edges.where(F.col("predicate").isin(required)).select("subject", "predicate"))
    got = have.groupBy("subject").agg(F.collect_set("predicate").alias("got"))
    j = over.join(got, "subject", "left").withColumn("got", F.coalesce("got", F.array().cast("array<string>")))
    missing = F.array_except(F.array(*map(F.lit, required)), F.col("got"))
    return j.select(F.col("subject").alias("node"), F.array_join(missing, ",").alias("missing")).where("missing <> ''")


def maintain_completeness(before: DataFrame, over: DataFrame, log: DataFrame, touched: DataFrame, required: list[str], plain: bool = False) -> DataFrame:
    """Completeness after a write: only subjects whose required predicates were touched, or that are new, are looked at again.

    before: as ``completeness`` gave it; log: after the write, of which only the rows of those subjects are folded.
    """
    hit = over.join(touched.where(F.col("predicate").isin(required)).select("subject").distinct(), "subject", "left_semi")
    hit = cut(hit, "touched")
    part = log.where(F.col("predicate").isin(required)).join(hit, "subject", "left_semi")
    edges = fold.many(part, plain=plain).where(F.col("object.node").isNotNull()).select("subject", "predicate", F.col("object.node").alias("object"))
    again = completeness(hit, fold.one(part, plain=plain), edges, required)
    return before.join(hit.withColumnRenamed("subject", "node"), "node", "left_anti").join(over.withColumnRenamed("subject", "node"), "node", "left_semi").unionByName(again)
