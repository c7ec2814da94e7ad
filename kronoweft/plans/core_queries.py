"""One query per operator of the fact and graph engine, over whole tables, and the SQL that checks it."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kronoweft.functions import calendar
from kronoweft.model import node_, object_text, text_, visible
from kronoweft.operators import changefeed, confidence, fold, graph, lookup, rules, temporal, vectors
from kronoweft.operators.snapshot import Pipeline, Snapshot
from kronoweft.session import cut
from kronoweft.sources import bridge, catalog, store
from kronoweft.sources.tables import table
from kronoweft.streaming import live

AT = 1_750_000_000  # 2025-06-15, the instant of as-of queries
NOW = 1_790_000_000
YEAR = 365 * 86_400
MASK = 0b0101
SPLIT = "2026-01-01"  # arrivals before it are the base of incremental queries

#: A billing issue goes to whoever managed, at the time of approval, the department its approver was in at that time.
HANDOVER = rules.Rule(
    "Issue", "assigned-to", [rules.Hop("approved-by"), rules.Hop("member-of", "approved-at"), rules.Hop("manager-of", "approved-at")], [],
    rules.Condition("component", "text:billing"), rules.Condition("status", "text:blocked"),
)
SELF = rules.Rule("Issue", "approved-by", [], [rules.Hop("assigned-to")], rules.Condition("issue-type", "text:change"), rules.Condition("status", "text:closed"))
REQUIRED = ["title", "status", "assigned-to", "component"]


def _facts(spark: SparkSession, d: str) -> Snapshot:
    return Snapshot(bridge.facts(spark, d), bridge.attrs(spark, d), plain=True)


def _feed(spark: SparkSession, d: str) -> Snapshot:
    return Snapshot(bridge.feed(spark, d), seq=F.col("seq"))


def _ok(df: DataFrame) -> DataFrame:
    return df.withColumn("seq", F.col("ok.seq"))


def _show(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumn("object", object_text("object")).select(*cols)


# --- fold ---------------------------------------------------------------------------------------------------------


def fold_one_lww(spark, d):
    return _show(_ok(_feed(spark, d).one), "subject", "predicate", "object", "seq")


def fold_one_history(spark, d):
    return _show(_ok(_feed(spark, d).one_history.distinct()), "subject", "predicate", "object", "seq", "valid_from", "valid_to")


def fold_close_one(spark, d):
    return _ok(_feed(spark, d).one.where("object IS NULL")).select("subject", "predicate", "seq", F.col("valid_from").alias("closed_from"))


def fold_many_present(spark, d):
    return _show(_ok(_feed(spark, d).many), "subject", "predicate", "object", "seq")


def fold_close_many(spark, d):
    s = _feed(spark, d)
    h = fold.heads(s.many_history, [*fold.KEY, "object"]).where("NOT is_add")
    return _show(_ok(h).withColumnRenamed("valid_from", "closed_from"), "subject", "predicate", "object", "seq", "closed_from")


def fold_retract(spark, d):
    return _show(_ok(_feed(spark, d).many_history.where("is_add").distinct()), "subject", "predicate", "object", "seq")


def fold_hard_delete(spark, d):
    """Every change that is left above the floors."""
    return fold.live(bridge.feed(spark, d), [*fold.ONE, *fold.MANY]).select("subject", "predicate", "seq", "op").distinct()


def fold_multi_source(spark, d):
    log = bridge.feed(spark, d)
    parts = [log.where("source IS NULL"), log.where("source IN ('1', '2', '3')"), log.where("source > '2'")]
    return _show(_ok(fold.one(fold.merge(*reversed(parts)))), "subject", "predicate", "object", "seq")


def fold_idempotent(spark, d):
    log = bridge.feed(spark, d)
    return _show(_ok(fold.many(fold.merge(log, log), F.col("seq"))), "subject", "predicate", "object", "seq")


def compacted_state(spark, d):
    raw = table(spark, d, "record_feed")
    early = raw.where(F.col("arrived_at") < F.lit(SPLIT).cast("timestamp_ntz"))
    late = raw.where(F.col("arrived_at") >= F.lit(SPLIT).cast("timestamp_ntz"))
    return changefeed.current_values(late, base=changefeed.compact(early))


def edge_props_lww(spark, d):
    return _show(fold.edge_props(bridge.edge_props(spark, d)), "subject", "predicate", "object", "key", "value")


def edge_props_lookup(spark, d):
    return edge_props_lww(spark, d).where("predicate = 'works-on' AND key = 'role'")


def node_attrs_lww(spark, d):
    return fold.node_attrs(bridge.feed(spark, d))


def _halves(spark, d):
    log = bridge.facts(spark, d)
    at = F.lit(SPLIT).cast("timestamp_ntz")
    return log.where(F.col("arrived_at") < at), log.where(F.col("arrived_at") >= at)


def read_merge(spark, d):
    return _show(fold.one(fold.merge(*_halves(spark, d)), plain=True), "subject", "predicate", "object", "ok")


def observe_incremental(spark, d):
    base, tail = _halves(spark, d)
    return _show(fold.observe_incremental(fold.one(base, plain=True), base, tail, plain=True), "subject", "predicate", "object", "ok")


def late_arrival(spark, d):
    """Late facts are never dropped: they re-slice history, and take the head if they arrived last."""
    both = _facts(spark, d).one_history.groupBy(*fold.KEY).agg(F.max_by(F.struct("object", "valid_from"), "ok").alias("h"), F.max("valid_from").alias("newest"))
    return _show(both.select(*fold.KEY, "h.object", "h.valid_from", "newest").where("valid_from < newest"), "subject", "predicate", "object", "valid_from", "newest")


def suppress_noop(spark, d):
    base, tail = _halves(spark, d)
    batch = tail.where("op = 'SetOne'").withColumn("line", F.col("ok")).select("line", "subject", "predicate", "object", "valid_from", "valid_to", "source")
    return fold.suppress_one(batch, fold.one(base, plain=True)).select("line", "subject", "predicate")


def suppress_noop_many(spark, d):
    base, tail = _halves(spark, d)
    batch = tail.where("op = 'AddMany'").withColumn("line", F.col("ok")).select("line", "subject", "predicate", "object", "valid_from", "valid_to", "source")
    return fold.suppress_many(batch, fold.many_history(base, plain=True).where("is_add")).select("line", "subject", "predicate")


# --- point reads and timelines ------------------------------------------------------------------------------------


def point_one(spark, d):
    return _show(_facts(spark, d).one.where("object IS NOT NULL"), "subject", "predicate", "object", "valid_from", "source")


def point_asof(spark, d):
    return _show(temporal.asof_one(_facts(spark, d).one_history, AT), "subject", "predicate", "object", "valid_from")


def point_many(spark, d):
    return _show(_facts(spark, d).many, "subject", "predicate", "object")


def point_many_asof(spark, d):
    return _show(temporal.asof_many(_feed(spark, d).many_history, AT), "subject", "predicate", "object")


def closed_from(spark, d):
    one = _feed(spark, d).one
    return one.select("subject", "predicate", F.when(F.col("object").isNull(), F.col("valid_from")).alias("closed_from"))


def confidence_tier(spark, d):
    out = confidence.signals(_facts(spark, d).one_history, NOW, YEAR)
    return _show(out, "subject", "predicate", "object", "corroboration", "age", "tier")


def timeline(spark, d):
    return temporal.timeline(_facts(spark, d).one_history)


def timeline_derived(spark, d):
    hist = _facts(spark, d).one_history.where(F.col("predicate").isin("assigned-to", "member-of", "manager-of"))
    return temporal.derived_timeline(temporal.timeline(hist), ["assigned-to", "member-of", "manager-of"])


def timeline_confidence(spark, d):
    s = _facts(spark, d)
    edges = s.one.where(F.col("object.node").isNotNull())
    a = edges.where("predicate = 'assigned-to'").select("subject", F.col("subject").alias("node"), F.col("object.node").alias("next"))
    b = a.join(edges.where("predicate = 'member-of'").select(F.col("subject").alias("next"), F.lit(1).alias("has")), "next")
    support = a.select("subject", "node", F.lit("assigned-to").alias("predicate")).unionByName(b.select("subject", F.col("next").alias("node"), F.lit("member-of").alias("predicate")))
    return confidence.weakest(support, confidence.signals(s.one_history))


def asof_join(spark, d):
    s = _facts(spark, d)
    at = s.one.where("predicate = 'approved-at' AND object.i IS NOT NULL").select("subject", F.lit("status").alias("predicate"), F.col("object.i").alias("at"))
    return temporal.asof_join(at, temporal.timeline(s.one_history.where("predicate = 'status'")))


def describe_node(spark, d):
    s = _facts(spark, d)
    return lookup.describe(s.one_history, s.many, s.attrs, _node_vectors(spark, d), NOW, YEAR)


def schema_inventory(spark, d):
    return catalog.inventory(table(spark, d, "pred_defs"), bridge.attrs(spark, d), ["handover", "self-approval"])


# --- filters, scope and lookups -----------------------------------------------------------------------------------


def filter_has_type(spark, d):
    return bridge.attrs(spark, d).where("type = 'Issue'").select("node")


def filter_has_value(spark, d):
    s = _facts(spark, d)
    return s.attrs.select("node").join(s.one.where("predicate = 'priority' AND object IS NOT NULL").select(F.col("subject").alias("node")), "node", "left_semi")


def filter_int_cmp(spark, d):
    one = _facts(spark, d).one.where("predicate = 'estimate' AND object.i >= 13")
    return one.select(F.col("subject").alias("node"), F.col("object.i").alias("value"))


def filter_int_cmp_asof(spark, d):
    one = temporal.asof_one(_facts(spark, d).one_history, AT).where("predicate = 'priority' AND object.i < 3")
    return one.select(F.col("subject").alias("node"), F.col("object.i").alias("value"))


def authz_scope(spark, d):
    return bridge.attrs(spark, d).where(visible(F.col("label"), MASK)).select("node", "label")


def authz_point(spark, d):
    """Current values of visible subjects; node values out of scope are absent."""
    s = _facts(spark, d)
    hidden = s.attrs.where(~visible(F.col("label"), MASK)).select("node")
    one = s.one.where("object IS NOT NULL").join(hidden.withColumnRenamed("node", "subject"), "subject", "left_anti").withColumn("n", F.col("object.node"))
    return _show(one.join(hidden.withColumnRenamed("node", "n"), "n", "left_anti"), "subject", "predicate", "object")


def find_text(spark, d):
    s = _facts(spark, d)
    return lookup.find(s.one, s.many, "Audit", s.attrs, MASK)


def find_limited(spark, d):
    """The first 20 nodes that say "release", and whether there are more."""
    s = _facts(spark, d)
    return lookup.first_found(lookup.find(s.one, s.many, "release", s.attrs, MASK), 20)


def find_excerpt(spark, d):
    """Documents that mention a harbour, each with the place where it does; long texts are cut around it."""
    t = table(spark, d, "documents").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("text").alias("text"))
    rows = t.select(F.col("doc_id").alias("subject"), F.lit("text").alias("predicate"), text_(F.col("text")).alias("object"))
    return lookup.find(rows, rows.limit(0), "harbour")


def display_name(spark, d):
    return lookup.display_name(_facts(spark, d).one)


# --- graph --------------------------------------------------------------------------------------------------------


def _issues(s: Snapshot) -> DataFrame:
    return s.attrs.where("type = 'Issue'").select(F.col("node").alias("subject"))


def expand_1hop(spark, d):
    s = _facts(spark, d)
    return graph.expand(_issues(s), s.edges, "assigned-to")


def expand_asof(spark, d):
    s = _facts(spark, d)
    return graph.expand(_issues(s), s.edges_at(AT), "assigned-to")


def expand_2hop(spark, d):
    s = _facts(spark, d)
    return graph.two_hop(_issues(s), s.edges, "assigned-to", "member-of")


def expand_reverse(spark, d):
    s = _facts(spark, d)
    people = s.attrs.where("type = 'Department'").select(F.col("node").alias("subject"))
    return graph.expand(people, graph.reverse(s.edges), "member-of")


def expand_symmetric(spark, d):
    s = _facts(spark, d)
    start = s.attrs.select(F.col("node").alias("subject"))
    return graph.expand(start, s.edges, "works-on", graph.Relation(symmetric=True))


def expand_inverse(spark, d):
    s = _facts(spark, d)
    start = s.attrs.where("type = 'Department'").select(F.col("node").alias("subject"))
    return graph.expand(start, s.edges, "manager-of", graph.Relation(inverse="member-of"))


def expand_transitive(spark, d):
    tree = bridge.customer_tree(spark, d)
    e = tree.select(F.col("s").alias("subject"), F.lit("parent").alias("predicate"), F.col("o").alias("object"))
    start = table(spark, d, "customer").select(F.col("c_custkey").alias("subject"))
    return graph.expand(start, e, "parent", graph.Relation(transitive=True), max_depth=16)


def neighbors(spark, d):
    s = _facts(spark, d)
    return graph.neighbours(_issues(s), s.edges)


def neighborhood_khop(spark, d):
    """Nodes within two hops of node 7 in scope, at their depth."""
    s = _facts(spark, d)
    start = spark.createDataFrame([(7,)], "subject long")
    e = graph.scoped(s.edges, s.attrs, MASK)
    return graph.neighbourhood(start, e, 2, max_nodes=None)[0].select("node", "depth")


def neighborhood_edges(spark, d):
    s = _facts(spark, d)
    start = spark.createDataFrame([(7,)], "subject long")
    e = graph.scoped(s.edges, s.attrs, MASK)
    return graph.neighbourhood(start, e, 2, max_nodes=None)[1].select("a", "b", "strength")


def edge_strength(spark, d):
    return graph.strengths(_facts(spark, d).edges)


def graph_induced(spark, d):
    """Edges among the first 3000 visible nodes: the size of a whole-graph view."""
    s = _facts(spark, d)
    return graph.induced(s.edges, s.attrs, MASK, 3000)[1]


def overview_types(spark, d):
    return graph.overview_types(bridge.attrs(spark, d), MASK)


def overview_edges(spark, d):
    s = _facts(spark, d)
    return graph.overview_edges(s.edges, s.attrs, MASK)


def label_histogram(spark, d):
    return graph.label_histogram(bridge.attrs(spark, d))


def sources_inventory(spark, d):
    return bridge.facts(spark, d).where("source IS NOT NULL").select("source").distinct()


# --- vectors ------------------------------------------------------------------------------------------------------


def _emb(spark, d):
    """embeddings as vectors of nodes: type by label, scope label and order number by id."""
    e = table(spark, d, "embeddings")
    rows = e.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("seqno"), F.col("embedding").alias("x"))
    attrs = e.select(F.col("vec_id").alias("node"), F.concat(F.lit("T"), F.col("label").cast("string")).alias("type"), (F.col("vec_id") % 4).alias("label"))
    return rows, attrs, rows.where("id % 50 = 0")


def _near(df: DataFrame) -> DataFrame:
    return df.select("query", "id", F.round("dist", 4).alias("dist"), F.round("score", 4).alias("score"), "rank")


def knn_exact(spark, d):
    rows, _, queries = _emb(spark, d)
    return _near(vectors.knn(rows, queries))


def knn_typed(spark, d):
    rows, attrs, queries = _emb(spark, d)
    return _near(vectors.knn(vectors.scope(rows, attrs, "T3"), queries))


def knn_authz(spark, d):
    rows, attrs, queries = _emb(spark, d)
    return _near(vectors.knn(vectors.scope(rows, attrs, None, MASK), queries))


def knn_strict(spark, d):
    """Only what was indexed when four fifths of the order numbers had been given out."""
    rows, _, queries = _emb(spark, d)
    watermark = rows.agg(F.max("seqno")).first()[0] * 4 // 5
    return _near(vectors.knn(vectors.up_to(rows, watermark), queries))


def knn_fresh(spark, d):
    rows, _, queries = _emb(spark, d)
    return _near(vectors.knn(vectors.up_to(rows, None), queries, itself=False))


def topk_score(spark, d):
    e = table(spark, d, "events")
    return vectors.top_k(e.select(F.col("event_id").alias("id"), F.col("value").alias("score")), 100)


@lru_cache(maxsize=4)
def _trained(spark: SparkSession, d: str):
    ivf, indexed, _ = vectors.refresh(_emb(spark, d)[0], None)
    return ivf, indexed, vectors.calibrated_probes(indexed, ivf)


def ann_ivf(spark, d):
    ivf, indexed, probes = _trained(spark, d)
    return _near(vectors.search(indexed, ivf, _emb(spark, d)[2], probes=probes, rerank=128))


def ann_rerank(spark, d):
    ivf, indexed, probes = _trained(spark, d)
    return _near(vectors.search(indexed, ivf, _emb(spark, d)[2], probes=probes, rerank=256))


def ann_recall(spark, d):
    """Whether the searches over cells find nine tenths of the exact neighbours of their queries."""
    exact = knn_exact(spark, d).select("query", "id")
    parts = []
    for name, got in (("ann_ivf", ann_ivf(spark, d)), ("ann_rerank", ann_rerank(spark, d))):
        hit = got.select("query", "id", F.lit(1).alias("hit"))
        parts.append(exact.join(hit, ["query", "id"], "left").agg(F.lit(name).alias("search"), (F.sum("hit") >= 0.9 * F.count("*")).alias("reached")))
    return parts[0].unionByName(parts[1])


def ann_complete(spark, d):
    """Two probed cells, and the rest within a budget that holds all of it: the result is exact."""
    ivf, indexed, _ = _trained(spark, d)
    return _near(vectors.search_complete(indexed, ivf, _emb(spark, d)[2], probes=2, budget=indexed.count())[0])


def ann_budget(spark, d):
    """With a tenth of the rows as budget no query scores more of the tail, each leaves some out, and all have k results."""
    ivf, indexed, _ = _trained(spark, d)
    budget = indexed.count() // 10
    found, told = vectors.search_complete(indexed, ivf, _emb(spark, d)[2], probes=2, budget=budget)
    return told.select("query", (F.col("tail") <= budget).alias("within"), "left_out").join(found.groupBy("query").agg(F.count("*").alias("n")), "query")


def ann_reuse(spark, d):
    """Quantizers trained on half of the rows are kept for the same rows with a few more, and trained anew when rows double."""
    rows = _emb(spark, d)[0]
    first = vectors.Ivf.train(rows.where("id % 2 = 0"))
    more, all_ = (vectors.refresh(rows.where(c), first)[2] for c in ("id % 2 = 0 OR id % 20 = 1", "true"))
    return spark.createDataFrame([("a few more", more), ("twice as many", all_)], "rows string, trained_anew boolean")


def ann_fit(spark, d):
    ivf, indexed, _ = _trained(spark, d)
    return spark.createDataFrame([vectors.fit(indexed, ivf)], "trained double, live double, ratio double")


def _node_vectors(spark, d) -> DataFrame:
    return vectors.latest(vectors.sound(table(spark, d, "vector_rows"), 32))


def _pipeline(spark, d) -> Pipeline:
    s = _facts(spark, d)
    s.embeddings = _node_vectors(spark, d)
    return Pipeline(s, mask=MASK)


def search_expand(spark, d):
    """The 10 visible vectors of a type nearest to vector 0, then the customers they lead to, capped at 100."""
    rows, attrs, _ = _emb(spark, d)
    c = table(spark, d, "customer")
    log = c.select(F.col("c_custkey").alias("ok"), F.lit("AddMany").alias("op"), (F.col("c_custkey") % 500).alias("subject"), F.lit("leads-to").alias("predicate"), node_(F.col("c_custkey") + 1_000_000).alias("object"))
    log = log.withColumns({"valid_from": F.lit(0).cast("long"), "valid_to": F.lit(None).cast("long"), "source": F.lit(None).cast("string"), "observed": F.lit(None).cast("array<bigint>")})
    s = Snapshot(log, attrs, rows, plain=True)
    vector = rows.where("id = 0").first()["x"]
    return Pipeline(s, mask=MASK, max_nodes=100).similar_to(list(vector), "T3", 10).expand("leads-to").df


def pipeline_similar(spark, d):
    first = _node_vectors(spark, d).agg(F.min("id")).first()[0]
    return _pipeline(spark, d).similar(first, 25).df.select("id", F.round("score", 4).alias("score"), "ord")


def pipeline_compose(spark, d):
    """Who is assigned to an issue with a low priority number whose title is known, over all issues."""
    s = _facts(spark, d)
    p = Pipeline(s, mask=MASK, max_nodes=None).nodes(s.attrs.where("type = 'Issue'")).has_value("title").int_cmp("priority", "<=", 2).expand("assigned-to").filter_type("Person")
    return p.df.select("id", "score")


def pipeline_cap(spark, d):
    """The cap is the feature: 100 issues in the order of their ids, what they lead to, and the first 10 of that."""
    s = _facts(spark, d)
    return Pipeline(s, max_nodes=100).nodes(s.attrs.where("type = 'Issue'")).expand("in-project").cap(10).df.select("id", "ord")


def retrieve_context(spark, d):
    """From a search to the lines of a block: the 25 nodes nearest to the first node, with what they are called and when approved, in the block's order."""
    s = _facts(spark, d)
    hits = pipeline_similar(spark, d).select(F.col("id").alias("node"), "score")
    text = lookup.display_name(s.one).withColumnRenamed("name", "content")
    when = s.one.where("predicate = 'approved-at'").select(F.col("subject").alias("node"), F.col("object.i").alias("date"))
    lines = lookup.context(hits.join(text, "node", "left").join(when, "node", "left"), AT, offset_min=540, start_month=4)
    place = F.row_number().over(Window.orderBy(*lookup.in_order(lines)))  # over k hits
    return lines.select(place.alias("place"), "node", "date", "stamp", "line")


def context_lines(spark, d):
    """Every document with the calendar line that goes into a context block."""
    docs = table(spark, d, "documents")
    date = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("crawled_at").cast("timestamp_ntz"))
    hits = docs.select(F.col("doc_id").alias("node"), F.lit(1.0).alias("score"), date.alias("date"), F.col("text").alias("content"))
    return lookup.context(hits, AT, offset_min=540, start_month=4).select("node", "date", "stamp", "line")


def calendar_stamp(spark, d):
    t = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("o_orderdate").cast("timestamp_ntz")) + F.col("o_orderkey") % 86_400
    o = table(spark, d, "orders").select("o_orderkey", t.alias("t"))
    c, m = F.col("t"), -210
    return o.select(
        "o_orderkey", "t", calendar.iso(c, m).alias("iso"), calendar.weekday(c, m).alias("weekday"), calendar.business_hours(c, m).alias("business"),
        calendar.fiscal_year(c, m, 4).alias("fiscal_year"), calendar.fiscal_quarter(c, m, 4).alias("fiscal_quarter"), calendar.relative_days(c, F.lit(900_000_000), m).alias("rel_days"),
    )


# --- rules --------------------------------------------------------------------------------------------------------


def conformance_verdicts(spark, d):
    s = _facts(spark, d)
    return rules.conformance(HANDOVER, s.one_history, rules.subjects(s.attrs, "Issue", MASK))


def conformance_distinct(spark, d):
    s = _facts(spark, d)
    return rules.conformance(SELF, s.one_history, rules.subjects(s.attrs, "Issue", MASK))


def completeness(spark, d):
    s = _facts(spark, d)
    return rules.completeness(rules.subjects(s.attrs, "Issue", MASK), s.one, graph.edges(s.many), REQUIRED)


def _maintained(spark, d):
    base, tail = _halves(spark, d)
    over = rules.subjects(bridge.attrs(spark, d), "Issue", MASK)
    old = fold.one_history(base, plain=True)
    before, support = (cut(x, "before") for x in rules.judge(HANDOVER, old, over))
    return rules.maintain(HANDOVER, before, support, fold.one_history(fold.merge(base, tail), plain=True), over, fold.touched(tail))


def conformance_incremental(spark, d):
    return _maintained(spark, d)[0]


def conformance_changes(spark, d):
    return _maintained(spark, d)[1]


def live_diff(spark, d):
    """What a registered query (what is in effect at an instant) gained and lost with the tail."""
    base, tail = _halves(spark, d)
    logs, told = [base], []
    live_queries = live.LiveQueries()
    live_queries.register(lambda: _show(temporal.asof_one(fold.one_history(logs[-1], plain=True), AT), "subject", "predicate", "object"), lambda added, removed: told.append((added, removed)))
    logs.append(fold.merge(base, tail))
    live_queries.changed()
    if not told:
        return spark.createDataFrame([], "subject long, predicate string, object string, change string")
    added, removed = told[0]
    return added.withColumn("change", F.lit("added")).unionByName(removed.withColumn("change", F.lit("removed")))


def live_completeness(spark, d):
    """Completeness kept by key: only nodes whose required predicates the tail touched are looked at again."""
    base, tail = _halves(spark, d)
    over = rules.subjects(bridge.attrs(spark, d), "Issue", MASK)
    old = Snapshot(base, plain=True)
    before = rules.completeness(over, old.one, graph.edges(old.many), REQUIRED)
    return rules.maintain_completeness(before, over, fold.merge(base, tail), fold.touched(tail), REQUIRED, plain=True)


# --- sources ------------------------------------------------------------------------------------------------------


def csv_facts(spark, d):
    """customer compiled to facts by column roles, with deterministic node ids."""
    from kronoweft.sources import csvfacts

    roles = {"c_custkey": csvfacts.Role("id"), "c_name": csvfacts.Role("literal"), "c_nationkey": csvfacts.Role("edge", target="Nation"), "c_mktsegment": csvfacts.Role("literal")}
    f = csvfacts.compile_facts(table(spark, d, "customer").select(*[F.col(c).cast("string").alias(c) for c in roles]), "Customer", roles)
    return _show(f, "subject", "predicate", "object")


def store_stats(spark, d):
    return store.log_stats(_facts(spark, d), _node_vectors(spark, d))


def validate_facts(spark, d):
    """Facts that break their predicate's declared domain or range: opt-in, and open-world for untyped nodes."""
    bad = catalog.violations(bridge.facts(spark, d), table(spark, d, "pred_defs"), bridge.attrs(spark, d))
    return bad.select("ok", "predicate", "problem")


def stream_fold(spark, d):
    return live.stream_current_values(spark, f"{d}/record_feed.parquet")


NAMES = """fold_one_lww fold_one_history fold_close_one fold_many_present fold_close_many fold_retract fold_hard_delete fold_multi_source fold_idempotent
compacted_state edge_props_lww edge_props_lookup node_attrs_lww read_merge observe_incremental late_arrival suppress_noop suppress_noop_many
point_one point_asof point_many point_many_asof closed_from confidence_tier timeline timeline_derived timeline_confidence asof_join describe_node schema_inventory
filter_has_type filter_has_value filter_int_cmp filter_int_cmp_asof authz_scope authz_point find_text find_limited find_excerpt display_name
expand_1hop expand_asof expand_2hop expand_reverse expand_symmetric expand_inverse expand_transitive neighbors neighborhood_khop neighborhood_edges edge_strength
graph_induced overview_types overview_edges label_histogram sources_inventory
knn_exact knn_typed knn_authz knn_strict knn_fresh topk_score ann_ivf ann_rerank ann_recall ann_complete ann_budget ann_reuse ann_fit search_expand pipeline_similar pipeline_compose pipeline_cap
retrieve_context context_lines calendar_stamp conformance_verdicts conformance_distinct completeness conformance_incremental conformance_changes live_diff live_completeness
csv_facts store_stats validate_facts stream_fold""".split()

QUERIES = {n: globals()[n] for n in NAMES}

from kronoweft.plans.core_sql import SQL  # noqa: E402, F401
