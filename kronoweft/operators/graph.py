"""Traversal of node-valued facts: expansion with relation properties, neighbourhoods, strengths and overviews.

edges: subject, predicate, object (node id). Traversals keep their visited pairs as tables in the shared folder, so
each hop reads the last one's result and the plan does not grow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kronoweft.model import visible
from kronoweft.session import cut, table_path


@dataclass(frozen=True)
class Relation:
    """What a predicate's declaration says of its edges."""

    symmetric: bool = False
    transitive: bool = False
    inverse: str | None = None

    @property
    def plain(self) -> bool:
        return not (self.symmetric or self.transitive or self.inverse)


def edges(*states: DataFrame) -> DataFrame:
    """subject, predicate, object of all node-valued rows of states (current or as-of, one or many)."""
    parts = [s.where(F.col("object.node").isNotNull()).select("subject", "predicate", F.col("object.node").alias("object")) for s in states]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def reverse(e: DataFrame) -> DataFrame:
    return e.select(F.col("object").alias("subject"), "predicate", F.col("subject").alias("object"))


def relation_edges(e: DataFrame, predicate: str, rel: Relation = Relation()) -> DataFrame:
    """subject, object: the edges that one step along a predicate may take."""
    out = e.where(F.col("predicate") == predicate)
    if rel.symmetric:
        out = out.unionByName(reverse(out))
    if rel.inverse:
        out = out.unionByName(reverse(e.where(F.col("predicate") == rel.inverse)))
    return out.select("subject", "object").distinct()


def expand(start: DataFrame, e: DataFrame, predicate: str, rel: Relation = Relation(), max_depth: int = 16) -> DataFrame:
    """subject, node (and depth if transitive) reached from each start node. start: subject.

    A predicate without properties takes one step whatever the depth; a transitive one takes 1 to max_depth steps,
    and reaches its start only through a cycle.
    """
    step = relation_edges(e, predicate, rel)
    if not rel.transitive:
        return start.select("subject").distinct().join(step, "subject").select("subject", F.col("object").alias("node"))
    return closure(start, step, max_depth)


def closure(start: DataFrame, step: DataFrame, max_depth: int = 16) -> DataFrame:
    """subject, node, depth: all nodes within max_depth steps of each start, at their least depth.

    Each hop is written, as a part of the one table of all that has been seen, and counted in one job. It is anti-joined
    with that table, of which only the columns of the pair are read.
    """
    spark = start.sparkSession
    step = cut(step.select(F.col("subject").alias("node"), F.col("object").alias("next")).distinct(), "steps")
    frontier = start.select("subject", F.col("subject").alias("node")).distinct()
    path, empty = table_path(spark, "closure"), spark.createDataFrame([], "subject long, node long, depth int")
    for depth in range(1, max_depth + 1):
        new = frontier.join(step, "node").select("subject", F.col("next").alias("node"))
        if depth > 1:
            new = new.join(spark.read.schema(empty.schema).parquet(path).select("subject", "node"), ["subject", "node"], "left_anti")
        grown = Observation()
        new.distinct().observe(grown, F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/depth={depth}")
        if not grown.get["n"]:
            break
        frontier = spark.read.schema("subject long, node long").parquet(f"{path}/depth={depth}")
    return spark.read.schema(empty.schema).parquet(path) if max_depth > 0 else empty


def neighbours(start: DataFrame, e: DataFrame) -> DataFrame:
    """subject, node over all predicates."""
    return start.select("subject").distinct().join(e, "subject").select("subject", F.col("object").alias("node")).distinct()


def two_hop(start: DataFrame, e: DataFrame, first: str, second: str) -> DataFrame:
    mid = expand(start, e, first)
    step = relation_edges(e, second).select(F.col("subject").alias("node"), "object")
    return mid.join(step, "node").select("subject", F.col("object").alias("node")).distinct()


def undirected(e: DataFrame) -> DataFrame:
    """a, b with both directions of each edge, loops included."""
    return e.select(F.col("subject").alias("a"), F.col("object").alias("b")).unionByName(e.select(F.col("object").alias("a"), F.col("subject").alias("b"))).distinct()


def strengths(e: DataFrame) -> DataFrame:
    """a < b, strength: the number of different predicates between two nodes in either direction."""
    pairs = e.where("subject <> object").select(F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b"), "predicate")
    return pairs.groupBy("a", "b").agg(F.count_distinct("predicate").alias("strength"))


def scoped(e: DataFrame, attrs: DataFrame, mask: int) -> DataFrame:
    """Edges whose ends are both in scope; nodes without a record are public."""
    hidden = attrs.where(~visible(F.col("label"), mask)).select("node")
    return e.join(hidden, e["subject"] == hidden["node"], "left_anti").join(hidden, e["object"] == hidden["node"], "left_anti")


def neighbourhood(start: DataFrame, e: DataFrame, hops: int = 2, max_nodes: int | None = 3000) -> tuple[DataFrame, DataFrame]:
    """(subject, node, depth) within hops of each start, undirected, and (subject, a, b, strength) between them.

    Only edges of nodes that were expanded (depth < hops) are given. max_nodes keeps the nodes of each start that come
    first by (depth, id).
    """
    # read in both directions at every hop
    e, start = cut(e, "edges"), start.select("subject").distinct()
    nodes = cut(start.select("subject", F.col("subject").alias("node"), F.lit(0).alias("depth")), "nodes")
    for depth in range(1, hops + 1):
        edge = nodes.where(F.col("depth") == depth - 1).select("subject", F.col("node").alias("n"))
        out = edge.join(e.select(F.col("subject").alias("n"), F.col("object").alias("node")), "n").unionByName(edge.join(e.select(F.col("object").alias("n"), F.col("subject").alias("node")), "n"))
        reached = out.select("subject", "node", F.lit(depth).alias("depth")).unionByName(nodes)
        nodes = cut(reached.groupBy("subject", "node").agg(F.min("depth").alias("depth")), "nodes")
    if max_nodes is not None:
        from pyspark.sql import Window

        w = Window.partitionBy("subject").orderBy("depth", "node")
        nodes = nodes.withColumn("r", F.row_number().over(w)).where(F.col("r") <= max_nodes).drop("r")
    nodes = cut(nodes, "nodes") if max_nodes is not None else nodes
    left, right = nodes.where(F.col("depth") < hops).select("subject", F.col("node").alias("x")), nodes.select("subject", F.col("node").alias("y"))
    ends = e.where("subject <> object").select(F.col("subject").alias("x"), F.col("object").alias("y"), "predicate")
    touched = left.join(ends, "x").unionByName(left.join(ends.select(F.col("y").alias("x"), F.col("x").alias("y"), "predicate"), "x")).join(right, ["subject", "y"])
    pairs = touched.groupBy("subject", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count_distinct("predicate").alias("strength"))
    return nodes, pairs.select("subject", "a", "b", "strength")


def induced(e: DataFrame, attrs: DataFrame, mask: int, max_nodes: int = 3000) -> tuple[DataFrame, DataFrame, bool]:
    """The first max_nodes visible nodes by id, the edges between them (a <= b), and whether nodes were cut off."""
    shown = attrs.where(visible(F.col("label"), mask)).select("node")
    nodes = shown.orderBy("node").limit(max_nodes)
    truncated = shown.limit(max_nodes + 1).count() > max_nodes
    pairs = e.select(F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b")).distinct()
    pairs = pairs.join(nodes.withColumnRenamed("node", "a"), "a", "left_semi").join(nodes.withColumnRenamed("node", "b"), "b", "left_semi")
    return nodes, pairs, truncated


UNTYPED = "(untyped)"


def overview_types(attrs: DataFrame, mask: int) -> DataFrame:
    """type, n, sample (least id) of the visible nodes."""
    return attrs.where(visible(F.col("label"), mask)).groupBy(F.coalesce("type", F.lit(UNTYPED)).alias("type")).agg(F.count("*").alias("n"), F.min("node").alias("sample"))


def overview_edges(e: DataFrame, attrs: DataFrame, mask: int) -> DataFrame:
    """type_a < type_b, n: node-valued facts between different types with both ends in scope."""
    t = attrs.select("node", F.coalesce("type", F.lit(UNTYPED)).alias("type"), visible(F.col("label"), mask).alias("shown"))
    a, b = t.select(F.col("node").alias("subject"), F.col("type").alias("ta"), F.col("shown").alias("sa")), t.select(F.col("node").alias("object"), F.col("type").alias("tb"), F.col("shown").alias("sb"))
    j = e.join(a, "subject", "left").join(b, "object", "left").where(F.coalesce("sa", F.lit(True)) & F.coalesce("sb", F.lit(True)))
    j = j.select(F.coalesce("ta", F.lit(UNTYPED)).alias("ta"), F.coalesce("tb", F.lit(UNTYPED)).alias("tb")).where("ta <> tb")
    return j.groupBy(F.least("ta", "tb").alias("type_a"), F.greatest("ta", "tb").alias("type_b")).agg(F.count("*").alias("n"))


def label_histogram(attrs: DataFrame) -> DataFrame:
    return attrs.where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n"))
