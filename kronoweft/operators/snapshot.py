"""The derived views of one change log, and pipelines over them."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kronoweft.model import ALL_LABELS, visible
from kronoweft.operators import fold, graph, temporal, vectors

COMPARE = {"<": Column.__lt__, "<=": Column.__le__, "==": Column.__eq__, "!=": Column.__ne__, ">=": Column.__ge__, ">": Column.__gt__}


class Snapshot:
    """State of a log: lazy DataFrames, each derived once. seq: the order number that removals name; plain: see fold.live."""

    def __init__(self, log: DataFrame, attrs: DataFrame | None = None, embeddings: DataFrame | None = None, seq: Column | None = None, plain: bool = False):
        self.log, self._attrs, self.embeddings, self.seq, self.plain = log, attrs, embeddings, seq, plain

    @cached_property
    def one_history(self) -> DataFrame:
        return fold.one_history(self.log, self.plain)

    @cached_property
    def one(self) -> DataFrame:
        return fold.heads(self.one_history)

    @cached_property
    def many_history(self) -> DataFrame:
        return fold.many_history(self.log, self.seq, self.plain)

    @cached_property
    def many(self) -> DataFrame:
        return fold.heads(self.many_history, [*fold.KEY, "object"]).where("is_add")

    @cached_property
    def edges(self) -> DataFrame:
        return graph.edges(self.one, self.many)

    @cached_property
    def attrs(self) -> DataFrame:
        return self._attrs if self._attrs is not None else fold.node_attrs(self.log)

    def edges_at(self, at: int) -> DataFrame:
        return graph.edges(temporal.asof_one(self.one_history, at), temporal.asof_many(self.many_history, at))


@dataclass(frozen=True)
class Pipeline:
    """A chain of steps over ranked nodes: df has id, score, ord (place in the list).

    max_nodes cuts the list after the source and each expand. With None nothing is cut, and ord is what the list is
    ordered by instead of the place, since counting places over all rows would need one task.
    """

    snap: Snapshot
    df: DataFrame | None = None
    mask: int = ALL_LABELS
    max_nodes: int | None = 3000

    def _ranked(self, df: DataFrame, *order: Column) -> Pipeline:
        """Number the rows and cut to max_nodes. The window sees at most max_nodes rows, which the limit keeps."""
        if self.max_nodes is None:
            return replace(self, df=df.select("id", "score", F.struct(*order).alias("ord")))
        cut = df.orderBy(*order).limit(self.max_nodes)
        return replace(self, df=cut.withColumn("ord", F.row_number().over(Window.orderBy(*order))).select("id", "score", "ord"))

    def nodes(self, ids: list[int] | DataFrame) -> Pipeline:
        """The listed nodes in the order of the list, or those of a DataFrame with node in the order of their ids."""
        if isinstance(ids, DataFrame):
            df = ids.where("node IS NOT NULL").select(F.col("node").alias("id"), F.lit(1.0).alias("score")).distinct()
            return self._ranked(self._shown(df), F.col("id"))
        spark = self.snap.log.sparkSession
        df = spark.createDataFrame([(i, 1.0, n) for n, i in enumerate(dict.fromkeys(ids))], "id long, score double, ord int")
        return self._ranked(self._shown(df), F.col("ord"))

    def similar_to(self, vector: list[float], node_type: str | None, k: int = 10, watermark: int | None = None) -> Pipeline:
        """The k nearest nodes of a type that are in scope; a watermark reads the indexed prefix only."""
        rows = vectors.scope(vectors.up_to(self.snap.embeddings, watermark), self.snap.attrs, node_type, self.mask)
        q = self.snap.log.sparkSession.createDataFrame([(0, [float(v) for v in vector])], "id long, x array<double>")
        return self._ranked(vectors.knn(rows, q, k).select("id", "score", "rank"), F.col("rank"))

    def similar(self, node: int, k: int = 10) -> Pipeline:
        """The k nearest other nodes in scope of a node's own vector."""
        rows = vectors.scope(self.snap.embeddings, self.snap.attrs, None, self.mask)
        q = self.snap.embeddings.where(F.col("id") == node)
        return self._ranked(vectors.knn(rows, q, k, itself=False).select("id", "score", "rank"), F.col("rank"))

    def _shown(self, df: DataFrame) -> DataFrame:
        hidden = self.snap.attrs.where(~visible(F.col("label"), self.mask)).select(F.col("node").alias("id"))
        return df.join(hidden, "id", "left_anti")

    def expand(self, predicate: str, rel: graph.Relation = graph.Relation(), max_depth: int = 16, at: int | None = None) -> Pipeline:
        """Replace the nodes by what they lead to: score 1, in the order in which they are first reached."""
        e = self.snap.edges if at is None else self.snap.edges_at(at)
        start = self.df.select(F.col("id").alias("subject"), "ord")
        reached = graph.expand(start, e, predicate, rel, max_depth).join(start, "subject")
        firsts = reached.groupBy(F.col("node").alias("id")).agg(F.min("ord").alias("ord")).withColumn("score", F.lit(1.0))
        return self._ranked(self._shown(firsts), F.col("ord"), F.col("id"))

    def filter_type(self, node_type: str) -> Pipeline:
        keep = self.snap.attrs.where(F.col("type") == node_type).select(F.col("node").alias("id"))
        return replace(self, df=self.df.join(keep, "id", "left_semi"))

    def has_value(self, predicate: str) -> Pipeline:
        keep = self.snap.one.where((F.col("predicate") == predicate) & F.col("object").isNotNull()).select(F.col("subject").alias("id"))
        return replace(self, df=self.df.join(keep, "id", "left_semi"))

    def int_cmp(self, predicate: str, op: str, value: int, at: int | None = None) -> Pipeline:
        """Keep nodes whose integer value (as of an instant) compares; values of other classes do not."""
        v = self.snap.one if at is None else temporal.asof_one(self.snap.one_history, at)
        keep = v.where((F.col("predicate") == predicate) & COMPARE[op](F.col("object.i"), F.lit(value))).select(F.col("subject").alias("id"))
        return replace(self, df=self.df.join(keep, "id", "left_semi"))

    def top_k(self, k: int) -> Pipeline:
        return replace(self, max_nodes=k)._ranked(self.df, F.col("score").desc(), F.col("id"))

    def cap(self, n: int) -> Pipeline:
        return replace(self, max_nodes=n)._ranked(self.df, F.col("ord"))
