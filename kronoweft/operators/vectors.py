"""Nearest-neighbour search for a stated set of queries: exact, scoped, and over an inverted file of cells.

Queries are taken to the rows in blocks of bounded size; each task keeps its k best per query, so what is shuffled is
(tasks x queries x k) rows. Rows are filtered by type, scope and order number before they are scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kronoweft.model import visible
from kronoweft.session import cut

#: Queries that go to the rows at once.
BLOCK = 2048
#: Points of a cell of an inverted file that one task scores.
CELL = 16_384


def latest(rows: DataFrame, node: str = "node", order: str = "vector_id", vector: str = "vector") -> DataFrame:
    """id, seqno, x: of several vectors of a node the last one counts."""
    return rows.where(F.col(node).isNotNull() & F.col(vector).isNotNull()).groupBy(F.col(node).alias("id")).agg(F.max(order).alias("seqno"), F.max_by(vector, order).alias("x"))


def sound(rows: DataFrame, dim: int, vector: str = "vector") -> DataFrame:
    """Rows whose vector has dim numbers, none NULL or NaN and not all zero."""
    v = F.col(vector)
    return rows.where((F.size(v) == dim) & ~F.exists(v, lambda e: e.isNull() | F.isnan(e)) & F.exists(v, lambda e: e != 0))


def scope(rows: DataFrame, attrs: DataFrame, node_type: str | None = None, mask: int | None = None) -> DataFrame:
    """Rows of a type and in scope, by the attributes of their nodes; what is filtered out is never scored."""
    keep = attrs
    if node_type is not None:
        keep = keep.where(F.col("type") == node_type)
    if mask is not None:
        keep = keep.where(visible(F.col("label"), mask))
    if node_type is None:  # nodes without a record are public
        hidden = attrs.join(keep, "node", "left_anti").select(F.col("node").alias("id"))
        return rows.join(hidden, "id", "left_anti")
    return rows.join(keep.select(F.col("node").alias("id")), "id", "left_semi")


def up_to(rows: DataFrame, watermark: int | None) -> DataFrame:
    """Strict reads see the indexed prefix (seqno < watermark); fresh reads see all rows."""
    return rows if watermark is None else rows.where(F.col("seqno") < watermark)


def matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _blocks(queries: DataFrame, size: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, xs = [], []
    for r in queries.select("id", "x").toLocalIterator():
        ids.append(r[0])
        xs.append(r[1])
        if len(ids) == size:
            yield np.array(ids, np.int64), np.array(xs, np.float64)
            ids, xs = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(xs, np.float64)


def _best(d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least by (distance, id)."""
    if len(d) > k:
        near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
    else:
        near = np.arange(len(d))
    return near[np.lexsort((ids[near], d[near]))][:k]


def knn(rows: DataFrame, queries: DataFrame, k: int = 10, itself: bool = True) -> DataFrame:
    """query, id, dist (squared Euclidean), score (1 / (1 + dist)), rank. rows, queries: id, x."""
    spark, parts = rows.sparkSession, []
    for qid, q in _blocks(queries):
        shared = spark.sparkContext.broadcast((qid, q))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qid, q = shared.value
            for b in batches:
                ids, x = b.column(0).to_numpy(), matrix(b.column(1), b.num_rows)
                a, c, dist = [], [], []
                for i in range(len(qid)) if len(ids) else ():
                    d = ((x - q[i]) ** 2).sum(1)
                    if not itself:
                        d = np.where(ids == qid[i], np.inf, d)
                    at = _best(d, ids, k)
                    at = at[np.isfinite(d[at])]
                    a.append(np.full(len(at), qid[i]))
                    c.append(ids[at])
                    dist.append(d[at])
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in (a, c, dist)], ["query", "id", "dist"])

        parts.append(rows.select(F.col("id").cast("long").alias("id"), "x").mapInArrow(run, "query long, id long, dist double"))
    if not parts:
        return spark.createDataFrame([], "query long, id long, dist double, score double, rank int")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy("query").orderBy("dist", "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "id", "dist", (1 / (1 + F.col("dist"))).alias("score"), "rank")


def top_k(df: DataFrame, k: int) -> DataFrame:
    """Score descending, id ascending."""
    return df.orderBy(F.col("score").desc(), "id").limit(k)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        a = nearest(x, c)
        for i in np.unique(a):
            c[i] = x[a == i].mean(0)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)


@dataclass
class Ivf:
    """Cells (coarse centres) and product-quantizer codebooks, trained at the driver on a bounded sample."""

    centres: np.ndarray
    books: np.ndarray  # (m, codes, dim / m)
    trained_fit: float = 0.0
    trained_rows: int = 0

    @classmethod
    def train(cls, rows: DataFrame, sample: int = 20_000, m: int | None = None, codes: int = 256, seed: int = 7) -> Ivf:
        n = rows.count()
        got = rows.select("x").orderBy(F.xxhash64("id")).limit(sample).toArrow().column(0).combine_chunks()
        x = matrix(got, len(got))
        rng = np.random.default_rng(seed)
        cells = min(max(16, round(4 * math.sqrt(max(n, 1)))), 65536, max(1, len(x) // 8))
        centres = _kmeans(x, cells, rng)
        dim = x.shape[1]
        m = m or next(i for i in range(min(96, dim), 0, -1) if dim % i == 0 and (dim // i >= 4 or i == 1))
        books = np.stack([_kmeans(p, min(codes, len(x)), rng) for p in np.split(x, m, axis=1)])
        out = cls(centres, books, trained_rows=n)
        out.trained_fit = float(np.sqrt(((x - centres[nearest(x, centres)]) ** 2).sum(1)).mean())
        return out

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([nearest(p, b) for p, b in zip(np.split(x, len(self.books), axis=1), self.books)], axis=1).astype(np.uint8)

    def table(self, q: np.ndarray) -> np.ndarray:
        """Distances of a query's parts to all codes: a candidate's distance is a sum of look-ups."""
        parts = np.split(q, len(self.books))
        return np.stack([((b - p) ** 2).sum(1) for p, b in zip(parts, self.books)])

    def probes(self, q: np.ndarray, n: int) -> np.ndarray:
        return ((self.centres - q) ** 2).sum(1).argsort(kind="stable")[:n]


def index(rows: DataFrame, ivf: Ivf) -> DataFrame:
    """rows (id, x and others) with cell and code, written once in order of cells, so that a search reads the cells it probes."""
    shared = rows.sparkSession.sparkContext.broadcast(ivf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), b.num_rows)
            if b.num_rows:
                code = [c.tobytes() for c in shared.value.codes(x)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nearest(x, shared.value.centres), pa.int32()), pa.array(code, pa.binary())], ["id", "x", "cell", "code"])

    kind = rows.schema["x"].dataType.simpleString()
    out = rows.select(F.col("id").cast("long").alias("id"), "x").mapInArrow(run, f"id long, x {kind}, cell int, code binary")
    return cut(out.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id"), "index")


def probed(queries: DataFrame, ivf: Ivf, probes: int) -> DataFrame:
    """query, x, cell: a row for each cell that a query probes."""
    shared = queries.sparkSession.sparkContext.broadcast(ivf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n = min(probes, len(shared.value.centres))
                cells = np.array([shared.value.probes(v, n) for v in matrix(b.column(1), b.num_rows)])
                at = pa.array(np.repeat(np.arange(b.num_rows), n))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(cells.ravel(), pa.int32())], ["query", "x", "cell"])

    kind = queries.schema["x"].dataType.simpleString()
    return queries.select(F.col("id").cast("long").alias("id"), "x").mapInArrow(run, f"query long, x {kind}, cell int")


def _in_cells(indexed: DataFrame, asks: DataFrame, of, schema: str) -> DataFrame:
    """``of(points, queries)`` for the points of each cell and the queries that ask for it; hot cells in blocks of points.

    Points of cells that nobody asks for are not read beyond the statistics of their row groups, where few are asked for.
    """
    cells = [r[0] for r in asks.select("cell").distinct().collect()]  # at most the number of cells
    some = indexed.where(F.col("cell").isin(cells)) if len(cells) <= 1000 else indexed.join(asks.select("cell").distinct(), "cell", "left_semi")
    blocks = some.groupBy("cell").agg(F.ceil(F.count("*") / CELL).cast("int").alias("n"))
    block = F.pmod(F.xxhash64("id"), F.col("n")).cast("int")
    points = some.join(F.broadcast(blocks), "cell").select("cell", block.alias("b"), F.lit(0).alias("side"), "id", F.col("x").cast("array<double>").alias("x"), "code")
    queries = asks.join(F.broadcast(blocks), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("b"), F.lit(1).alias("side"), F.col("query").alias("id"), F.col("x").cast("array<double>").alias("x"), F.lit(None).cast("binary").alias("code"))

    def run(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        p, q = t.filter(pa.array(side == 0)).combine_chunks(), t.filter(pa.array(side == 1)).combine_chunks()
        return of(p, q)

    return points.unionByName(queries).groupBy("cell", "b").applyInArrow(run, schema)


def search(indexed: DataFrame, ivf: Ivf, queries: DataFrame, k: int = 10, probes: int = 8, rerank: int = 256) -> DataFrame:
    """As knn, over the probed cells: the ``rerank`` best by code distance, of those the k best by exact distance."""
    shared = indexed.sparkSession.sparkContext.broadcast(ivf)

    def of(p: pa.Table, q: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]]
        if len(p) and len(q):
            ids, x = p.column("id").to_numpy(), matrix(p.column("x").chunk(0), len(p))
            code = np.frombuffer(b"".join(p.column("code").to_pylist()), np.uint8).reshape(len(p), -1)
            for i, v in zip(q.column("id").to_pylist(), matrix(q.column("x").chunk(0), len(q))):
                near = shared.value.table(v)[np.arange(code.shape[1]), code].sum(1)
                best = _best(near, ids, rerank)
                for z, y in zip(out, (np.full(len(best), i), ids[best], near[best], ((x[best] - v) ** 2).sum(1))):
                    z.append(y)
        return pa.table([np.concatenate(z) for z in out], ["query", "id", "near", "dist"])

    out = _in_cells(indexed, probed(queries, ivf, probes), of, "query long, id long, near double, dist double")
    out = out.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("near", "id"))).where(F.col("r") <= rerank)
    return _ranked(out, k)


def _ranked(out: DataFrame, k: int) -> DataFrame:
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("dist", "id"))).where(F.col("rank") <= k)
    return out.select("query", "id", "dist", (1 / (1 + F.col("dist"))).alias("score"), "rank")


def calibrated_probes(indexed: DataFrame, ivf: Ivf, k: int = 10, target: float = 0.97, sample: int = 100) -> int:
    """The least number of probed cells that hold the target share of exact neighbours of ``sample`` rows.

    The sample is taken by the hash of the ids and compared with all rows.
    """
    queries = indexed.select("id", "x").orderBy(F.xxhash64("id")).limit(sample)
    xs = {r["id"]: np.array(r["x"], np.float64) for r in queries.collect()}
    near = knn(indexed, queries, k).join(indexed.select("id", "cell"), "id").select("query", "cell").collect()
    place = {i: {int(c): n for n, c in enumerate(ivf.probes(x, len(ivf.centres)))} for i, x in xs.items()}
    needed = sorted(place[r["query"]][r["cell"]] + 1 for r in near)
    return needed[min(len(needed) - 1, math.ceil(target * len(needed)) - 1)] if needed else 1


def search_complete(indexed: DataFrame, ivf: Ivf, queries: DataFrame, k: int = 10, probes: int = 8, budget: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Probed cells, then the other cells nearest first, scored exactly while they fit each query's budget of rows.

    A cell that does not fit is left out whole, and smaller ones beyond it are still taken. Returns the result, and per
    query how many rows of the tail were scored and whether any were left out.
    """
    held = np.zeros(len(ivf.centres), np.int64)
    for r in indexed.groupBy("cell").agg(F.count("*").alias("n")).collect():  # at most the number of cells
        held[r["cell"]] = r["n"]
    shared = indexed.sparkSession.sparkContext.broadcast((ivf, held))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ivf, held = shared.value
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), matrix(b.column(1), b.num_rows)):
                order = ivf.probes(v, len(held)).tolist()
                take, tail, left_out = order[:probes], 0, False
                for c in order[probes:]:
                    if tail + held[c] > budget:
                        left_out = left_out or held[c] > 0
                    elif held[c]:
                        take.append(c)
                        tail += int(held[c])
                n = len(take)
                yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int64()), pa.array([v.tolist()] * n, pa.list_(pa.float64())), pa.array(take, pa.int32()), pa.array([tail] * n, pa.int64()), pa.array([bool(left_out)] * n)], ["query", "x", "cell", "tail", "left_out"])

    asks = cut(queries.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x")).mapInArrow(plan, "query long, x array<double>, cell int, tail long, left_out boolean"), "plan")

    def of(p: pa.Table, q: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if len(p) and len(q):
            ids, x = p.column("id").to_numpy(), matrix(p.column("x").chunk(0), len(p))
            for i, v in zip(q.column("id").to_pylist(), matrix(q.column("x").chunk(0), len(q))):
                d = ((x - v) ** 2).sum(1)
                best = _best(d, ids, k)
                for z, y in zip(out, (np.full(len(best), i), ids[best], d[best])):
                    z.append(y)
        return pa.table([np.concatenate(z) for z in out], ["query", "id", "dist"])

    found = _ranked(_in_cells(indexed, asks.select("query", "x", "cell"), of, "query long, id long, dist double"), k)
    return found, asks.select("query", "tail", "left_out").distinct()


def refresh(rows: DataFrame, ivf: Ivf | None) -> tuple[Ivf, DataFrame, bool]:
    """(quantizers, index, whether they were trained anew) over rows: trained ones are kept as long as they fit."""
    if ivf is not None:
        indexed = index(rows, ivf)
        if keep_quantizers(fit(indexed, ivf)[2], ivf.trained_rows, indexed.count()):
            return ivf, indexed, False
    ivf = Ivf.train(rows)
    return ivf, index(rows, ivf), True


def fit(indexed: DataFrame, ivf: Ivf) -> tuple[float, float, float]:
    """Mean distance to the own cell's centre when trained and now, and their ratio (a drift above 1.5 asks to retrain)."""
    shared = indexed.sparkSession.sparkContext.broadcast(ivf.centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0), b.num_rows)
                d = np.sqrt(((x - shared.value[b.column(1).to_numpy()]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array([float(d.sum())]), pa.array([len(d)])], ["s", "n"])

    r = indexed.select("x", "cell").mapInArrow(run, "s double, n long").agg(F.sum("s"), F.sum("n")).first()
    now = (r[0] or 0.0) / max(1, r[1] or 0)
    return ivf.trained_fit, now, now / ivf.trained_fit if ivf.trained_fit else 1.0


def keep_quantizers(ratio: float, trained_rows: int, rows: int) -> bool:
    """Reuse trained cells and codes while they still fit and the rows have not doubled."""
    return ratio <= 1.5 and rows < 2 * max(1, trained_rows)
