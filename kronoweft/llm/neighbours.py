"""The most similar vectors of every vector, by a hierarchical k-means tree.

* The tree is fitted at the driver on a bounded sample (``sample`` rows in hash order). Where its leaves would hold too
  many rows, each is divided further by centres fitted in the executors on a sample of its own rows, until leaves hold
  about ``leaf`` rows, however many rows there are. Every row is indexed.
* A query visits leaves best bin first: its priority queue pops the nearest bin, pushes the children of an inner bin
  and visits a leaf. The queues of a batch of queries are worked in step, so that each step is one array operation; a
  query is only measured against bins that it opens.
* How many leaves are visited is calibrated: for ``probes`` queries the exact neighbours are found among all rows, and
  visits widen until the target recall is reached on them, with a margin.
* Leaves that lie side by side are searched in one task (a shard of about ``POINTS`` rows). A query goes to a shard
  once, with the numbers of the leaves it visits there, and only those are searched. Shards of more rows or queries
  than a cell of work may hold are split into blocks, so a leaf that holds a third of all rows takes many tasks.
* Identical vectors are one class, searched once; its members are neighbours at distance 0 and travel with it.

Distances are Euclidean in double precision; ties go to the smaller id.

Defined cases: a vector counts if it has ``dim`` finite numbers that are not all zero; rows without id are ignored;
of several usable rows of an id the one with the greatest order counts; fewer than two ids give no rows; ids with
fewer than k others get all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kronoweft.llm.text import spread
from kronoweft.session import cut

#: Sampled rows that fit a tree or a part of it; rows of a leaf aimed at; sampled rows behind a leaf at least.
SAMPLE, LEAF, BEHIND = 30_000, 200, 12
#: Bytes of centres that are broadcast at most; beyond it leaves get larger, and are searched in blocks.
MOST_TREE = 64 << 20
#: Exact searches that calibrate the number of visits, the recall aimed at, and the margin on the visits found.
PROBES, RECALL, MARGIN = 200, 0.999, 2.0
#: Points and queries in one cell of work.
POINTS, QUERIES = 4096, 8192


def usable_vectors(rows: DataFrame, dim: int, node: str = "node", vector: str = "vector", order: str = "vector_id") -> DataFrame:
    """node, x (dim little-endian float32 in bytes as an array<float>): the vector that counts for each id."""
    v = F.col(vector)
    finite = ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    good = rows.where(F.col(node).isNotNull() & (F.size(v) == dim) & finite & F.exists(v, lambda e: e != 0))
    return good.groupBy(F.col(node).cast("long").alias("node")).agg(F.max_by(v, F.col(order)).alias("x"))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        a = _nearest(x, c)
        n = np.bincount(a, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, a, x)
        c[n > 0] = s[n > 0] / n[n > 0, None]
        empty = np.flatnonzero(n == 0)
        if len(empty):
            c[empty] = x[rng.choice(len(x), len(empty))]
    return c


def _squared(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.maximum((q * q).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2.0 * (q @ p.T), 0.0)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([_squared(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


class Tree:
    """Bins in arrays: ``centre`` of each, and the place and number of its children. The first ``roots`` bins have no parent."""

    def __init__(self, sample: np.ndarray, leaves: int, fan: int = 32, seed: int = 7):
        rng = np.random.default_rng(seed)
        depth = max(1, math.ceil(math.log(max(leaves, 2)) / math.log(fan)))
        width = max(2, math.ceil(leaves ** (1 / depth)))
        self.centre = np.zeros((0, sample.shape[1]))
        self.first, self.many = np.zeros(0, np.int64), np.zeros(0, np.int64)
        groups: list[tuple[int, np.ndarray]] = [(-1, sample)]
        for _ in range(depth):
            below = []
            for parent, x in groups:
                distinct = np.unique(x, axis=0)
                # wide groups get more children, so that leaves hold about the same number of rows
                k = min(len(distinct), max(1, round(width * len(x) * len(groups) / max(len(sample), 1))))
                c = _kmeans(distinct, k, rng)
                a = _nearest(x, c)
                held = [i for i in range(k) if (a == i).any()]
                at = self._add(parent, c[held])
                below += [(at + n, x[a == i]) for n, i in enumerate(held)]
            if parent == -1:
                self.roots = len(self.centre)
            groups = below
        self._number()

    def _add(self, parent: int, centres: np.ndarray) -> int:
        at = len(self.centre)
        self.centre = np.concatenate([self.centre, centres])
        self.first, self.many = (np.concatenate([x, np.zeros(len(centres), np.int64)]) for x in (self.first, self.many))
        if parent >= 0:
            self.first[parent], self.many[parent] = at, len(centres)
        return at

    def _number(self) -> None:
        """Number the leaves so that leaves below one bin lie side by side."""
        self.leaf = np.full(len(self.centre), -1, np.int64)
        stack, self.leaves = list(range(self.roots))[::-1], 0
        while stack:
            b = stack.pop()
            if self.many[b]:
                stack += range(self.first[b] + self.many[b] - 1, self.first[b] - 1, -1)
            else:
                self.leaf[b] = self.leaves
                self.leaves += 1
        self.bin = np.empty(self.leaves, np.int64)
        self.bin[self.leaf[self.leaf >= 0]] = np.flatnonzero(self.leaf >= 0)

    def divide(self, parts: dict[int, np.ndarray]) -> None:
        """Make leaves into bins with the given centres as children."""
        for b, c in sorted((int(self.bin[n]), c) for n, c in parts.items()):
            self._add(b, c)
        self._number()

    def visits(self, q: np.ndarray, n: int) -> np.ndarray:
        """The first n leaves that each query visits."""
        n, rows = min(n, self.leaves), len(q)
        out = np.empty((rows, n), np.int64)
        got = np.zeros(rows, np.int64)
        # a queue per query: distances and bins; what has been popped is at infinity
        room = self.roots + 4 * max(1, int(self.many.max(initial=0)))
        keys, bins = np.full((rows, room), np.inf), np.zeros((rows, room), np.int64)
        keys[:, : self.roots], bins[:, : self.roots] = _squared(q, self.centre[: self.roots]), np.arange(self.roots)
        held = np.full(rows, self.roots)
        live = np.arange(rows)
        while len(live):
            wide = held[live].max()
            at = keys[live, :wide].argmin(1)
            b = bins[live, at]
            keys[live, at] = np.inf
            leaf = self.leaf[b]
            here = leaf >= 0
            out[live[here], got[live[here]]] = leaf[here]
            got[live[here]] += 1
            r, b = live[~here], b[~here]
            if len(r):
                most = int(self.many[b].max())
                if held[r].max() + most > keys.shape[1]:
                    more = max(keys.shape[1], most)
                    keys, bins = np.concatenate([keys, np.full((rows, more), np.inf)], 1), np.concatenate([bins, np.zeros((rows, more), np.int64)], 1)
                kid = np.arange(most)
                there = kid < self.many[b][:, None]
                child = np.where(there, self.first[b][:, None] + kid, 0)
                far = ((self.centre[child] - q[r][:, None, :]) ** 2).sum(2)
                place = held[r][:, None] + kid
                keys[r[:, None], place], bins[r[:, None], place] = np.where(there, far, np.inf), child
                held[r] += self.many[b]
            live = live[got[live] < n]
        return out

    def home(self, x: np.ndarray) -> np.ndarray:
        """The leaf that holds a row: the first that a query at its place would visit."""
        return self.visits(x, 1)[:, 0]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list<float> column as rows of doubles."""
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return np.asarray(flat, dtype=np.float64).reshape(-1, dim)


def _top(q: np.ndarray, qid: np.ndarray, p: np.ndarray, pid: np.ndarray, k: int, spare: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest points by (squared distance, id) of each query, itself excluded: query ids, point ids, distances."""
    a, b, d = [], [], []
    if not len(p):
        q = q[:0]
    else:
        # around the middle of the points, where the products lose the least precision
        middle = p.mean(0)
        p_near = p - middle
        longest = (p_near * p_near).sum(1).max()
    m = min(len(p), k + 1 + spare)
    for i in range(0, len(q), 512):
        own = q[i : i + 512]
        s = _squared(own - middle, p_near)
        near = np.argpartition(s, m - 1, axis=1)[:, :m] if m < len(p) else np.tile(np.arange(len(p)), (len(s), 1))
        exact = ((own[:, None, :] - p[near]) ** 2).sum(2)
        ids = pid[near]
        exact = np.where(ids == qid[i : i + 512, None], np.inf, exact)
        order = np.lexsort((ids, exact), axis=1)[:, :k]
        ids, exact = np.take_along_axis(ids, order, 1), np.take_along_axis(exact, order, 1)
        if m < len(p):
            # where more points than were looked at may be as near as the last of them, all of those are
            last = np.partition(np.take_along_axis(s, near, 1), min(k, m - 1), axis=1)[:, min(k, m - 1)]
            bound = last + 1e-12 * (longest + ((own - middle) ** 2).sum(1))
            for r in np.flatnonzero((s <= bound[:, None]).sum(1) > m):
                at = np.flatnonzero(s[r] <= bound[r])
                at = at[pid[at] != qid[i + r]]
                far = ((own[r] - p[at]) ** 2).sum(1)
                first = np.lexsort((pid[at], far))[:k]
                ids[r, : len(first)], exact[r, : len(first)] = pid[at][first], far[first]
        a.append(np.repeat(qid[i : i + 512], ids.shape[1]))
        b.append(ids.ravel())
        d.append(exact.ravel())
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    a, b, d = np.concatenate(a), np.concatenate(b), np.concatenate(d)
    ok = np.isfinite(d)
    return a[ok], b[ok], d[ok]


def _classes(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame | None]:
    """Identical vectors: (cid, x, members) per class with its k + 1 smallest ids, and (node, first) of the further copies."""
    w = Window.partitionBy("x").orderBy("node")
    # the rank limit is applied before the shuffle too, so a huge class sends k + 1 rows a task
    firsts = vectors.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    classes = firsts.groupBy("x").agg(F.array_sort(F.collect_list("node")).alias("members")).select(F.element_at("members", 1).alias("cid"), "x", "members")
    classes = cut(classes, "classes")
    # classes with more copies are at most 1 / (k + 2) of the rows; copies are salted against hot classes
    large = classes.where(F.size("members") > k).select("x", F.slice("members", 1, k).alias("first"), F.element_at("members", -1).alias("last"))
    if large.isEmpty():
        return classes, None
    salts = 16
    salted = vectors.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int"))
    more = salted.join(large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["x", "salt"]).where("node > last")
    return classes, more.select("node", "first")


def _in_steps(x: np.ndarray, of, size: int = 1024) -> np.ndarray:
    return np.concatenate([of(x[i : i + size]) for i in range(0, len(x), size)])


def fit_tree(classes: DataFrame, n: int, dim: int, sample: int = SAMPLE, leaf: int = LEAF, behind: int = BEHIND) -> Tree | None:
    """The tree over all rows: a top over a sample of at most ``sample`` rows, taken by the hash of their ids, and what divides its leaves."""
    rows = classes.select("cid", "x").orderBy(F.xxhash64("cid")).limit(sample).select("x").toArrow().column(0)
    x = _matrix(rows, dim)
    if not len(x):
        return None
    tree = Tree(x, max(2, min(n // leaf, len(x) // behind)))
    leaf = max(leaf, math.ceil(n * dim * 8 / MOST_TREE))
    while n > 2 * leaf * tree.leaves:
        before = tree.leaves
        tree = _divided(classes, tree, dim, sample, leaf, behind)
        if tree.leaves < 1.1 * before:
            break  # what is left cannot be told apart by centres; it is searched in blocks
    return tree


def _divided(classes: DataFrame, tree: Tree, dim: int, sample: int, leaf: int, behind: int) -> Tree:
    """The tree with leaves of more than 2 * leaf rows divided by centres that are fitted to a sample of each."""
    shared = classes.sparkSession.sparkContext.broadcast(tree)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_in_steps(_matrix(b.column(1), dim), shared.value.home)), b.column(0), b.column(1)], ["leaf", "cid", "x"])

    rows = cut(spread(classes.select("cid", "x"), "cid").mapInArrow(homes, "leaf long, cid long, x array<float>"), "homes")
    large = rows.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > 2 * leaf)
    # enough sampled rows behind each centre, and no more than a fit may take
    share = F.least(F.lit(1.0), F.lit(float(behind)) / leaf, F.lit(float(sample)) / F.col("n"))
    picked = rows.join(F.broadcast(large), "leaf").where(F.pmod(F.xxhash64("cid", F.lit("divide")), F.lit(1 << 20)) < share * (1 << 20))

    def fit(t: pa.Table) -> pa.Table:
        x = np.unique(_matrix(t.column("x"), dim), axis=0)
        c = _kmeans(x, min(len(x), max(2, math.ceil(t.column("n")[0].as_py() / leaf))), np.random.default_rng(7))
        c = c[np.unique(_nearest(x, c))]
        return pa.table({"leaf": t.column("leaf").slice(0, 1), "centres": pa.array([c.ravel().tolist()], pa.list_(pa.float64()))})

    got = picked.select("leaf", "n", "x").groupBy("leaf").applyInArrow(fit, "leaf long, centres array<double>").collect()
    tree.divide({r["leaf"]: np.array(r["centres"]).reshape(-1, dim) for r in got if len(r["centres"]) > dim})
    return tree


def _calibrated(classes: DataFrame, tree: Tree, dim: int, k: int, probes: int) -> int:
    """The number of visits at which the probes' exact neighbours among all rows are found."""
    rows = classes.select("cid", "x").orderBy(F.xxhash64("cid", F.lit("probe"))).limit(probes).toArrow()
    qid, q = rows.column(0).to_numpy(), _matrix(rows.column(1), dim)
    queries = classes.sparkSession.sparkContext.broadcast((qid, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = queries.value
        best: list[list[tuple]] = [[] for _ in qid]
        at = {int(i): r for r, i in enumerate(qid)}
        for b in batches:
            p, pid = _matrix(b.column(1), dim), b.column(0).to_numpy()
            place = {int(i): r for r, i in enumerate(pid)}
            for a, c, d in zip(*(z.tolist() for z in _top(q, qid, p, pid, k))):
                best[at[a]].append((d, c, p[place[c]].tolist()))
            best = [sorted(x)[:k] for x in best]
        flat = [(int(qid[i]), d, c, x) for i, near in enumerate(best) for d, c, x in near]
        if flat:
            a, d, c, x = zip(*flat)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(d, pa.float64()), pa.array(c, pa.int64()), pa.array(x, pa.list_(pa.float64()))], ["a", "d", "b", "x"])

    near = spread(classes.select("cid", "x"), "cid").mapInArrow(run, "a long, d double, b long, x array<double>")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).where(F.col("r") <= k).select("a", "x").toArrow()
    if not near.num_rows:
        return 1
    at = {int(i): r for r, i in enumerate(qid)}
    who, leaf = np.array([at[a] for a in near.column(0).to_pylist()]), tree.home(_matrix(near.column(1), dim))
    n = 32
    while True:
        n = min(n, tree.leaves)
        hit = tree.visits(q, n)[who] == leaf[:, None]
        needed = np.sort(np.where(hit.any(1), hit.argmax(1) + 1, tree.leaves + 1))
        want = int(needed[min(len(needed) - 1, math.ceil(RECALL * len(needed)) - 1)])
        if want <= n or n == tree.leaves:
            return min(want, tree.leaves)
        n *= 4


def _counts(routed: DataFrame, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """How many rows each leaf holds, and how many queries visit it: counted in each task, summed over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, asked = np.zeros(leaves, np.int64), np.zeros(leaves, np.int64)
        for b in batches:
            v = b.column(0)
            asked += np.bincount(np.asarray(v.flatten()), minlength=leaves)
            if len(v):
                held += np.bincount(np.asarray(v.flatten())[np.asarray(v.offsets)[:-1] - v.offsets[0].as_py()], minlength=leaves)
        some = np.flatnonzero(held + asked)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some]), pa.array(asked[some])], ["leaf", "held", "asked"])

    out = np.zeros((2, leaves), np.int64)
    for r in routed.select("leaves").mapInArrow(run, "leaf long, held long, asked long").groupBy("leaf").agg(F.sum("held").alias("held"), F.sum("asked").alias("asked")).collect():
        out[:, r["leaf"]] = r["held"], r["asked"]
    return out[0], out[1]


def _shards(held: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each leaf its shard; for each shard in how many blocks its points and its queries are worked on."""
    shard, n, s = np.zeros(len(held), np.int64), 0, 0
    for i, m in enumerate(held.tolist()):
        if n and n + m > POINTS:
            s, n = s + 1, 0
        shard[i] = s
        n += m
    points, queries = np.bincount(shard, held), np.bincount(shard, asked)
    return shard, np.maximum(1, np.ceil(points / POINTS)).astype(np.int64), np.maximum(1, np.ceil(queries / QUERIES)).astype(np.int64)


_WORK = "cell long, side int, cid long, x array<float>, leaves array<int>, members array<long>"
_FOUND = "cid long, bs array<long>, ds array<double>, members array<long>"


def _rows(x: pa.RecordBatch, rows: np.ndarray, cell: np.ndarray, side: int, at: np.ndarray, leaves: np.ndarray) -> pa.RecordBatch:
    """Work for rows of x: leaves holds the lists of leaf numbers, one after the other, that begin at ``at``."""
    take = pa.array(rows)
    lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(leaves.astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.full(len(rows), side, np.int32)), x.column("cid").take(take), x.column("x").take(take), lists, x.column("members").take(take)], ["cell", "side", "cid", "x", "leaves", "members"])


def _work(shared):
    """Every row as a point of its leaf's shard, and as a query of each shard in which it visits leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, pb, qb = shared.value
        base = np.concatenate([[0], np.cumsum(pb * qb)])
        for x in batches:
            n = x.num_rows
            if not n:
                continue
            v = np.asarray(x.column("leaves").flatten(), np.int64).reshape(n, -1)
            cid = x.column("cid").to_numpy()
            turn = (cid * 2654435761 >> 7) & 0x7FFFFFFF
            # points: one row per block of queries
            s = shard[v[:, 0]]
            r = np.repeat(np.arange(n), qb[s])
            q = np.arange(len(r)) - np.repeat(np.cumsum(qb[s]) - qb[s], qb[s])
            yield _rows(x, r, base[s[r]] + (turn[r] % pb[s[r]]) * qb[s[r]] + q, 0, np.arange(len(r) + 1), v[r, 0])
            # queries: one row per shard and block of points
            row, leaf = np.repeat(np.arange(n), v.shape[1]), v.ravel()
            order = np.lexsort((shard[leaf], row))
            row, leaf = row[order], leaf[order]
            s = shard[leaf]
            start = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (s[1:] != s[:-1])))
            size = np.diff(np.append(start, len(row)))
            row, s = row[start], s[start]
            for p in range(int(pb[s].max())):
                has = np.flatnonzero(pb[s] > p)
                at = np.concatenate([[0], np.cumsum(size[has])])
                inner = np.arange(at[-1]) - np.repeat(at[:-1], size[has]) + np.repeat(start[has], size[has])
                yield _rows(x, row[has], base[s[has]] + p * qb[s[has]] + turn[row[has]] % qb[s[has]], 1, at, leaf[inner])

    return run


def _search(dim: int, k: int):
    """For each query of a cell its k nearest points in the leaves it visits there, from rows in order of (cell, side)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            rest.append(b)
            cell = b.column("cell")
            if cell[0].as_py() == cell[-1].as_py() == rest[0].column("cell")[0].as_py():
                continue
            t = pa.Table.from_batches(rest).combine_chunks()
            c = t.column("cell").to_numpy()
            edge = np.append(np.flatnonzero(np.append(True, c[1:] != c[:-1])), len(c))
            for i, j in zip(edge[:-2].tolist(), edge[1:-1].tolist()):
                yield from of(t.slice(i, j - i))
            rest = t.slice(int(edge[-2])).to_batches()
        if rest:
            yield from of(pa.Table.from_batches(rest))

    def of(t: pa.Table) -> Iterator[pa.RecordBatch]:
        side = t.column("side").to_numpy()
        cut_at = int(np.searchsorted(side, 1))
        points, queries = t.slice(0, cut_at).combine_chunks(), t.slice(cut_at).combine_chunks()
        if not queries.num_rows:
            return
        p, pid, leaf = _matrix(points.column("x"), dim), points.column("cid").to_numpy(), np.asarray(_flat(points.column("leaves")))
        q, qid = _matrix(queries.column("x"), dim), queries.column("cid").to_numpy()
        order = np.argsort(leaf, kind="stable")
        p, pid, leaf = p[order], pid[order], leaf[order]
        size = np.asarray(pa.compute.list_value_length(queries.column("leaves")))
        row, asked = np.repeat(np.arange(len(q)), size), np.asarray(_flat(queries.column("leaves")))
        by = np.argsort(asked, kind="stable")
        row, asked = row[by], asked[by]
        a, b, d = [], [], []
        for n in np.unique(asked).tolist():
            lo, hi = np.searchsorted(leaf, [n, n + 1])
            if lo < hi:
                i, j = np.searchsorted(asked, [n, n + 1])
                got = _top(q[row[i:j]], qid[row[i:j]], p[lo:hi], pid[lo:hi], k)
                for z, y in zip((a, b, d), got):
                    z.append(y)
        a, b, d = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (a, b, d))
        a, b, d = _first(a, b, d, k)
        many = np.asarray(pa.compute.list_value_length(points.column("members")))[order]
        if (many > 1).any():
            # classes of several members stand for all of them
            by = np.argsort(pid)
            at = by[np.searchsorted(pid[by], b)] if len(b) else np.zeros(0, np.int64)
            start = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.list_value_length(points.column("members"))))])[:-1][order]
            all_members = np.asarray(_flat(points.column("members")))
            n = np.minimum(many[at], k)
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[at], n)
            a, b, d = _first(np.repeat(a, n), all_members[inner], np.repeat(d, n), k)
        ids = np.sort(qid)
        at = np.searchsorted(a, np.append(ids, np.iinfo(np.int64).max))
        at[-1] = len(a)
        lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(z, ty)) for z, ty in ((b, pa.int64()), (d, pa.float64()))]
        yield pa.RecordBatch.from_arrays([pa.array(ids), *lists, queries.column("members").combine_chunks().take(pa.array(np.argsort(qid)))], ["cid", "bs", "ds", "members"])

    return run


def _flat(column: pa.ChunkedArray) -> pa.Array:
    c = column.combine_chunks()
    return c.flatten()


def _first(a: np.ndarray, b: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k least (d, b) of each a, in order of (a, d, b)."""
    order = np.lexsort((b, d, a))
    a, b, d = a[order], b[order], d[order]
    start = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
    keep = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a)))) < k
    return a[keep], b[keep], d[keep]


def nearest(vectors: DataFrame, dim: int, k: int = 5, sample: int = SAMPLE, leaf: int = LEAF, behind: int = BEHIND, probes: int = PROBES, visits: int | None = None) -> DataFrame:
    """node, near (array of the ids of its k nearest others, by distance and id). vectors: node, x."""
    spark = vectors.sparkSession
    classes, copies = _classes(vectors, k)
    n = classes.count()
    tree = fit_tree(classes, n, dim, sample, leaf, behind)
    if tree is None:
        return spark.createDataFrame([], "node long, near array<long>")
    if visits is None:
        visits = math.ceil(MARGIN * _calibrated(classes, tree, dim, k, probes))
    visits = min(visits, tree.leaves)
    shared = spark.sparkContext.broadcast(tree)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = _in_steps(_matrix(b.column(1), dim), lambda x: shared.value.visits(x, visits))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * visits, pa.int32()), pa.array(v.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], ["cid", "x", "members", "leaves"])

    # the first leaf of a row's visits is the one that holds it
    routed = cut(spread(classes.select("cid", "x", "members"), "cid").mapInArrow(route, "cid long, x array<float>, members array<long>, leaves array<int>"), "routed")
    split = spark.sparkContext.broadcast(_shards(*_counts(routed, tree.leaves)))
    work = routed.mapInArrow(_work(split), _WORK).repartition("cell").sortWithinPartitions("cell", "side")
    found = work.mapInArrow(_search(dim, k), _FOUND)
    pairs = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("ds", "bs"))))
    own = found.groupBy("cid").agg(F.first("members").alias("members"), F.transform(F.slice(pairs, 1, k), lambda s: s["bs"]).alias("others"))
    near = F.concat(F.filter("members", lambda m: m != F.col("node")), "others")
    heads = own.select("members", "others", F.explode("members").alias("node")).select("node", F.slice(near, 1, k).alias("near"))
    return heads.unionByName(copies.select("node", F.col("first").alias("near"))) if copies is not None else heads


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """node_a < node_b, each pair once."""
    pairs = near.select("node", F.explode("near").alias("other"))
    return pairs.select(F.least("node", "other").alias("node_a"), F.greatest("node", "other").alias("node_b")).distinct()


def recall(near: DataFrame, vectors: DataFrame, dim: int, k: int = 5, queries: int = 200) -> float:
    """The share of exact neighbours found, over ``queries`` ids compared with all vectors."""
    some = vectors.orderBy(F.xxhash64("node", F.lit("recall"))).limit(queries).toArrow()
    shared = vectors.sparkSession.sparkContext.broadcast((some.column(0).to_numpy(), _matrix(some.column(1), dim)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c, d = _top(shared.value[1], shared.value[0], _matrix(b.column(1), dim), b.column(0).to_numpy(), k)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), pa.array(d)], ["a", "b", "d"])

    exact = vectors.select("node", "x").mapInArrow(run, "a long, b long, d double").withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).where(F.col("r") <= k)
    hit = exact.join(near.select(F.col("node").alias("a"), F.explode("near").alias("b")), ["a", "b"], "left_semi").count()
    return hit / max(1, exact.count())
