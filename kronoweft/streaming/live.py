"""Streams of changes folded into tables, live queries, and watched rules with a journal of changes.

There is no watermark: late facts are always accepted and re-slice history, and a change that is delivered again
folds to the same state.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kronoweft.operators import changefeed, rules
from kronoweft.session import Files, cut, scratch, shared_dir


@dataclass
class FoldedState:
    """The compacted changes of a stream in a folder, hash-split by key into ``buckets``.

    A batch rewrites the buckets that it touches and then names, in one small file with the batch's number, where each
    bucket now lies. The state is what the file with the greatest number names: a batch is applied once, a replayed
    number is ignored, and a new FoldedState on the folder goes on where the last one stopped, as the stream's own
    position (beside it in ``checkpoint``) does. A batch that failed half-way left nothing that is named.
    """

    spark: SparkSession
    folder: str
    buckets: int = 64
    listeners: list[Callable[[DataFrame, int], None]] = field(default_factory=list)

    def __post_init__(self):
        self.files = Files(self.spark, f"{self.folder}/state")
        self.load()

    def load(self) -> None:
        """Take up the newest state in the folder."""
        self.batch, self.paths = -1, {}
        if named := [n for n in self.files.names() if n.startswith("batch-")]:
            told = json.loads(self.files.read(named[-1]))
            self.batch, self.buckets, self.paths = told["batch"], told["buckets"], {int(k): v for k, v in told["paths"].items()}

    def _read(self, buckets: Iterable[int]) -> DataFrame | None:
        paths = sorted({f"{self.folder}/{self.paths[k]}" for k in buckets if k in self.paths})
        return self.spark.read.parquet(*paths).select(*changefeed.FEED) if paths else None

    def changes(self) -> DataFrame | None:
        return self._read(self.paths)

    def apply(self, batch: DataFrame, number: int) -> None:
        if number <= self.batch:
            return
        bucket = F.pmod(F.xxhash64("subject", "predicate"), F.lit(self.buckets)).cast("int")
        with scratch():
            rows = cut(batch.select(*changefeed.FEED).where("subject IS NOT NULL AND predicate IS NOT NULL"), "micro")
            touched = sorted(r[0] for r in rows.select(bucket.alias("b")).distinct().collect())  # at most ``buckets``
            if touched:
                old = self._read(touched)
                new = changefeed.compact(rows if old is None else rows.unionByName(old)).withColumn("bucket", bucket)
                at = f"tables/{number}"
                new.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{at}")
                left = {k for k in touched if Files(self.spark, f"{self.folder}/{at}").exists(f"bucket={k}")}
                self.paths = {k: v for k, v in self.paths.items() if k not in touched} | {k: f"{at}/bucket={k}" for k in left}
            self._commit(number)
            for f in self.listeners:
                f(rows.select("subject", "predicate").distinct(), number)

    def _commit(self, number: int) -> None:
        self.files.write(f"batch-{number:012d}", json.dumps({"batch": number, "buckets": self.buckets, "paths": self.paths}))
        before, self.batch = self.batch, number
        if before < 0:
            return
        # what only the state before the last one names is no longer read; the last one may still be
        for n in self.files.names():
            if n.startswith("batch-") and n < f"batch-{before:012d}":
                self.files.delete(n)
        kept = {v for n in self.files.names() if n.startswith("batch-") for v in json.loads(self.files.read(n))["paths"].values()}
        tables = Files(self.spark, f"{self.folder}/tables")
        for n in tables.names():
            if not any(v.startswith(f"tables/{n}/") for v in kept):
                tables.delete(n)

    def current(self) -> DataFrame:
        changes = self.changes()
        if changes is None:
            return self.spark.createDataFrame([], "subject long, predicate string, object string, seq long")
        return changefeed.current_values(changes)


def fold_stream(stream: DataFrame, state: FoldedState, available_now: bool = True):
    """Start folding a stream of changes (columns of changefeed.FEED) into the state."""
    writer = stream.writeStream.foreachBatch(lambda df, n: state.apply(df, n)).option("checkpointLocation", f"{state.folder}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def read_feed(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """A change feed in a file or a folder of files as a stream."""
    schema = spark.read.parquet(path).schema
    # a single file and a folder of files are both read as a pattern
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(path + "*")


def stream_current_values(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """Current values after streaming all files of a change feed."""
    state = FoldedState(spark, f"{shared_dir(spark).rstrip('/')}/kronoweft/stream-{uuid.uuid4().hex}", buckets=max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    fold_stream(read_feed(spark, path, files_per_batch), state).awaitTermination()
    return state.current()


class LiveQueries:
    """Registered queries whose results are compared after each change. fn: () -> DataFrame."""

    def __init__(self, most: int = 64):
        self.most, self._next = most, 0
        self.queries: dict[int, tuple[Callable[[], DataFrame], DataFrame, Callable[[DataFrame, DataFrame], None]]] = {}

    def register(self, fn: Callable[[], DataFrame], on_change: Callable[[DataFrame, DataFrame], None]) -> int:
        if len(self.queries) >= self.most:
            raise RuntimeError(f"at most {self.most} live queries")
        self._next += 1
        self.queries[self._next] = (fn, cut(fn(), "live"), on_change)
        return self._next

    def deregister(self, number: int) -> bool:
        return self.queries.pop(number, None) is not None

    def changed(self) -> int:
        """Evaluate all queries anew and hand (added, removed) to those whose results differ. Returns their number."""
        told = 0
        for number, (fn, old, tell) in list(self.queries.items()):
            new = cut(fn(), "live")
            added, removed = new.subtract(old), old.subtract(new)
            if not (added.isEmpty() and removed.isEmpty()):
                self.queries[number] = (fn, new, tell)
                tell(added, removed)
                told += 1
        return told


@dataclass
class Watch:
    """A watched rule: its verdicts, the keys they rest on, and a journal of changes with a bounded number of heads.

    over: () -> subjects in type and unscoped; history: () -> fold.one_history. Labels are filtered when read.
    """

    rule: rules.Rule
    history: Callable[[], DataFrame]
    over: Callable[[], DataFrame]
    keep: int = 1024
    head: int = 0

    def __post_init__(self):
        self._judge()
        self.journal: list[tuple[int, DataFrame]] = []

    def _judge(self):
        verdicts, support = rules.judge(self.rule, self.history(), self.over())
        self.verdicts, self.support = cut(verdicts, "verdicts"), cut(support, "supports")

    def apply(self, touched: DataFrame, head: int) -> DataFrame:
        """Bring the verdicts up to a head at which the given keys were written; returns the diffs."""
        new, diffs, support = rules.maintain(self.rule, self.verdicts, self.support, self.history(), self.over(), touched)
        diffs = cut(diffs, "diffs")
        self.verdicts, self.support = cut(new, "verdicts"), cut(support, "supports")
        self.head = head
        self.journal = [*self.journal, (head, diffs)][-self.keep :]
        return diffs

    def changes(self, cursor: int, hidden: DataFrame | None = None) -> dict:
        """{changes, cursor} of all diffs after a cursor, or {resync, cursor} if the journal does not reach back."""
        oldest = self.journal[0][0] if self.journal else self.head + 1
        if cursor > self.head or (cursor < self.head and cursor < oldest - 1 and len(self.journal) >= self.keep):
            return {"resync": True, "cursor": self.head}
        out = None
        for h, d in self.journal:
            if h > cursor:
                d = d.withColumn("head", F.lit(h))
                out = d if out is None else out.unionByName(d)
        if out is not None and hidden is not None:
            out = out.join(hidden.select(F.col("node").alias("subject")), "subject", "left_anti")
        return {"changes": out, "cursor": self.head}
