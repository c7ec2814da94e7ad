"""Session and shared-storage helpers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "kronoweft", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE with skew-join, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application: they may not have it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_kronoweft", False):
        return
    home = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="kronoweft-")
    path = os.path.join(folder, "kronoweft.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f"kronoweft/{f.relative_to(home)}")
    sc.addPyFile(path)
    sc._kronoweft = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. In local mode, where there is one machine, a temporary one is made if none is set."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="kronoweft-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


class Files:
    """Small files and folders in any file system that Hadoop knows, through the session's JVM."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self) -> list[str]:
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._path(""))) if self.exists("") else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Write a file under a passing name and rename it, so that it is there whole or not at all."""
        self._fs.mkdirs(self._path(""))
        passing = self._path(f"_{name}.{uuid.uuid4().hex}")
        stream = self._fs.create(passing, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self._fs.delete(self._path(name), False)
        if not self._fs.rename(passing, self._path(name)):
            raise OSError(f"cannot rename to {self.root}/{name}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def bytes(self) -> int:
        return self._fs.getContentSummary(self._path("")).getLength() if self.exists("") else 0


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone already
        pass


_SCOPES: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that ``cut`` writes within are removed at its end: use it around work whose result has been written."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for spark, path in _SCOPES.pop():
            _remove(spark, path)


def table_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed at the end of the innermost ``scratch``, or else when the driver ends."""
    ship(spark)
    path = f"{shared_dir(spark).rstrip('/')}/kronoweft/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append((spark, path))
    else:
        atexit.register(_remove, spark, path)
    return path


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Later steps that read it several times neither recompute it nor depend on executors staying alive,
    and each reader still prunes columns and pushes filters. See ``table_path`` for when it is removed.
    """
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
