"""Tables that operators write for themselves, in the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Give the package to Python workers that would not find it (Spark's file server sends it)."""
    root, sc = Path(__file__).resolve().parents[2], spark.sparkContext
    known = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(root) in known or getattr(sc, "_loomspark_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="loomspark-")) / "loomspark.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "loomspark").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(path))
    sc._loomspark_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master, whose executors are threads of the driver, gets a temporary
    folder where none is set; on a cluster that is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = sc._jsc.sc().getCheckpointDir()
        found = own.get() if own.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="loomspark-")
        sc.setCheckpointDir(found)
    return found


#: Tables written by the open scratch scopes of a thread, innermost last.
_SCRATCH = threading.local()


def _scopes() -> list[list[str]]:
    if not hasattr(_SCRATCH, "open"):
        _SCRATCH.open = []
    return _SCRATCH.open


@contextmanager
def scratch() -> Iterator[None]:
    """A scope at whose end the tables written within it are deleted, but for kept ones."""
    _scopes().append([])
    try:
        yield
    finally:
        for path in _scopes().pop():
            fs, target = file_system(SparkSession.getActiveSession(), path)
            fs.delete(target, True)


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


#: Setting by which the shuffle files of a query end with it.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files; else they stay until the driver collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, keep: bool = False) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it back.

    ``keep``: the table outlives the innermost scratch scope.  All end with the application.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomspark-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(path)
    scopes = _scopes()[:-1] if keep else _scopes()
    if scopes:
        scopes[-1].append(path)
    fs, target = file_system(spark, path)
    fs.deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession, path: str, build: Callable[[], DataFrame], *partition: str) -> DataFrame:
    """The table at ``path``; built and written first if it is not there, or not whole."""
    fs, done = file_system(spark, f"{path}/_SUCCESS")
    if not fs.exists(done):
        table = build()
        with tidy(spark):
            table.write.mode("overwrite").partitionBy(*partition).parquet(path)
    return spark.read.parquet(path)


def version(spark: SparkSession, *paths: str) -> str:
    """A name for the present content of files: it changes with their names, sizes or times."""
    seen = []
    for path in paths:
        fs, target = file_system(spark, path)
        files = fs.listFiles(target, True)
        while files.hasNext():
            f = files.next()
            seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return uuid.uuid5(uuid.NAMESPACE_URL, "\n".join(sorted(seen))).hex
