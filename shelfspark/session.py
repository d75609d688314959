"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_DIRS: dict[str, str] = {}
_SHIPPED: set[str] = set()
_SCOPES: list[list[str]] = []  # paths made inside each open `scratch`


def build_session(app: str = "shelfspark", cores: str = "*", partitions: int = 8) -> SparkSession:
    """Local session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir` where the cluster sets it."""
    app = spark.sparkContext.applicationId
    if app not in _DIRS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base:
            _DIRS[app] = f"{base.rstrip('/')}/shelfspark-{app}"
        elif spark.sparkContext.master.startswith("local"):
            _DIRS[app] = tempfile.mkdtemp(prefix="shelfspark-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return _DIRS[app]


def new_path(spark: SparkSession, name: str) -> str:
    """Fresh path for a written table, a sink or a stream checkpoint."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in whatever store holds it; a missing one is no error."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of the data files under a file or folder, in whatever store holds it; none if it is missing."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found, todo = [], fs.listFiles(at, True)
    while todo.hasNext():
        f = todo.next()
        if not f.getPath().getName().startswith(("_", ".")):
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(found)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside go when the block ends, so what is read later must be written outside or to a path of its own."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            delete(spark, path)


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage: write `df` once to the shared folder and read it back.

    Later passes scan only the columns they need, and a lost executor costs a
    re-read of a file instead of a rerun of the whole plan.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application, so that Python functions import it there."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = os.path.dirname(os.path.abspath(__file__))
        base = os.path.join(tempfile.mkdtemp(prefix="shelfspark-ship-"), os.path.basename(root))
        spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(root), os.path.basename(root)))
        _SHIPPED.add(app)
    return spark
