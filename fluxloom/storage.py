"""Tables written between the stages of an operator, in the folder all executors share.

``materialize`` cuts lineage by writing parquet, not by caching: a lost executor
costs nothing but a re-read.  The folder is the one the cluster names in
``spark.checkpoint.dir``; only where that is unset (tests, local mode) a
temporary folder of our own is used.
"""

from __future__ import annotations

import atexit
import contextlib
import pathlib
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="fluxloom-")
        _written.append((spark, _own[app]))
    return _own[app]


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once a session; they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    here = pathlib.Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="fluxloom-package-")
    with zipfile.ZipFile(f"{folder}/fluxloom.zip", "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    spark.sparkContext.addPyFile(f"{folder}/fluxloom.zip")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path nobody has used yet; it is removed when the session's Python ends."""
    ship(spark)
    path = f"{shared_dir(spark)}/fluxloom/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system that holds ``path``, and the path object."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def release(spark: SparkSession | None = None) -> None:
    """Delete the tables written so far (of ``spark``, or of every session)."""
    for entry in [e for e in _written if spark is None or e[0] is spark]:
        _written.remove(entry)
        with contextlib.suppress(Exception):
            fs, at = file_system(*entry)
            fs.delete(at, True)


atexit.register(release)


#: Bytes a task reads at most, by Spark's default for files.
_SPLIT = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of ``df`` before a Python stage, where its input alone makes fewer splits."""
    ship(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if size >= cores * _SPLIT else df.repartition(cores)
