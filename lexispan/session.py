"""Session defaults and lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, memory: str = "8g", **conf) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lexispan")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false")
    )
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; local sessions without one get their own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return _own_folder[0]


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, for clusters on which it is not installed."""
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{os.path.basename(root)}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)


_staged: list[tuple[SparkSession, str]] = []


def _drop_paths(paths: list[tuple[SparkSession, str]]) -> None:
    for spark, path in paths:
        context = spark.sparkContext
        if context._jsc is None:
            continue
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def release_staged(since: int = 0) -> None:
    """Delete the tables that ``materialize`` has written from position ``since`` on; frames that read them end here."""
    paths = _staged[since:]
    del _staged[since:]
    _drop_paths(paths)


def staged_since(count: int) -> list[tuple[SparkSession, str]]:
    """What was staged after the first ``count`` tables that are there."""
    return _staged[count:]


def staged_count() -> int:
    return len(_staged)


def drop_staged(tables: list[tuple[SparkSession, str]]) -> None:
    """Delete some of the staged tables."""
    for table in tables:
        if table in _staged:
            _staged.remove(table)
            _drop_paths([table])


@contextlib.contextmanager
def staging():
    """Delete what is staged inside the block when it ends; results must be written before."""
    before = len(_staged)
    try:
        yield
    finally:
        release_staged(before)


def staged_path(spark: SparkSession) -> str:
    """A new folder under the shared one, deleted with the staged tables."""
    if not _staged:
        # Runs before the session's own exit handler, which was registered earlier.
        atexit.unregister(release_staged)
        atexit.register(release_staged)
    path = f"{shared_folder(spark).rstrip('/')}/lexispan/{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


def materialize(df: DataFrame, compression: str = "snappy", tidy: bool = False) -> DataFrame:
    """Write a frame once to the shared folder and go on from the written table.

    Used where several branches of a plan read the same expensive result, and
    to cut the lineage of loops. The table survives lost executors. It is
    deleted by ``release_staged``, at the end of ``staging``, or when the
    program ends. ``tidy`` lets Spark delete the shuffle files of earlier steps.
    """
    spark = df.sparkSession
    path = staged_path(spark)
    df.write.option("compression", compression).parquet(path)
    if tidy:
        # Shuffle files go when the plan that made them is collected; a long chain of steps would keep them all.
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)
