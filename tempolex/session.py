"""Session helpers: a local session for tests, tables by name, and cut points of the lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int = 8, partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A session on one machine, for tests and the bench. On a cluster the caller brings the session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tempolex")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Where the setting is absent a folder of our own is made, but only on one machine (a local master): a cluster must name its folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[[^,\]]*(,[^,\]]*)?\])?$", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tempolex-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    except Exception:  # the session may have ended before us
        pass


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Queries run inside leave no shuffle files behind: what is written or collected needs none. The caller's setting is put back."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back: a cut of the lineage that survives a lost executor.

    Used where two branches read one expensive result. The table is removed when the driver ends; that of instead_of,
    an earlier result of this function that nothing reads any more, at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_released(spark):
        df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    if instead_of is not None:
        _remove(spark, instead_of._written_to)
    return out
