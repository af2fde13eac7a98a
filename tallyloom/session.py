"""Session construction and the one place that decides where scratch tables go."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "tallyloom", cores: int | str | None = None, **conf: str) -> SparkSession:
    """A session for local work. On a cluster, pass the cluster's own session instead."""
    n = cores or os.environ.get("BENCH_CPUS", "8")
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": str(n),
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return SparkSession.builder.master(f"local[{n}]").appName(name).config(map=defaults).getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder for tables that cut lineage.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that one is used
    whenever it is set. Only where it is unset (local mode, tests) is a folder of
    this machine made, once per session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = spark.conf.get("tallyloom.scratch", None)
    if not own:
        folder = tempfile.mkdtemp(prefix="tallyloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        own = "file://" + folder
        spark.conf.set("tallyloom.scratch", own)
    return own


#: Scratch tables written and not yet released, by the innermost ``scratch`` that owns them; the first level belongs to the session.
_OWNED: list[list[str]] = [[]]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Scratch tables that are written inside are deleted at the end.

    Results read from them lazily, so write or collect the result inside. Blocks may
    be nested; a table belongs to the innermost.
    """
    _OWNED.append([])
    try:
        yield
    finally:
        _delete(spark, _OWNED.pop())


def release(spark: SparkSession) -> int:
    """Delete every scratch table that no open ``scratch`` owns, and say how many; frames that still read them cannot be used any more."""
    gone, _OWNED[0][:] = list(_OWNED[0]), []
    _delete(spark, gone)
    return len(gone)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialise(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The result no longer depends on the plan above it, so a lost executor costs a
    re-read and not a recomputation, and several consumers share one computation.
    The table stays until the ``scratch`` around it ends, or until ``release``.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    _OWNED[-1].append(path)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
