"""Session helpers: a local session for tests and bench, the shared folder, lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def local_session(cpus: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("panelworks")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    A temporary folder serves only a local master; on a cluster a missing setting is an error,
    because executors would write to disks of their own.
    """
    context = spark.sparkContext
    conf = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    conf = conf or context.getCheckpointDir()
    if conf:
        return conf.rstrip("/")
    if not re.fullmatch(r"local(\[[^,\]]*(,\d+)?\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = spark.conf.get("panelworks.local.dir", None)
    if made is None:
        made = tempfile.mkdtemp(prefix="panelworks-")
        spark.conf.set("panelworks.local.dir", made)
    return made


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


#: Spark's switch for the removal of an execution's shuffle files as soon as it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Settings that hold for the executions inside only."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: a lineage cut that outlives any executor.

    Used where a costly table feeds several branches of one plan. As parquet it keeps column
    pruning, filter pushdown and true sizes for the join strategy. The shuffle files behind the
    table go as soon as it is written; otherwise they stay until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    with settings(spark, {SHUFFLE_CLEANUP: "true"}):
        df.write.parquet(path)
    return kept_at(spark, path, df.schema)


def kept_at(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table that was written under ``path``, for ``discard``."""
    kept = spark.read.schema(schema).parquet(path)
    kept._kept_at = path
    return kept


def discard(kept: DataFrame) -> None:
    """Remove the files of a written table that nothing will read again."""
    spark = kept.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(kept._kept_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
