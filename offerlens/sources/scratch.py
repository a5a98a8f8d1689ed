"""Tables written to the shared scratch folder to cut lineage between the passes of a job."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def _base(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def ensure_scratch(spark: SparkSession) -> None:
    """For entry points: give a local session that names no scratch folder one of its own.

    Its executors share this machine. Elsewhere an unset folder stays an error.
    """
    if not _base(spark) and spark.sparkContext.master.startswith("local["):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="offerlens-"))


def scratch_dir(spark: SparkSession) -> str:
    """A new path under the folder that the cluster names in `spark.checkpoint.dir`."""
    base = _base(spark)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    return f"{base.rstrip('/')}/offerlens/{uuid.uuid4().hex}"


_steps: ContextVar[list[str] | None] = ContextVar("step tables", default=None)


@contextmanager
def step_tables(spark: SparkSession) -> Iterator[None]:
    """Drop the tables that are materialised inside, but for those that are kept."""
    paths: list[str] = []
    token = _steps.set(paths)
    try:
        yield
    finally:
        _steps.reset(token)
        for path in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialise(df: DataFrame, partition_by: str | None = None, keep: bool = False, compression: str | None = None) -> DataFrame:
    """Write the rows once and read them back: survives lost executors, and is not recomputed.

    Inside `step_tables` the copy lasts as long as that block, unless it is kept.
    """
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    steps = _steps.get()
    if steps is not None and not keep:
        steps.append(path)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    if compression:
        writer = writer.option("compression", compression)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
