"""Table sinks and sources."""

from typing import NamedTuple
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


class TableInfo(NamedTuple):
    """Load metadata of a written table."""

    path: str
    row_count: int


def _refuse_own_source(df: DataFrame, path: str) -> None:
    """An overwrite deletes the old files first: rows still to be read from them would be lost."""
    folder = f"/{urlparse(path).path.strip('/')}/"
    if any(folder in unquote(urlparse(file).path) for file in df.inputFiles()):
        raise ValueError(f"cannot overwrite '{path}' with rows read from it")


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | list[str] | None = None
) -> TableInfo:
    """Replace a table, its schema included, and report the row count that was stored.

    The count is read back from the file footers, so it states what a reader will see.
    `fmt="delta"` works where the session has the Delta extension.
    """
    _refuse_own_source(df, path)
    writer = df.write.format(fmt).mode("overwrite")
    if fmt == "delta":
        writer = writer.option("overwriteSchema", "true")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.save(path)
    return TableInfo(path, read_table(df.sparkSession, path, fmt).count())


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


def export_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header. `single_file` is for reports: it sends every row through one task."""
    _refuse_own_source(df, path)
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).csv(path)
