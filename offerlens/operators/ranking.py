"""Frequency and rank operators."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Rows per value, NULL included, most frequent first; `k` keeps the head of the report."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    ordered = counts.orderBy(F.desc("n"), F.asc(column))
    return ordered if k is None else ordered.limit(k)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values without NULL."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def distinct_count(df: DataFrame, *columns: str) -> DataFrame:
    """Number of distinct rows of the columns, combined per task before the shuffle."""
    return df.select(*columns).distinct().agg(F.count(F.lit(1)).alias("n_distinct"))


def top_by(
    df: DataFrame,
    metric: str,
    k: int,
    by: str | tuple[str, ...],
    ascending: bool = False,
    tie: str = "card_name",
) -> DataFrame:
    """The k first rows of each group by a metric, with their `position`; NULL metrics never rank.

    Spark cuts each task's rows to k per group before the shuffle, so large groups stay cheap.
    """
    order = F.asc(metric) if ascending else F.desc(metric)
    by = (by,) if isinstance(by, str) else by
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(order, F.asc(tie)))
    return (
        df.filter(F.col(metric).isNotNull())
        .withColumn("position", rank)
        .filter(F.col("position") <= k)
    )
