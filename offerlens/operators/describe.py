"""Distribution summary of a numeric column."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.operators.running import running, with_ranges

# Reported quartiles.
QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def _moments(column: str) -> list:
    return [
        F.count(column).alias("n"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
    ]


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, standard deviation, range, and approximate quartiles from a bounded sketch."""
    quartiles = [F.percentile_approx(column, p).alias(q) for q, p in QUARTILES.items()]
    return df.agg(*_moments(column), *quartiles)


def describe_exact(df: DataFrame, column: str) -> DataFrame:
    """As `describe` with exact, linearly interpolated quartiles.

    Equal values are counted first. The rank of each distinct value then comes from a running sum
    spread over many tasks, so no task holds the whole distribution.
    """
    counts = (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("times"))
    )
    counts = with_ranges(counts, "value")
    value, times, upto = F.col("value").cast("double"), F.col("times"), F.col("upto")
    mean = F.sum(value * times) / F.sum(times)
    known = counts.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("n"), mean.alias("mean")).first()

    def quartile(share: float) -> Column:
        rank = max(known["n"] - 1, 0) * share
        low, fraction = int(rank), rank % 1
        at = F.min(F.when(upto > low, value))
        after = F.min(F.when(upto > low + (fraction > 0), value))
        return at + (after - at) * fraction

    # the mean is known by now, so the spread is summed around it and nothing cancels
    squares = F.sum((value - F.lit(known["mean"]).cast("double")) ** 2 * times)
    spread = F.sqrt(squares / (known["n"] - 1)) if known["n"] > 1 else F.lit(None).cast("double")
    return running(counts, "value", times, "upto").agg(
        F.coalesce(F.sum("times"), F.lit(0)).alias("n"),
        mean.alias("mean"),
        spread.alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        *[quartile(share).alias(name) for name, share in QUARTILES.items()],
    )
