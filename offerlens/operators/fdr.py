"""False-discovery control."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.operators.running import running, with_ranges


def testable() -> Column:
    """Fitted without an error and converged."""
    return F.col("error").isNull() & F.coalesce("converged", F.lit(False))


def fdr_bh(
    results: DataFrame,
    p_value: str = "was_picked_pvalue",
    q_value: str = "was_picked_qvalue",
    tested: Column | None = None,
) -> DataFrame:
    """Benjamini-Hochberg q-values over the tested rows, NULL for the others.

    Equal p-values are counted into one step. Both the ranks (running count) and the step-up
    (running minimum from the largest p down) are spread over p ranges.
    """
    tested = testable() if tested is None else tested
    tested = tested & F.col(p_value).isNotNull()
    steps = (
        results.filter(tested)
        .groupBy(F.col(p_value).alias("_p"))
        .agg(F.count(F.lit(1)).alias("_times"))
    )
    ranges = with_ranges(steps, "_p")
    tests = ranges.agg(F.coalesce(F.sum("_times"), F.lit(0))).first()[0]
    ranked = running(ranges, "_p", F.col("_times"), "_rank")
    raw = F.col("_p") * tests / F.col("_rank")
    q_values = running(
        ranked.withColumn("_raw", raw), "_p", F.col("_raw"), "_q",
        combine=F.min, merge=F.least, descending=True,
    ).select(F.col("_p"), F.least("_q", F.lit(1.0)).alias(q_value))
    # rows without a test match nothing; keys below zero spread them over the join's tasks
    elsewhere = -1.0 - F.pmod(F.xxhash64(*results.columns), F.lit(1_000_000))
    key = F.when(tested, F.col(p_value)).otherwise(elsewhere)
    return results.join(q_values, key == F.col("_p"), "left").drop("_p")
