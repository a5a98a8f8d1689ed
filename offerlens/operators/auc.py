"""Rank-based area under the ROC curve per group."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.operators.running import running, with_ranges


def auc_by_group(
    rows: DataFrame,
    by: tuple[str, ...],
    score: str,
    positives: str = "positives",
    negatives: str = "negatives",
) -> DataFrame:
    """AUC with ties counted half; NULL for a group with one outcome class.

    Rows carry counts of positive and negative outcomes; those without a score cannot be ranked and
    do not count. Scores are counted per group before any ordering, and the running sum is spread
    over score ranges, so a group may hold most rows.
    """
    counts = rows.filter(F.col(score).isNotNull()).groupBy(*by, score).agg(
        F.sum(positives).alias("positives"), F.sum(negatives).alias("negatives")
    )
    ranked = running(with_ranges(counts, score), score, F.col("negatives"), "upto", by)
    # counts of pairs outgrow a long, so multiply as doubles
    pos, neg = F.col("positives").cast("double"), F.col("negatives").cast("double")
    won_pairs = F.sum(pos * (F.col("upto") - neg / 2))
    all_pairs = F.sum(pos) * F.sum(neg)
    return ranked.groupBy(*by).agg(
        F.sum("positives").alias("n_positive"),
        F.sum("negatives").alias("n_negative"),
        F.when(all_pairs > 0, won_pairs / F.nullif(all_pairs, F.lit(0.0))).alias("auc"),
    )


def outcome_counts(rows: DataFrame, label: str) -> DataFrame:
    """A boolean label as the two counts that `auc_by_group` sums."""
    return rows.withColumns(
        {
            "positives": F.col(label).cast("bigint"),
            "negatives": (~F.col(label)).cast("bigint"),
        }
    )
