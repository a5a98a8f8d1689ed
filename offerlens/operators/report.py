"""Reading the fitted effects: native pool, significance, summaries, diagnostics."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlens.functions.scalars import base_name
from offerlens.operators.fdr import testable
from offerlens.operators.ranking import top_by, value_counts

# Share of a card's offers that makes a character its owner, the accepted false
# discovery rate, and the odds ratios between which an effect is too small to report.
NATIVE_SHARE = 0.05
MAX_Q = 0.05
SMALL_EFFECT = (0.9, 1.1)
TOP = 5

REPORT_COLUMNS = (
    "character_chosen", "card_name", "n", "odds_ratio", "odds_ratio_ci_low", "odds_ratio_ci_high",
    "was_picked_pvalue", "was_picked_qvalue", "pseudo_r2", "auc",
)


def native_pool(results: DataFrame, threshold: float = NATIVE_SHARE) -> DataFrame:
    """Mark the cards a character owns: its share of all offers of the base card.

    Upgraded and base versions are summed first and then divided. Results hold one row per
    character and version, so a window over a base card stays that small, and one shuffle serves
    both windows.
    """
    named = results.withColumn("base_card", base_name("card_name"))
    total = F.sum("n").over(Window.partitionBy("base_card"))
    own = F.sum("n").over(Window.partitionBy("base_card", "character_chosen"))
    return named.withColumn("character_share", own / total).withColumn(
        "native_pool", F.col("character_share") >= threshold
    )


def significant(
    results: DataFrame, max_q: float = MAX_Q, small_effect: tuple[float, float] = SMALL_EFFECT
) -> DataFrame:
    """Effects that converged, are native, pass the false discovery rate, and matter in size."""
    low, high = small_effect
    ratio = F.col("odds_ratio")
    return results.filter(
        testable()
        & F.col("native_pool")
        & (F.col("was_picked_qvalue") < max_q)
        & ((ratio <= low) | (ratio >= high))
    )


def ordered_report(effects: DataFrame) -> DataFrame:
    """Report columns, groups ascending and the best effect first."""
    return effects.select(*REPORT_COLUMNS).orderBy(
        F.asc("character_chosen"), F.desc("odds_ratio"), F.asc("card_name")
    )


def report_summary(effects: DataFrame, by: str = "character_chosen") -> DataFrame:
    """Per group: number of effects, of positive and of negative ones."""
    return effects.groupBy(by).agg(
        F.count("card_name").alias("n_significant"),
        F.count_if(F.col("odds_ratio") > 1).alias("n_positive"),
        F.count_if(F.col("odds_ratio") < 1).alias("n_negative"),
    )


def top_bottom(
    effects: DataFrame, k: int = TOP, by: str = "character_chosen", metric: str = "odds_ratio"
) -> DataFrame:
    """Per group the k best and the k worst effects, marked by `side`, in one ranking."""
    sides = F.array(
        F.struct(F.lit("top").alias("side"), F.col(metric).alias("_rank_by")),
        F.struct(F.lit("bottom").alias("side"), (-F.col(metric)).alias("_rank_by")),
    )
    columns = [by, "card_name", "n", metric, "was_picked_pvalue"]
    entered = effects.select(F.inline(sides), *columns)
    return top_by(entered, "_rank_by", k, ("side", by)).select("side", "position", *columns)


def fit_counts(results: DataFrame) -> DataFrame:
    """How many groups there are, were fitted, converged, and are native where that is known."""
    fitted = F.col("error").isNull()
    counts = [
        F.count(F.lit(1)).alias("n_groups"),
        F.count_if(fitted).alias("n_fitted"),
        F.count_if(testable()).alias("n_converged"),
    ]
    if "native_pool" in results.columns:
        counts.append(F.count_if("native_pool").alias("n_native"))
    return results.agg(*counts)


def error_breakdown(results: DataFrame, k: int = 20) -> DataFrame:
    """The most frequent fit errors; NULL counts the fitted groups."""
    return value_counts(results, "error", k)


def convergence_breakdown(results: DataFrame) -> DataFrame:
    """Fitted groups by convergence."""
    return value_counts(results.filter(F.col("error").isNull()), "converged")


def lift_against_effect(screen: DataFrame, results: DataFrame) -> DataFrame:
    """Raw lift next to the controlled odds ratio of the same pair.

    A clear raw lift with an odds ratio near 1 marks a confounded one.
    """
    effects = results.filter(testable()).select(
        "character_chosen", "card_name", "odds_ratio", "was_picked_qvalue"
    )
    low, high = SMALL_EFFECT
    return screen.join(effects, ["character_chosen", "card_name"]).withColumn(
        "small_controlled_effect", (F.col("odds_ratio") > low) & (F.col("odds_ratio") < high)
    )
