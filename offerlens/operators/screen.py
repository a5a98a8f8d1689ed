"""Lift screen: outcomes when an option was picked against when it was passed over."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.functions.scalars import correlation, share_true
from offerlens.operators.ranking import top_by

BY = ("character_chosen", "card_name")
# Outcome columns and the names their means and lifts are reported under.
OUTCOMES = {"win_rate": "victory", "floors_gained": "floors_gained"}
MIN_SIDE = 500
TOP = 15


def lift_table(
    offers: DataFrame,
    by: tuple[str, ...] = BY,
    flag: str = "was_picked",
    outcomes: dict[str, str] = OUTCOMES,
) -> DataFrame:
    """Counts, pick rate, and per outcome both conditional means and their difference.

    One aggregate that combines before the shuffle, so only one row per group and task moves and
    a group of any size stays cheap. A side without rows has a NULL mean and a NULL lift.
    """
    picked = F.col(flag)
    means = []
    for name, outcome in outcomes.items():
        value = F.col(outcome).cast("double")
        means += [
            F.avg(F.when(picked, value)).alias(f"{name}_picked"),
            F.avg(F.when(~picked, value)).alias(f"{name}_not_picked"),
        ]
    table = offers.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_offered"),
        F.sum(picked.cast("int")).alias("n_picked"),
        share_true(picked).alias("pick_rate"),
        *means,
    )
    return table.withColumns(
        {f"{name}_lift": F.col(f"{name}_picked") - F.col(f"{name}_not_picked") for name in outcomes}
    )


def enough_on_both_sides(table: DataFrame, min_n: int = MIN_SIDE) -> DataFrame:
    """Groups with at least `min_n` picked and `min_n` passed offers."""
    return table.withColumn("n_not_picked", F.col("n_offered") - F.col("n_picked")).filter(
        (F.col("n_picked") >= min_n) & (F.col("n_not_picked") >= min_n)
    )


def lift_screen(offers: DataFrame, min_n: int = MIN_SIDE, **table) -> DataFrame:
    return enough_on_both_sides(lift_table(offers, **table), min_n)


def top_lifts(screen: DataFrame, k: int = TOP, by: str = "character_chosen") -> DataFrame:
    """Per group the k options with the largest lift, one list per outcome, as `metric` rows.

    Each row enters every list, so the screen is computed once for all of them.
    """
    metrics = [f"{name}_lift" for name in OUTCOMES]
    lists = F.array(
        *[F.struct(F.lit(name).alias("metric"), F.col(name).alias("value")) for name in metrics]
    )
    columns = [by, "card_name", "n_offered", "pick_rate", "win_rate_lift", "floors_gained_lift"]
    entered = screen.select(F.inline(lists), *columns)
    return top_by(entered, "value", k, ("metric", by)).select("metric", "position", *columns)


def popularity_correlation(screen: DataFrame, by: str = "character_chosen") -> DataFrame:
    """Does popularity follow impact? Correlations of pick rate and lifts within each group."""
    return screen.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_cards"),
        correlation("pick_rate", "win_rate_lift").alias("corr_pick_rate_win_rate_lift"),
        correlation("pick_rate", "floors_gained_lift").alias("corr_pick_rate_floors_gained_lift"),
        correlation("win_rate_lift", "floors_gained_lift").alias("corr_lifts"),
    )


def floor_adjusted_lift(
    offers: DataFrame, by: tuple[str, ...] = BY, outcome: str = "floors_gained"
) -> DataFrame:
    """Lift with the floor of the choice held fixed.

    Means of both sides are compared per floor, where room left to gain is the same, and averaged
    with the number of offers as weight. Floors seen on one side only cannot be compared.
    """
    value, picked = F.col(outcome).cast("double"), F.col("was_picked")
    floors = (
        offers.groupBy(*by, "floor")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.when(picked, value)).alias("picked"),
            F.avg(F.when(~picked, value)).alias("passed"),
        )
        .withColumn("lift", F.col("picked") - F.col("passed"))
        .filter(F.col("lift").isNotNull())
    )
    return floors.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_floors"),
        F.sum("n").alias("n_compared"),
        (F.sum(F.col("lift") * F.col("n")) / F.sum("n")).alias(f"{outcome}_adjusted_lift"),
    )
