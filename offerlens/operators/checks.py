"""Quality checks: one row of counts per table; violations should be zero."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.functions.scalars import share_true


def check_runs(runs: DataFrame) -> DataFrame:
    """Rows, distinct keys, keys and rows in excess, and wins. Counted per key, not collected."""
    per_key = runs.groupBy("play_id").agg(
        F.count(F.lit(1)).alias("copies"), F.count_if("victory").alias("wins")
    )
    return per_key.agg(
        F.sum("copies").alias("n_runs"),
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(F.col("copies") > 1).alias("duplicate_keys"),
        F.sum(F.col("copies") - 1).alias("excess_rows"),
        F.sum("wins").alias("n_wins"),
    )


def check_picks(picks: DataFrame) -> DataFrame:
    """A card is named exactly when one was taken; floors never exceed the last floor."""
    taken, card = F.col("is_selected"), F.col("card")
    return picks.agg(
        F.count(F.lit(1)).alias("n_picks"),
        F.count_if(taken & card.isNull()).alias("selected_without_card"),
        F.count_if(~taken & card.isNotNull()).alias("skipped_with_card"),
        F.count_if(F.col("floors_gained") < 0).alias("negative_floors_gained"),
        share_true(~taken).alias("skip_rate"),
    )


def check_prepared(prepared: DataFrame) -> DataFrame:
    """Of the exclusive pairs of columns exactly one is filled."""
    card, floor = F.col("card_selected"), F.col("card_selected_floor")
    skipped = F.col("card_not_selected")
    return prepared.agg(
        F.count(F.lit(1)).alias("n_picks"),
        F.count_if(card.isNull() & floor.isNull() & ~skipped).alias("neither_filled"),
        F.count_if(card.isNotNull() & skipped).alias("both_filled"),
        share_true(skipped).alias("skip_rate"),
    )


def check_offers(offers: DataFrame) -> DataFrame:
    """One option is picked per occasion, none on a skip."""
    occasions = offers.groupBy("play_id", "pick_num").agg(
        F.count(F.lit(1)).alias("options"),
        F.count_if("was_picked").alias("picked"),
        F.max("was_skip").alias("was_skip"),
    )
    picked, skip = F.col("picked"), F.col("was_skip")
    return occasions.agg(
        F.sum("options").alias("n_offers"),
        F.count(F.lit(1)).alias("n_occasions"),
        F.count_if(skip).alias("n_skips"),
        F.count_if(skip & (picked > 0)).alias("skips_with_pick"),
        F.count_if(~skip & (picked != 1)).alias("occasions_without_one_pick"),
    )
