"""Tiered offers: options of the boss choices, one row per option."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.functions.nested import or_empty
from offerlens.operators.picks import RUN_STATE
from offerlens.operators.runs import runs_with_picks

# Fixed value: tiers are numbered 0, 1, 2 after the bosses of the three acts.
MAX_TIER = 2


def tier_offers(
    runs: DataFrame, picks: DataFrame | None = None, max_tier: int = MAX_TIER
) -> DataFrame:
    """Boss options, picked or not. Here a skip is a missing pick, not a marker string.

    The tier is the list position, so cutting the list first equals filtering on the tier.
    """
    chosen = F.col("event.picked")
    was_skip = chosen.isNull()
    options = F.concat(
        F.when(~was_skip, F.array(chosen)).otherwise(F.array().cast("array<string>")),
        or_empty("event.not_picked"),
    )
    events = runs_with_picks(runs, picks).select(
        "play_id",
        F.posexplode(F.slice("boss_relics", 1, max_tier + 1)).alias("boss_relic_tier", "event"),
        F.array_size("relics").alias("relic_count"),
        *RUN_STATE,
    )
    return events.select(
        "play_id",
        "boss_relic_tier",
        F.posexplode(options).alias("position", "relic_name"),
        was_skip.alias("was_skip"),
        "relic_count",
        *RUN_STATE,
    ).select(
        "play_id",
        "boss_relic_tier",
        "relic_name",
        (~F.col("was_skip") & (F.col("position") == 0)).alias("was_picked"),
        "was_skip",
        "relic_count",
        "floor_reached",
        "victory",
        "character_chosen",
        "ascension_level",
        "neow_bonus",
        "neow_cost",
        "player_experience",
    )
