"""Run summary: one row per run that has picks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions.nested import count_where
from offerlens.operators.picks import SKIP, pick_stats
from offerlens.operators.runs import runs_with_picks, usable_choices

# Path codes and the summary column that counts each.
PATH_CODES = {
    "num_elites_fought": "E",
    "num_events": "?",
    "num_treasures": "T",
    "num_shops": "$",
}


def _code_count(code: str) -> Column:
    return count_where("path_taken", lambda step: step == code)


def _run_fields() -> list:
    return [
        "play_id", "victory", "floor_reached", "character_chosen", "ascension_level", "score",
        "playtime", "gold", "neow_bonus", "neow_cost", "player_experience", "killed_by",
        F.array_size("relics").alias("relic_count"),
        *[_code_count(code).alias(name) for name, code in PATH_CODES.items()],
        "campfire_rested", "campfire_upgraded",
        F.array_size("potions_obtained").alias("num_potions_obtained"),
    ]


def run_summary(runs: DataFrame, picks: DataFrame | None = None) -> DataFrame:
    """Outcome, path and pick counts per run.

    With a stored `picks` table the pick counts hold exactly the runs wanted, so one inner join
    both restricts the runs and attaches the counts. Without one everything is counted inside
    each run's own record, with no join and no shuffle; runs must then be unique, as ingested.
    """
    if picks is not None:
        return runs.select(_run_fields()).join(pick_stats(picks), "play_id")

    def decided(test) -> Column:
        known = count_where(usable_choices(), lambda choice: choice["picked"].isNotNull())
        # A sum over nothing but NULLs is NULL, not zero.
        return F.when(known > 0, count_where(usable_choices(), test)).cast("bigint")

    return runs_with_picks(runs).select(
        *_run_fields(),
        F.array_size(usable_choices()).cast("bigint").alias("pick_count"),
        decided(lambda choice: choice["picked"] != SKIP).alias("cards_picked"),
        decided(lambda choice: choice["picked"] == SKIP).alias("skip_count"),
    )
