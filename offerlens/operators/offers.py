"""Offers: one row per option shown, picked or passed over."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.functions.nested import or_empty
from offerlens.schemas import PICK_TYPES

# the run state that picks carry, under the names of the pick schema
OFFER_STATE = tuple(
    name
    for name in PICK_TYPES
    if name not in ("play_id", "pick_num", "card", "is_selected", "choice_floor", "not_picked_options")
)


def offers(picks: DataFrame) -> DataFrame:
    """Every option of every pick event, in one pass over the picks.

    The taken option is put before the passed ones and the list exploded with positions, so the
    table is scanned once and not once per side of a union.
    """
    taken = F.coalesce("is_selected", F.lit(False))
    options = F.concat(
        F.when(taken, F.array("card")).otherwise(F.array().cast("array<string>")),
        or_empty("not_picked_options"),
    )
    return picks.select(
        "play_id",
        "pick_num",
        F.posexplode(options).alias("position", "card_name"),
        taken.alias("taken"),
        (~F.col("is_selected")).alias("was_skip"),
        F.col("choice_floor").alias("floor"),
        *OFFER_STATE,
    ).select(
        "play_id",
        "pick_num",
        "card_name",
        (F.col("taken") & (F.col("position") == 0)).alias("was_picked"),
        "was_skip",
        "floor",
        *OFFER_STATE,
    )

