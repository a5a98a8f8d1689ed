"""Rows a model is fitted on, with the state known when the choice was made."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.sources.tables import TableInfo, read_table, write_table

KEYS = ("character_chosen", "card_name")
FLAG = "was_picked"
FEATURES = (FLAG, "hp_ratio", "floor", "relic_count", "ascension_level")

# Facts about how a run ended. As predictors they would give the outcome away.
LEAKS = ("floor_reached", "floors_gained", "victory")

_STATE = ("floor", "current_hp", "max_hp", "relic_count", "ascension_level")


def check_features(features: tuple[str, ...]) -> None:
    leaks = [name for name in features if name in LEAKS]
    if leaks:
        raise ValueError(f"known only after the run, so not allowed as predictors: {leaks}")
    if FLAG not in features:
        raise ValueError(f"the features must include '{FLAG}'")


def raw_model_rows(offers: DataFrame, outcome: str = "victory") -> DataFrame:
    """Nine columns of the offers; a row with a NULL in any of them is dropped."""
    return offers.select(*KEYS, FLAG, outcome, *_STATE).na.drop()


def with_hp_ratio(rows: DataFrame) -> DataFrame:
    """Health as a share of its maximum, in place of both columns. Kept where already present."""
    if "hp_ratio" in rows.columns:
        return rows
    return (
        rows.filter(F.col("max_hp") > 0)
        .withColumn("hp_ratio", F.col("current_hp") / F.col("max_hp"))
        .drop("current_hp", "max_hp")
    )


def model_input(offers: DataFrame, outcome: str = "victory") -> DataFrame:
    """One lazy plan from offers to model rows; nothing is collected."""
    return with_hp_ratio(raw_model_rows(offers, outcome))


def save_model_rows(offers: DataFrame, path: str, outcome: str = "victory") -> TableInfo:
    """Store the raw columns for repeated fits; the ratio is derived on reading."""
    return write_table(raw_model_rows(offers, outcome), path)


def load_model_rows(spark: SparkSession, path: str) -> DataFrame:
    return with_hp_ratio(read_table(spark, path))


def restrict_to_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of the listed (character, card) pairs. Spark broadcasts the list when it is small."""
    return rows.join(pairs.select(*KEYS).distinct(), list(KEYS))
