"""Run-level operators."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions.nested import nested_max
from offerlens.functions.scalars import none_of
from offerlens.sources.scratch import materialise

# Flags of non-standard runs, and the floors a standard run ends on.
NON_STANDARD_FLAGS = ("is_endless", "is_daily", "is_trial", "chose_seed")
MIN_FLOOR = 5
MAX_FLOOR = 57

# Files whose names a driver may list.
MANY_FILES = 10_000


def drop_duplicate_runs(runs: DataFrame, key: str = "play_id") -> DataFrame:
    """One copy per key, the one from the smallest source file.

    Copies within one file are told apart by a content hash, so the survivor never depends on
    task order. The aggregate combines before the shuffle: a key with very many copies sends one
    row per task.

    Before that, a job over keys and files alone finds the files that are the smallest of some key.
    Only these are read in whole, so files that only repeat others, like rollups, are not parsed or
    moved. With more than `MANY_FILES` of them, as with a file per run, all rows are aggregated.
    Where no key comes twice in the files that are read, their rows are the result as they stand:
    nothing is sorted or shuffled.
    """
    columns = [name for name in runs.columns if name != key]
    order = F.struct("_source_file", F.xxhash64(*columns))
    found = materialise(runs.groupBy(key, "_source_file").agg(F.count(F.lit(1)).alias("copies")))
    smallest = found.groupBy(key).agg(F.min(F.struct("_source_file")).alias("first"))
    files = [row[0] for row in smallest.select("first._source_file").distinct().limit(MANY_FILES + 1).collect()]
    needed = runs
    if len(files) <= MANY_FILES:
        unnamed = F.col("_source_file").isNull() if None in files else F.lit(False)
        held = F.col("_source_file").isin([name for name in files if name is not None]) | unnamed
        needed = runs.filter(held)
        repeated = found.filter(held).groupBy(key).agg(F.sum("copies").alias("copies")).filter(F.col("copies") > 1)
        if repeated.isEmpty():
            return needed
    kept = needed.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("kept"))
    return kept.select(*[key if name == key else f"kept.`{name}`" for name in runs.columns])


def standard_runs(
    runs: DataFrame, min_floor: int = MIN_FLOOR, max_floor: int = MAX_FLOOR
) -> DataFrame:
    """Runs of the standard mode that passed the early floors and whose floors are consistent.

    Three-valued: a NULL flag drops the run, and so do missing or empty choices.
    """
    last_choice = nested_max("card_choices", "floor")
    anomalous = (F.col("floor_reached") > max_floor) | (last_choice > F.col("floor_reached"))
    return runs.filter(none_of(*NON_STANDARD_FLAGS) & (F.col("floor_reached") >= min_floor)).filter(
        ~anomalous
    )


def usable_choices() -> Column:
    """Choices of a run that carry a floor."""
    return F.filter("card_choices", lambda choice: choice["floor"].isNotNull())


def runs_with_picks(runs: DataFrame, picks: DataFrame | None = None, **floors) -> DataFrame:
    """Runs that have at least one pick event.

    With a stored `picks` table this is a semi join. Without one the same population is read off
    each run, with no join and no shuffle.
    """
    if picks is not None:
        return runs.join(picks.select("play_id"), "play_id", "left_semi")
    has_pick = (F.array_size(usable_choices()) > 0) & F.col("play_id").isNotNull()
    return standard_runs(runs, **floors).filter(has_pick)
