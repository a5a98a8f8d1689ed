"""The stored tables, from raw records to analysis-ready offers."""

from pyspark.sql import DataFrame, SparkSession

from offerlens.operators.offers import offers
from offerlens.operators.picks import pick_events
from offerlens.operators.summary import run_summary
from offerlens.operators.tiers import tier_offers
from offerlens.sources.records import ingest_runs
from offerlens.sources.tables import TableInfo, read_table, write_table

# Table names. The choice events are the card offers under their analysis name.
BRONZE_RUNS = "bronze_runs"
SILVER_PICKS = "silver_picks"
SILVER_CARD_OFFERS = "silver_card_offers"
GOLD_RUN_SUMMARY = "gold_run_summary"
GOLD_RELIC_OFFERS = "gold_relic_offers"
ALIASES = {"gold_card_choice_events": SILVER_CARD_OFFERS}

# What each table is built from, in an order that builds inputs first. Summary and relic offers
# need only the runs: the runs with picks are found in the run records themselves.
STEPS = {
    SILVER_PICKS: (BRONZE_RUNS, pick_events),
    SILVER_CARD_OFFERS: (SILVER_PICKS, offers),
    GOLD_RUN_SUMMARY: (BRONZE_RUNS, run_summary),
    GOLD_RELIC_OFFERS: (BRONZE_RUNS, tier_offers),
}


def build_tables(
    spark: SparkSession,
    landing: str,
    warehouse: str,
    only: list[str] | None = None,
    fmt: str = "parquet",
    partition_by: dict[str, str] | None = None,
    **ingest,
) -> dict[str, TableInfo]:
    """Build the tables, or the named ones from those already stored; gives paths and row counts."""
    wanted = [ALIASES.get(name, name) for name in only or [BRONZE_RUNS, *STEPS]]
    unknown = set(wanted) - {BRONZE_RUNS, *STEPS}
    if unknown:
        raise ValueError(f"unknown tables: {sorted(unknown)}")
    partition_by = partition_by or {}
    built = {}

    def write(name: str, df: DataFrame) -> None:
        path = f"{warehouse}/{name}"
        built[name] = write_table(df, path, fmt, partition_by.get(name))

    if BRONZE_RUNS in wanted:
        write(BRONZE_RUNS, ingest_runs(spark, landing, **ingest))
    for name, (source, build) in STEPS.items():
        if name in wanted:
            write(name, build(load_table(spark, warehouse, source, fmt)))
    return built


def load_table(
    spark: SparkSession, warehouse: str, name: str, fmt: str = "parquet"
) -> DataFrame:
    return read_table(spark, f"{warehouse}/{ALIASES.get(name, name)}", fmt)
