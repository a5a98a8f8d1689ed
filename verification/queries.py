"""Queries over the test tables, one or more per operator."""

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.operators import checks, describe, offers, picks, ranking, report, runs, screen
from offerlens.operators.auc import auc_by_group, outcome_counts
from offerlens.operators.boosting import boosted_effects
from offerlens.operators.counterfactual import counterfactual_effect
from offerlens.operators.fdr import fdr_bh
from offerlens.operators.logit import fit_effects
from offerlens.operators.model_input import (
    KEYS,
    load_model_rows,
    model_input,
    restrict_to_pairs,
    save_model_rows,
)
from offerlens.operators.summary import run_summary
from offerlens.operators.tiers import tier_offers
from offerlens.plans.analysis import effect_models, screened_pairs
from offerlens.plans.build import build_tables, load_table
from offerlens.sources import records
from offerlens.sources.laid_out import load_pairs, save_bucketed, save_by_pair
from offerlens.sources.scratch import materialise, scratch_dir
from offerlens.sources.tables import export_csv, read_table, write_table
from verification import order_runs as fixture

# The test groups are small and spread evenly, so the screen and the pool are asked for less.
MIN_SIDE = 20
NATIVE_SHARE = 0.2

RUN_FIELDS = (
    "play_id", "character_chosen", "ascension_level", "victory", "floor_reached", "score",
    "playtime", "gold", "killed_by",
)

Query = Callable[[SparkSession, str], DataFrame]


_stored: dict[str, str] = {}


def store_runs(spark: SparkSession, sf_dir: str) -> None:
    """Write the runs of the tables once, for queries that are to be timed without their making."""
    path = scratch_dir(spark)
    fixture.order_runs(spark, sf_dir).write.parquet(path)
    _stored[sf_dir] = path


def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    if sf_dir in _stored:
        return spark.read.parquet(_stored[sf_dir])
    return fixture.order_runs(spark, sf_dir)


def _picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picks.pick_events(order_runs(spark, sf_dir))


def _offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers.offers(_picks(spark, sf_dir))


def _stored_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What screens and models read of the offers, written once for both."""
    return materialise(
        _offers(spark, sf_dir).select(
            *KEYS, "was_picked", "victory", "floors_gained", "floor", "current_hp", "max_hp", "relic_count", "ascension_level"
        )
    )


def _lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.lift_table(_offers(spark, sf_dir))


def _screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.lift_screen(_offers(spark, sf_dir), MIN_SIDE)


def _n_choices() -> Column:
    return F.coalesce(F.array_size("card_choices"), F.lit(0)).cast("bigint").alias("n_choices")


def _joined(array: str) -> Column:
    return F.array_join(array, ",").alias(array)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in columns})


def _landing(spark: SparkSession, sf_dir: str) -> str:
    """The runs as JSON records, once per day folder and once more in a rollup.

    The runs are made once; the rollup repeats the records of the day folder. Files are compressed.
    """
    landing = scratch_dir(spark)
    wrapped = order_runs(spark, sf_dir).select(F.struct("*").alias("event"))
    wrapped.write.json(f"{landing}/daily", compression="gzip")
    spark.read.text(f"{landing}/daily").write.text(f"{landing}/rollup", compression="gzip")
    return landing


def runs_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    unique = order_runs(spark, sf_dir)
    copies = [
        unique.withColumn("_source_file", F.concat(F.lit("landing/"), F.col(key), F.lit(".json")))
        for key in ("character_chosen", "neow_bonus")
    ]
    kept = runs.drop_duplicate_runs(copies[0].unionByName(copies[1]))
    return kept.select(*RUN_FIELDS, _n_choices(), "_source_file")


def ingest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ingested = records.ingest_runs(spark, _landing(spark, sf_dir), multi_line=False)
    folder = F.regexp_extract("_source_file", r"/([^/]+)/[^/]+$", 1).alias("source_folder")
    return ingested.select(*RUN_FIELDS, _n_choices(), folder)


def flatten_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = order_runs(spark, sf_dir).select(
        F.struct(*RUN_FIELDS, "card_choices").alias("event"), _n_choices()
    )
    return records.flatten_structs(wrapped).drop("event.card_choices")


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = order_runs(spark, sf_dir).select("play_id", "card_choices")
    types = {"card_choices": nested.schema["card_choices"].dataType}
    decoded = records.decode_nested(records.encode_nested(nested), types)
    return decoded.select("play_id", F.posexplode("card_choices").alias("pick_num", "c")).select(
        "play_id", "pick_num", "c.floor", "c.picked",
        F.array_join("c.not_picked", ",").alias("not_picked"),
    )


def stored_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row count of each stored table as it was reported, and as it is read back, per character."""
    warehouse = scratch_dir(spark)
    built = build_tables(spark, _landing(spark, sf_dir), warehouse, multi_line=False)
    reported = spark.createDataFrame(
        [(name, info.row_count) for name, info in built.items()],
        "table_name string, reported bigint",
    )
    parts = [_key_hashes(load_table(spark, warehouse, name), name) for name in built]
    return reduce(DataFrame.unionByName, parts).join(reported, "table_name")


def table_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = write_table(
        _offers(spark, sf_dir), scratch_dir(spark), partition_by="character_chosen"
    )
    return read_table(spark, info.path)


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, path = _lift(spark, sf_dir), scratch_dir(spark)
    export_csv(table, path)
    return spark.read.option("header", True).schema(table.schema).csv(path)


def stored_model_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = save_model_rows(_offers(spark, sf_dir), scratch_dir(spark))
    return load_model_rows(spark, info.path)


def pick_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(describe.describe_exact(_picks(spark, sf_dir), "floors_gained"), "mean", "std")


def lift_by_ascension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.lift_table(
        _offers(spark, sf_dir),
        by=("character_chosen", "ascension_level", "card_name"),
        outcomes={"win_rate": "victory"},
    )


def popularity_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    correlations = screen.popularity_correlation(_screen(spark, sf_dir))
    return _rounded(correlations, *correlations.columns[2:])


def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [
        ("AUTOMOBILE", "Brand#1"), ("BUILDING", "Brand#2"), ("FURNITURE", "Brand#3+1"),
        ("MACHINERY", "Brand#4"),
    ]
    listed = spark.createDataFrame(pairs, ", ".join(f"{key} string" for key in KEYS))
    return restrict_to_pairs(model_input(_offers(spark, sf_dir)), listed)


def stored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model rows of the pairs that head the lists, read back from a table laid out by pair."""
    rows = model_input(_offers(spark, sf_dir))
    info = save_by_pair(rows, scratch_dir(spark))
    return load_pairs(spark, info.path, screened_pairs(_offers(spark, sf_dir), MIN_SIDE)).select(*rows.columns)


def _bucketed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Runs and picks as stored tables with buckets of the run."""
    name, path = f"t{uuid.uuid4().hex}", scratch_dir(spark)
    stored = save_bucketed(order_runs(spark, sf_dir), f"{name}_runs", f"{path}/runs")
    return stored, save_bucketed(picks.pick_events(stored), f"{name}_picks", f"{path}/picks")


def native_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _lift(spark, sf_dir).select(*KEYS, F.col("n_offered").alias("n"))
    return report.native_pool(sizes, NATIVE_SHARE)


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-derived test results: as many as orders, with repeated p-values."""
    segments = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = F.col("o_orderkey")
    uniform = ((key * 7919) % 10007 + 1) / 10008
    return (
        spark.read.parquet(f"{sf_dir}/orders.parquet")
        .join(segments, F.expr("o_custkey = c_custkey"))
        .select(
            F.col("c_mktsegment").alias("character_chosen"),
            F.concat(F.lit("Card#"), key.cast("string")).alias("card_name"),
            key.alias("n"),
            F.when(F.col("o_orderpriority") == "5-LOW", "too few rows").alias("error"),
            (F.col("o_orderstatus") != "P").alias("converged"),
            (F.col("o_totalprice") > 100000).alias("native_pool"),
            (uniform * uniform * uniform).alias("was_picked_pvalue"),
            (0.5 + (key % 1000) / 1000).alias("odds_ratio"),
        )
    )


def _significant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.significant(fdr_bh(_tests(spark, sf_dir)))


def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = outcome_counts(_offers(spark, sf_dir), "victory").withColumn(
        "score", F.col("floor") * 100 + F.col("relic_count")
    )
    return _rounded(auc_by_group(scored, KEYS, "score"), "auc")


def _rounded_effects(results: DataFrame) -> DataFrame:
    doubles = [
        name for name, kind in results.dtypes if kind == "double" and name != "character_share"
    ]
    return _rounded(results, *doubles)


def logit_2x2(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    rows = model_input(_offers(spark, sf_dir))
    return _rounded_effects(fit_effects(rows, features=("was_picked",), **options))


def _separated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits of an outcome that the flag decides for some options, wholly or on one side."""
    wholly, partly = F.col("card_name").startswith("Brand#2"), F.col("card_name").startswith("Brand#1")
    won = F.when(wholly, F.col("was_picked")).when(partly, F.col("was_picked") | F.col("victory"))
    rows = model_input(_offers(spark, sf_dir))
    rows = rows.withColumn("victory", won.otherwise(F.col("victory")))
    return materialise(fit_effects(rows, features=("was_picked",)))


def logit_2x2_separated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What does not converge has no effect to compare, only its status."""
    fits = _separated(spark, sf_dir)
    doubles = [name for name, kind in fits.dtypes if kind == "double"]
    shown = {name: F.when(F.col("converged"), F.col(name)) for name in doubles}
    return _rounded_effects(fits.withColumns(shown))


def logit_2x2_by_ascension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effect of taking any offered option, per character and difficulty."""
    return logit_2x2(spark, sf_dir, by=("character_chosen", "ascension_level"))


def _effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effect_models(_offers(spark, sf_dir), native_share=NATIVE_SHARE)


def ordered_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report over fits of an outcome on which some options have real effects."""
    rows = model_input(_offers(spark, sf_dir))
    helped = F.col("card_name").startswith("Brand#2") & F.col("was_picked") & (F.col("relic_count") % 2 == 0)
    rows = rows.withColumn("victory", F.col("victory") | helped)
    results = report.native_pool(fdr_bh(fit_effects(rows, features=("was_picked",))), NATIVE_SHARE)
    return _rounded_effects(report.ordered_report(report.significant(results)))


def lift_against_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _stored_offers(spark, sf_dir)
    compared = report.lift_against_effect(
        screen.lift_screen(stored, MIN_SIDE), effect_models(stored, native_share=NATIVE_SHARE)
    )
    return _rounded(
        compared.select(
            *KEYS, "n_offered", "win_rate_lift", "odds_ratio", "was_picked_qvalue",
            "small_controlled_effect",
        ),
        "odds_ratio", "was_picked_qvalue",
    )


def counterfactual_flag_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the flag as the only feature the trees give the difference of two means."""
    stored = _stored_offers(spark, sf_dir)
    pairs = screened_pairs(stored, MIN_SIDE)
    effects = counterfactual_effect(stored, pairs, features=("was_picked",), trees=2)
    return _rounded(effects.drop("was_picked_importance"), "was_picked_effect")


def _damaged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth run twice."""
    all_runs = order_runs(spark, sf_dir)
    return all_runs.unionByName(all_runs.filter(F.col("play_id").cast("bigint") % 5 == 0))


def _damaged_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards named on some skips, none named on some choices, and floors beyond the last one."""
    number = F.col("play_id").cast("bigint")
    card = F.when(number % 7 == 0, F.when(~F.col("is_selected"), "Brand#0")).otherwise(F.col("card"))
    gained = F.when(number % 11 == 0, -F.col("floors_gained") - 1).otherwise(F.col("floors_gained"))
    return _picks(spark, sf_dir).withColumns({"card": card, "floors_gained": gained})


def _damaged_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("play_id").cast("bigint")
    prepared = picks.prepared_picks(_picks(spark, sf_dir))
    empty = (number % 7 == 0) & ~F.col("card_not_selected")
    return prepared.withColumns(
        {
            "card_selected": F.when(number % 13 == 0, "Brand#0").when(~empty, F.col("card_selected")),
            "card_selected_floor": F.when(~empty, F.col("card_selected_floor")),
        }
    )


def _damaged_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All options of some occasions marked as picked, or as passed over."""
    number = F.col("play_id").cast("bigint")
    marked = F.when(number % 7 == 0, True).when(number % 11 == 0, False).otherwise(F.col("was_picked"))
    return _offers(spark, sf_dir).withColumn("was_picked", marked)


def _key_hashes(rows: DataFrame, name: str) -> DataFrame:
    """Rows of a stored table per character, and the sums of its numbers as a view of its content."""
    sums = [F.sum(F.col(c).cast("bigint")) for c, kind in rows.dtypes if kind in ("int", "bigint", "boolean")]
    total = reduce(Column.__add__, [F.coalesce(one, F.lit(0)) for one in sums])
    return rows.groupBy("character_chosen").agg(F.count("*").alias("row_count"), total.alias("content")).select(
        F.lit(name).alias("table_name"), "*"
    )


def _boosted(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """Every screened pair with all features; as many trees as the operator grows, unless told."""
    stored = _stored_offers(spark, sf_dir)
    pairs = screen.lift_screen(stored, MIN_SIDE).select(*KEYS)
    return _rounded(boosted_effects(stored, pairs, **options), "was_picked_effect")


QUERIES: dict[str, Query] = {
    "runs_dedup": runs_dedup,
    "ingest_runs": ingest_runs,
    "flatten_structs": flatten_structs,
    "json_round_trip": json_round_trip,
    "runs_standard": lambda s, d: runs.standard_runs(order_runs(s, d)).select(*RUN_FIELDS),
    "run_checks": lambda s, d: checks.check_runs(_damaged_runs(s, d)),
    "flag_value_counts": lambda s, d: ranking.value_counts(order_runs(s, d), "is_trial"),
    "floor_value_counts": lambda s, d: ranking.value_counts(order_runs(s, d), "floor_reached", 50),
    "card_value_counts": lambda s, d: ranking.value_counts(
        _picks(s, d).filter(F.col("card").isNotNull()), "card", 20
    ),
    "distinct_characters": lambda s, d: ranking.distinct_values(
        order_runs(s, d), "character_chosen"
    ),
    "sample_rows": lambda s, d: order_runs(s, d).select(*RUN_FIELDS).orderBy("play_id").limit(50),
    "choice_list": lambda s, d: picks.choice_list(order_runs(s, d)).withColumn(
        "not_picked", _joined("not_picked")
    ),
    "pick_events": lambda s, d: _picks(s, d).withColumn(
        "not_picked_options", _joined("not_picked_options")
    ),
    "pick_stats": lambda s, d: picks.pick_stats(_picks(s, d)),
    "skip_rate": lambda s, d: picks.skip_rate(_picks(s, d)),
    "pick_describe": pick_describe,
    "pick_describe_sketch": lambda s, d: _rounded(
        describe.describe(_picks(s, d), "floors_gained"), "mean", "std"
    ),
    "prepared_picks": lambda s, d: picks.prepared_picks(_picks(s, d)).withColumn(
        "not_picked_options", _joined("not_picked_options")
    ),
    "prepared_checks": lambda s, d: checks.check_prepared(_damaged_prepared(s, d)),
    "pick_checks": lambda s, d: checks.check_picks(_damaged_picks(s, d)),
    "offer_checks": lambda s, d: checks.check_offers(_damaged_offers(s, d)),
    "offers": _offers,
    "table_round_trip": table_round_trip,
    "run_summary": lambda s, d: run_summary(order_runs(s, d)),
    "run_summary_joined": lambda s, d: run_summary(order_runs(s, d), _picks(s, d)),
    "tier_offers": lambda s, d: tier_offers(order_runs(s, d)),
    "tier_offers_joined": lambda s, d: tier_offers(order_runs(s, d), _picks(s, d)),
    "run_summary_bucketed": lambda s, d: run_summary(*_bucketed(s, d)),
    "tier_offers_bucketed": lambda s, d: tier_offers(*_bucketed(s, d)),
    "stored_pairs": stored_pairs,
    "stored_tables": stored_tables,
    "lift_table": _lift,
    "csv_round_trip": csv_round_trip,
    "lift_screen": _screen,
    "lift_top_k": lambda s, d: screen.top_lifts(_screen(s, d)),
    "lift_by_ascension": lift_by_ascension,
    "floor_adjusted_lift": lambda s, d: _rounded(
        screen.floor_adjusted_lift(_offers(s, d)), "floors_gained_adjusted_lift"
    ),
    "popularity_corr": popularity_corr,
    "model_input": lambda s, d: model_input(_offers(s, d)),
    "stored_model_input": stored_model_input,
    "candidate_pairs": candidate_pairs,
    "pair_count": lambda s, d: ranking.distinct_count(model_input(_offers(s, d)), *KEYS),
    "native_pool": native_pool,
    "fdr_bh": lambda s, d: fdr_bh(_tests(s, d)),
    "significant": _significant,
    "report_summary": lambda s, d: report.report_summary(_significant(s, d)),
    "top_bottom": lambda s, d: report.top_bottom(_significant(s, d)),
    "auc_by_group": auc,
    "logit_2x2": logit_2x2,
    "logit_2x2_separated": logit_2x2_separated,
    "logit_2x2_by_ascension": logit_2x2_by_ascension,
    "effect_models": lambda s, d: _rounded_effects(_effects(s, d)),
    "ordered_report": ordered_report,
    "fit_counts": lambda s, d: report.fit_counts(_effects(s, d)),
    "error_breakdown": lambda s, d: report.error_breakdown(_effects(s, d)),
    "convergence_breakdown": lambda s, d: report.convergence_breakdown(_separated(s, d)),
    "lift_against_effect": lift_against_effect,
    "counterfactual_flag_only": counterfactual_flag_only,
    "counterfactual_effect": _boosted,
    "counterfactual_shallow": lambda s, d: _boosted(s, d, trees=2, depth=2),
}
