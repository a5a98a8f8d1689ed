"""Effect of picking on a continuous outcome, from boosted trees per listed (character, card)."""

import re
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.operators.logit import MIN_ROWS, TOO_FEW
from offerlens.operators.model_input import (
    FEATURES,
    FLAG,
    KEYS,
    check_features,
    model_input,
)
from offerlens.schemas import OUTCOME_EFFECT_FIELDS
from offerlens.sources.scratch import materialise, step_tables

# Size of the boosted model. The bins are the finest split grid it may use.
TREES = 200
DEPTH = 5
LEARNING_RATE = 0.05
MIN_LEAF = 20
BINS = 255

_SCHEMA = ", ".join(f"{key} string" for key in KEYS) + ", " + OUTCOME_EFFECT_FIELDS


def cells(rows: DataFrame, features: tuple[str, ...], outcome: str) -> DataFrame:
    """Distinct covariates per pair with their number of rows and mean outcome.

    Under squared loss these train the same trees as the rows: the spread inside a cell is the
    same on both sides of any split, and the leaf size is set as a weight.
    """
    numbers = [F.col(name).cast("double").alias(name) for name in features]
    return (
        rows.select("pair", *numbers, F.col(outcome).cast("double").alias("value"))
        .groupBy("pair", *features)
        .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    )


def counterfactual_effect(
    offers: DataFrame,
    pairs: list[tuple[str, str]],
    outcome: str = "floors_gained",
    features: tuple[str, ...] = FEATURES,
    min_rows: int = MIN_ROWS,
    trees: int = TREES,
    at_once: int = 4,
) -> DataFrame:
    """Mean prediction with the flag forced on minus forced off, per listed pair.

    The list is short and hand-picked, so there is one distributed fit per pair and the driver
    only holds one result row for each; a fit takes about five small jobs per tree, whatever the
    rows. `at_once` fits share the cluster. Bins limit the split candidates of a feature. An empty
    list gives an empty frame with the same columns; a fit that fails ends the call.
    """
    check_features(features)
    if min_rows < 2 * MIN_LEAF:
        raise ValueError(f"a split needs two leaves of {MIN_LEAF} rows")
    spark = offers.sparkSession
    listed = sorted(set(pairs))
    if not listed:
        return spark.createDataFrame([], _SCHEMA)
    numbered = spark.createDataFrame(
        [(number, *pair) for number, pair in enumerate(listed)],
        f"pair int, {', '.join(f'{key} string' for key in KEYS)}",
    )
    rows = model_input(offers, outcome).join(numbered, list(KEYS))
    # one folder per pair, so that a fit reads its own cells only; the rebalance gives a small
    # pair one file and splits a large one
    counted = cells(rows, features, outcome).hint("rebalance", "pair")
    with step_tables(spark):
        results = _effects(materialise(counted, partition_by="pair"), listed, features, min_rows, trees, at_once)
    # a pair without rows is no group, so it gives no result
    return spark.createDataFrame([r for r in results if r[len(KEYS)] > 0], _SCHEMA)


def _effects(
    counted: DataFrame, listed: list[tuple], features: tuple[str, ...], min_rows: int, trees: int, at_once: int
) -> list[tuple]:
    """One fit per pair, a few at a time."""

    def effect(number: int) -> tuple:
        own = counted.filter(F.col("pair") == number).drop("pair")
        n = own.agg(F.sum("n")).first()[0] or 0
        if n < min_rows:
            return (*listed[number], n, TOO_FEW, None, None)
        return (*listed[number], n, None, *_fit(own, n, features, trees))

    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(inheritable_thread_target(counted.sparkSession)(effect), range(len(listed))))


def _fit(counted: DataFrame, n: int, features: tuple[str, ...], trees: int) -> tuple[float, int]:
    """Effect of the flag, and the number of splits made on it."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="x")
    model = GBTRegressor(
        featuresCol="x",
        labelCol="mean",
        weightCol="n",
        maxIter=trees,
        maxDepth=DEPTH,
        stepSize=LEARNING_RATE,
        minInstancesPerNode=1,
        # weights are whole numbers; half a row less keeps the product with n from rounding above a leaf
        minWeightFractionPerNode=(MIN_LEAF - 0.5) / n,
        maxBins=BINS,
        seed=0,
    ).fit(assembler.transform(counted))

    def predicted(flag: float, name: str, df: DataFrame) -> DataFrame:
        forced = assembler.transform(df.withColumn(FLAG, F.lit(flag)))
        return model.setPredictionCol(name).transform(forced).drop("x")

    both = predicted(0.0, "passed", predicted(1.0, "picked", counted))
    effect = F.sum((F.col("picked") - F.col("passed")) * F.col("n")) / F.sum("n")
    on_flag = rf"If \(feature {features.index(FLAG)} "
    return both.agg(effect).first()[0], len(re.findall(on_flag, model.toDebugString))


def fitted_effects(results: DataFrame) -> DataFrame:
    """Fitted pairs, groups ascending and the largest effect first."""
    return (
        results.filter(F.col("error").isNull())
        .drop("error")
        .orderBy(F.asc("character_chosen"), F.desc("was_picked_effect"), F.asc("card_name"))
    )
