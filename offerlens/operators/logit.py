"""One logistic regression per (character, card), for groups of any size.

Rows with equal covariates are first counted into cells, which loses nothing and shrinks the input
before its only large shuffle. Then all groups take their Newton steps together: a step is one
aggregate over the cells, so no group is ever brought to one task, and the number of jobs depends
on the steps, not on the groups. Groups that have ended leave the next step.
"""

from collections.abc import Iterator
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions import newton
from offerlens.operators.auc import auc_by_group
from offerlens.operators.model_input import FEATURES, FLAG, KEYS, check_features
from offerlens.schemas import EFFECT_FIELDS
from offerlens.sources.scratch import materialise, step_tables

# Fixed value: groups with fewer rows are reported as too small instead of fitted.
MIN_ROWS = 200

TOO_FEW = "too few rows"
ONE_CLASS = "one outcome class"

_RESULT = [field.split()[0] for field in EFFECT_FIELDS.strip().split(",")]


def _key_fields(df: DataFrame, by: tuple[str, ...]) -> str:
    return ", ".join(f"{key} {df.schema[key].dataType.simpleString()}" for key in by)


def cells(
    rows: DataFrame, by: tuple[str, ...], features: tuple[str, ...], outcome: str
) -> DataFrame:
    """Distinct covariates per group with their number of rows and of wins."""
    numbers = [F.col(name).cast("double").alias(name) for name in features]
    return (
        rows.select(*by, *numbers, F.col(outcome).cast("int").alias("won"))
        .groupBy(*by, *features)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("won").alias("wins"))
    )


def fit_effects(
    rows: DataFrame,
    features: tuple[str, ...] = FEATURES,
    outcome: str = "victory",
    min_rows: int = MIN_ROWS,
    by: tuple[str, ...] = KEYS,
) -> DataFrame:
    """Effect of the flag per group. Every group gives one row; a failed fit fills `error`.

    A group whose outcome is separated, wholly or partly, ends with `converged` false, whatever
    the order of its rows. Runs its jobs when called and writes the result once, as later steps
    read it several times. A column in `by` does not vary within a group, so it cannot be a
    feature as well.
    """
    check_features(features)
    if set(by) & set(features):
        raise ValueError(f"constant within a group: {sorted(set(by) & set(features))}")
    with step_tables(rows.sparkSession):
        counted = materialise(cells(rows, by, features, outcome))
        return materialise(_fit(counted, by, features, min_rows), keep=True)


def _known_error(n: float, wins: float, min_rows: int) -> str | None:
    if n < min_rows:
        return TOO_FEW
    return ONE_CLASS if wins in (0, n) else None


def _design(features: tuple[str, ...]) -> list[Column]:
    return [F.lit(1.0), *[F.col(name) for name in features]]


def _eta(features: tuple[str, ...]) -> Column:
    return sum(
        (F.get("beta", F.lit(i)) * x for i, x in enumerate(_design(features))), start=F.lit(0.0)
    )


def _statistics(
    counted: DataFrame, state: DataFrame, by: tuple[str, ...], features: tuple[str, ...]
) -> DataFrame:
    """Gradient, information matrix and log-likelihood per group at its coefficients.

    The state has one row per group. Sums are combined before the shuffle, so a group of any size
    sends one row per task. Only numbers are aggregated, as an array among the results would have
    every step sort all cells; the state joins the sums again afterwards.
    """
    design = _design(features)
    scored = counted.join(state.select(*by, "beta"), list(by)).withColumn("eta", _eta(features))
    scored = scored.withColumn("p", 1 / (1 + F.exp(-F.col("eta"))))
    n, wins, eta, p = (F.col(name) for name in ("n", "wins", "eta", "p"))
    scored = scored.withColumns({"_residual": wins - n * p, "_weight": n * p * (1 - p)})
    softplus = F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))
    products = list(combinations_with_replacement(design, 2))
    sums = scored.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum("wins").alias("wins"),
        *[F.sum(F.col("_residual") * x).alias(f"_gradient{i}") for i, x in enumerate(design)],
        *[F.sum(F.col("_weight") * x * y).alias(f"_information{i}") for i, (x, y) in enumerate(products)],
        F.sum(wins * eta - n * softplus).alias("log_lik"),
    )
    arrays = [
        F.array(*[f"_{name}{i}" for i in range(size)]).alias(name)
        for name, size in (("gradient", len(design)), ("information", len(products)))
    ]
    return sums.select(*by, "n", "wins", *arrays, "log_lik").join(state, list(by))


def _square(upper: np.ndarray, width: int) -> np.ndarray:
    matrix = np.zeros((width, width))
    matrix[np.triu_indices(width)] = upper
    return matrix + np.triu(matrix, 1).T


def _fit(
    counted: DataFrame, by: tuple[str, ...], features: tuple[str, ...], min_rows: int
) -> DataFrame:
    width, at = len(features) + 1, 1 + features.index(FLAG)
    state_fields = [*by, "beta", "scale", "least", "n", "error", "done", "converged"]
    state_schema = (
        f"{_key_fields(counted, by)}, beta array<double>, scale array<double>, least double, "
        "n bigint, error string, done boolean, converged boolean"
    )

    def advanced(row, taken: int) -> dict:
        beta, information = np.array(row.beta), _square(row.information, width)
        error, converged, scale, least = _known_error(row.n, row.wins, min_rows), None, None, None
        if error is None:
            if taken == 1:
                start = newton.start_scale(information)
                if start is None:
                    error = "Singular matrix"
                else:
                    scale, least = start
            else:
                scale, least = np.array(row.scale), row.least
        if error is None:
            if newton.is_separated(information, scale, least):
                converged = False
            else:
                beta, done = newton.step(beta, np.array(row.gradient), information, row.n)
                if done or taken == newton.MAX_STEPS:
                    converged = taken < newton.MAX_STEPS
        return {key: getattr(row, key) for key in by} | {
            "beta": beta, "scale": scale, "least": least, "n": row.n, "error": error,
            "done": error is not None or converged is not None, "converged": converged,
        }

    def advance(batches: Iterator[pd.DataFrame], taken: int) -> Iterator[pd.DataFrame]:
        for batch in batches:
            states = [advanced(row, taken) for row in batch.itertuples()]
            yield pd.DataFrame(states, columns=state_fields)

    def conclude(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            results = []
            for row in batch.itertuples():
                result = dict.fromkeys(_RESULT) | {key: getattr(row, key) for key in by}
                result |= {"n": row.n, "converged": row.converged, "auc": row.auc}
                result |= newton.inference(
                    np.array(row.beta), _square(row.information, width), at,
                    row.n, row.wins, row.log_lik,
                )
                results.append(result)
            yield pd.DataFrame(results, columns=[*by, *_RESULT])

    start = [
        F.array_repeat(F.lit(0.0), width).alias("beta"),
        F.lit(None).cast("array<double>").alias("scale"),
        F.lit(None).cast("double").alias("least"),
    ]
    # stored, so that its size is known and the first step moves no cells either
    active = materialise(counted.select(*by).distinct()).select(*by, *start)
    ended = []
    for taken in range(1, newton.MAX_STEPS + 1):
        sums = _statistics(counted, active.select(*by, "beta", "scale", "least"), by, features)
        state = materialise(
            sums.mapInPandas(lambda batches, taken=taken: advance(batches, taken), state_schema)
        )
        ended.append(state.filter("done"))
        active = state.filter("not done")
        if active.isEmpty():
            break
    final = materialise(reduce(DataFrame.unionByName, ended))

    fitted = final.filter(F.col("error").isNull())
    betas = fitted.select(*by, "beta", "scale", "least")
    scored = counted.join(betas, list(by)).select(
        *by,
        _eta(features).alias("eta"),
        F.col("wins").alias("positives"),
        (F.col("n") - F.col("wins")).alias("negatives"),
    )
    aucs = auc_by_group(scored, by, "eta").select(*by, "auc")
    concluded = (
        _statistics(counted, betas, by, features)
        .join(fitted.select(*by, "converged"), list(by))
        .join(aucs, list(by), "left")
        .mapInPandas(conclude, f"{_key_fields(counted, by)}, {EFFECT_FIELDS}")
    )
    failed = final.filter(F.col("error").isNotNull()).select(*by, "n", "error")
    return concluded.unionByName(failed, allowMissingColumns=True)
