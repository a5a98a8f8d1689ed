"""Analyses from offers to reports, each one chain of operators."""

from pyspark.sql import DataFrame

from offerlens.operators.boosting import boosted_effects
from offerlens.operators.counterfactual import counterfactual_effect, fitted_effects
from offerlens.operators.fdr import fdr_bh
from offerlens.operators.logit import MIN_ROWS, fit_effects
from offerlens.operators.model_input import FEATURES, model_input
from offerlens.operators.report import NATIVE_SHARE, native_pool
from offerlens.operators.screen import MIN_SIDE, lift_screen, top_lifts


def effect_models(
    offers: DataFrame,
    features: tuple[str, ...] = FEATURES,
    min_rows: int = MIN_ROWS,
    native_share: float = NATIVE_SHARE,
) -> DataFrame:
    """One controlled fit per (character, card), with q-values and native-pool marks."""
    results = fit_effects(model_input(offers), features, min_rows=min_rows)
    return native_pool(fdr_bh(results), native_share)


def screened_pairs(
    offers: DataFrame, min_n: int = MIN_SIDE, k: int = 1
) -> list[tuple[str, str]]:
    """Pairs heading a character's lift lists: a short list to model further."""
    top = top_lifts(lift_screen(offers, min_n), k)
    return [tuple(row) for row in top.select("character_chosen", "card_name").distinct().collect()]


def outcome_effects(offers: DataFrame, pairs: list[tuple[str, str]], **options) -> DataFrame:
    """Fitted counterfactual effects of the listed pairs, sorted for reading."""
    return fitted_effects(counterfactual_effect(offers, pairs, **options))


def pair_effects(offers: DataFrame, pairs: DataFrame | None = None, **options) -> DataFrame:
    """Fitted counterfactual effects of all pairs, or those of a table, from trees grown together."""
    return fitted_effects(boosted_effects(offers, pairs, **options))
