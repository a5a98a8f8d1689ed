"""Screens, fits and corrections against hand-computed values, brute force and MLlib."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import functions as F

from offerlens.functions import newton
from offerlens.functions.scalars import base_name, correlation
from offerlens.operators import counterfactual as cf, logit
from offerlens.operators.auc import auc_by_group
from offerlens.operators.checks import check_offers, check_picks, check_runs
from offerlens.operators.describe import describe, describe_exact
from offerlens.operators.fdr import fdr_bh
from offerlens.operators.logit import fit_effects
from offerlens.operators.model_input import FEATURES, KEYS, model_input
from offerlens.operators.ranking import top_by, value_counts
from offerlens.operators.report import (
    fit_counts,
    lift_against_effect,
    native_pool,
    ordered_report,
    report_summary,
    significant,
    top_bottom,
)
from offerlens.operators.running import running, with_ranges
from offerlens.operators.screen import floor_adjusted_lift, lift_screen, lift_table, top_lifts

MANY = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

OFFER = (
    "character_chosen string, card_name string, was_picked boolean, victory boolean, "
    "floors_gained bigint, floor int, current_hp bigint, max_hp bigint, relic_count int, "
    "ascension_level bigint"
)


def offer_rows(card, n, seed, flag=None, outcome=None, character="RED"):
    """Random offers of one card, with the outcome depending on flag and health."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        picked = rng.random() < 0.4 if flag is None else flag
        hp, floor = rng.randrange(1, 81), rng.randrange(1, 30)
        chance = 1 / (1 + math.exp(-(0.8 * picked + hp / 40 - 1.2)))
        won = rng.random() < chance if outcome is None else outcome(picked)
        gained = 20 + 5 * picked - floor // 2 + rng.randrange(4)
        rows.append(
            (character, card, picked, won, gained, floor, hp, 80, rng.randrange(6), rng.randrange(5))
        )
    return rows


# ---- running aggregates ----------------------------------------------------------------------


@MANY
@given(
    st.dictionaries(
        st.tuples(st.sampled_from(["a", "b", None]), st.integers(-50, 50)),
        st.integers(0, 9), min_size=1, max_size=40,
    ),
    st.sampled_from([2, 7, 64]),
)
def test_running_sum_equals_a_plain_loop(spark, values, ranges):
    rows = [(group, at, times) for (group, at), times in values.items()]
    df = spark.createDataFrame(rows, "g string, at int, times int")
    got = running(with_ranges(df, "at", ranges), "at", F.col("times"), "upto", ("g",)).collect()
    assert len(got) == len(rows)
    for row in got:
        assert row.upto == sum(t for g, at, t in rows if g == row.g and at <= row["at"])


def test_running_shuffles_the_rows_once(spark):
    df = with_ranges(spark.range(1000).select((F.col("id") % 3).alias("g"), "id"), "id", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = running(df, "id", F.col("id"), "upto", ("g",))
        out.collect()
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        physical = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Join" in plan
    # the rows themselves, their range totals, and the totals again in range order and for the join
    whole = [line for line in physical.splitlines() if "Exchange" in line and "_place" in line]
    sorts = [line for line in physical.splitlines() if "Sort [" in line and "id#" in line]
    assert len(whole) <= 3 and len(sorts) == 1, physical


def test_one_group_is_spread_over_many_ranges(spark):
    df = with_ranges(spark.range(10_000).select(F.lit("hot").alias("g"), "id"), "id", 50)
    sizes = [r["count"] for r in df.groupBy("_range").count().collect()]
    assert len(sizes) == 50 and max(sizes) < 400


# ---- false discovery --------------------------------------------------------------------------


def p_values_frame(spark, rows):
    return spark.createDataFrame(rows, "error string, converged boolean, was_picked_pvalue double")


def test_bh_by_hand_and_null_outside_the_tested_rows(spark):
    rows = [(None, True, p) for p in (0.01, 0.04, 0.03, 0.005)]
    rows += [(None, False, 0.001), ("too few rows", None, None), (None, None, 0.002)]
    got = {r.was_picked_pvalue: r.was_picked_qvalue for r in fdr_bh(p_values_frame(spark, rows)).collect()}
    assert got == pytest.approx(
        {0.01: 0.02, 0.04: 0.04, 0.03: 0.04, 0.005: 0.02, 0.001: None, None: None, 0.002: None}
    )


@MANY
@given(st.lists(st.sampled_from([0.0, 1e-12, 0.001, 0.02, 0.2, 0.5, 0.9, 1.0]), min_size=1, max_size=30))
def test_bh_equals_its_definition(spark, p_values):
    got = fdr_bh(p_values_frame(spark, [(None, True, p) for p in p_values])).collect()
    m = len(p_values)
    assert len(got) == m
    for row in got:
        later = [p for p in p_values if p >= row.was_picked_pvalue]
        expected = min(p * m / sum(x <= p for x in p_values) for p in later)
        assert row.was_picked_qvalue == pytest.approx(min(expected, 1.0))


# ---- area under the curve and distributions ----------------------------------------------------


@MANY
@given(st.lists(st.tuples(st.integers(0, 5), st.booleans()), min_size=1, max_size=40))
def test_auc_equals_counting_pairs(spark, cases):
    df = spark.createDataFrame(
        [("g", s, int(won), int(not won)) for s, won in cases],
        "g string, score int, positives int, negatives int",
    )
    got = auc_by_group(df, ("g",), "score").first()
    pos, neg = [s for s, won in cases if won], [s for s, won in cases if not won]
    assert (got.n_positive, got.n_negative) == (len(pos), len(neg))
    if not pos or not neg:
        assert got.auc is None
    else:
        won = sum((p > q) + (p == q) / 2 for p, q in itertools.product(pos, neg))
        assert got.auc == pytest.approx(won / len(pos) / len(neg))
        x = np.array([s for s, _ in cases], float)
        y = np.array([w for _, w in cases], float)


@MANY
@given(st.lists(st.one_of(st.none(), st.integers(-20, 20)), max_size=30))
def test_exact_description_equals_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v int")
    got = describe_exact(df, "v").first()
    known = [v for v in values if v is not None]
    assert got.n == len(known)
    if known:
        expected = [np.mean(known), min(known), max(known), *np.quantile(known, [0.25, 0.5, 0.75])]
        assert [got["mean"], got["min"], got["max"], got.p25, got.p50, got.p75] == pytest.approx(expected)
    if len(known) > 1:
        assert got["std"] == pytest.approx(np.std(known, ddof=1))
    else:
        assert got["std"] is None


def test_sketched_description(spark):
    got = describe(spark.range(101), "id").first()
    assert (got.n, got["mean"], got["min"], got["max"], got.p50) == (101, 50.0, 0, 100, 50)


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0)], "x double, y double, c double")
    row = df.agg(correlation("x", "y").alias("xy"), correlation("x", "c").alias("xc")).first()
    assert row.xy == pytest.approx(1.0) and row.xc is None


# ---- lift ---------------------------------------------------------------------------------------


def test_lift_by_hand(spark):
    rows = [
        ("RED", "X", True, True, 10), ("RED", "X", True, False, 20), ("RED", "X", False, False, 6),
        ("RED", "Y", True, True, 5),
    ]
    df = spark.createDataFrame(
        rows, "character_chosen string, card_name string, was_picked boolean, victory boolean, floors_gained int"
    )
    got = {r.card_name: r for r in lift_table(df).collect()}
    assert (got["X"].n_offered, got["X"].n_picked) == (3, 2)
    assert got["X"].pick_rate == pytest.approx(2 / 3)
    assert (got["X"].win_rate_lift, got["X"].floors_gained_lift) == (0.5, 9.0)
    assert got["Y"].win_rate_not_picked is None and got["Y"].win_rate_lift is None
    assert [r.card_name for r in lift_screen(df, 1).collect()] == ["X"]
    top = top_lifts(lift_screen(df, 1), 1).collect()
    assert {(r.metric, r.position, r.card_name) for r in top} == {
        ("floors_gained_lift", 1, "X"), ("win_rate_lift", 1, "X"),
    }


def test_floor_adjusted_lift_compares_within_floors(spark):
    """Picks happen early, where more can be gained: the raw lift shows that, the adjusted not."""
    rows = [("RED", "X", floor == 1 or i == 0, 50 - floor, floor) for floor in (1, 40) for i in range(9)]
    rows += [("RED", "X", False, 49, 1)]
    df = spark.createDataFrame(
        rows, "character_chosen string, card_name string, was_picked boolean, floors_gained int, floor int"
    )
    row = floor_adjusted_lift(df).first()
    assert (row.n_floors, row.n_compared, row.floors_gained_adjusted_lift) == (2, 19, 0.0)


def test_top_by_breaks_ties_by_name_and_skips_null(spark):
    df = spark.createDataFrame(
        [("g", "b", 1.0), ("g", "a", 1.0), ("g", "c", None), ("h", "d", 2.0)], "g string, card_name string, m double"
    )
    got = top_by(df, "m", 2, "g").orderBy("g", "position").collect()
    assert [(r.g, r.card_name) for r in got] == [("g", "a"), ("g", "b"), ("h", "d")]
    last = top_by(df, "m", 1, "g", ascending=True).orderBy("g").collect()
    assert [(r.g, r.card_name) for r in last] == [("g", "a"), ("h", "d")]
    plan = top_by(df, "m", 2, "g")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_value_counts_keep_null(spark):
    df = spark.createDataFrame([("x",), (None,), ("x",)], "v string")
    assert [tuple(r) for r in value_counts(df, "v").collect()] == [("x", 2), (None, 1)]


# ---- model input ----------------------------------------------------------------------------


def test_model_rows_need_every_column_and_a_positive_maximum(spark):
    good = ("RED", "X", True, True, 5, 3, 40, 80, 1, 2)
    rows = [good]
    rows += [good[:i] + (None,) + good[i + 1 :] for i in range(len(good)) if i != 4]
    rows += [good[:4] + (None,) + good[5:], good[:7] + (0,) + good[8:]]
    got = model_input(spark.createDataFrame(rows, OFFER)).collect()
    assert len(got) == 2 and {r.hp_ratio for r in got} == {0.5}


# ---- logistic fits -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def fitted(spark):
    """Groups of every kind."""
    rows = offer_rows("normal", 800, 1) + offer_rows("other", 300, 2)
    rows += offer_rows("n199", 199, 3) + offer_rows("n200", 200, 4)
    rows += offer_rows("always picked", 250, 5, flag=True) + offer_rows("never", 250, 6, flag=False)
    rows += offer_rows("always won", 250, 7, outcome=lambda picked: True)
    rows += offer_rows("separated", 250, 8, outcome=lambda picked: picked)
    rows += offer_rows("normal", 400, 9, character="BLUE")
    offers = spark.createDataFrame(rows, OFFER)
    model = model_input(offers)
    by_name = lambda df: {(r.character_chosen, r.card_name): r for r in df.collect()}
    return offers, by_name(fit_effects(model))


def test_every_group_gives_one_row_with_its_error(fitted):
    _, results = fitted
    errors = {card: r.error for (character, card), r in results.items() if character == "RED"}
    assert errors == {
        "normal": None, "other": None, "n200": None, "n199": "too few rows", "separated": None,
        "always picked": "Singular matrix", "never": "Singular matrix",
        "always won": "one outcome class",
    }
    assert results["RED", "n199"].n == 199
    assert results["RED", "normal"].converged and results["RED", "normal"].n == 800
    assert results["RED", "separated"].converged is False


def test_status_of_separated_groups_does_not_depend_on_order_or_partitions(spark):
    """Whole and one-sided separation by the flag and by health, and groups that only come near it."""
    rng = random.Random(11)
    rules = {
        "whole": lambda r: r[2],
        "picked win": lambda r: r[2] or r[3],
        "healthy win": lambda r: r[6] > 40 or r[3] and r[6] > 30,
        "by health": lambda r: r[6] > 40,
    }
    rows, near = [], set()
    for k in range(40):
        name, rule = list(rules.items())[k % 4]
        card = f"{name} {k}"
        own = [(*r[:3], bool(rule(r)), *r[4:]) for r in offer_rows(card, 210 + k, 100 + k)]
        if name == "healthy win":  # both outcomes where health is middling
            near.add(card)
        if k >= 32:  # one row against the rule: nearly separated, but a fit exists
            near.add(card)
            i = next(i for i, r in enumerate(own) if r[2] and r[3] and r[6] > 45)
            own[i] = (*own[i][:3], False, *own[i][4:])
        rows += own
    seen = set()
    for partitions in (1, 8):
        rng.shuffle(rows)
        model = model_input(spark.createDataFrame(rows, OFFER).repartition(partitions))
        got = {(r.card_name, r.error, r.converged) for r in fit_effects(model).collect()}
        assert len(got) == 40
        seen.add(frozenset(got))
    assert len(seen) == 1
    for card, error, converged in seen.pop():
        assert error is None
        assert card in near or converged is False, card


def plain_fit(rows, steps=30):
    """Newton steps on all rows at once."""
    x = np.array([[1.0, r.was_picked, r.hp_ratio, r.floor, r.relic_count, r.ascension_level] for r in rows])
    y, beta = np.array([float(r.victory) for r in rows]), np.zeros(6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve((x.T * (p * (1 - p))) @ x, x.T @ (y - p))
    return beta


def test_coefficients_equal_plain_newton_steps(fitted):
    offers, results = fitted
    for card in ("normal", "other", "n200"):
        rows = model_input(offers).filter(f"character_chosen = 'RED' AND card_name = '{card}'").collect()
        assert results["RED", card].was_picked_coef == pytest.approx(plain_fit(rows)[1], rel=1e-8)


def test_coefficient_and_error_equal_a_generalized_linear_model(fitted, spark):
    offers, results = fitted
    rows = model_input(offers).filter("character_chosen = 'RED' AND card_name = 'normal'")
    numbers = rows.select(*[F.col(c).cast("double") for c in (*FEATURES, "victory")])
    x = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(numbers)
    glm = GeneralizedLinearRegression(
        family="binomial", labelCol="victory", featuresCol="x", tol=1e-12, maxIter=50
    ).fit(x)
    got = results["RED", "normal"]
    assert got.was_picked_coef == pytest.approx(glm.coefficients[0], abs=1e-9)
    se = math.log(got.odds_ratio_ci_high / got.odds_ratio_ci_low) / 2 / newton.Z_95
    assert se == pytest.approx(glm.summary.coefficientStandardErrors[0], rel=1e-7)
    assert got.odds_ratio == pytest.approx(math.exp(got.was_picked_coef))
    assert got.was_picked_pvalue == pytest.approx(math.erfc(abs(got.was_picked_coef) / se / math.sqrt(2)))
    assert got.pseudo_r2 == pytest.approx(1 - glm.summary.deviance / glm.summary.nullDeviance)


def test_flag_alone_gives_the_log_odds_ratio_of_the_table(fitted, spark):
    offers, _ = fitted
    rows = model_input(offers).filter("card_name = 'other'")
    table = {(r.was_picked, r.victory): r["count"] for r in rows.groupBy("was_picked", "victory").count().collect()}
    a, b, c, d = (table[k] for k in ((True, True), (True, False), (False, True), (False, False)))
    got = fit_effects(rows, features=("was_picked",)).first()
    assert got.was_picked_coef == pytest.approx(math.log(a * d / b / c), abs=1e-9)


def test_a_fit_leaves_only_its_result(fitted, spark, monkeypatch, tmp_path):
    offers, _ = fitted
    monkeypatch.setattr("offerlens.sources.scratch._base", lambda session: str(tmp_path))
    got = fit_effects(model_input(offers).filter("card_name = 'other'"), features=("was_picked",))
    assert len(list((tmp_path / "offerlens").iterdir())) == 1
    assert got.count() == 1


def test_a_step_neither_sorts_nor_moves_cells(spark):
    rows = model_input(spark.createDataFrame(offer_rows("A", 40, 1) + offer_rows("B", 40, 2), OFFER))
    counted = logit.cells(rows, KEYS, FEATURES, "victory")
    start = [F.array_repeat(F.lit(0.0), 6).alias("beta"), F.lit(None).cast("array<double>").alias("scale"), F.lit(1.0).alias("least")]
    state = counted.select(*KEYS).distinct().select(*KEYS, *start)
    sums = logit._statistics(counted, state, KEYS, FEATURES)
    assert "SortAggregate" not in sums._jdf.queryExecution().executedPlan().toString()
    for row in sums.collect():
        own = counted.filter(F.col("card_name") == row.card_name).collect()
        signs = [r.wins - r.n / 2 for r in own]
        design = [[1.0, *(r[name] for name in FEATURES)] for r in own]
        assert row.gradient == pytest.approx(list(np.array(design).T @ signs))
        weighted = np.array(design).T @ (np.array(design) * np.array([[r.n / 4] for r in own]))
        assert row.information == pytest.approx(list(weighted[np.triu_indices(6)]))
        assert (row.n, row.wins, row.beta, row.scale, row.least) == (40, sum(r.wins for r in own), [0.0] * 6, None, 1.0)


def test_effects_by_another_group_key(fitted):
    offers, _ = fitted
    by = ("character_chosen", "ascension_level")
    features = ("was_picked", "hp_ratio", "floor", "relic_count")
    got = fit_effects(model_input(offers), features, min_rows=50, by=by)
    assert got.columns[:2] == list(by) and dict(got.dtypes)["ascension_level"] == "bigint"
    assert got.filter("error IS NULL").count() == 10


def test_outcome_leaks_are_refused(fitted):
    offers, _ = fitted
    for leak in ("floor_reached", "floors_gained"):
        with pytest.raises(ValueError, match=leak):
            fit_effects(offers, features=("was_picked", leak))
        with pytest.raises(ValueError, match=leak):
            cf.counterfactual_effect(offers, [], features=("was_picked", leak))
    with pytest.raises(ValueError, match="was_picked"):
        fit_effects(offers, features=("floor",))
    with pytest.raises(ValueError, match="floor"):
        fit_effects(offers, features=("was_picked", "floor"), by=("floor",))


# ---- reports ---------------------------------------------------------------------------------


def test_base_name_drops_one_mark(spark):
    df = spark.createDataFrame([("X+1",), ("X+1+1",), ("X",), ("X+10",)], "c string")
    assert [r[0] for r in df.select(base_name("c")).collect()] == ["X", "X+1", "X", "X+10"]


def test_share_sums_versions_before_dividing(spark):
    rows = [("A", "X", 10), ("A", "X+1", 90), ("B", "X", 5), ("B", "X+1", 895), ("C", "X", None)]
    df = spark.createDataFrame(rows, "character_chosen string, card_name string, n bigint")
    got = native_pool(df, 0.1).collect()
    shares = {(r.character_chosen, r.card_name): (r.character_share, r.native_pool) for r in got}
    assert shares["A", "X"] == shares["A", "X+1"] == (0.1, True)
    assert shares["B", "X"] == (0.9, True)
    # a group without offers owns nothing of the card
    assert shares["C", "X"][1] is None


@pytest.fixture()
def results(spark):
    fields = (
        "character_chosen string, card_name string, n bigint, error string, converged boolean, "
        "native_pool boolean, was_picked_qvalue double, odds_ratio double, odds_ratio_ci_low double, "
        "odds_ratio_ci_high double, was_picked_pvalue double, pseudo_r2 double, auc double"
    )

    def row(card, ratio, q=0.01, error=None, converged=True, native=True):
        return ("RED", card, 300, error, converged, native, q, ratio, 0.1, 9.0, 0.01, 0.1, 0.6)

    return spark.createDataFrame(
        [
            row("low edge", 0.9), row("high edge", 1.1), row("small", 1.0999), row("big", 3.0),
            row("q", 3.0, q=0.05), row("off class", 3.0, native=False), row("failed", 3.0, error="x"),
            row("diverged", 22.3, converged=False), row("unknown", 3.0, converged=None),
        ],
        fields,
    )


def test_significance_edges(results):
    kept = ordered_report(significant(results)).collect()
    assert [r.card_name for r in kept] == ["big", "high edge", "low edge"]
    summary = report_summary(significant(results)).first()
    assert (summary.n_significant, summary.n_positive, summary.n_negative) == (3, 2, 1)
    listed = top_bottom(significant(results), 1).collect()
    assert {(r.side, r.card_name) for r in listed} == {("top", "big"), ("bottom", "low edge")}
    counts = fit_counts(results).first()
    assert (counts.n_groups, counts.n_fitted, counts.n_converged, counts.n_native) == (9, 8, 6, 8)


def test_raw_lift_is_set_against_the_controlled_effect(results, spark):
    screen = spark.createDataFrame(
        [("RED", "small", 0.2), ("RED", "big", 0.2), ("RED", "diverged", 0.3)],
        "character_chosen string, card_name string, win_rate_lift double",
    )
    got = lift_against_effect(screen, results).collect()
    assert {r.card_name: r.small_controlled_effect for r in got} == {"small": True, "big": False}


# ---- checks ------------------------------------------------------------------------------------


def test_checks_count_violations(spark):
    runs = spark.createDataFrame([("a", True), ("a", True), ("b", None)], "play_id string, victory boolean")
    assert tuple(check_runs(runs).first()) == (3, 2, 1, 1, 2)
    picks = spark.createDataFrame(
        [(True, "X", 1), (True, None, 1), (False, "X", -1), (False, None, 0), (None, None, 0)],
        "is_selected boolean, card string, floors_gained int",
    )
    assert tuple(check_picks(picks).first()) == (5, 1, 1, 1, 0.5)
    offers = spark.createDataFrame(
        [("a", 0, True, False), ("a", 0, True, False), ("a", 1, True, True), ("a", 2, False, False),
         ("a", 3, True, False), ("a", 4, False, True), ("a", 5, False, None)],
        "play_id string, pick_num int, was_picked boolean, was_skip boolean",
    )
    assert tuple(check_offers(offers).first()) == (7, 6, 2, 1, 2)


# ---- counterfactual ----------------------------------------------------------------------------


def test_counterfactual_rows_and_errors(spark):
    rows = offer_rows("X", 400, 1) + offer_rows("Y", 50, 2) + offer_rows("X", 300, 3, character="BLUE")
    offers = spark.createDataFrame(rows, OFFER)
    pairs = [("RED", "X"), ("RED", "Y"), ("GREEN", "X")]
    got = {(r.character_chosen, r.card_name): r for r in cf.counterfactual_effect(offers, pairs, trees=10).collect()}
    assert got.keys() == {("RED", "X"), ("RED", "Y")}
    assert got["RED", "Y"].error == "too few rows" and got["RED", "Y"].n == 50
    x = got["RED", "X"]
    assert x.error is None and x.n == 400 and x.was_picked_importance > 0
    assert x.was_picked_effect == pytest.approx(5, abs=2)
    empty = cf.counterfactual_effect(offers, [])
    assert empty.count() == 0 and empty.columns == [*KEYS, "n", "error", "was_picked_effect", "was_picked_importance"]


def test_counted_cells_train_the_same_trees_as_rows(spark):
    """Fit on repeated rows without weights, and on cells with weights and the leaf size as weight."""
    rows = offer_rows("X", 120, 4) * 3
    model = model_input(spark.createDataFrame(rows, OFFER), "floors_gained").withColumn("pair", F.lit(0))
    counted = cf.cells(model, FEATURES, "floors_gained").drop("pair")
    effect, splits = cf._fit(counted, len(rows), FEATURES, trees=4)

    numbers = model.select(*[F.col(c).cast("double") for c in (*FEATURES, "floors_gained")])
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="x")
    plain = GBTRegressor(
        featuresCol="x", labelCol="floors_gained", maxIter=4, maxDepth=cf.DEPTH,
        stepSize=cf.LEARNING_RATE, minInstancesPerNode=cf.MIN_LEAF, maxBins=cf.BINS, seed=0,
    ).fit(assembler.transform(numbers))
    means = [
        plain.transform(assembler.transform(numbers.withColumn("was_picked", F.lit(flag))))
        .agg(F.avg("prediction"))
        .first()[0]
        for flag in (1.0, 0.0)
    ]
    assert effect == pytest.approx(means[0] - means[1], rel=1e-9)
    assert splits == plain.toDebugString.count("If (feature 0 ")


@pytest.mark.parametrize("n", [281, 294, 525])
def test_a_leaf_may_hold_exactly_the_least_number_of_rows(spark, n):
    counted = spark.createDataFrame(
        [(1.0, cf.MIN_LEAF, 30.0), (0.0, n - cf.MIN_LEAF, 20.0)], "was_picked double, n bigint, mean double"
    )
    effect, splits = cf._fit(counted, n, ("was_picked",), trees=2)
    assert effect == pytest.approx(10.0) and splits >= 1
    below = counted.withColumn("n", F.when(F.col("was_picked") == 1, cf.MIN_LEAF - 1).otherwise(F.col("n")))
    assert cf._fit(below, n - 1, ("was_picked",), trees=2) == (0.0, 0)


def test_fits_need_rows_for_two_leaves(spark):
    offers = spark.createDataFrame(offer_rows("X", 50, 1), OFFER)
    with pytest.raises(ValueError, match="two leaves"):
        cf.counterfactual_effect(offers, [("RED", "X")], min_rows=39)
