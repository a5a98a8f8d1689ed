"""Grouped boosted trees against MLlib, and that neither groups nor row order matter."""

import pytest
from pyspark.sql import functions as F
from test_statistics import OFFER, offer_rows

from offerlens.operators import boosting, counterfactual
from offerlens.operators.model_input import FEATURES, KEYS, model_input
from verification import queries


def pairs_of(spark, pairs):
    return spark.createDataFrame(pairs, ", ".join(f"{key} string" for key in KEYS))


def shown(df):
    return {(r.character_chosen, r.card_name): (r.n, r.error, r.was_picked_effect, r.was_picked_importance) for r in df.collect()}


@pytest.fixture(scope="module")
def offers(spark):
    rows = [row for i, card in enumerate("VWXYZ") for row in offer_rows(card, 200 + 40 * i, 30 + i)]
    return spark.createDataFrame(rows + offer_rows("few", 60, 9), OFFER).cache()


def test_equals_mllib_on_every_pair(spark, offers):
    listed = [("RED", card) for card in "VWXYZ"]
    got = shown(boosting.boosted_effects(offers, pairs_of(spark, [*listed, ("RED", "few"), ("BLUE", "V")]), trees=3))
    expected = shown(counterfactual.counterfactual_effect(offers, listed, trees=3))
    assert got.keys() == {*listed, ("RED", "few")} and got["RED", "few"] == (60, "too few rows", None, None)
    for pair in listed:
        assert got[pair][2] == pytest.approx(expected[pair][2], rel=1e-9)
        assert got[pair][0] == expected[pair][0] and got[pair][3] == expected[pair][3] > 0


def test_neither_order_nor_partitions_nor_other_pairs_matter(spark, offers):
    every = shown(boosting.boosted_effects(offers, trees=2, depth=3))
    again = shown(boosting.boosted_effects(offers.orderBy(F.rand(3)).repartition(11), trees=2, depth=3))
    one = shown(boosting.boosted_effects(offers, pairs_of(spark, [("RED", "X")] * 2), trees=2, depth=3))
    assert len(every) == 6 and one.keys() == {("RED", "X")}
    for pair, (n, error, effect, splits) in every.items():
        for other in (again, one) if pair in one else (again,):
            assert other[pair][:2] == (n, error) and other[pair][3] == splits
            assert other[pair][2] == (pytest.approx(effect, rel=1e-9) if effect is not None else None)


def test_jobs_do_not_grow_with_the_pairs(spark, offers):
    """Counted without adaptive execution, which runs stages as jobs; small sides may still be broadcast by a job more."""
    jobs = []
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    for name, pairs in (("one", [("RED", "X")]), ("all", [("RED", card) for card in "VWXYZ"])):
        spark.sparkContext.setJobGroup(f"boosting {name}", name)
        boosting.boosted_effects(offers, pairs_of(spark, pairs), trees=2, depth=2)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"boosting {name}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert jobs[1] <= jobs[0]


def test_jobs_do_not_grow_with_the_trees_of_groups_that_fit_a_task(spark, offers):
    jobs = []
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    for trees in (1, 6):
        spark.sparkContext.setJobGroup(f"trees {trees}", "trees")
        boosting.boosted_effects(offers, trees=trees)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"trees {trees}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert jobs[0] == jobs[1]


@pytest.mark.parametrize("held", [0, 300])
def test_groups_too_large_for_a_task_grow_the_same_trees(spark, offers, monkeypatch, held):
    cells = boosting.binned_cells(model_input(offers, "floors_gained"), FEATURES, "floors_gained", KEYS)
    sizes = [r["count"] for r in cells.groupBy(*KEYS).count().collect()]
    assert min(sizes) < 300 < max(sizes)
    whole = shown(boosting.boosted_effects(offers, trees=3))
    monkeypatch.setattr(boosting, "WHOLE_CELLS", held)
    split = shown(boosting.boosted_effects(offers, trees=3))
    assert split.keys() == whole.keys()
    for pair, (n, error, effect, splits) in whole.items():
        assert (split[pair][:2], split[pair][3]) == ((n, error), splits)
        assert split[pair][2] == (pytest.approx(effect, rel=1e-9) if effect is not None else None)


def test_the_query_grows_all_trees_of_every_screened_pair(spark, offers, monkeypatch):
    monkeypatch.setattr(queries, "_stored_offers", lambda session, sf_dir: offers)
    got = shown(queries.QUERIES["counterfactual_effect"](spark, "tables"))
    expected = shown(boosting.boosted_effects(offers, trees=200, depth=5))
    assert len(got) == 6
    for pair, (n, error, effect, splits) in got.items():
        assert (n, error, splits) == (expected[pair][0], expected[pair][1], expected[pair][3])
        assert effect == (pytest.approx(expected[pair][2], abs=1e-6) if error is None else None)


def test_many_values_share_bins(spark):
    rows = [("RED", "X", i % 2 == 0, True, 10 + 5 * (i % 2 == 0), i, 50, 100, 3, 1) for i in range(1200)]
    offers = spark.createDataFrame(rows, OFFER)
    cells = boosting.binned_cells(model_input(offers, "floors_gained"), FEATURES, "floors_gained", KEYS, bins=16)
    floor = cells.groupBy(F.element_at("bins", 1 + FEATURES.index("floor")).alias("bin")).agg(F.sum("n").alias("n")).collect()
    assert sorted(r.bin for r in floor) == list(range(16)) and {r.n for r in floor} == {75}
    [row] = boosting.boosted_effects(offers, trees=2).collect()
    assert row.was_picked_effect == pytest.approx(5.0) and row.was_picked_importance == 1


def test_odd_input(spark, offers):
    with pytest.raises(ValueError, match="floors_gained"):
        boosting.boosted_effects(offers, features=("was_picked", "floors_gained"))
    with pytest.raises(ValueError, match="two leaves"):
        boosting.boosted_effects(offers, min_rows=39)
    empty = boosting.boosted_effects(offers.limit(0), trees=1, depth=1)
    assert empty.count() == 0 and empty.columns == [*KEYS, "n", "error", "was_picked_effect", "was_picked_importance"]
    always = spark.createDataFrame(offer_rows("X", 250, 5, flag=True), OFFER)
    nulls = always.union(always.limit(40).withColumn("floor", F.lit(None).cast("int")))
    [row] = boosting.boosted_effects(nulls, trees=2, depth=2).collect()
    assert (row.n, row.error, row.was_picked_effect, row.was_picked_importance) == (250, None, 0.0, 0)


def test_cells_are_walked_down_the_splits_by_compiled_columns(spark):
    splits = {1: (0, 2), 2: (1, 0), 3: (1, 5), 5: (0, 0)}
    rows = [([a, b], splits) for a in range(5) for b in range(8)] + [([1, 1], {})]
    cells = spark.createDataFrame(rows, "bins array<int>, splits map<int, struct<feature: int, bin: int>>")
    walked = boosting._walked(cells, {"node": F.col("bins"), "_other": F.array(F.lit(4), F.element_at("bins", 2))}, 3)
    assert walked.columns == ["bins", "splits", "node", "_other"]
    assert "lambda" not in walked._jdf.queryExecution().optimizedPlan().toString()

    def node(bins, known):
        at = 1
        for _ in range(3):
            if at in known:
                at = 2 * at + int(bins[known[at][0]] > known[at][1])
        return at

    for row in walked.collect():
        assert (row["node"], row["_other"]) == (node(row.bins, row.splits), node([4, row.bins[1]], row.splits))
