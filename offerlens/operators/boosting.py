"""Counterfactual effects from boosted trees, grown for all groups together.

Covariates are counted into cells and cut into bins, so a group has no more cells than distinct
binned covariates, whatever its rows. A group of at most `WHOLE_CELLS` cells, which is a memory of
known size, is grown by one task: all of its trees are arrays there, and one job grows all such
groups.

Larger groups are never brought together. One step grows one level of one tree of all of them: a
histogram of the residuals over (group, node, feature, bin), combined per task, then the best split
of each node from running sums over at most `BINS` bins. So their jobs follow trees and depth only,
not the number of groups. Trees are small tables; cells find their node by walking the splits of
their group. Either way each cell carries, beside its own prediction, those with the flag forced on
and off, and the trees are the same.

The first tree is taken whole and later ones by the learning rate, twice, as the slope of squared
loss has it. Gains are rounded before they are compared, and of equal ones the first feature and
lowest bin count, so neither row order nor partitioning changes a tree.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.operators.counterfactual import BINS, DEPTH, LEARNING_RATE, MIN_LEAF, TREES
from offerlens.operators.logit import MIN_ROWS, TOO_FEW
from offerlens.operators.model_input import FEATURES, FLAG, KEYS, check_features, model_input, restrict_to_pairs
from offerlens.sources.scratch import materialise, step_tables

GAIN_DIGITS = 6
CELLS_PER_TASK = 200_000
# Cells of a group that one task may hold: with five features some 200 bytes each at most.
WHOLE_CELLS = 1_500_000
MANY_TASKS = 10_000


def binned_cells(rows: DataFrame, features: tuple[str, ...], outcome: str, by: tuple[str, ...], bins: int = BINS) -> DataFrame:
    """Distinct binned covariates per group, as an array, with their rows `n` and mean outcome.

    A feature with up to `bins` values in a group has a bin for each; otherwise the bins hold about
    equally many rows. The values of one feature in one group are sorted in one task: they are
    counted first, so they are as many as the feature has values, not rows. The flag is its own bin.
    """
    numbers = [F.col(name).cast("double").alias(name) for name in features]
    counted = (
        rows.select(*by, *numbers, F.col(outcome).cast("double").alias("_value"))
        .groupBy(*by, *features)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("_value").alias("total"))
    )
    counted = materialise(counted)
    for name in features:
        if name == FLAG:
            continue
        values = counted.groupBy(*by, name).agg(F.sum("n").alias("_n"))
        order = Window.partitionBy(*by).orderBy(name)
        whole = Window.partitionBy(*by)
        before = F.sum("_n").over(order) - F.col("_n")
        share = F.floor(bins * before / F.sum("_n").over(whole))
        own = F.when(F.count(F.lit(1)).over(whole) <= bins, F.row_number().over(order) - 1).otherwise(share)
        values = values.select(*by, name, own.cast("int").alias("_bin"))
        counted = counted.join(values, [*by, name]).drop(name).withColumnRenamed("_bin", name)
    array = F.array(*(F.col(name).cast("int") for name in features)).alias("bins")
    return counted.groupBy(*by, array).agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"))


def _walked(cells: DataFrame, forms: dict[str, Column], depth: int) -> DataFrame:
    """Cells with, by name, the node that each array of bins ends in after `depth` steps down the splits of its group.

    A step is two plain columns: they are compiled, which functions over arrays are not.
    """
    walked = cells.withColumns({name: F.lit(1) for name in forms} | {f"_bins_{name}": bins for name, bins in forms.items()})
    for _ in range(depth):
        walked = walked.withColumns({f"_split_{name}": F.element_at("splits", F.col(name)) for name in forms})
        steps = {}
        for name in forms:
            split, node = F.col(f"_split_{name}"), F.col(name)
            right = F.element_at(F.col(f"_bins_{name}"), split["feature"] + 1) > split["bin"]
            steps[name] = F.when(split.isNull(), node).otherwise(2 * node + right.cast("int"))
        walked = walked.withColumns(steps)
    return walked.drop(*(f"_{kind}_{name}" for kind in ("bins", "split") for name in forms))


def _grown(levels: list[DataFrame], by: tuple[str, ...]) -> DataFrame:
    """Per group the splits by node and the values of all nodes of a tree, from its levels."""
    nodes = reduce(DataFrame.unionByName, levels)
    split = F.struct("node", F.struct("feature", "bin").alias("split"))
    values = F.when(F.col("node") == 1, F.array(F.struct(F.col("node"), F.col("value"))))
    children = F.when(
        F.col("feature").isNotNull(),
        F.array(F.struct((2 * F.col("node")).alias("node"), F.col("left").alias("value")), F.struct((2 * F.col("node") + 1).alias("node"), F.col("right").alias("value"))),
    )
    nothing = F.array().cast("array<struct<node:int,value:double>>")
    return nodes.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("feature").isNotNull(), split))).alias("splits"),
        F.map_from_entries(F.flatten(F.collect_list(F.concat(F.coalesce(values, nothing), F.coalesce(children, nothing))))).alias("node_values"),
        F.count(F.when(F.col("feature") == F.col("flag"), 1)).alias("flag_splits"),
    )


def _level(cells: DataFrame, levels: list[DataFrame], by: tuple[str, ...], flag: int, min_leaf: int) -> DataFrame:
    """Value and best split, if any, of every node of the next level. `feature` is NULL without a split."""
    depth = len(levels)
    if depth:
        cells = _walked(cells.join(_grown(levels, by), list(by)), {"node": F.col("bins")}, depth).filter(F.col("node") >= 1 << depth)
    else:
        cells = cells.withColumn("node", F.lit(1))
    spread = cells.select(*by, "node", "n", (F.col("n") * (F.col("mean") - F.col("f"))).alias("g"), F.posexplode("bins").alias("feature", "bin"))
    histogram = spread.groupBy(*by, "node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    feature = Window.partitionBy(*by, "node", "feature")
    below = feature.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = histogram.select(
        *by, "node", "feature", "bin",
        F.sum("n").over(below).alias("n_left"), F.sum("g").over(below).alias("g_left"),
        F.sum("n").over(feature).alias("n"), F.sum("g").over(feature).alias("g"),
    )
    n_right, g_right = F.col("n") - F.col("n_left"), F.col("g") - F.col("g_left")
    gain = F.round(F.col("g_left") ** 2 / F.col("n_left") + g_right**2 / n_right - F.col("g") ** 2 / F.col("n"), GAIN_DIGITS)
    split = F.struct(
        gain.alias("gain"), (-F.col("feature")).alias("feature"), (-F.col("bin")).alias("bin"),
        (F.col("g_left") / F.col("n_left")).alias("left"), (g_right / n_right).alias("right"),
    )
    allowed = (F.col("n_left") >= min_leaf) & (n_right >= min_leaf)
    best = sums.groupBy(*by, "node").agg(
        F.min(F.struct("feature", (F.col("g") / F.col("n")).alias("value"))).alias("own"), F.max(F.when(allowed & (gain > 0), split)).alias("best")
    )
    return best.select(
        *by, "node", F.col("own.value").alias("value"), (-F.col("best.feature")).alias("feature"), (-F.col("best.bin")).alias("bin"),
        "best.left", "best.right", F.lit(flag).alias("flag"),
    )


def boosted(
    cells: DataFrame, features: tuple[str, ...], by: tuple[str, ...], trees: int = TREES, depth: int = DEPTH, rate: float = LEARNING_RATE, min_leaf: int = MIN_LEAF
) -> DataFrame:
    """The cells with their predictions `f`, `f_on`, `f_off`, and the splits on the flag of all trees.

    Runs `depth` jobs and a write a tree.
    """
    flag = features.index(FLAG)
    forms = {"f": F.col("bins")}
    for name, value in (("f_on", 1), ("f_off", 0)):
        forms[name] = F.array(*(F.lit(value) if i == flag else F.element_at("bins", i + 1) for i in range(len(features))))
    state = cells.withColumns({name: F.lit(0.0) for name in forms} | {"flag_count": F.lit(0).cast("bigint")})
    for tree in range(trees):
        levels: list[DataFrame] = []
        for _ in range(depth):
            levels.append(materialise(_level(state, levels, by, flag, min_leaf)))
        share = 2 * rate if tree else 1.0
        joined = _walked(state.join(_grown(levels, by), list(by)), {f"_node_{name}": bins for name, bins in forms.items()}, depth)
        after = {name: F.col(name) + share * F.element_at("node_values", F.col(f"_node_{name}")) for name in forms}
        after["flag_count"] = F.col("flag_count") + F.col("flag_splits")
        state = materialise(joined.withColumns(after).select(state.columns))
    return state


def _best_splits(node: np.ndarray, nodes: int, bins: np.ndarray, n: np.ndarray, g: np.ndarray, min_leaf: int) -> tuple[np.ndarray, ...]:
    """Per node the gain, feature, bin, left and right value of its best split, and its own value.

    The rules of `_level`: gains are rounded, and of equal ones the first feature and lowest bin count.
    """
    best = np.zeros(nodes)
    feature, at = np.full(nodes, -1), np.zeros(nodes, np.int64)
    left, right, own = np.zeros(nodes), np.zeros(nodes), np.zeros(nodes)
    each = np.arange(nodes)
    for i, values in enumerate(bins):
        width = int(values.max()) + 1
        key = node * width + values
        n_left = np.bincount(key, n, nodes * width).reshape(nodes, width).cumsum(axis=1)
        g_left = np.bincount(key, g, nodes * width).reshape(nodes, width).cumsum(axis=1)
        n_all, g_all = n_left[:, -1:], g_left[:, -1:]
        n_right, g_right = n_all - n_left, g_all - g_left
        with np.errstate(divide="ignore", invalid="ignore"):
            if not i:
                own = (g_all / n_all)[:, 0]
            gain = g_left**2 / n_left + g_right**2 / n_right - g_all**2 / n_all
            # half up, as SQL rounds
            gain = np.floor(gain * 10**GAIN_DIGITS + 0.5) / 10**GAIN_DIGITS
            gain = np.where((n_left >= min_leaf) & (n_right >= min_leaf), gain, 0.0)
            top = gain.argmax(axis=1)
            better = gain[each, top] > best
            here, of = each[better], top[better]
            best[here], feature[here], at[here] = gain[here, of], i, of
            left[here], right[here] = g_left[here, of] / n_left[here, of], g_right[here, of] / n_right[here, of]
    return feature, at, left, right, own


def boosted_whole(
    bins: np.ndarray, n: np.ndarray, mean: np.ndarray, flag: int, trees: int = TREES, depth: int = DEPTH, rate: float = LEARNING_RATE, min_leaf: int = MIN_LEAF
) -> tuple[np.ndarray, np.ndarray, int]:
    """Predictions of the cells of one group with the flag forced on and off, and the splits on the flag of all trees.

    `bins` has a row per feature. A cell's own prediction is one of the two, so only one is walked for beside it.
    """
    n = n.astype(float)
    forced = 1 - bins[flag]
    f, other = np.zeros(len(n)), np.zeros(len(n))
    flag_count = 0
    for tree in range(trees):
        g = n * (mean - f)
        node, node_other = np.ones(len(n), np.int32), np.ones(len(n), np.int32)
        value = np.zeros(2 << depth)
        split, limit = np.full(2 << depth, -1), np.zeros(2 << depth, np.int64)
        for level in range(depth):
            first = 1 << level
            here = np.flatnonzero(node >= first)
            if not len(here):
                break
            # only nodes that hold cells, numbered without gaps
            held, own = np.unique(node[here], return_inverse=True) if level else (np.ones(1, np.int64), np.zeros(len(here), np.int64))
            whole = len(here) == len(n)
            part = (bins, n, g) if whole else (bins[:, here], n[here], g[here])
            feature, at, left, right, mean_held = _best_splits(own, len(held), *part, min_leaf)
            if not level:
                value[1] = mean_held[0]
            found = feature >= 0
            nodes = held[found]
            split[nodes], limit[nodes] = feature[found], at[found]
            value[2 * nodes], value[2 * nodes + 1] = left[found], right[found]
            flag_count += int((feature == flag).sum())
            for of, alone in ((node, False), (node_other, True)):
                cells = np.flatnonzero((of >= first) & (split[of] >= 0))
                by = split[of[cells]]
                seen = bins[by, cells]
                if alone:
                    seen = np.where(by == flag, forced[cells], seen)
                of[cells] = 2 * of[cells] + (seen > limit[of[cells]])
        share = 2 * rate if tree else 1.0
        f += share * value[node]
        other += share * value[node_other]
    on = bins[flag] == 1
    return np.where(on, f, other), np.where(on, other, f), flag_count


def _whole_effects(cells: DataFrame, features: tuple[str, ...], by: tuple[str, ...], trees: int, depth: int) -> DataFrame:
    """Effect and splits on the flag of groups that fit a task."""
    flag, names, width = features.index(FLAG), list(by), len(features)
    kinds = [cells.schema[name] for name in by]
    shown = ", ".join(f"`{kind.name}` {kind.dataType.simpleString()}" for kind in kinds)

    def effect(table: pa.Table) -> pa.Table:
        keys = table.select(names).slice(0, 1)
        n, mean = (table.column(name).to_numpy() for name in ("n", "mean"))
        arrays = table.column("bins").combine_chunks()
        bins = np.ascontiguousarray(arrays.flatten().to_numpy().reshape(-1, width).T)
        del table, arrays
        on, off, splits = boosted_whole(bins, n, mean, flag, trees, depth)
        mean_effect = float(((on - off) * n).sum() / n.sum())
        found = keys.append_column("was_picked_effect", pa.array([mean_effect], pa.float64()))
        return found.append_column("was_picked_importance", pa.array([splits], pa.int64()))

    return cells.groupBy(*by).applyInArrow(effect, f"{shown}, was_picked_effect double, was_picked_importance bigint")


def _split_effects(cells: DataFrame, features: tuple[str, ...], by: tuple[str, ...], trees: int, depth: int) -> DataFrame:
    """The same for groups of any size, grown by level."""
    # cells, not pairs, are dealt out, so that a pair with most of the rows is spread as well
    parts = max(cells.sparkSession.sparkContext.defaultParallelism, cells.count() // CELLS_PER_TASK)
    fitted = boosted(materialise(cells.repartition(parts, *by, "bins")), features, by, trees, depth)
    effect = F.sum((F.col("f_on") - F.col("f_off")) * F.col("n")) / F.sum("n")
    return fitted.groupBy(*by).agg(effect.alias("was_picked_effect"), F.max("flag_count").alias("was_picked_importance"))


def boosted_effects(
    offers: DataFrame,
    pairs: DataFrame | None = None,
    outcome: str = "floors_gained",
    features: tuple[str, ...] = FEATURES,
    min_rows: int = MIN_ROWS,
    trees: int = TREES,
    depth: int = DEPTH,
) -> DataFrame:
    """Mean prediction with the flag forced on minus forced off, and the splits on the flag, per pair.

    `pairs` restricts the pairs; without it every pair with rows is fitted. Pairs below `min_rows`
    give an error. NULL rows are dropped as everywhere in the models. A pair in which the flag does
    not vary has the effect 0.
    """
    check_features(features)
    if min_rows < 2 * MIN_LEAF:
        raise ValueError(f"a split needs two leaves of {MIN_LEAF} rows")
    rows = model_input(offers, outcome)
    if pairs is not None:
        rows = restrict_to_pairs(rows, pairs)
    by = KEYS
    with step_tables(offers.sparkSession):
        cells = materialise(binned_cells(rows, features, outcome, by))
        sizes = materialise(cells.groupBy(*by).agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("cells")))
        fitting = sizes.filter(F.col("size") >= min_rows)
        held = F.col("cells") <= WHOLE_CELLS
        small, split = fitting.agg(F.count_if(held), F.count_if(~held)).first()
        parts = max(offers.sparkSession.sparkContext.defaultParallelism, min(small, MANY_TASKS))
        whole = cells.join(fitting.filter(held).select(*by), list(by), "left_semi").repartition(parts, *by)
        effects = _whole_effects(whole, features, by, trees, depth)
        if split:
            large = materialise(cells.join(fitting.filter(~held).select(*by), list(by), "left_semi"))
            effects = effects.unionByName(_split_effects(large, features, by, trees, depth))
        results = sizes.join(effects, list(by), "left").select(
            *by, F.col("size").alias("n"), F.when(F.col("size") < min_rows, TOO_FEW).alias("error"), "was_picked_effect", "was_picked_importance"
        )
        return materialise(results, keep=True)
