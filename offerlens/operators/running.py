"""Running aggregates over a long order, spread over many tasks.

A window over one long group, or over a whole table, runs in one task. Here the order is cut into
ranges that hold about equally many rows; windows run inside the ranges, and the range totals,
a few hundred rows, carry the result from one range to the next.
"""

import math
from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.sources.scratch import materialise

ORDER = "_order"
RANGE = "_range"
PLACE = "_place"
ROWS_PER_RANGE = 50_000


def with_ranges(df: DataFrame, order: str, ranges: int | None = None) -> DataFrame:
    """The rows, written once, with the number of their range of the order column.

    Runs its jobs when called. The number of ranges follows the number of rows, so that a range
    stays the same size however large the table is.

    The order column must be a number and not NULL. Rows should be distinct in it per group:
    repeated values must be counted into one row first, as equal values always share a range.
    """
    rows = materialise(df)
    ranges = ranges or max(2, math.ceil(rows.count() / ROWS_PER_RANGE))
    shares = [i / ranges for i in range(1, ranges)]
    # one number per range; the sketch is finer than the ranges
    cuts = rows.agg(F.percentile_approx(order, shares, max(10_000, 10 * ranges))).first()[0] or [0.0]
    splits = [-float("inf"), *sorted({float(cut) for cut in cuts}), float("inf")]
    numbered = Bucketizer(splits=splits, inputCol=ORDER, outputCol=RANGE, handleInvalid="keep")
    ranged = numbered.transform(rows.withColumn(ORDER, F.col(order).cast("double")))
    return ranged.drop(ORDER).withColumn(RANGE, F.col(RANGE).cast("int"))


def running(
    ranged: DataFrame,
    order: str,
    value: Column,
    out: str,
    by: tuple[str, ...] = (),
    combine: Callable[[Column], Column] = F.sum,
    merge: Callable[[Column, Column], Column] = lambda a, b: F.coalesce(a, F.lit(0)) + b,
    descending: bool = False,
) -> DataFrame:
    """Add the aggregate of `value` over all rows of the group up to and including each row.

    `combine` is the aggregate (sum, min) and `merge` joins the carried part with the range's own.
    """

    def direction(name: str) -> Column:
        return F.desc(name) if descending else F.asc(name)

    # a struct is never NULL, though its fields may be, so one exchange by it serves the range
    # totals, the join and the window
    placed = ranged.withColumn(PLACE, F.struct(*by, RANGE))
    within = Window.partitionBy(PLACE).orderBy(direction(order))
    within = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*by).orderBy(direction(RANGE))
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(PLACE).agg(combine(value).alias("_total"))
    carried = totals.select(PLACE, f"{PLACE}.*", "_total").select(
        PLACE, combine("_total").over(earlier).alias("_carried")
    )
    return (
        placed.join(carried, PLACE, "left")
        .withColumn(out, merge(F.col("_carried"), combine(value).over(within)))
        .select(*ranged.columns, out)
    )
