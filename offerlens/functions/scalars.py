"""Column helpers for flags, names and safe arithmetic."""

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def none_of(*flags: str) -> Column:
    """True when every flag is false; NULL when one is NULL and no other is true."""
    return reduce(and_, [~F.col(flag) for flag in flags])


def share_true(flag: str | Column) -> Column:
    """Aggregate: share of true among the non-NULL values of a flag."""
    flag = F.col(flag) if isinstance(flag, str) else flag
    return F.avg(flag.cast("double"))


def base_name(name: str | Column) -> Column:
    """Name without one trailing `+1` upgrade mark."""
    return F.regexp_replace(name, r"\+1$", "")


def correlation(x: str, y: str) -> Column:
    """Aggregate: Pearson correlation over complete pairs; NULL when a side does not vary.

    Built on central moments because the plain aggregate fails on a constant column in ANSI mode.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0))

