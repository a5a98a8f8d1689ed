"""Column helpers for nested run records."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def nested_max(array: str, field: str) -> Column:
    """Largest value of one struct field over an array; NULL when there is none."""
    return F.array_max(F.transform(array, lambda element: element[field]))


def count_where(array: str | Column, predicate) -> Column:
    """Number of array elements for which the predicate is true; NULL for a NULL array."""
    return F.array_size(F.filter(array, predicate))


def value_at_anchor(array: str, position: Column, last_position: Column) -> Column:
    """Element of a series whose *last* entry belongs to `last_position`.

    Series may start late, so they are read from the end. Positions outside the series give NULL.
    """
    index = position - last_position + F.array_size(array) - 1
    return F.get(array, index.cast("int"))


def or_empty(array: str | Column) -> Column:
    """The array, or an empty one where it is NULL."""
    return F.coalesce(array, F.array())
