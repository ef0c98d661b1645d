"""Array expressions that Spark has no function for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is made once for the row, however often and within whatever lambda it is read."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running_sums(a: Column) -> Column:
    """The sum of an array of integers up to and with each entry; ``a`` must be a column of its own, as it is read twice.

    Sums grow within blocks, so the copies made stay in proportion to the length. A block begins with the sum before it.
    """
    long = lambda x: x.cast("bigint")
    blocks = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _BLOCK).cast("int"))
    inner = lambda b, total: F.aggregate(F.slice(a, b * _BLOCK + 1, F.lit(_BLOCK)), F.array(total), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    parts = F.aggregate(blocks, F.array(F.array(long(F.lit(0)))), lambda acc, b: F.concat(acc, F.array(inner(b, F.element_at(F.element_at(acc, -1), -1)))))
    return F.when(F.size(a) > 0, F.flatten(F.transform(parts, lambda p: F.slice(p, 2, _BLOCK)))).when(a.isNotNull(), F.array().cast("array<bigint>"))
