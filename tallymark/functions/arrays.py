"""Array expressions in time proportional to the array: values that are bound once, and running results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256  #: elements of a block of ``running``


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, also where ``body`` uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, zero: Column, merge: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """Of every place of an array of ints, all elements up to it merged.

    Blocks get their start from the running result of the blocks' own totals, so that no array longer than a block
    is copied element by element. ``values`` must be a lambda's variable.
    """

    def within(some: Column, start: Column) -> Column:
        def step(done: Column, x: Column) -> Column:
            return let(merge(done["at"], x), lambda at: F.struct(at.alias("at"), F.concat(done["out"], F.array(at)).alias("out")))

        return F.aggregate(some, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), step)["out"]

    if levels == 1:
        return within(values, zero)
    numbers = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))
    blocks = F.transform(numbers, lambda i: F.slice(values, i * BLOCK + 1, F.lit(BLOCK)))

    def joined(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, zero, merge))
        ends = let(totals, lambda t: running(t, zero, merge, levels - 1))
        return let(F.concat(F.array(zero), ends), lambda starts: F.flatten(F.transform(parts, lambda p, i: within(p, F.get(starts, i)))))

    return let(blocks, joined)


def running_sum(values: Column) -> Column:
    return let(values, lambda v: running(v, F.lit(0), lambda a, b: a + b))


def running_max(values: Column, least: int = -1) -> Column:
    return let(values, lambda v: running(v, F.lit(least), lambda a, b: F.greatest(a, b)))
