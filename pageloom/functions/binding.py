"""Local names inside expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once.

    A column used several times inside higher-order functions is otherwise computed at every use,
    inside lambdas once per element.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


BLOCK = 64


def running(values: Column, combine: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each element of an array, ``combine`` folded over it and all before it; ``combine`` is associative.

    A fold that appends to its result copies it at every step. Here blocks fold by themselves, so the cost is
    linear in the array, but for one value a block.
    """

    def over(own: Column) -> Column:
        count = F.size(own)

        def indices(block: Column) -> Column:
            return F.sequence(block * BLOCK, F.least(block * BLOCK + BLOCK, count) - 1)

        def appended(values_of, start: Column, items: Column) -> Column:
            kind = F.array_remove(F.array(start), start)  # an empty array of that type
            state = F.struct(start.alias("at"), kind.alias("out"))
            return F.aggregate(items, state, values_of)["out"]

        def inclusive(state: Column, i: Column) -> Column:
            value = combine(state["at"], F.get(own, i))
            return F.struct(value.alias("at"), F.array_append(state["out"], value).alias("out"))

        def exclusive(state: Column, value: Column) -> Column:
            return F.struct(
                combine(state["at"], value).alias("at"), F.array_append(state["out"], state["at"]).alias("out")
            )

        blocks = F.sequence(F.lit(0), F.floor((count - 1) / BLOCK).cast("int"))
        folded = F.transform(blocks, lambda b: F.aggregate(indices(b), zero, lambda a, i: combine(a, F.get(own, i))))
        starts = appended(exclusive, zero, folded)
        return F.flatten(F.transform(starts, lambda at, b: appended(inclusive, at, indices(b))))

    return bind(values, lambda own: F.when(F.size(own) > 0, over(own)).otherwise(own))
