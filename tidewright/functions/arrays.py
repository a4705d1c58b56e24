"""Passes over arrays that carry a state along, in time that follows the array's length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items whose results one aggregate holds, and blocks of them whose states one holds.
BLOCK, BLOCKS = 16, 64

State = dict[str, Column]


def running(
    items: Column, kind: str, state: dict[str, tuple[Column, str]], step: Callable[[Column, Column], tuple[Column, State]], after: Callable[[Column, Column], State] | None = None
) -> Column:
    """The results of ``step(state, item)`` over an array, in order, those that are null left out: an array of ``kind``; none of a null array.

    step gives a result and the state after it; ``state`` has the first values with their types. An aggregate copies all that it carries at each
    item, so none carries more than a few: the states before parts of BLOCK * BLOCKS items come first, from them those before blocks, and from those the results
    of a block. ``after(state, part)`` is the state after a whole part, where that is told in a cheaper way than item by item.
    """
    names = list(state)
    packed = lambda values: F.struct(*[values[k].cast(state[k][1]).alias(k) for k in names])
    one = "struct<" + ", ".join(f"`{k}`: {state[k][1]}" for k in names) + ">"
    count = F.size(items)

    def advanced(at: Column, part: Column) -> Column:
        return packed(after(at, part)) if after else F.aggregate(part, at, lambda x, item: packed(step(x, item)[1]))

    def before_parts(at: Column, first: Column, size: int, parts: Column) -> Column:
        def add(held: Column, k: Column) -> Column:
            part = F.slice(items, first + k * size + 1, F.lit(size))
            return F.struct(F.concat(held["all"], F.array(held["now"])).alias("all"), advanced(held["now"], part).alias("now"))

        zero = F.struct(F.array().cast(f"array<{one}>").alias("all"), at.alias("now"))
        return F.aggregate(F.sequence(F.lit(0), parts - 1), zero, add, lambda held: held["all"])

    def results(at: Column, first: Column) -> Column:
        def add(held: Column, item: Column) -> Column:
            result, then = step(held["now"], item)
            return F.struct(F.concat(held["out"], F.filter(F.array(result), lambda x: x.isNotNull())).alias("out"), packed(then).alias("now"))

        zero = F.struct(F.array().cast(f"array<{kind}>").alias("out"), at.alias("now"))
        return F.aggregate(F.slice(items, first + 1, F.lit(BLOCK)), zero, add, lambda held: held["out"])

    def part_results(at: Column, c: Column) -> Column:
        first = c * (BLOCK * BLOCKS)
        blocks = F.ceil(F.least(F.lit(BLOCK * BLOCKS), count - first) / BLOCK).cast("int")
        return F.flatten(F.transform(before_parts(at, first, BLOCK, blocks), lambda then, b: results(then, first + b * BLOCK)))

    parts = F.ceil(count / (BLOCK * BLOCKS)).cast("int")
    every = F.flatten(F.transform(before_parts(packed({k: v for k, (v, _) in state.items()}), F.lit(0), BLOCK * BLOCKS, parts), part_results))
    return F.when(count > 0, every).otherwise(F.array().cast(f"array<{kind}>"))
