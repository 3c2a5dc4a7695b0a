"""Array building blocks that keep per-file work inside one row, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, functions as F

_CHUNK = 128
_PART = 8


_built: dict = {}


def built_once(fn: Callable[..., Column]) -> Callable[..., Column]:
    """Keep the column a function builds from names, per Spark context.

    A fold over nested lambdas is hundreds of expressions, each several calls to the JVM; the
    unresolved column is the same for every plan that uses the same names.
    """
    @wraps(fn)
    def cached(*args):
        key = (id(SparkContext._active_spark_context), fn.__module__, fn.__qualname__, args)
        if key not in _built:
            _built[key] = fn(*args)
        return _built[key]

    return cached


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    Inside lambdas Spark shares no common subexpressions, so anything used twice is bound here.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def slice_array(
    arr: Column, is_header: Callable[[Column], Column], absorb_lead: bool = False, part: str = "part"
) -> Column:
    """Cut an array at its header elements: an array of (at, part) with the header first in each part.

    Elements ahead of the first header form a part of their own, or with ``absorb_lead`` belong
    to the first one. Every element is copied once, so the cost is linear.
    """
    hits = F.filter(
        F.transform(arr, lambda s, i: F.when(is_header(s), i).otherwise(F.lit(-1))), lambda i: i >= 0
    )
    zero = F.array(F.lit(0))
    if absorb_lead:
        starts = let(hits, lambda h: F.concat(zero, F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0)))))
    else:
        starts = F.array_distinct(F.concat(zero, hits))
    return let(starts, lambda st: F.transform(st, lambda at, j: F.struct(
        at.alias("at"),
        F.slice(arr, at + 1, F.coalesce(F.get(st, j + 1), F.size(arr)) - at).alias(part),
    )))


@built_once
def _slices(arr: str, is_header: Callable[[Column], Column], absorb_lead: bool, part: str) -> Column:
    return slice_array(F.col(arr), is_header, absorb_lead, part)


def explode_slices(
    df: DataFrame,
    arr: str,
    is_header: Callable[[Column], Column],
    keep: list[str],
    base: Column | None = None,
    absorb_lead: bool = False,
    part: str = "part",
) -> DataFrame:
    """One row per slice of an array column: ``keep``, ``base`` (position in the file) and ``part``."""
    offset = F.lit(0) if base is None else base
    cut = df.withColumn("_slices", _slices(arr, is_header, absorb_lead, part))
    # the outer form on purpose: for the inner one the optimizer adds a size check that it pushes
    # down, and with it a second evaluation of everything the array is computed from
    return cut.select(*keep, offset.alias("_offset"), F.inline_outer("_slices")).select(
        *keep, (F.col("_offset") + F.col("at")).alias("base"), part
    )


def scan_states(
    events: Column, state_ddl: str, initial: Column, step: Callable[[Column, Column], Column], long: bool = False
) -> Column:
    """Running fold over an array that returns the state after every element.

    ``step(previous, element)`` builds the next state. Elements are folded in chunks, so
    growing the output never copies more than one chunk and the fold stays linear. A fold copies all that
    it holds at every element: where arrays are ``long``, a chunk is folded in parts of a few elements.
    """
    arr_type = f"ARRAY<{state_ddl}>"
    last = -1

    def fold(chunk: Column, start: Column) -> Column:
        return F.aggregate(
            chunk,
            F.array(start).cast(arr_type),
            lambda acc, x: F.array_append(acc, let(F.element_at(acc, last), lambda prev: step(prev, x))),
        )

    def cut(arr: Column, width: int) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.greatest(F.ceil(F.size(arr) / F.lit(float(width))).cast("int") - 1, F.lit(0))),
            lambda k: F.slice(arr, k * width + 1, width),
        )

    def runs_of(pieces: Column, start: Column, fold_piece: Callable[[Column, Column], Column]) -> Column:
        return F.aggregate(
            pieces,
            F.array(F.array(start)).cast(f"ARRAY<{arr_type}>"),
            lambda acc, piece: F.array_append(acc, fold_piece(piece, F.element_at(F.element_at(acc, last), last))),
        )

    def fold_parts(chunk: Column, start: Column) -> Column:
        # the run that the fold starts from is the state itself; every other one repeats its first state
        return F.flatten(F.transform(
            runs_of(cut(chunk, _PART), start, fold), lambda r, i: F.when(i == 0, r).otherwise(F.slice(r, 2, F.size(r) - 1))
        ))

    # the chunk count comes from the event column, which callers pass as a plain column
    runs = runs_of(cut(events, _CHUNK), initial, fold_parts if long else fold)
    # every run repeats the state it started from as its first element
    return F.flatten(F.transform(runs, lambda r: F.slice(r, 2, F.size(r) - 1)))
