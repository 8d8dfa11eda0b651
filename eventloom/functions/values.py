"""Values of plain text, and nested arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """Struct (whole, number, text): the first of a whole number, a double and the text itself that fits; the others are null."""
    whole, number = text.try_cast("bigint"), text.try_cast("double")
    return F.struct(whole.alias("whole"), F.when(whole.isNull(), number).alias("number"), F.when(whole.isNull() & number.isNull(), text).alias("text"))


def finite(number: Column) -> Column:
    """The number; an error for one that isn't finite."""
    bad = F.isnan(number) | (F.abs(number) == float("inf"))
    return F.when(bad, F.raise_error(F.concat(F.lit("not finite: "), number.cast("string")))).otherwise(number)


def reshaped(flat: Column, width: int) -> Column:
    """The array cut into rows of ``width``; an error if its size is no multiple."""
    places = F.sequence(F.lit(0), F.floor(F.size(flat) / width).cast("int") - 1)
    rows = F.when(F.size(flat) > 0, F.transform(places, lambda i: F.slice(flat, i * width + 1, F.lit(width)))).otherwise(F.array())
    return F.when(F.size(flat) % width == 0, rows).otherwise(F.raise_error(F.lit(f"no multiple of {width}")))


def sliced(values: Column, start: int | None = None, stop: int | None = None, step: int = 1) -> Column:
    """Places start to stop, by step, counted from the end if negative, as Python slices are."""
    if not step:
        raise ValueError("step can't be 0")
    n, forward = F.size(values), step > 0
    low, high = (F.lit(0), n) if forward else (F.lit(-1), n - 1)
    clip = lambda i: F.least(F.greatest(F.when(i < 0, i + n).otherwise(i), low), high)
    begin = (low if forward else high) if start is None else clip(F.lit(start))
    end = (high if forward else low) if stop is None else clip(F.lit(stop))
    some = begin < end if forward else begin > end
    places = F.sequence(begin, end - (1 if forward else -1), F.lit(step))
    return F.when(some, F.transform(places, lambda i: F.get(values, i))).otherwise(F.slice(values, F.lit(1), F.lit(0)))
