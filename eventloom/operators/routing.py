"""Explicit dealing of events to units; the patterns' results don't depend on it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_key(events: DataFrame, key: str, units: int) -> DataFrame:
    """Unit by a numeric key; events without one are dropped, as a keyed pattern can't use them."""
    return events.filter(F.col(key).isNotNull()).withColumn("unit", F.pmod(F.col(key).cast("long"), F.lit(units)))


def covering_key(events: DataFrame, attributes: Sequence[str], held: Mapping[str, Sequence[str]]) -> DataFrame:
    """Events of the types of ``held`` (type to its attributes) with ``key``: the first attribute of the list that the type has.

    A type without any of them can't be keyed, which is an error.
    """
    chosen = {kind: next((a for a in attributes if a in own), None) for kind, own in held.items()}
    if lacking := sorted(k for k, a in chosen.items() if a is None):
        raise ValueError(f"none of {list(attributes)} is an attribute of {lacking}")
    key = F.coalesce(*(F.when(F.col("etype") == kind, F.col(a).cast("string")) for kind, a in sorted(chosen.items())))
    return events.filter(F.col("etype").isin(*chosen)).withColumn("key", key)


def by_time_slice(events: DataFrame, window_us: int, multiple: int, time: Column) -> DataFrame:
    """Unit by slices of ``multiple`` windows; an event within a window of its slice's begin also goes to the slice before.

    A match belongs to the slice of its first event (column ``owner`` of that event's own copy).
    """
    size = window_us * multiple
    own = F.floor(time / size)
    copies = F.when(time - own * size <= window_us, F.array(own, own - 1)).otherwise(F.array(own))
    return events.withColumn("owner", own).withColumn("unit", F.explode(copies))


def by_hypercube(events: DataFrame, attributes: dict[str, str], shares: dict[str, int]) -> DataFrame:
    """Cells of a grid with an axis for each event type: an event is fixed on its type's axis and copied along the others."""
    axes = sorted(attributes)
    cells = F.array(F.array().cast("array<int>"))
    for axis in axes:
        fixed = F.array(F.pmod(F.hash(F.col(attributes[axis])), F.lit(shares[axis])))
        every = F.array(*[F.lit(i) for i in range(shares[axis])])
        here = F.when(F.col("etype") == axis, fixed).otherwise(every)
        cells = _product(cells, here)
    return events.filter(F.col("etype").isin(axes)).withColumn("unit", F.explode(cells))


def _product(cells: Column, values: Column) -> Column:
    def extend(cell: Column) -> Column:
        return F.transform(values, lambda x: F.array_append(cell, x))

    return F.flatten(F.transform(cells, extend))
