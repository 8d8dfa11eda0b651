"""Arrival rates and selectivities of event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def occurrences(events: DataFrame) -> DataFrame:
    return events.groupBy("etype").agg(F.count(F.lit(1)).alias("n"))


def rates(events: DataFrame) -> DataFrame:
    """Events of each type per second of the whole stream's span."""
    span = events.agg((F.max("us") - F.min("us")).alias("span"))
    return occurrences(events).join(F.broadcast(span)).select("etype", (F.col("n") * 1_000_000 / F.col("span")).alias("per_second"))


def sliding_arrivals(events: DataFrame, window_us: int, partition: list[str]) -> DataFrame:
    """At each event, how many of its type came in the window that ends with it."""
    recent = Window.partitionBy("etype", *partition).orderBy("us").rangeBetween(-window_us, 0)
    return events.select("pos", "etype", F.count(F.lit(1)).over(recent).alias("arrivals"))


def pair_selectivity(events: DataFrame, first: str, second: str, keys: list[str], condition: Column) -> DataFrame:
    """Of the ordered pairs of two types that share the keys, the part that meets the condition (on l and r); 1 without pairs.

    Without keys it would compare all pairs, which is an error.
    """
    if not keys:
        raise ValueError("name the keys that pairs share")
    l, r = events.filter(F.col("etype") == first).alias("l"), events.filter(F.col("etype") == second).alias("r")
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    on = F.col("l.us") <= F.col("r.us")
    for s in same:
        on = s & on
    return l.join(r, on).agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.avg(condition.cast("double")), F.lit(1.0)).alias("selectivity"))
