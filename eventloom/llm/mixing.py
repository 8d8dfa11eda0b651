"""Mixtures of sources at target weights, drawn by balanced sampling."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Sequence
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import row_key
from .scratch import write_out

#: Rows of one source that a flight takes at once, and how many of them it may leave undecided for the next one or the landing.
BLOCK_ROWS, LANDING_ROWS = 4_000, 12
#: Sources up to this number are sent to every executor; beyond it they are joined by a shuffle.
BROADCAST_SOURCES = 10_000
_DECIDED = 1e-9


def flight(chances: list[float], sizes: Sequence[float], seed: str) -> list[float]:
    """The cube method's flight: move the chances until at most LANDING_ROWS are neither 0 nor 1.

    Three undecided units at a time form a vector; the direction that leaves the sum of
    chances and the sum of chance * size unchanged spans the null space of the two
    constraints. A step goes along it to a face of the cube, in one of both senses at
    random such that every chance keeps its mean.
    """
    draw = random.Random(hashlib.sha256(seed.encode()).digest())
    out = list(chances)
    open_: list[int] = []
    undecided = [i for i, p in enumerate(out) if _DECIDED < p < 1 - _DECIDED]
    for i in undecided[: max(0, len(undecided) - LANDING_ROWS + 2)]:
        chance = out[i]
        if _DECIDED < chance < 1 - _DECIDED:
            open_.append(i)
        while len(open_) == 3:
            a, b, c = open_
            u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = min((1 - out[k]) / v if v > 0 else out[k] / -v for k, v in zip(open_, u) if v)
            down = min(out[k] / v if v > 0 else (1 - out[k]) / -v for k, v in zip(open_, u) if v)
            step = up if draw.random() * (up + down) < down else -down
            for k, v in zip(open_, u):
                p = out[k] + step * v
                out[k] = 0.0 if p < _DECIDED else 1.0 if p > 1 - _DECIDED else p
            open_ = [k for k in open_ if _DECIDED < out[k] < 1 - _DECIDED]
    return [round(p) if p < _DECIDED or p > 1 - _DECIDED else p for p in out]


def landing(chances: list[float], sizes: Sequence[float]) -> list[float]:
    """Decide the last few units: of all choices the one whose sums of size, then of units, are nearest."""
    open_ = [i for i, p in enumerate(chances) if 0 < p < 1]
    choices = np.array(list(product((0.0, 1.0), repeat=len(open_))))
    own = np.array([chances[i] for i in open_])
    off = np.abs((choices - own) @ np.array([float(sizes[i]) for i in open_]))
    out = list(chances)
    for i, x in zip(open_, choices[np.lexsort((np.abs((choices - own).sum(1)), off))[0]] if open_ else ()):
        out[i] = float(x)
    return out


def _fly(last: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["order", "size", "row_key"], kind="stable")
        sizes = frame["size"].tolist()
        chances = flight(frame["chance"].tolist(), sizes, f"{frame['order'].iloc[0]} {len(frame)} {last}")
        return frame.assign(chance=landing(chances, sizes) if last else chances)

    return run


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets by source of a table (source, source_size).

    The weights go to the sources by code point, null last, and repeat. The total is
    ``share`` of all sizes. A target stops at ``most`` times its source's size; the excess is
    shared among the others by weight until none is above. That is one level L with
    target = min(weight * L, cap): with sources ordered by cap / weight, the first k are
    capped for the least k at which the next one isn't.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, map(float, weights)))
    s = sizes.withColumn("weight", F.element_at(cycle, (F.row_number().over(by_name) - 1) % len(weights) + 1)).withColumn("cap", F.col("source_size") * most)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    so_far, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(everything) * share)
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(so_far), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(so_far), F.lit(0.0))))
    # the first source, in this order, whose share at its level is within its cap sets the level of all
    within = F.when(F.col("weight") * F.col("level") <= F.col("cap"), F.col("level"))
    s = s.withColumn("level", F.first(within, ignorenulls=True).over(everything))
    target = F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("level"), F.col("cap")))
    return s.select("source", "source_size", target.alias("target"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, text: str = "text", row_id: str = "doc_id", source: str = "source", key: Column | None = None) -> DataFrame:
    """How often a mixture takes each row of ``docs``, so that every source nears its target of words.

    Returns a row for each row of ``docs``: the id, ``row_key`` (``key``, or a hash of id and text), ``source``, ``size`` (words),
    ``source_size``, ``target`` and ``times`` (0 to ceil(most)). A source's rate is
    target / source_size: its whole part is taken of every row, the rest is each row's
    chance in a balanced sample, which keeps the totals of words and of rows.

    The flight runs on blocks of about 4,000 rows of one source, each of which leaves 12
    rows undecided at most. These form blocks anew and fly again, until no source has more than one block;
    then the landing decides its last 12 by trying all choices. So a source of any size spreads over tasks, and its total is off by less
    than one of its rows. A hot source only has more blocks.

    Null sources are one source. Null and empty texts have size 0 and any outcome of theirs takes no
    words. Repeated rows and ids are rows of their own. An empty table gives an empty
    table. Reruns agree: order and chance come from hashes of the row.
    """
    rows = write_out(
        docs.select(
            F.col(row_id).alias("id"),
            F.col(source).alias("source"),
            word_count(F.col(text)).alias("size"),
            (row_key(text, row_id) if key is None else key).alias("row_key"),
        ).withColumn("order", F.xxhash64("row_key", F.lit(6))),
        "mix-rows",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sizes = write_out(sizes, "mix-sizes")
    targets = source_targets(sizes.select("source", "source_size"), weights, share, most).join(sizes.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    if sizes.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rated = rows.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = rated.withColumn("whole", F.floor(rate + F.lit(_DECIDED)).cast("int")).withColumn("chance", F.greatest(rate - F.col("whole"), F.lit(0.0)))
    left = (F.col("chance") > 0) & (F.col("chance") < 1)
    largest, decided = sizes.agg(F.max("n")).first()[0] or 0, []
    while largest > BLOCK_ROWS:  # each round leaves at most LANDING_ROWS of a block: two rounds for a billion rows
        dealt = rated.withColumn("block", F.pmod(F.xxhash64("order", F.lit(len(decided))), F.ceil(F.col("n") / BLOCK_ROWS)).cast("long"))
        flown = write_out(dealt.groupBy("source", "block").applyInPandas(_fly(False), dealt.schema).drop("block"), "mix-flown")
        decided.append(flown.filter(~left).drop("n"))
        open_ = flown.filter(left).drop("n")
        counts = write_out(open_.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "mix-open")
        largest = counts.agg(F.max("n")).first()[0] or 0
        again = F.broadcast(counts) if counts.count() <= BROADCAST_SOURCES else counts
        rated = open_.join(again.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    last = rated.drop("n")
    done = reduce(DataFrame.unionByName, decided, last.groupBy("source").applyInPandas(_fly(True), last.schema))
    return done.select(F.col("id").alias(row_id), "row_key", "source", "size", "source_size", "target", (F.col("whole") + F.round("chance").cast("int")).alias("times"))
