"""Which matches stay: selection by start and end, limits, and consumption of events by matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.scratch import write_out


def select_next(matches: DataFrame, partition: list[str]) -> DataFrame:
    """Of the matches with one start and end, the one that prefers early events: the least list of positions."""
    return _first(matches, partition, F.col("ids").asc())


def select_last(matches: DataFrame, partition: list[str]) -> DataFrame:
    """Of the matches with one start and end, the one that prefers late events, from the end backwards."""
    return _first(matches, partition, F.reverse("ids").desc())


def _first(matches: DataFrame, partition: list[str], order) -> DataFrame:
    by = Window.partitionBy(*partition, "lo_pos", "hi_pos").orderBy(order)
    return matches.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")


def select_max(matches: DataFrame, partition: list[str]) -> DataFrame:
    """Matches whose events are no strict subset of those of another match with the same start and end."""
    keys = [*partition, "lo_pos", "hi_pos"]
    other = matches.select(*(F.col(k).alias(f"o_{k}") for k in keys), F.col("ids").alias("o_ids"))
    same = [F.col(k) == F.col(f"o_{k}") for k in keys]
    larger = (F.size("o_ids") > F.size("ids")) & (F.size(F.array_except("ids", "o_ids")) == 0)
    on = larger
    for s in same:
        on = s & on
    return matches.join(other, on, "left_anti")


def limit_per_trigger(matches: DataFrame, most: int, partition: list[str]) -> DataFrame:
    """The first ``most`` matches, by positions, of each event that completes some."""
    by = Window.partitionBy(*partition, "hi_pos").orderBy("ids")
    return matches.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= most).drop("_n")


def triggers(matches: DataFrame, partition: list[str]) -> DataFrame:
    """Detection only: each completing event once."""
    return matches.select(*partition, F.col("hi_pos").alias("trigger_id")).distinct()


#: Positions in one range when the next match is sought; within a range a task sorts a partition's marks.
RANGE = 1 << 16


def _next_end(matches: DataFrame, partition: list[str]) -> DataFrame:
    """(partition, of, next): of each end the least end of a match that starts after it, if any.

    A minimum over later starts: over those in the end's range of positions, and over whole later ranges, of which there
    are few, so that no partition is one task.
    """
    starts = matches.groupBy(*partition, "lo_pos").agg(F.min("hi_pos").alias("end")).withColumnRenamed("lo_pos", "at").withColumn("of", F.lit(None).cast("long"))
    ends = matches.select(*partition, F.col("hi_pos").alias("at"), F.lit(None).cast("long").alias("end"), F.col("hi_pos").alias("of")).distinct()
    marks = starts.unionByName(ends).withColumn("range", F.floor(F.col("at") / RANGE))
    inside = Window.partitionBy(*partition, "range").orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*partition).orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranges = marks.groupBy(*partition, "range").agg(F.min("end").alias("least")).withColumn("beyond", F.min("least").over(after)).drop("least")
    own = marks.withColumn("near", F.min("end").over(inside)).filter("of is not null").join(ranges, [*partition, "range"])
    return own.select(*partition, "of", F.least("near", "beyond").alias("next")).filter("next is not null")


def consume(matches: DataFrame, partition: list[str]) -> DataFrame:
    """Matches that remain if each event that completes one clears all partial matches of its partition.

    With no partition, of all partitions (their events share one order of positions). After a trigger only matches that start later can
    complete, so the triggers are a chain: from an end to the least end of a match that starts after
    it. The chain is followed by pointer doubling: a round doubles the distance each end sees, so n triggers
    take log2(n) joins, not n steps. Each round is written out, which cuts its lineage.
    """
    matches = write_out(matches, "consumed")
    step = write_out(_next_end(matches, partition), "consume-step")
    reached, jump = matches.groupBy(*partition).agg(F.min("hi_pos").alias("of")).filter("of is not null"), step
    while True:
        fresh = reached.join(jump, [*partition, "of"]).select(*partition, F.col("next").alias("of"))
        reached = write_out(reached.union(fresh).distinct(), "consume-reached")
        far = jump.select(*partition, F.col("of").alias("next"), F.col("next").alias("far"))
        jump = write_out(jump.join(far, [*partition, "next"]).select(*partition, "of", F.col("far").alias("next")), "consume-jump")
        if jump.isEmpty():
            break
    # the last round's jumps may still lead somewhere: every end that follows a reached one is reached
    chain = reached.join(step, [*partition, "of"]).select(*partition, F.col("next").alias("hi_pos"), F.col("of").alias("cleared"))
    first = matches.groupBy(*partition).agg(F.min("hi_pos").alias("hi_pos")).withColumn("cleared", F.lit(None).cast("long"))
    kept = matches.join(chain.unionByName(first), [*partition, "hi_pos"]).filter(F.col("cleared").isNull() | (F.col("lo_pos") > F.col("cleared")))
    return kept.select(*matches.columns)


def single_use(matches: DataFrame, partition: list[str], single: Column | None = None) -> DataFrame:
    """Matches such that no event is in two of them: in order of completion, each is kept if its events are still unused.

    ``single``: an array of the positions that count (default: all of a match). A match that comes first at
    all its events is kept, those that share one with it go, and so on until none is left; rounds
    are written out. So no partition, however many of its matches overlap, is folded in one task.
    """
    order = F.struct("hi_pos", "ids")
    left = matches.withColumn("_single", F.col("ids") if single is None else single).withColumn("_order", order).dropDuplicates([*partition, "hi_pos", "ids"])
    left, kept = write_out(left, "single-left"), []
    same = [*partition, "_order"]
    while not left.isEmpty():
        events = left.select(*partition, "_order", F.explode("_single").alias("_event"))
        first = events.groupBy(*partition, "_event").agg(F.min("_order").alias("_first"))
        behind = events.join(first, [*partition, "_event"]).filter(F.col("_order") != F.col("_first")).select(*same).distinct()
        won = write_out(_without(left, behind, same), "single-kept")
        used = won.select(*partition, F.explode("_single").alias("_event")).distinct()
        gone = events.join(used, [*partition, "_event"], "left_semi").select(*same).union(won.select(*same)).distinct()
        kept.append(won)
        left = write_out(_without(left, gone, same), "single-left")
    return reduce(DataFrame.unionByName, kept or [left]).drop("_single", "_order")


def _without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys, null ones included, are not among ``gone``."""
    out = gone.select(*(F.col(k).alias(f"_gone{i}") for i, k in enumerate(keys)))
    on = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_gone{i}")) for i, k in enumerate(keys)))
    return rows.join(out, on, "left_anti")


def first_final(matches: DataFrame, partition: list[str]) -> DataFrame:
    """Matches that extend no other one: none whose events are the first ones of a longer list with the same first event stays beside it.

    That is what remains if a run stops once it is complete.
    """
    begun = matches.select(*(F.col(k).alias(f"_p{i}") for i, k in enumerate(partition)), F.col("lo_pos").alias("_lo"), F.col("ids").alias("_ids")).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"_p{i}")) for i, k in enumerate(partition)] + [F.col("lo_pos") == F.col("_lo")]
    shorter = (F.size("_ids") < F.size("ids")) & (F.slice("ids", F.lit(1), F.size("_ids")) == F.col("_ids"))
    return matches.join(begun, reduce(Column.__and__, on) & shorter, "left_anti")


def limit_input(events: DataFrame, most: int | None) -> DataFrame:
    """The first ``most`` events by position (0: none, None: all); positions are gapless from 0."""
    return events if most is None else events.filter(F.col("pos") < most)


def checked_runs(matches: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The matches, written out; an error if there are more than ``most``."""
    matches = write_out(matches, "runs")
    if (n := matches.count()) > most:
        raise ValueError(f"{n} matches, more than {most}")
    return matches
