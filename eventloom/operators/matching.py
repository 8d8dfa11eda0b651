"""Patterns lowered to DataFrame joins.

A partial match is a row: partition keys, a struct for each alias (an array of structs for
a repetition), the least and greatest time, position and window metric, the positions of all its
events, and their joint probability. Every join has equality keys: the partition attributes
and, for windows by time or attribute, a bucket of the window's size, so that neither a hot
key nor a pattern without keys falls back to comparing all pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.operators.selection import single_use
from eventloom.plans.pattern import And, Condition, Event, Not, Or, Part, Pattern, Repeat, Seq
from eventloom.scratch import write_out

_OWN = ["lo_ts", "hi_ts", "lo_pos", "hi_pos", "lo_m", "hi_m", "ids", "prob"]
_SPAN = ["lo_ts", "hi_ts", "lo_pos", "hi_pos", "ids"]


def stream(events: DataFrame, position: str = "event_id", time: str = "ts", kind: str = "event_type") -> DataFrame:
    """Events with the columns that matching reads: pos, us (microseconds), etype; all others stay.

    Positions must be unique and grow with the input order.
    """
    us = F.expr(f"unix_micros(cast({time} as timestamp))") if dict(events.dtypes)[time].startswith("timestamp") else F.col(time).cast("long")
    return events.withColumn("pos", F.col(position).cast("long")).withColumn("us", us).withColumn("etype", F.col(kind))


class _Lowering:
    def __init__(self, events: DataFrame, pattern: Pattern) -> None:
        self.events, self.pattern, self.window = events, pattern, pattern.window
        self.keys = [f"key{i}" for i in range(len(pattern.partition))]
        self.columns = [c for c in events.columns]
        metric = {"time": F.col("us"), "events": F.col("pos")}.get(self.window.metric)
        self.metric = metric if metric is not None else F.col(self.window.attribute).cast("long")

    # leaves

    def fitting(self, part: Event | Or) -> Column:
        """Whether an event is one of the part; never null."""
        if isinstance(part, Or):
            return reduce(Column.__or__, map(self.fitting, part.parts))
        fits = F.col("etype").isin([part.types] if isinstance(part.types, str) else list(part.types))
        if part.stream:
            fits = fits & (F.col("stream") == part.stream)
        if part.where:
            fits = fits & part.where(F.col)
        return F.coalesce(fits, F.lit(False))

    def leaf(self, part: Event) -> DataFrame:
        types = [part.types] if isinstance(part.types, str) else list(part.types)
        rows = self.events.filter(F.col("etype").isin(types) if len(types) > 1 else F.col("etype") == types[0])
        if part.stream:
            rows = rows.filter(F.col("stream") == part.stream)
        if part.where:
            rows = rows.filter(part.where(F.col))
        prob = F.col("probability").cast("double") if "probability" in self.columns else F.lit(None).cast("double")
        return rows.select(
            *(F.col(a).alias(k) for a, k in zip(self.pattern.partition, self.keys)),
            F.struct(*self.columns).alias(part.alias),
            F.col("us").alias("lo_ts"), F.col("us").alias("hi_ts"), F.col("pos").alias("lo_pos"), F.col("pos").alias("hi_pos"),
            self.metric.alias("lo_m"), self.metric.alias("hi_m"), F.array("pos").alias("ids"), prob.alias("prob"),
        )

    # joins

    def _renamed(self, rows: DataFrame) -> DataFrame:
        return rows.select(*(F.col(c).alias(f"r_{c}") if c in _OWN or c in self.keys else F.col(c) for c in rows.columns))

    def meet(self, left: DataFrame, right: DataFrame, on: Column, how: str, around: bool) -> DataFrame:
        """Join rows whose window metric is near: on the keys and on buckets of the window's size.

        around: the right side may also begin a bucket before the left one.
        """
        r = self._renamed(right)
        same = [F.col(k) == F.col(f"r_{k}") for k in self.keys]
        size = max(1, self.window.size)
        bucket = F.floor(F.col("lo_m") / size)
        near = F.array(*([bucket - 1] if around else []), bucket, bucket + 1)
        if how == "left_anti":
            # the left row must stay one row: the right side takes the buckets from which it can be seen
            seen = F.floor(F.col("r_lo_m") / size)
            r = r.withColumn("r_bucket", F.explode(F.array(seen - 1, seen, *([seen + 1] if around else []))))
            return left.withColumn("bucket", bucket).join(r, reduce(Column.__and__, [*same, F.col("bucket") == F.col("r_bucket"), on]), how).drop("bucket")
        out = left.withColumn("bucket", F.explode(near)).join(r.withColumn("r_bucket", F.floor(F.col("r_lo_m") / size)), reduce(Column.__and__, [*same, F.col("bucket") == F.col("r_bucket"), on]), how)
        return out.drop("bucket", "r_bucket", *(f"r_{k}" for k in self.keys))

    def in_order(self, first: str = "", then: str = "r_") -> Column:
        if self.pattern.order == "position":
            return F.col(f"{first}hi_pos") < F.col(f"{then}lo_pos")
        return F.col(f"{first}hi_ts") <= F.col(f"{then}lo_ts")

    def within(self) -> Column:
        return self.window.fits(F.greatest("hi_m", "r_hi_m") - F.least("lo_m", "r_lo_m"))

    def merged(self, rows: DataFrame) -> DataFrame:
        """One partial match of the two that were joined."""
        merged = {
            "lo_ts": F.least("lo_ts", "r_lo_ts"), "hi_ts": F.greatest("hi_ts", "r_hi_ts"), "lo_pos": F.least("lo_pos", "r_lo_pos"), "hi_pos": F.greatest("hi_pos", "r_hi_pos"),
            "lo_m": F.least("lo_m", "r_lo_m"), "hi_m": F.greatest("hi_m", "r_hi_m"), "ids": F.concat("ids", "r_ids"),
            "prob": F.coalesce(F.col("prob") * F.col("r_prob"), "prob", "r_prob"),
        }
        keep = [c for c in rows.columns if c not in merged and not (c.startswith("r_") and c[2:] in _OWN)]
        return rows.select(*keep, *(v.alias(k) for k, v in merged.items()))

    def sequence(self, part: Seq) -> DataFrame:
        positive = [p for p in part.parts if not isinstance(p, Not)]
        rows = self.joined(positive, True) if part.gap == "any" else self.followed(positive, part.gap)
        return self.absent(rows, part)

    def joined(self, parts: list[Part], ordered: bool) -> DataFrame:
        """All parts within the window, one after the other if ordered.

        Repetitions come last, each grown between its neighbours that are there already, so a chain grows
        only where these match. If all parts are repetitions, the first is grown by itself. Columns _at0, _at1 and so on
        hold the span of each part.
        """
        fixed = [i for i, p in enumerate(parts) if not isinstance(p, Repeat)] or [0]
        rows = None
        for i in fixed:
            own = self.build(parts[i]).withColumn(f"_at{i}", F.struct(*_SPAN))
            if rows is None:
                rows = own
                continue
            on = self.within() & ~F.arrays_overlap("ids", "r_ids")
            rows = self.chosen(self.merged(self.meet(rows, own, self.in_order() & on if ordered else on, "inner", not ordered)))
        for i, p in enumerate(parts):
            if i not in fixed:
                after = min((j for j in fixed if j > i), default=None)
                rows = self.grown(rows, p, i, i - 1 if ordered and i else None, after if ordered else None)
        return rows.withColumn("ids", F.concat(*(F.col(f"_at{i}").ids for i in range(len(parts)))))

    def chosen(self, rows: DataFrame) -> DataFrame:
        """With selection ``next``, each event of a partition is in one match of every node."""
        return single_use(rows, self.keys) if self.pattern.selection == "next" else rows

    def grown(self, rows: DataFrame, part: Repeat, place: int, before: int | None, after: int | None) -> DataFrame:
        """Rows with each chain of the repetition that fits between two of their parts."""
        one, at, position = self.items(part), f"_at{place}", self.pattern.order == "position"
        fits = self.within() & ~F.arrays_overlap("_fixed", "r_ids")
        if before is not None:
            b = F.col(f"_at{before}")
            fits = fits & ((b.hi_pos < F.col("r_lo_pos")) if position else (b.hi_ts <= F.col("r_lo_ts")))
        if after is not None:
            a = F.col(f"_at{after}")
            fits = fits & ((F.col("r_hi_pos") < a.lo_pos) if position else (F.col("r_hi_ts") <= a.lo_ts))
        new = F.struct(*(F.col(f"r_{c}").alias(c) for c in _SPAN))
        met = self.meet(rows.withColumn("_fixed", F.col("ids")), one, fits, "inner", before is None)
        first = self.merged(met.withColumn(at, new).withColumn("_tail", F.col("r_ids"))).withColumn(part.alias, F.array("_item")).drop("_item")

        def step(chains: DataFrame) -> DataFrame:
            old = F.col(at)
            span = {"lo_ts": F.least, "hi_ts": F.greatest, "lo_pos": F.least, "hi_pos": F.greatest, "ids": F.concat}
            both = F.struct(*(f(old[c], F.col(f"r_{c}")).alias(c) for c, f in span.items()))
            found = self.meet(chains, one, self.later(old.hi_pos) & fits, "inner", before is None)
            found = self.merged(found.withColumn(at, both).withColumn("_tail", F.col("r_ids")))
            return found.withColumn(part.alias, F.array_append(part.alias, F.col("_item"))).drop("_item")

        return self.rounds(first, step, part).drop("_fixed", "_tail")

    def followed(self, parts: list[Event | Or], gap: str) -> DataFrame:
        """Single events, each the very next of its partition (strict) or the first that fits (next); no join.

        The parts are taken from the last one on: each event carries what follows it, seen in one running pass.
        Where the order is that of the window's metric, a partition is cut into buckets of the window's
        size, each with the one after it, as no match reaches further. Events whose keys are null are a
        partition of their own for strict, and in no match for next.
        """
        cut = (self.window.metric, self.pattern.order) in (("time", "time"), ("events", "position"))
        if not cut and not self.keys:
            raise ValueError(f"gap {gap!r} without a partition takes a window by time in the order of time, or by events in the order of positions")
        prob = F.col("probability").cast("double") if "probability" in self.columns else F.lit(None).cast("double")
        rows = self.events.select(
            *(F.col(a).alias(k) for a, k in zip(self.pattern.partition, self.keys)),
            F.struct(F.struct(*self.columns).alias("event"), F.col("us").alias("ts"), F.col("pos"), self.metric.alias("m"), prob.alias("prob")).alias("own"),
            *(self.fitting(p).alias(f"fits{i}") for i, p in enumerate(parts)),
        )
        if gap == "next":
            rows = rows.dropna(subset=self.keys) if self.keys else rows
        by = list(self.keys)
        if cut:
            bucket = F.floor(F.col("own.m") / max(1, self.window.size))
            rows = rows.withColumn("home", bucket).withColumn("bucket", F.explode(F.array(bucket - 1, bucket)))
            by.append("bucket")
        back = [F.col("own.ts").desc(), F.col("own.pos").desc()] if self.pattern.order == "time" else [F.col("own.pos").desc()]
        later = W.partitionBy(*by).orderBy(*back)
        chain = F.when(F.col(f"fits{len(parts) - 1}"), F.array("own"))
        for i in range(len(parts) - 2, -1, -1):
            rest = F.lag("chain", 1).over(later) if gap == "strict" else F.last("chain", ignorenulls=True).over(later.rowsBetween(W.unboundedPreceding, -1))
            rows = rows.withColumn("chain", chain).withColumn("chain", rest)
            chain = F.when(F.col(f"fits{i}") & F.col("chain").isNotNull(), F.concat(F.array("own"), F.col("chain")))
        rows = rows.withColumn("chain", chain).filter(F.col("chain").isNotNull())
        if cut:
            rows = rows.filter(F.col("home") == F.col("bucket"))
        each = [F.col("chain")[i] for i in range(len(parts))]
        of = lambda name, side: side(F.transform("chain", lambda x: x[name]))
        rows = rows.select(
            *self.keys, *(x.event.alias(p.aliases()[0]) for x, p in zip(each, parts)),
            *(F.struct(x.ts.alias("lo_ts"), x.ts.alias("hi_ts"), x.pos.alias("lo_pos"), x.pos.alias("hi_pos"), F.array(x.pos).alias("ids")).alias(f"_at{i}") for i, x in enumerate(each)),
            *(of(name, side).alias(f"{a}_{name}") for name in ("ts", "pos", "m") for a, side in (("lo", F.array_min), ("hi", F.array_max))),
            F.transform("chain", lambda x: x.pos).alias("ids"), reduce(lambda p, q: F.coalesce(p * q, p, q), [x.prob for x in each]).alias("prob"),
        )
        return rows.filter(self.window.fits(F.col("hi_m") - F.col("lo_m")))

    def absent(self, rows: DataFrame, part: Seq | And) -> DataFrame:
        """Drop matches that some forbidden part fits, in order and within the window.

        Between two positive parts the forbidden one lies between these; first or last it lies
        before or after all, within the window. A bounded one must have come before the match was
        complete.
        """
        positive = [p for p in part.parts if not isinstance(p, Not)]
        place = 0  # positive parts so far
        for p in part.parts:
            if not isinstance(p, Not):
                place += 1
                continue
            bad = self.build(p.part)
            on = self.within() & ~F.arrays_overlap("ids", "r_ids")
            if isinstance(part, Seq):
                time = self.pattern.order == "time"
                if place:
                    b = F.col(f"_at{place - 1}")
                    on = on & ((b.hi_ts <= F.col("r_lo_ts")) if time else (b.hi_pos < F.col("r_lo_pos")))
                if place < len(positive):
                    a = F.col(f"_at{place}")
                    on = on & ((F.col("r_hi_ts") <= a.lo_ts) if time else (F.col("r_hi_pos") < a.lo_pos)) & (F.col("r_hi_pos") < F.col("hi_pos"))
            if p.condition:
                on = on & self.not_false(p.condition, set(part.aliases()))
            if self.pattern.confidence is not None and "probability" in self.columns:
                rows = self.doubted(rows, bad, on)
            else:
                rows = self.meet(rows, bad, on, "left_anti", True)
        return rows.drop(*(f"_at{i}" for i in range(len(positive))))

    def not_false(self, condition: Condition, bound: set[str]) -> Column:
        """The condition, or true where it is unknown since an alternative leaves an alias of ``bound`` without an event."""
        named: set[str] = set()

        def value(alias: str, attribute: str) -> Column:
            named.add(alias)
            return F.col(f"`{alias}`.`{attribute}`")

        holds = condition(value)
        unknown = [F.col(f"`{a}`").isNull() for a in sorted(named & bound)]
        return F.coalesce(holds, reduce(Column.__or__, unknown, F.lit(False)))

    def doubted(self, rows: DataFrame, bad: DataFrame, on: Column) -> DataFrame:
        """Uncertain forbidden parts don't drop a match; each makes it less likely by its own probability. A certain one leaves 0."""
        keys = [*self.keys, "ids"]
        doubt = self.meet(rows, bad, on, "inner", True).groupBy(*keys).agg(F.product(1 - F.coalesce("r_prob", F.lit(1.0))).alias("doubt"))
        left = rows.join(doubt, keys, "left")
        return left.withColumn("prob", F.when(F.col("doubt").isNull(), F.col("prob")).otherwise(F.coalesce("prob", F.lit(1.0)) * F.col("doubt"))).drop("doubt")

    def conjunction(self, part: And) -> DataFrame:
        positive = [p for p in part.parts if not isinstance(p, Not)]
        return self.absent(self.joined(positive, False), part)

    # repetition

    def items(self, part: Repeat) -> DataFrame:
        own = part.part.aliases()
        item = F.col(own[0]) if len(own) == 1 else F.struct(*own)
        return self.build(part.part).withColumn("_item", item).drop(*own)

    def later(self, hi_pos: Column) -> Column:
        """Parts come in the order of their last events; ties, which share that event, by their positions."""
        if self.pattern.order == "position":
            return hi_pos < F.col("r_lo_pos")
        return (hi_pos < F.col("r_hi_pos")) | ((hi_pos == F.col("r_hi_pos")) & (F.col("_tail") < F.col("r_ids")))

    def rounds(self, rows: DataFrame, step: Callable[[DataFrame], DataFrame], part: Repeat) -> DataFrame:
        """Chains of all lengths that are asked for; without a bound they grow until a round, written out, is empty."""
        found, n = [], 1
        while True:
            if part.most is None:
                rows = write_out(rows, "chains")
            if n >= part.least:
                found.append(rows)
            if n == part.most or (part.most is None and rows.isEmpty()):
                break
            rows, n = step(rows), n + 1
        # chains that ended before the least length leave the last, empty round
        return reduce(DataFrame.unionByName, found or [rows])

    def repetition(self, part: Repeat) -> DataFrame:
        """Chains of the part's matches, each later than the one before; grown one step at a time within the window."""
        one = self.items(part)

        def step(chains: DataFrame) -> DataFrame:
            met = self.meet(chains, one, self.later(F.col("hi_pos")) & self.within(), "inner", True).withColumn("_tail", F.col("r_ids"))
            return self.merged(met).withColumn(part.alias, F.array_append(part.alias, F.col("_item"))).drop("_item")

        first = one.withColumn(part.alias, F.array("_item")).withColumn("_tail", F.col("ids")).drop("_item")
        return self.rounds(first, step, part).drop("_tail")

    def build(self, part: Part) -> DataFrame:
        if isinstance(part, Event):
            return self.leaf(part)
        if isinstance(part, Seq):
            return self.sequence(part)
        if isinstance(part, And):
            return self.conjunction(part)
        if isinstance(part, Or):
            return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(self.build, part.parts))
        if isinstance(part, Repeat):
            return self.repetition(part)
        raise TypeError(f"{part} can't stand here")

    def run(self) -> DataFrame:
        rows = self.build(self.pattern.structure)
        if self.pattern.condition:
            rows = rows.filter(self.not_false(self.pattern.condition, set(self.pattern.structure.aliases())))
        if self.pattern.confidence is not None:
            rows = rows.filter(F.coalesce("prob", F.lit(1.0)) >= self.pattern.confidence)
        return rows if self.pattern.selection == "any" else single_use(rows, self.keys)


def match(events: DataFrame, pattern: Pattern) -> DataFrame:
    """All matches of ``pattern`` in ``events`` (from ``stream``), one row each."""
    return _Lowering(events, pattern).run()
