"""The library's own registered queries over ``events``, each beside its DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.functions import conditions
from eventloom.operators import routing, selection, statistics
from eventloom.operators.matching import match, stream
from eventloom.plans.pattern import DAY, HOUR, And, Event, Not, Or, Pattern, Repeat, Seq, Window
from eventloom.scratch import shared_folder
from eventloom.sources import text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
USER = ("user_id",)


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _id(alias: str) -> Column:
    return F.col(f"{alias}.pos").alias(f"{alias}_id")


def _ids(c: str = "ids") -> Column:
    return F.array_join(F.col(c).cast("array<string>"), ",")


def _find(spark, sf_dir, structure, size, *aliases, condition=None, partition=USER, order="time", inclusive=True, metric="time", attribute=None, **settings) -> DataFrame:
    pattern = Pattern(structure, Window(size, metric, inclusive, attribute), condition, partition, order, settings=settings)
    found = match(_events(spark, sf_dir), pattern)
    return found.select(*map(_id, aliases)) if aliases else found


def _e(kind: str, alias: str, where=None) -> Event:
    return Event(kind, alias, where)


# single events


@query("SELECT event_id, user_id FROM events WHERE event_type = 'click'")
def leaf_type_filter(spark, sf_dir):
    return _events(spark, sf_dir).filter(F.col("etype") == "click").select("event_id", "user_id")


@query("SELECT event_id, value FROM events WHERE event_type = 'purchase' AND value BETWEEN 10 AND 50")
def leaf_value_range(spark, sf_dir):
    return _events(spark, sf_dir).filter((F.col("etype") == "purchase") & F.col("value").between(10, 50)).select("event_id", "value")


@query("SELECT event_id FROM events WHERE user_id IS NOT DISTINCT FROM 7")
def cond_null_safe_eq(spark, sf_dir):
    return _events(spark, sf_dir).filter(F.col("user_id").eqNullSafe(F.lit(7))).select("event_id")


@query("SELECT event_id FROM events WHERE user_id IS DISTINCT FROM 7")
def cond_neq(spark, sf_dir):
    return _events(spark, sf_dir).filter(~F.col("user_id").eqNullSafe(F.lit(7))).select("event_id")


@query("SELECT event_id FROM events WHERE event_type = 'error' OR value > 90")
def cond_or_branches(spark, sf_dir):
    return _events(spark, sf_dir).filter((F.col("etype") == "error") | (F.col("value") > 90)).select("event_id")


@query("SELECT event_id FROM events WHERE user_id IN (1, 3, 5) AND event_type NOT IN ('view', 'click')")
def cond_in_not_in(spark, sf_dir):
    return _events(spark, sf_dir).filter(F.col("user_id").isin(1, 3, 5) & ~F.col("etype").isin("view", "click")).select("event_id")


@query("SELECT event_id FROM events WHERE value * 2 - 1 >= CAST(user_id AS DOUBLE) + 3 AND -value < -10")
def cond_arith(spark, sf_dir):
    return _events(spark, sf_dir).filter((F.col("value") * 2 - 1 >= F.col("user_id").cast("double") + 3) & (-F.col("value") < -10)).select("event_id")


@query("SELECT event_id FROM events WHERE regexp_matches(event_type, '^(sign|pur)')")
def cond_like_regex(spark, sf_dir):
    return _events(spark, sf_dir).filter(F.col("etype").rlike("^(sign|pur)")).select("event_id")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_attr(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT event_id, regexp_replace(event_type || ' / ' || upper(event_type), '[\\s/]', '', 'g') AS zone FROM events")
def zone_normalise(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.regexp_replace(F.concat_ws(" / ", "etype", F.upper("etype")), r"[\s/]", "").alias("zone"))


@query("SELECT event_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS bar, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS sensor FROM events")
def parse_ts_formats(spark, sf_dir):
    """Time stamps written in the layouts of bars and of sensors, and parsed again."""
    again = lambda layout: F.to_timestamp_ntz(F.date_format("ts", layout), F.lit(layout))
    rows = _events(spark, sf_dir).select("event_id", again("yyyyMMddHHmm").alias("bar"), again("MM/dd/yyyy HH:mm:ss").alias("sensor"))
    return rows.select("event_id", F.date_format("bar", "yyyy-MM-dd HH:mm").alias("bar"), F.date_format("sensor", "yyyy-MM-dd HH:mm:ss").alias("sensor"))


# joins


_PAIR = """SELECT {cols} FROM events a JOIN events b ON {keys} {on}
WHERE a.event_type = '{x}' AND b.event_type = '{y}'"""


@query(_PAIR.format(cols="a.event_id AS a_id, b.event_id AS b_id", keys="a.user_id = b.user_id", on="AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 24 HOUR", x="view", y="purchase"))
def seq2_incl_window(spark, sf_dir):
    return _find(spark, sf_dir, Seq(_e("view", "a"), _e("purchase", "b")), DAY, "a", "b")


_TRIPLE = """SELECT {cols} FROM events a JOIN events b ON a.user_id = b.user_id JOIN events c ON c.user_id = b.user_id
WHERE a.event_type = '{x}' AND b.event_type = '{y}' AND c.event_type = '{z}' AND {on}"""
_ABC = "a.event_id AS a_id, b.event_id AS b_id, c.event_id AS c_id"


@query(_TRIPLE.format(cols=_ABC, x="view", y="click", z="purchase", on="b.ts >= a.ts AND c.ts >= b.ts AND c.ts <= a.ts + INTERVAL 24 HOUR"))
def seq3_user_24h(spark, sf_dir):
    return _find(spark, sf_dir, Seq(_e("view", "a"), _e("click", "b"), _e("purchase", "c")), DAY, "a", "b", "c")


@query(_PAIR.format(cols="a.event_id AS a_id, b.event_id AS b_id", keys="TRUE", on="AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 10 MINUTE", x="signup", y="error"))
def seq_range_join_no_key(spark, sf_dir):
    return _find(spark, sf_dir, Seq(_e("signup", "a"), _e("error", "b")), HOUR // 6, "a", "b", partition=())


@query(_PAIR.format(cols="a.event_id AS a_id, b.event_id AS b_id", keys="a.user_id = b.user_id", on="AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 48 HOUR AND b.value > a.value", x="view", y="purchase"))
def seq_cross_condition(spark, sf_dir):
    return _find(spark, sf_dir, Seq(_e("view", "a"), _e("purchase", "b")), 2 * DAY, "a", "b", condition=lambda v: v("b", "value") > v("a", "value"))


@query("""SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id
WHERE a.event_type = 'click' AND b.event_type = 'error' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 43200000000""")
def and2_window(spark, sf_dir):
    return _find(spark, sf_dir, And(_e("click", "a"), _e("error", "b")), 12 * HOUR, "a", "b")


@query(_TRIPLE.format(cols=_ABC, x="click", y="error", z="view", on="greatest(a.ts, b.ts, c.ts) <= least(a.ts, b.ts, c.ts) + INTERVAL 24 HOUR"))
def and3_window(spark, sf_dir):
    return _find(spark, sf_dir, And(_e("click", "a"), _e("error", "b"), _e("view", "c")), DAY, "a", "b", "c")


@query("SELECT event_id AS a_id FROM events WHERE event_type IN ('error', 'signup')")
def or_union(spark, sf_dir):
    return _find(spark, sf_dir, Or(_e("error", "a"), _e("signup", "a")), DAY, "a")


@query("""SELECT a.event_id AS a_id, b.event_id AS b_id, c.event_id AS c_id FROM events a JOIN events b ON a.user_id = b.user_id JOIN events c ON c.user_id = b.user_id
WHERE a.event_type = 'view' AND b.event_type = 'click' AND c.event_type = 'error' AND a.ts <= least(b.ts, c.ts) AND greatest(b.ts, c.ts) <= a.ts + INTERVAL 24 HOUR""")
def seq_of_and(spark, sf_dir):
    return _find(spark, sf_dir, Seq(_e("view", "a"), And(_e("click", "b"), _e("error", "c"))), DAY, "a", "b", "c")


@query("""SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id <> a.event_id
WHERE a.event_type = 'view' AND b.event_type = 'view' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 24 HOUR""")
def seq_no_reuse(spark, sf_dir):
    return _find(spark, sf_dir, Seq(_e("view", "a"), _e("view", "b")), DAY, "a", "b")


@query("""SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON b.event_id = a.event_id + 1
WHERE a.event_type = 'view' AND b.event_type = 'click' AND b.ts <= a.ts + INTERVAL 1 HOUR""")
def seq_contiguous(spark, sf_dir):
    found = _find(spark, sf_dir, Seq(_e("view", "a"), _e("click", "b")), HOUR, partition=(), condition=lambda v: v("b", "pos") == v("a", "pos") + 1)
    return found.select(_id("a"), _id("b"))


@query(_PAIR.format(cols="a.event_id AS a_id, b.event_id AS b_id", keys="a.user_id = b.user_id", on="AND b.event_id > a.event_id AND epoch_us(b.ts) - epoch_us(a.ts) < 86400000000", x="view", y="click"))
def strict_window_time(spark, sf_dir):
    return _find(spark, sf_dir, Seq(_e("view", "a"), _e("click", "b")), DAY, "a", "b", order="position", inclusive=False)


@query(_PAIR.format(cols="a.event_id AS a_id, b.event_id AS b_id", keys="a.user_id = b.user_id", on="AND b.event_id > a.event_id AND b.event_id - a.event_id < 100", x="view", y="click"))
def strict_window_events(spark, sf_dir):
    return _find(spark, sf_dir, Seq(_e("view", "a"), _e("click", "b")), 100, "a", "b", order="position", inclusive=False, metric="events")


@query(_PAIR.format(cols="a.event_id AS a_id, b.event_id AS b_id", keys="a.user_id = b.user_id", on="AND b.event_id > a.event_id AND abs(CAST(trunc(b.value) AS BIGINT) - CAST(trunc(a.value) AS BIGINT)) < 5", x="view", y="click"))
def strict_window_attr(spark, sf_dir):
    return _find(spark, sf_dir, And(_e("view", "a"), _e("click", "b")), 5, "a", "b", order="position", inclusive=False, metric="attribute", attribute="value", condition=lambda v: v("b", "pos") > v("a", "pos"))


# negation


_NO = "NOT EXISTS (SELECT 1 FROM events n WHERE n.user_id = a.user_id AND n.event_type = 'error' AND {})"


@query(_PAIR.format(cols="a.event_id AS a_id, b.event_id AS b_id", keys="a.user_id = b.user_id", on="AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 24 HOUR", x="view", y="purchase") + " AND " + _NO.format("n.ts >= a.ts AND n.ts <= b.ts"))
def not_bounded(spark, sf_dir):
    return _find(spark, sf_dir, Seq(_e("view", "a"), Not(_e("error", "n")), _e("purchase", "b")), DAY, "a", "b")


@query("SELECT a.event_id AS a_id FROM events a WHERE a.event_type = 'purchase' AND " + _NO.format("n.ts <= a.ts AND a.ts <= n.ts + INTERVAL 24 HOUR"))
def not_leading(spark, sf_dir):
    return _find(spark, sf_dir, Seq(Not(_e("error", "n")), _e("purchase", "a")), DAY, "a")


@query("SELECT a.event_id AS a_id FROM events a WHERE a.event_type = 'signup' AND " + _NO.format("n.ts >= a.ts AND n.ts <= a.ts + INTERVAL 24 HOUR"))
def not_trailing(spark, sf_dir):
    return _find(spark, sf_dir, Seq(_e("signup", "a"), Not(_e("error", "n"))), DAY, "a")


@query("SELECT a.event_id AS a_id FROM events a WHERE a.event_type = 'signup' AND " + _NO.format("abs(epoch_us(n.ts) - epoch_us(a.ts)) <= 86400000000"))
def and_not(spark, sf_dir):
    return _find(spark, sf_dir, And(_e("signup", "a"), Not(_e("error", "n"))), DAY, "a")


@query("SELECT a.event_id AS a_id FROM events a WHERE a.event_type = 'signup' AND " + _NO.format("n.ts >= a.ts AND n.ts <= a.ts + INTERVAL 24 HOUR AND n.value > a.value"))
def not_conditional(spark, sf_dir):
    return _find(spark, sf_dir, Seq(_e("signup", "a"), Not(_e("error", "n"), condition=lambda v: v("n", "value") > v("a", "value"))), DAY, "a")


@query("""SELECT a.event_id AS a_id FROM events a WHERE a.event_type = 'signup' AND NOT EXISTS (
SELECT 1 FROM events n JOIN events b ON n.user_id = b.user_id WHERE n.user_id = a.user_id AND n.event_type = 'error' AND b.event_type = 'click'
AND n.ts >= a.ts AND b.ts >= n.ts AND b.ts <= a.ts + INTERVAL 24 HOUR
AND NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = a.user_id AND x.event_type = 'view' AND x.ts >= b.ts AND x.ts <= n.ts + INTERVAL 24 HOUR))""")
def nested_not(spark, sf_dir):
    return _find(spark, sf_dir, Seq(_e("signup", "a"), Not(Seq(_e("error", "n"), _e("click", "b"), Not(_e("view", "x"))))), DAY, "a")


@query("""SELECT CASE WHEN a.event_type = 'view' THEN a.event_id END AS a_id, CASE WHEN a.event_type = 'click' THEN a.event_id END AS b_id, c.event_id AS c_id
FROM events a JOIN events c ON a.user_id = c.user_id WHERE a.event_type IN ('view', 'click') AND c.event_type = 'purchase' AND c.ts >= a.ts AND c.ts <= a.ts + INTERVAL 24 HOUR
AND """ + _NO.format("n.ts >= a.ts AND n.ts <= c.ts"))
def not_beside_or(spark, sf_dir):
    return _find(spark, sf_dir, Seq(Or(_e("view", "a"), _e("click", "b")), Not(_e("error", "n")), _e("purchase", "c")), DAY, "a", "b", "c")


@query(_PAIR.format(cols="a.event_id AS a_id, b.event_id AS b_id, NULL::BIGINT AS c_id", keys="a.user_id = b.user_id", on="AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 24 HOUR AND b.value > a.value", x="view", y="purchase") + " UNION ALL SELECT NULL, NULL, event_id FROM events WHERE event_type = 'signup'")
def or_condition(spark, sf_dir):
    """A condition on events of one alternative keeps the matches of the other."""
    structure = Or(Seq(_e("view", "a"), _e("purchase", "b")), _e("signup", "c"))
    return _find(spark, sf_dir, structure, DAY, "a", "b", "c", condition=lambda v: v("b", "value") > v("a", "value"))


@query("""WITH p AS (SELECT a.user_id, a.event_id AS x, b.event_id AS y, a.ts AS lo, b.ts AS hi FROM events a JOIN events b ON a.user_id = b.user_id
WHERE a.event_type = 'view' AND b.event_type = 'click' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 24 HOUR)
SELECT x || ',' || y || ',' || c.event_id AS ids FROM p JOIN events c ON c.user_id = p.user_id AND c.event_type = 'purchase' AND c.ts >= p.hi AND c.ts <= p.lo + INTERVAL 24 HOUR
WHERE NOT EXISTS (SELECT 1 FROM events n WHERE n.user_id = p.user_id AND n.event_type = 'error' AND n.ts >= p.hi AND n.ts <= c.ts)""")
def not_beside_repeat(spark, sf_dir):
    structure = Seq(Repeat(Seq(_e("view", "a"), _e("click", "b")), "k", 1, 1), Not(_e("error", "n")), _e("purchase", "c"))
    return _find(spark, sf_dir, structure, DAY).select(_ids().alias("ids"))


# probability


@query("""SELECT a.event_id AS a_id, b.event_id AS b_id, round(a.value * b.value / 10000, 6) AS prob FROM events a JOIN events b ON a.user_id = b.user_id
WHERE a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 24 HOUR AND a.value <= 100 AND b.value <= 100 AND (a.value / 100) * (b.value / 100) >= 0.25""")
def prob_join_confidence(spark, sf_dir):
    rows = _events(spark, sf_dir).filter("value <= 100").withColumn("probability", F.col("value") / 100)
    pattern = Pattern(Seq(_e("view", "a"), _e("purchase", "b")), Window(DAY), None, USER, confidence=0.25)
    return match(rows, pattern).select(_id("a"), _id("b"), F.round(F.col("a.value") * F.col("b.value") / 10000, 6).alias("prob"))


@query("""WITH f AS (SELECT a.event_id, product(1 - n.value / 100) AS doubt FROM events a JOIN events n ON n.user_id = a.user_id AND n.event_type = 'error' AND n.value <= 100 AND n.ts >= a.ts AND n.ts <= a.ts + INTERVAL 24 HOUR WHERE a.event_type = 'signup' GROUP BY a.event_id)
SELECT a.event_id AS a_id, round(a.value / 100 * coalesce(doubt, 1), 6) AS prob FROM events a LEFT JOIN f USING (event_id) WHERE a.event_type = 'signup' AND a.value <= 100 AND a.value / 100 * coalesce(doubt, 1) >= 0.2""")
def prob_negation(spark, sf_dir):
    rows = _events(spark, sf_dir).filter("value <= 100").withColumn("probability", F.col("value") / 100)
    pattern = Pattern(Seq(_e("signup", "a"), Not(_e("error", "n"))), Window(DAY), None, USER, confidence=0.2)
    return match(rows, pattern).select(_id("a"), F.round("prob", 6).alias("prob"))


# repetition: chains as WITH RECURSIVE


_CHAIN = """WITH RECURSIVE r(user_id, first_us, last_id, last_value, n, ids) AS (
SELECT user_id, epoch_us(ts), event_id, value, 1, CAST(event_id AS VARCHAR) FROM events WHERE event_type = 'click' {where0}
UNION ALL SELECT r.user_id, r.first_us, e.event_id, e.value, r.n + 1, r.ids || ',' || CAST(e.event_id AS VARCHAR) FROM r JOIN events e ON e.user_id = r.user_id
AND e.event_type = 'click' AND e.event_id > r.last_id AND epoch_us(e.ts) - r.first_us <= {size} AND r.n < {most} {where})
SELECT ids FROM r WHERE n >= {least}"""


@query(_CHAIN.format(where0="", where="", size=DAY, most=3, least=2))
def kleene_bounded_2_3(spark, sf_dir):
    return _find(spark, sf_dir, Repeat(_e("click", "k"), "k", 2, 3), DAY).select(_ids().alias("ids"))


@query(_CHAIN.format(where0="AND value > 50", where="AND e.value > 50", size=2 * DAY, most=3, least=2))
def kleene_forall_value(spark, sf_dir):
    found = _find(spark, sf_dir, Repeat(_e("click", "k"), "k", 2, 3), 2 * DAY)
    return found.filter(conditions.by_value(F.col("k"), lambda x, v: x.value > v, F.lit(50))).select(_ids().alias("ids"))


@query(_CHAIN.format(where0="", where="AND e.value > r.last_value", size=2 * DAY, most=3, least=2))
def kleene_offset_increasing(spark, sf_dir):
    found = _find(spark, sf_dir, Repeat(_e("click", "k"), "k", 2, 3), 2 * DAY)
    return found.filter(conditions.by_offset(F.col("k"), 1, lambda x, y: x.value < y.value)).select(_ids().alias("ids"))


@query("""WITH RECURSIVE r(user_id, first_us, a_id, last_id, ids) AS (
SELECT user_id, epoch_us(ts), event_id, event_id, CAST(event_id AS VARCHAR) FROM events WHERE event_type = 'view'
UNION ALL SELECT r.user_id, r.first_us, r.a_id, e.event_id, r.ids || ',' || CAST(e.event_id AS VARCHAR) FROM r JOIN events e ON e.user_id = r.user_id
AND e.event_type = 'click' AND e.event_id > r.last_id AND epoch_us(e.ts) - r.first_us <= 86400000000)
SELECT r.ids || ',' || CAST(c.event_id AS VARCHAR) AS ids FROM r JOIN events c ON c.user_id = r.user_id AND c.event_type = 'purchase'
AND c.event_id > r.last_id AND epoch_us(c.ts) - r.first_us <= 86400000000 WHERE r.last_id > r.a_id""")
def kleene_plus_between(spark, sf_dir):
    return _find(spark, sf_dir, Seq(_e("view", "a"), Repeat(_e("click", "k"), "k"), _e("purchase", "c")), DAY, order="position").select(_ids().alias("ids"))


@query("""WITH p AS (SELECT a.user_id, a.event_id AS x, b.event_id AS y, epoch_us(a.ts) AS lo, epoch_us(b.ts) AS hi FROM events a JOIN events b ON a.user_id = b.user_id
WHERE a.event_type = 'view' AND b.event_type = 'click' AND b.event_id > a.event_id AND epoch_us(b.ts) - epoch_us(a.ts) <= 86400000000)
SELECT p.x || ',' || p.y || ',' || q.x || ',' || q.y AS ids FROM p JOIN p q ON q.user_id = p.user_id AND q.x > p.y AND q.hi - p.lo <= 86400000000""")
def kleene_nested_seq(spark, sf_dir):
    return _find(spark, sf_dir, Repeat(Seq(_e("view", "a"), _e("click", "b")), "k", 2, 2), DAY, order="position").select(_ids().alias("ids"))


@query("""WITH RECURSIVE r(user_id, first_us, last_id, ids) AS (
SELECT user_id, epoch_us(ts), event_id, CAST(event_id AS VARCHAR) FROM events WHERE event_type = 'view'
UNION ALL SELECT r.user_id, r.first_us, e.event_id, r.ids || ',' || CAST(e.event_id AS VARCHAR) FROM r JOIN events e ON e.user_id = r.user_id
AND e.event_type = 'click' AND e.event_id > r.last_id AND epoch_us(e.ts) - r.first_us <= 86400000000)
SELECT r.ids || ',' || CAST(c.event_id AS VARCHAR) AS ids FROM r JOIN events c ON c.user_id = r.user_id AND c.event_type = 'purchase'
AND c.event_id > r.last_id AND epoch_us(c.ts) - r.first_us <= 86400000000""")
def srt_star_optional(spark, sf_dir):
    """A repetition that may be absent: the sequence with it or without it."""
    a, c = _e("view", "a"), _e("purchase", "c")
    return _find(spark, sf_dir, Or(Seq(a, c), Seq(a, Repeat(_e("click", "k"), "k"), c)), DAY, order="position").select(_ids().alias("ids"))


# contiguity and registers


@query("""WITH w AS (SELECT *, lead(event_id, 1) OVER u AS p2, lead(event_type, 1) OVER u AS t2, lead(event_id, 2) OVER u AS p3, lead(event_type, 2) OVER u AS t3 FROM events WINDOW u AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id AS pos1, p2 AS pos2, p3 AS pos3 FROM w WHERE event_type = 'view' AND t2 = 'click' AND t3 = 'purchase'""")
def srt_strict3(spark, sf_dir):
    structure = Seq(_e("view", "a"), _e("click", "b"), _e("purchase", "c"), gap="strict")
    found = _find(spark, sf_dir, structure, 1 << 52, order="position")
    return found.select(F.col("key0").alias("user_id"), *(F.col(f"{a}.pos").alias(f"pos{i}") for i, a in enumerate("abc", 1)))


@query("""SELECT a.event_id AS a_id, min(b.event_id) AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id > a.event_id
WHERE a.event_type = 'view' AND b.event_type = 'purchase' GROUP BY a.event_id HAVING min(epoch_us(b.ts)) - min(epoch_us(a.ts)) < 172800000000""")
def srt_next2(spark, sf_dir):
    """The first purchase after each view, if within two days: one pass over each user's events."""
    structure = Seq(_e("view", "a"), _e("purchase", "b"), gap="next")
    return _find(spark, sf_dir, structure, 2 * DAY, "a", "b", order="position", inclusive=False)


@query(_TRIPLE.format(cols=_ABC, x="view", y="click", z="purchase", on="b.event_id > a.event_id AND c.event_id > b.event_id AND epoch_us(c.ts) - epoch_us(a.ts) < 86400000000"))
def srt_any3(spark, sf_dir):
    return _find(spark, sf_dir, Seq(_e("view", "a"), _e("click", "b"), _e("purchase", "c"), gap="any"), DAY, "a", "b", "c", order="position", inclusive=False)


@query("""WITH x AS (SELECT a.event_id AS a_id, any_value(a.user_id) AS user_id, any_value(epoch_us(a.ts)) AS us, min(b.event_id) AS b_id FROM events a JOIN events b ON b.user_id = a.user_id AND b.event_id > a.event_id
WHERE a.event_type = 'view' AND b.event_type = 'click' GROUP BY a.event_id)
SELECT a_id, any_value(b_id) AS b_id, min(c.event_id) AS c_id FROM x JOIN events c ON c.user_id = x.user_id AND c.event_id > x.b_id WHERE c.event_type = 'purchase' GROUP BY a_id HAVING min(epoch_us(c.ts)) - any_value(us) < 259200000000""")
def srt_next3(spark, sf_dir):
    structure = Seq(_e("view", "a"), _e("click", "b"), _e("purchase", "c"), gap="next")
    return _find(spark, sf_dir, structure, 3 * DAY, "a", "b", "c", order="position", inclusive=False)


@query(_TRIPLE.format(cols=_ABC, x="view", y="view", z="view", on="b.event_id > a.event_id AND c.event_id > b.event_id AND b.value > a.value AND c.value > b.value AND epoch_us(c.ts) - epoch_us(a.ts) < 86400000000"))
def srt_register_chain(spark, sf_dir):
    rising = lambda v: (v("b", "value") > v("a", "value")) & (v("c", "value") > v("b", "value"))
    return _find(spark, sf_dir, Seq(_e("view", "a"), _e("view", "b"), _e("view", "c")), DAY, "a", "b", "c", order="position", inclusive=False, condition=rising)


@query("""SELECT DISTINCT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id
WHERE a.event_type IN ('view', 'click') AND b.event_type <> 'error' AND b.value > 80 AND b.event_id > a.event_id AND epoch_us(b.ts) - epoch_us(a.ts) < 43200000000""")
def srt_choice_guard_not(spark, sf_dir):
    kinds = ("click", "purchase", "signup", "view", "error")
    structure = Seq(Or(_e("view", "a"), _e("click", "a")), Event(kinds, "b", lambda c: ~(c("etype") == "error") & (c("value") > 80)))
    return _find(spark, sf_dir, structure, 12 * HOUR, "a", "b", order="position", inclusive=False).distinct()


# selection and consumption


_RUNS = """m AS (SELECT a.user_id, a.event_id AS s, b.event_id AS k, c.event_id AS e FROM events a JOIN events b ON a.user_id = b.user_id JOIN events c ON c.user_id = b.user_id
WHERE a.event_type = 'view' AND b.event_type = 'click' AND c.event_type = 'purchase' AND b.event_id > a.event_id AND c.event_id > b.event_id AND epoch_us(c.ts) - epoch_us(a.ts) < 259200000000)"""
_OUT = "CAST(s AS VARCHAR) || ',' || CAST(k AS VARCHAR) || ',' || CAST(e AS VARCHAR) AS ids"


def _runs(spark, sf_dir) -> DataFrame:
    found = _find(spark, sf_dir, Seq(_e("view", "a"), _e("click", "b"), _e("purchase", "c")), 3 * DAY, order="position", inclusive=False)
    return found.select(F.col("key0").alias("user_id"), "lo_pos", "hi_pos", "ids")


@query(f"WITH {_RUNS} SELECT {_OUT} FROM m")
def select_all(spark, sf_dir):
    return _runs(spark, sf_dir).select(_ids().alias("ids"))


@query(f"WITH {_RUNS}, q AS (SELECT *, row_number() OVER (PARTITION BY user_id, s, e ORDER BY k) AS n FROM m) SELECT {_OUT} FROM q WHERE n = 1")
def select_next(spark, sf_dir):
    return selection.select_next(_runs(spark, sf_dir), ["user_id"]).select(_ids().alias("ids"))


@query(f"WITH {_RUNS}, q AS (SELECT *, row_number() OVER (PARTITION BY user_id, s, e ORDER BY k DESC) AS n FROM m) SELECT {_OUT} FROM q WHERE n = 1")
def select_last(spark, sf_dir):
    return selection.select_last(_runs(spark, sf_dir), ["user_id"]).select(_ids().alias("ids"))


@query("""WITH RECURSIVE r(user_id, first_us, a_id, last_id, k) AS (
SELECT user_id, epoch_us(ts), event_id, event_id, 0 FROM events WHERE event_type = 'view'
UNION ALL SELECT r.user_id, r.first_us, r.a_id, e.event_id, r.k + 1 FROM r JOIN events e ON e.user_id = r.user_id
AND e.event_type = 'click' AND e.event_id > r.last_id AND epoch_us(e.ts) - r.first_us <= 86400000000)
SELECT r.a_id, c.event_id AS c_id, max(r.k) AS clicks FROM r JOIN events c ON c.user_id = r.user_id AND c.event_type = 'purchase'
AND c.event_id > r.last_id AND epoch_us(c.ts) - r.first_us <= 86400000000 WHERE r.k > 0 GROUP BY r.a_id, c.event_id""")
def select_max(spark, sf_dir):
    """The longest repetition between two events holds all events that fit between them, so these are counted."""
    found = _find(spark, sf_dir, Seq(_e("view", "a"), _e("click", "k"), _e("purchase", "c")), DAY, order="position")
    return found.groupBy(_id("a"), _id("c")).agg(F.count("*").alias("clicks"))


@query(f"WITH {_RUNS} SELECT DISTINCT k AS b_id, e AS c_id FROM m")
def projection_distinct(spark, sf_dir):
    return _runs(spark, sf_dir).select(F.get("ids", F.lit(1)).alias("b_id"), F.get("ids", F.lit(2)).alias("c_id")).distinct()


@query(f"WITH {_RUNS} SELECT DISTINCT user_id, e AS trigger_id FROM m")
def detect_only(spark, sf_dir):
    return selection.triggers(_runs(spark, sf_dir), ["user_id"])


@query(f"WITH {_RUNS}, q AS (SELECT *, row_number() OVER (PARTITION BY user_id, e ORDER BY s, k) AS n FROM m) SELECT {_OUT} FROM q WHERE n <= 2")
def limit_per_trigger(spark, sf_dir):
    return selection.limit_per_trigger(_runs(spark, sf_dir), 2, ["user_id"]).select(_ids().alias("ids"))


@query(f"""WITH RECURSIVE {_RUNS}, ends AS (SELECT DISTINCT user_id, e FROM m), nx AS (SELECT x.user_id, x.e, min(m.e) AS nxt FROM ends x JOIN m ON m.user_id = x.user_id AND m.s > x.e GROUP BY x.user_id, x.e),
t(user_id, e) AS (SELECT user_id, min(e) FROM m GROUP BY user_id UNION ALL SELECT t.user_id, nx.nxt FROM t JOIN nx ON nx.user_id = t.user_id AND nx.e = t.e),
f AS (SELECT user_id, e, lag(e) OVER (PARTITION BY user_id ORDER BY e) AS p FROM t)
SELECT {_OUT.replace('s AS', 'm.s AS').replace('(e AS', '(m.e AS')} FROM m JOIN f ON f.user_id = m.user_id AND f.e = m.e AND (f.p IS NULL OR m.s > f.p)""")
def consume_partition(spark, sf_dir):
    return selection.consume(_runs(spark, sf_dir), ["user_id"]).select(_ids().alias("ids"))


@query(f"""WITH RECURSIVE {_RUNS}, nx AS (SELECT x.e, min(m.e) AS nxt FROM (SELECT DISTINCT e FROM m) x JOIN m ON m.s > x.e GROUP BY x.e),
t(e) AS (SELECT min(e) FROM m UNION ALL SELECT nx.nxt FROM t JOIN nx ON nx.e = t.e), f AS (SELECT e, lag(e) OVER (ORDER BY e) AS p FROM t)
SELECT {_OUT.replace('s AS', 'm.s AS').replace('(e AS', '(m.e AS')} FROM m JOIN f ON f.e = m.e AND (f.p IS NULL OR m.s > f.p)""")
def consume_any(spark, sf_dir):
    """Each completing event clears the partial matches of all users."""
    return selection.consume(_runs(spark, sf_dir), []).select(_ids().alias("ids"))


SQL["srt_consume"] = SQL["consume_any"]


@query(SQL["srt_consume"])
def srt_consume(spark, sf_dir):
    """The same for sequences of single events by any gap: a match clears every run of every partition."""
    structure = Seq(_e("view", "a"), _e("click", "b"), _e("purchase", "c"), gap="any")
    found = _find(spark, sf_dir, structure, 3 * DAY, order="position", inclusive=False)
    return selection.consume(found.select("lo_pos", "hi_pos", "ids"), []).select(_ids().alias("ids"))


@query(_CHAIN.format(where0="", where="", size=DAY, most=2, least=2))
def srt_stop_after_final(spark, sf_dir):
    """Chains of two clicks are complete, so none of three is reported."""
    found = _find(spark, sf_dir, Repeat(_e("click", "k"), "k", 2, 3), DAY).select("key0", "lo_pos", "ids")
    return selection.first_final(found, ["key0"]).select(_ids().alias("ids"))


@query("SELECT event_id AS pos, event_type AS etype FROM events WHERE event_id < 500")
def input_limit(spark, sf_dir):
    return selection.limit_input(_events(spark, sf_dir), 500).select("pos", "etype")


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN user_id ELSE event_id END AS key FROM events WHERE event_type IN ('view', 'click')")
def covering_key(spark, sf_dir):
    """A partition key from a list of attributes, of which each event type has another."""
    keyed = routing.covering_key(_events(spark, sf_dir), ["user_id", "event_id"], {"view": ["user_id", "value"], "click": ["event_id"]})
    return keyed.select("event_id", F.col("key").cast("long").alias("key"))


@query("""WITH f AS (SELECT user_id, min(event_id) AS s FROM events GROUP BY user_id)
SELECT a.event_id AS a_id, b.event_id AS b_id, c.event_id AS c_id FROM f JOIN events a ON a.event_id = f.s JOIN events b ON b.user_id = a.user_id JOIN events c ON c.user_id = a.user_id
WHERE a.event_type = 'view' AND b.event_type = 'click' AND c.event_type = 'purchase' AND b.event_id > a.event_id AND c.event_id > b.event_id""")
def unwindowed_partition(spark, sf_dir):
    """Without a window a match can only begin at the first event of its partition."""
    rows = _events(spark, sf_dir).withColumn("first_pos", F.min("pos").over(W.partitionBy("user_id")))
    structure = Seq(Event("view", "a", lambda c: c("pos") == c("first_pos")), _e("click", "b"), _e("purchase", "c"))
    return match(rows, Pattern(structure, Window(1 << 52, "events"), None, USER, "position")).select(_id("a"), _id("b"), _id("c"))


@query()
def match_single(spark, sf_dir):
    return selection.single_use(_runs(spark, sf_dir), ["user_id"]).select(_ids().alias("ids"))


# several patterns, statistics, routing


@query("""WITH u AS (SELECT a.event_id AS a_id, b.event_id AS b_id, 1 AS p FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 12 HOUR
UNION ALL SELECT a.event_id, b.event_id, 2 FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 24 HOUR AND b.value > a.value)
SELECT a_id, b_id, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS patterns FROM u GROUP BY a_id, b_id""")
def multi_pattern_ids(spark, sf_dir):
    both = Seq(_e("view", "a"), _e("purchase", "b"))
    one = _find(spark, sf_dir, both, 12 * HOUR, "a", "b").withColumn("p", F.lit("1"))
    two = _find(spark, sf_dir, both, DAY, "a", "b", condition=lambda v: v("b", "value") > v("a", "value")).withColumn("p", F.lit("2"))
    return one.union(two).groupBy("a_id", "b_id").agg(F.array_join(F.sort_array(F.collect_set("p")), ",").alias("patterns"))


@query("SELECT event_type AS etype, count(*) AS n FROM events GROUP BY event_type")
def stats_occurrences(spark, sf_dir):
    return statistics.occurrences(_events(spark, sf_dir))


@query("SELECT event_type AS etype, round(count(*) * 1000000.0 / (SELECT max(epoch_us(ts)) - min(epoch_us(ts)) FROM events), 9) AS per_second FROM events GROUP BY event_type")
def stats_rates(spark, sf_dir):
    return statistics.rates(_events(spark, sf_dir)).select("etype", F.round("per_second", 9).alias("per_second"))


@query("""SELECT event_id AS pos, event_type AS etype, count(*) OVER (PARTITION BY event_type, user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS arrivals FROM events""")
def stats_sliding_arrivals(spark, sf_dir):
    return statistics.sliding_arrivals(_events(spark, sf_dir), DAY, ["user_id"])


@query("""SELECT count(*) AS pairs, round(coalesce(avg(CASE WHEN r.value > l.value THEN 1.0 ELSE 0.0 END), 1.0), 9) AS selectivity FROM events l JOIN events r ON l.user_id = r.user_id AND l.ts <= r.ts WHERE l.event_type = 'view' AND r.event_type = 'purchase'""")
def stats_pair_selectivity(spark, sf_dir):
    found = statistics.pair_selectivity(_events(spark, sf_dir), "view", "purchase", ["user_id"], F.col("r.value") > F.col("l.value"))
    return found.select("pairs", F.round("selectivity", 9).alias("selectivity"))


@query("SELECT event_id, user_id % 7 AS unit FROM events WHERE user_id IS NOT NULL")
def route_by_key(spark, sf_dir):
    return routing.by_key(_events(spark, sf_dir), "user_id", 7).select("event_id", F.col("unit").cast("long").alias("unit"))


@query(SQL["seq2_incl_window"])
def route_time_slices(spark, sf_dir):
    """The pattern on slices of 12 windows: equal to the unsliced one, as a match belongs to its first event's slice."""
    dealt = routing.by_time_slice(_events(spark, sf_dir), DAY, 12, F.col("us"))
    pattern = Pattern(Seq(_e("view", "a"), _e("purchase", "b")), Window(DAY), None, ("user_id", "unit"))
    return match(dealt, pattern).filter("a.owner = a.unit").select(_id("a"), _id("b"))


@query(SQL["and2_window"])
def route_hypercube(spark, sf_dir):
    """The pattern on a grid of click by error cells; every pair of events shares exactly one cell."""
    dealt = routing.by_hypercube(_events(spark, sf_dir), {"click": "event_id", "error": "event_id"}, {"click": 3, "error": 2})
    dealt = dealt.withColumn("cell", F.array_join(F.col("unit").cast("array<string>"), ":"))
    pattern = Pattern(And(_e("click", "a"), _e("error", "b")), Window(12 * HOUR), None, ("user_id", "cell"))
    return match(dealt, pattern).select(_id("a"), _id("b"))


# sources: events written as text and read again


def _text(lines: DataFrame) -> str:
    folder = f"{shared_folder(lines.sparkSession)}/eventloom/lines-{uuid.uuid4().hex}"
    lines.write.text(folder)
    return folder


_ATTRIBUTES = {k: {"user": "long", "value": "double", "note": "string"} for k in ("click", "purchase", "signup", "view", "error")}
_READ = """SELECT event_id AS pos, event_type AS etype, {ts} AS ts, user_id AS "user", value, {note} AS note FROM events"""
_NOTE = 'a, value=9) "b"'


@query(_READ.format(ts="epoch_us(ts) // 1000", note=f"'{_NOTE}'"))
def source_native(spark, sf_dir):
    """Lines EVENT(attribute=value, ...) with a time, and keys and quotes inside a quoted value."""
    note = F.lit('note="' + _NOTE.replace('"', '""') + '"')
    line = F.concat("etype", F.lit("("), F.concat_ws(", ", F.concat(F.lit("__ts="), F.floor(F.col("us") / 1000)), F.concat(F.lit("user="), "user_id"), note, F.concat(F.lit("value="), "value")), F.lit(")"))
    return text.read_native(spark, _text(_events(spark, sf_dir).orderBy("pos").select(line.alias("value"))), _ATTRIBUTES)


@query(_READ.format(ts="epoch_us(date_trunc('second', ts)) // 1000", note="'x;y'"))
def source_header_csv(spark, sf_dir):
    """A header and rows cut at semicolons, with dates as times."""
    row = F.concat_ws(";", "etype", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit('"x;y"'), F.col("value").cast("string"), F.col("user_id").cast("string"))
    rows = _events(spark, sf_dir).select("pos", row.alias("value"))
    head = spark.createDataFrame([(-1, "\ufeffEvent;time;note;value;user")], "pos long, value string")
    return text.read_header_csv(spark, _text(head.unionByName(rows).orderBy("pos").coalesce(1).select("value")), _ATTRIBUTES)


@query("SELECT event_id AS pos, CASE WHEN event_type = 'view' THEN 'BUY' ELSE 'SELL' END AS etype, event_id AS id, event_type || ', price=9' AS name, user_id AS volume, value AS price, epoch_us(ts) AS ts FROM events")
def source_keyed_quoted(spark, sf_dir):
    """Keyed lines whose names hold a comma and a key."""
    kind = F.when(F.col("etype") == "view", "BUY").otherwise("SELL")
    named = F.concat(F.lit('name="'), "etype", F.lit(', price=9"'))
    line = F.concat(kind, F.lit("("), F.concat_ws(", ", named, *(F.concat(F.lit(f"{k}="), c) for k, c in (("id", "event_id"), ("volume", "user_id"), ("price", "value"), ("timestamp", "us")))), F.lit(")"))
    lines = _events(spark, sf_dir).orderBy("pos").select(F.explode(F.array(line, F.lit("// a comment"), F.lit(" "))).alias("value"))
    return text.read_keyed(spark, _text(lines), "stock").drop("timestamp")


@query("""WITH u AS (SELECT 0 AS source, event_id, ts FROM events WHERE event_type IN ('view', 'click') UNION ALL SELECT 1, event_id, ts FROM events WHERE event_type NOT IN ('view', 'click'))
SELECT event_id, source, row_number() OVER (ORDER BY ts, source, event_id) - 1 AS seq FROM u""")
def source_merge(spark, sf_dir):
    """Two streams in one order of time, numbered from 0."""
    rows = _events(spark, sf_dir)
    view = F.col("etype").isin("view", "click")
    return text.merge([rows.filter(view), rows.filter(~view)]).select("event_id", "source", "seq")


@query("""WITH u AS (SELECT 0 AS source, event_id, ts FROM events WHERE event_type IN ('view', 'click') UNION ALL SELECT 1, event_id, ts FROM events WHERE event_type NOT IN ('view', 'click'))
SELECT event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, source, event_id) - 1 AS seq FROM u""")
def merge_streams_order(spark, sf_dir):
    """Two streams merged by time, source and place, numbered within each day."""
    rows = _events(spark, sf_dir)
    view = F.col("etype").isin("view", "click")
    both = rows.filter(view).withColumn("source", F.lit(0)).unionByName(rows.filter(~view).withColumn("source", F.lit(1)))
    by = W.partitionBy(F.to_date("ts")).orderBy("ts", "source", "event_id")
    return both.select("event_id", (F.row_number().over(by) - 1).cast("long").alias("seq"))
