"""Sequences over unbounded input, with state that the watermark bounds."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """Events from JSON lines ``{id, type, timestamp, attributes}`` in files that arrive in a folder: event_id, event_type, ts, attributes."""
    parsed = F.from_json("value", "id long, type string, timestamp long, attributes map<string,string>", {"mode": "FAILFAST"})
    rows = spark.readStream.text(folder).select(parsed.alias("e"))
    return rows.select(F.col("e.id").alias("event_id"), F.col("e.type").alias("event_type"), F.timestamp_millis("e.timestamp").alias("ts"), F.col("e.attributes").alias("attributes"))


def _part(events: DataFrame, fits: Column, late: str, key: str, place: int) -> DataFrame:
    own = events.filter(fits).withWatermark("ts", late)
    return own.select(F.col(key).alias(f"key{place}"), F.col("ts").alias(f"ts{place}"), F.col("event_id").alias(f"id{place}"))


def follow_all(events: DataFrame, parts: Sequence[Column], window: str, key: str = "user_id", late: str = "0 seconds") -> DataFrame:
    """Events of one key, one for each part, in this order and all at most ``window`` after the first: joins of streams.

    Every side keeps rows until the watermark leaves the window behind. Late rows are dropped by the engine. Returns id0, id1 and so on.
    """
    out = _part(events, parts[0], late, key, 0).withColumn("us0", F.unix_micros("ts0"))
    for i, fits in enumerate(parts[1:], 1):
        inside = (F.col(f"ts{i}") >= F.col("ts0")) & (F.col(f"ts{i}") <= F.col("ts0") + F.expr(f"INTERVAL {window}"))
        own = _part(events, fits, late, key, i).withColumn(f"us{i}", F.unix_micros(f"ts{i}"))
        # rows keep one time with a watermark, the first; the others are plain numbers
        out = out.join(own, (F.col("key0") == F.col(f"key{i}")) & inside & (F.col(f"us{i}") >= F.col(f"us{i - 1}"))).drop(f"ts{i}")
    return out.select(*(f"id{i}" for i in range(len(parts))))


def follow(events: DataFrame, first: Column, then: Column, window: str, key: str = "user_id", late: str = "0 seconds") -> DataFrame:
    """Pairs of events of one key where ``then`` comes at most ``window`` after ``first``."""
    return follow_all(events, [first, then], window, key, late).toDF("a_id", "b_id")


def never_followed(events: DataFrame, first: Column, then: Column, window: str, key: str = "user_id", late: str = "0 seconds") -> DataFrame:
    """``first`` events that no ``then`` follows within ``window``; each is given out once the watermark has passed its window.

    At the end of a bounded input, rows whose window reaches past the last event stay pending.
    """
    a, b = _part(events, first, late, key, 0), _part(events, then, late, key, 1)
    on = (F.col("key0") == F.col("key1")) & (F.col("ts1") >= F.col("ts0")) & (F.col("ts1") <= F.col("ts0") + F.expr(f"INTERVAL {window}"))
    return a.join(b, on, "left_outer").filter("key1 is null").select(F.col("id0").alias("a_id"))


def listen(matches: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Start a query that gives each batch of matches, with its number, to ``callback``; a repeated batch has the same number."""
    return matches.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint).start()
