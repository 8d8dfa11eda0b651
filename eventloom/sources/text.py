"""Event files in the layouts that users of pattern engines keep, read with explicit schemas.

All readers return (pos, etype, ts, payload columns); pos counts the lines that are kept, from 0, in the order of
files and of lines in them.
"""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.scratch import write_out

#: Columns of the bar layout; the last is optional.
BARS = ["ticker", "date", "open", "high", "low", "close", "volume", "probability"]
#: The three sensor layouts after the sensor's type and time stamp.
SENSORS = {
    "PressTemp": ["Amplitude", "Pressure", "Temperature"],
    "Accelerometer": ["Amplitude", "AccX", "AccY", "AccZ"],
    "Magnetometer": ["Amplitude", "MagX", "MagY", "MagZ"],
}
#: Event types of the keyed text lines, and of each field its kind and the names it may have; the field that holds the time.
KEYED = {
    "stock": (("BUY", "SELL"), {"id": ("long", "id"), "name": ("string", "name"), "volume": ("long", "volume"), "price": ("double", "price"), "timestamp": ("long", "timestamp")}, "timestamp"),
    "home": (("LOAD",), {"id": ("long", "id"), "plug_timestamp": ("long", "plug_timestamp", "timestamp"), "value": ("double", "value"), "household_id": ("long", "household_id", "householdId")}, "plug_timestamp"),
    "taxi": (("TRIP",), {"id": ("long", "id"), "dropoff_datetime": ("long", "dropoff_datetime", "timestamp"), "pickup_zone": ("string", "pickup_zone", "pickupZone"), "dropoff_zone": ("string", "dropoff_zone", "dropoffZone"), "total_amount": ("double", "total_amount", "totalAmount")}, "dropoff_datetime"),
}
#: Names that the time of a line may have, the first one present counts.
TIMES = ("__ts", "timestamp", "time")


def _lines(spark: SparkSession, path: str, comments: bool = True) -> DataFrame:
    """(value, pos) of lines that are neither blank nor comments.

    A line's place in its split is told by an id that grows by one in a partition; the splits, a row each, are added up in
    the order of files and offsets.
    """
    text = spark.read.text(path)
    kept = F.trim("value") != ""
    if comments:
        kept = kept & ~F.trim("value").startswith("//")
    lines = text.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")).filter(kept)
    lines = lines.withColumn("_id", F.monotonically_increasing_id())
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("_file", "_start").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_n"))
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return lines.join(splits, ["_file", "_start"]).select("value", (F.col("_id") - F.col("_least") + F.col("_before")).alias("pos"))


_QUOTED = r'"(?:[^"]|"")*+"'


def unquoted(text: Column) -> Column:
    """A field without the quotes around it; doubled quotes inside are one."""
    inner = lambda q: F.replace(F.substring(text, F.lit(2), F.length(text) - 2), F.lit(q + q), F.lit(q))
    return F.when(text.startswith('"'), inner('"')).when(text.startswith("'"), inner("'")).otherwise(F.trim(text))


def split_fields(line: Column, delimiter: str = ",") -> Column:
    """Fields of a line as an array, cut at the delimiter outside of double quotes; null where quotes don't match."""
    led = F.concat(F.lit(delimiter), line)
    field = rf'{delimiter}\s*({_QUOTED}\s*|[^{delimiter}"]*)'
    fits = led.rlike(rf'^(?:{delimiter}\s*(?:{_QUOTED}\s*|[^{delimiter}"]*))*+$')
    return F.when(fits, F.transform(F.regexp_extract_all(led, F.lit(field), F.lit(1)), lambda f: unquoted(F.trim(f))))


def keyed_fields(line: Column) -> Column:
    """Map of the fields of ``TYPE(key=value, ...)``, values quoted or not; null where the line is none. A repeated key is an error."""
    value = rf"""({_QUOTED}|'(?:[^']|'')*+'|[^,"']*)"""
    body = F.regexp_extract(line, r"^[^(]*\((.*)\)\s*$", 1)
    led = F.concat(F.lit(","), body)
    pair = rf",\s*([^=,\s\"']+)\s*=\s*{value}\s*"
    fits = line.rlike(r"^\s*\w+\s*\(.*\)\s*$") & ((F.trim(body) == "") | led.rlike(rf"^(?:{pair})++$"))
    keys, values = (F.regexp_extract_all(led, F.lit(pair), F.lit(i)) for i in (1, 2))
    return F.when(fits, F.map_from_arrays(keys, F.transform(values, lambda v: unquoted(F.trim(v)))))


def converted(text: Column, kind: str, name: str) -> Column:
    """The text as int, long, double (finite), boolean or string; anything else is an error."""
    if kind == "string":
        return text
    own = F.trim(text)
    found = F.when(F.lower(own).isin("true", "false"), F.lower(own) == "true") if kind == "boolean" else own.try_cast({"int": "int", "long": "bigint", "double": "double"}[kind])
    good = found.isNotNull() if kind != "double" else found.isNotNull() & ~F.isnan(found) & (F.abs(found) != float("inf"))
    return F.when(text.isNull(), F.lit(None)).when(good, found).otherwise(F.raise_error(F.concat(F.lit(f"{name} is no {kind}: "), text)))


def time_of(text: Column) -> Column:
    """Milliseconds: a whole number, or ``yyyy-MM-dd HH:mm:ss`` in UTC; anything else is an error."""
    own = F.trim(text)
    strict = own.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$")
    date = F.when(strict, F.unix_millis(F.try_to_timestamp(F.concat(own, F.lit(" +0000")), F.lit("yyyy-MM-dd HH:mm:ss Z"))))
    found = F.coalesce(own.try_cast("bigint"), date)
    return F.when(text.isNull(), F.lit(None)).when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("no time: "), text)))


def _checked(rows: DataFrame, good: Column, what: str) -> DataFrame:
    """The rows; an error for one that isn't good. Rows whose line is null pass, whatever the order of filters."""
    return rows.filter(F.when(good | F.col("value").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), "value")).cast("boolean")))


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars of 7 or 8 comma-separated values; the type is the ticker. Another number of values is an error."""
    cells = F.split("value", ",")
    rows = _checked(_lines(spark, path), F.size(cells).isin(7, 8), "a bar has 7 or 8 values")
    value = lambda i: F.trim(F.get(cells, F.lit(i)))
    numbers = [value(i).cast("long" if BARS[i] == "volume" else "double").alias(BARS[i]) for i in range(2, 8)]
    return rows.select("pos", value(0).alias("etype"), F.to_timestamp(value(1), "yyyyMMddHHmm").alias("ts"), *numbers)


def read_sensors(spark: SparkSession, path: str) -> DataFrame:
    """Sensor rows; the first value picks the layout and is the type, the second is ``MM/dd/yyyy HH:mm:ss``."""
    cells = F.split("value", ",")
    kind = F.trim(F.get(cells, F.lit(0)))
    names = sorted({n for own in SENSORS.values() for n in own})
    fits = F.coalesce(*[F.when(kind == k, F.size(cells) == len(own) + 2) for k, own in SENSORS.items()], F.lit(False))
    rows = _checked(_lines(spark, path), fits, "not a sensor row")
    of = lambda n: F.coalesce(*[F.when(kind == k, F.get(cells, F.lit(own.index(n) + 2)).cast("double")) for k, own in SENSORS.items() if n in own])
    return rows.select("pos", kind.alias("etype"), F.to_timestamp(F.get(cells, F.lit(1)), "MM/dd/yyyy HH:mm:ss").alias("ts"), *(of(n).alias(n) for n in names))


def read_keyed(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """Lines ``TYPE(key=value, ...)`` of a layout in KEYED; values may be quoted, quotes double inside. Zones lose spaces and slashes."""
    types, fields, time = KEYED[layout]
    lines = _lines(spark, path).withColumn("fields", keyed_fields(F.col("value"))).withColumn("etype", F.regexp_extract("value", r"^\s*(\w+)", 1))
    rows = _checked(lines, F.col("fields").isNotNull() & F.col("etype").isin(*types), "not TYPE(key=value, ...)")

    def field(name: str, kind: str, *names: str) -> Column:
        text = F.coalesce(*(F.col("fields")[n] for n in names))
        if name.endswith("_zone"):
            text = F.regexp_replace(text, r"[\s/]", "")
        return converted(F.when(text.isNull(), F.raise_error(F.concat(F.lit(f"no {name}: "), "value"))).otherwise(text), kind, name).alias(name)

    return rows.select("pos", "etype", *(field(n, *spec) for n, spec in fields.items())).withColumn("ts", F.col(time))


def _declared(events: Mapping[str, Mapping[str, str]]) -> dict[str, str]:
    """All attributes of the declared event types with their kinds; one name has one kind."""
    out: dict[str, str] = {}
    for name, attributes in events.items():
        for attribute, kind in attributes.items():
            if out.setdefault(attribute, kind) != kind:
                raise ValueError(f"{attribute} of {name} has two kinds")
    return out


def _events(rows: DataFrame, events: Mapping[str, Mapping[str, str]], ts: Column) -> DataFrame:
    """(pos, etype, ts, attributes) of rows (pos, etype, value, fields): each type has just its declared attributes."""
    rows = _checked(rows, F.col("etype").isin(*events), "not a declared event")
    for name, attributes in events.items():
        missing = F.array_except(F.array(*map(F.lit, attributes)).cast("array<string>"), F.map_keys("fields"))
        rows = _checked(rows, (F.col("etype") != name) | (F.size(missing) == 0), f"{name} lacks an attribute")
    of = lambda a, kind: converted(F.when(F.col("etype").isin([n for n, x in events.items() if a in x]), F.col("fields")[a]), kind, a).alias(a)
    return rows.select("pos", "etype", ts.alias("ts"), *(of(a, k) for a, k in _declared(events).items()))


def read_header_csv(spark: SparkSession, path: str, events: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """A file with a header: columns event, time (or timestamp) and attributes, cut at commas or semicolons, whichever gives more.

    ``events``: of each type its attributes and their kinds (int, long, double, boolean, string).
    """
    first = spark.read.text(path).filter(F.trim("value") != "").first()
    head = first["value"].lstrip("\ufeff") if first else ""
    delimiter = ";" if head.count(";") > head.count(",") else ","
    names = [n.strip().strip('"') for n in head.split(delimiter)]
    names = ["event" if n.lower() == "event" else "timestamp" if n.lower() in ("time", "timestamp") else n for n in names]
    if "" in names or len(set(names)) < len(names) or not {"event", "timestamp"} <= set(names):
        raise ValueError(f"a header has different names, event and time: {names}")
    lines = _lines(spark, path, False).filter("pos > 0").withColumn("value", F.when(F.col("pos") > 0, F.col("value")))  # no check sees the header
    cells = lines.withColumn("cells", split_fields(F.col("value"), delimiter))
    cells = _checked(cells, F.size("cells") == len(names), f"not {len(names)} columns")
    rows = cells.withColumn("fields", F.map_from_arrays(F.array(*map(F.lit, names)), "cells")).withColumn("etype", F.trim(F.col("fields")["event"]))
    return _events(rows.withColumn("pos", F.col("pos") - 1), events, time_of(F.col("fields")["timestamp"]))


def read_native(spark: SparkSession, path: str, events: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Lines ``EVENT(attribute=value, ...)`` of declared events; the time is a field of TIMES, or else the line's position."""
    lines = _lines(spark, path).withColumn("fields", keyed_fields(F.col("value"))).withColumn("etype", F.regexp_extract("value", r"^\s*(\w+)", 1))
    rows = _checked(lines, F.col("fields").isNotNull(), "not EVENT(attribute=value, ...)")
    for name, attributes in events.items():
        known = F.array(*map(F.lit, [*attributes, *TIMES]))
        rows = _checked(rows, (F.col("etype") != name) | (F.size(F.array_except(F.map_keys("fields"), known)) == 0), f"{name} has an unknown attribute")
    time = F.coalesce(*(F.col("fields")[t] for t in TIMES))
    return _events(rows, events, F.coalesce(time_of(time), F.col("pos")))


def read_streams(spark: SparkSession, descriptor: str, events: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """The merged streams of a descriptor: lines ``STREAM:FILE:path`` (native) or ``STREAM:CSV:path``, relative to its own folder."""
    found = []
    for row in _lines(spark, descriptor).orderBy("pos").collect():  # a line for each stream
        name, kind, path = row["value"].strip().split(":", 2)
        if kind not in ("FILE", "CSV"):
            raise ValueError(f"not FILE or CSV: {row['value']}")
        path = path if "://" in path or path.startswith("/") else f"{descriptor.rpartition('/')[0]}/{path}"
        found.append((read_native if kind == "FILE" else read_header_csv)(spark, path, events).withColumn("stream", F.lit(name)))
    return merge(found)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``{id, type, timestamp, attributes: {...}}``; attributes are a map of strings."""
    parsed = F.from_json("value", "id long, type string, timestamp long, attributes map<string,string>", {"mode": "FAILFAST"})
    return _lines(spark, path).select("pos", parsed.alias("e")).select("pos", F.col("e.id").alias("id"), F.col("e.type").alias("etype"), F.col("e.timestamp").alias("ts"), F.col("e.attributes").alias("attributes"))


def read_tweets(spark: SparkSession, path: str) -> DataFrame:
    """Tweets as JSON lines: created_at, text and counts, the user, the place's name and the id of what was retweeted."""
    schema = "created_at string, id long, text string, lang string, retweet_count long, favorite_count long, user struct<id:long,name:string,followers_count:long>, place struct<full_name:string>, retweeted_status struct<id:long>"
    rows = _lines(spark, path).select("pos", F.from_json("value", schema).alias("e"))
    parts = F.split("e.created_at", " ")
    at = F.to_timestamp(F.concat_ws(" ", F.get(parts, F.lit(5)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(4))), "yyyy MMM dd HH:mm:ss Z")
    return rows.select("pos", F.lit("Tweet").alias("etype"), at.alias("ts"), "e.id", "e.text", "e.lang", "e.retweet_count", "e.favorite_count", "e.user", F.col("e.place.full_name").alias("place_name"), F.col("e.retweeted_status.id").alias("retweeted_id"))


def generate_sensors(spark: SparkSession, rows: int, seed: int) -> DataFrame:
    """Pressure and temperature readings, one every 30 seconds."""
    return spark.range(rows).select(
        F.col("id").alias("pos"), F.lit("PressTemp").alias("etype"), F.timestamp_seconds(F.col("id") * 30).alias("ts"),
        F.rand(seed).alias("Amplitude"), (F.rand(seed + 1) * 100 + 950).alias("Pressure"), (F.rand(seed + 2) * 40 - 5).alias("Temperature"),
    )


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with ``seq``, gapless from 0 in this order; sorted by ranges, so no task has them all."""
    sorted_ = write_out(rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_id", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sorted_.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    out = sorted_.withColumn("_part", part).join(F.broadcast(parts), "_part")
    return out.withColumn("seq", F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_part", "_before")


def merge(streams: list[DataFrame]) -> DataFrame:
    """Streams merged by time, then by their order in the list, then by position: ``source`` tells which, ``seq`` the place from 0."""
    marked = [s.withColumn("source", F.lit(i)) for i, s in enumerate(streams)]
    out = marked[0]
    for s in marked[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return numbered(out, "ts", "source", "pos")


def _checked_path(path: str, inputs: list[str]) -> None:
    plain = lambda p: os.path.normpath(p.removeprefix("file://").removeprefix("file:"))
    if plain(path) in {plain(p) for p in inputs}:
        raise ValueError(f"{path} is an input")


def write_matches(matches: DataFrame, path: str, inputs: list[str] = ()) -> None:
    """Matches as JSON lines; the path must not be one of the inputs."""
    _checked_path(path, inputs)
    matches.write.json(path)


def match_text(matches: DataFrame, aliases: list[str], ids: Column | None = None) -> DataFrame:
    """One text for each match: the events of its aliases as JSON, a line each, then a blank line; with ``ids`` (an array), once for each pattern's id."""
    one = F.concat(*(F.concat(F.to_json(a), F.lit("\n")) for a in aliases))
    return matches.select(one.alias("value") if ids is None else F.array_join(F.transform(ids.cast("array<string>"), lambda i: F.concat(i, F.lit(": "), one)), "\n").alias("value"))


def write_text(matches: DataFrame, aliases: list[str], path: str, inputs: list[str] = ()) -> None:
    """The texts of the matches as text files."""
    _checked_path(path, inputs)
    match_text(matches, aliases).write.text(path)


def summary(events: DataFrame, matches: DataFrame, seconds: float) -> dict[str, float]:
    """Counts of a run, for people: events, matches, completing events, events a second."""
    n = events.count()
    m = matches.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("hi_pos").alias("t")).first()
    return {"events": n, "matches": m["n"], "triggers": m["t"], "seconds": seconds, "events_per_second": n / seconds if seconds else 0.0}
