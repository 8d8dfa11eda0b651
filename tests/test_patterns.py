"""Hand-made streams: ties, nesting, repetition, and the order-dependent operators."""

import random

import pytest
from pyspark.sql import functions as F

from eventloom.functions import conditions, values
from eventloom.operators import selection
from eventloom.operators.matching import match, stream
from eventloom.plans.pattern import And, Event, Not, Or, Pattern, Repeat, Seq, Window, sub_pattern
from eventloom.sources import text

SECOND = 1_000_000


def events(spark, line):
    """'A0 B2': type and second, in input order."""
    rows = [(i, x[0], int(x[1:]) * SECOND, 1) for i, x in enumerate(line.split())]
    return stream(spark.createDataFrame(rows, "event_id long, event_type string, ts long, user_id long"))


def count(spark, structure, seconds, line, **more):
    return match(events(spark, line), Pattern(structure, Window(seconds * SECOND), **more)).count()


A, B, C, D = (Event(t, t.lower()) for t in "ABCD")


@pytest.mark.parametrize(
    ("structure", "window", "line", "n"),
    [
        (Seq(A, B), 2, "A0 B2", 1), (Seq(A, B), 2, "A0 B3", 0), (Seq(A, B), 2, "B0 A1", 0), (Seq(A, B), 2, "B0 A0", 1),
        (Seq(A, Event("A", "a2")), 2, "A0", 0), (Seq(A, Event("A", "a2")), 2, "A0 A1", 1),
        (Seq(A, And(B, C), D), 5, "A0 C1 B2 D3", 1), (Seq(A, And(B, C), D), 5, "C0 A1 B2 D3", 0), (Or(A, B), 5, "A0 B1", 2),
        (Repeat(A, "k", 2, 3), 5, "A0 A1 A2", 4), (Repeat(A, "k", 2, 2), 5, "A0 A1 A2", 3), (Repeat(Seq(A, B), "k", 1, 2), 5, "A0 B1 A2 B3", 6),
        (Seq(A, Not(Event("N", "n")), B), 5, "A0 N1 B2", 0), (Seq(A, Not(Event("N", "n")), B), 5, "N0 A1 B2", 1),
        (Seq(A, Not(Event("N", "n"))), 3, "A0 N3", 0), (Seq(A, Not(Event("N", "n"))), 3, "A0 N4", 1), (And(A, Not(Event("N", "n"))), 3, "N0 A2 X9", 0),
    ],
)
def test_counts(spark, structure, window, line, n):
    assert count(spark, structure, window, line) == n


N = Event("N", "n")


@pytest.mark.parametrize(
    ("structure", "window", "line", "n"),
    [
        (Seq(Or(A, B), Not(N), C), 5, "A0 N1 C2", 0), (Seq(A, Not(N), Or(B, C)), 5, "A0 N1 C2", 0), (Seq(Or(A, B), Not(N), C), 5, "N0 B1 C2", 1),
        (Seq(Repeat(Seq(A, B), "k"), Not(N), C), 9, "A0 B1 N2 C3", 0), (Seq(Repeat(Seq(A, B), "k"), Not(N), C), 9, "A0 N1 B2 C3", 1),
        (And(A, Not(Seq(N, B, Not(Event("X", "x"))))), 3, "A0 N1 B2 Z4 Z5 Z7", 0), (And(A, Not(Seq(N, B, Not(Event("X", "x"))))), 3, "A0 N1 B2 X3 Z7", 1),
    ],
)
def test_negation_beside_other_parts(spark, structure, window, line, n):
    assert count(spark, structure, window, line) == n


def test_conditions_over_alternatives(spark):
    either = Or(Seq(A, B), C)
    later = lambda v: v("b", "pos") > v("a", "pos") + 1
    assert count(spark, either, 5, "A0 B1 C2", condition=later) == 1
    assert count(spark, either, 5, "A0 X1 B1 C2", condition=later) == 2
    assert count(spark, Seq(Or(A, B), Not(N, condition=lambda v: v("n", "pos") > v("a", "pos") + 1), C), 5, "A0 N1 C2", condition=None) == 1


def test_selection_at_the_root_and_at_every_node(spark):
    for selection_, n in (("any", 4), ("single", 2), ("next", 2)):
        assert count(spark, Seq(A, B), 5, "A0 A1 B2 B3", partition=("user_id",), selection=selection_) == n
    with pytest.raises(ValueError):
        Pattern(A, Window(1), selection="best")


def test_sub_patterns_and_limits(spark):
    whole = Pattern(Seq(A, Not(N), And(B, C), gap="any"), Window(5 * SECOND))
    assert sub_pattern(whole, {"a", "c"}).structure.aliases() == ["a", "c"]
    assert sub_pattern(whole, {"b"}).structure == B
    with pytest.raises(ValueError):
        sub_pattern(whole, {"z"})
    live = events(spark, "A0 A1 A2")
    assert [selection.limit_input(live, n).count() for n in (0, 2, None)] == [0, 2, 3]
    found = match(live, Pattern(A, Window(1)))
    assert selection.checked_runs(found, 3).count() == 3
    with pytest.raises(ValueError):
        selection.checked_runs(found, 2)


def test_consumption_of_all_keys(spark):
    rows = [(0, 0, 2, [0, 2]), (1, 1, 3, [1, 3])]
    matches = spark.createDataFrame(rows, "key long, lo_pos long, hi_pos long, ids array<long>")
    assert [r.ids for r in selection.consume(matches, []).collect()] == [[0, 2]]
    assert selection.consume(matches, ["key"]).count() == 2
    assert selection.consume(matches.limit(0), []).count() == 0 == selection.single_use(matches.limit(0), ["key"]).count()
    chain = spark.range(3000).select(F.lit(1).alias("key"), F.col("id").alias("lo_pos"), (F.col("id") + 1).alias("hi_pos"), F.array("id", F.col("id") + 1).alias("ids"))
    assert selection.consume(chain, ["key"]).count() == 1500
    again = [(0, 0, 2, [0, 2]), (0, 1, 2, [1, 2]), (0, 1, 4, [1, 4]), (0, 1, 4, [1, 4])]
    some = spark.createDataFrame(again, "key long, lo_pos long, hi_pos long, ids array<long>")
    assert sorted(r.ids for r in selection.single_use(some, ["key"]).collect()) == [[0, 2], [1, 4]]
    assert selection.single_use(some, ["key"], F.slice("ids", 2, 1)).count() == 2


def test_invalid_patterns():
    for bad in (lambda: Seq(Not(A), Not(B)), lambda: Repeat(Not(A), "k"), lambda: Pattern(Not(A), Window(1)), lambda: Pattern(Seq(A, A), Window(1)), lambda: Seq(A)):
        with pytest.raises(ValueError):
            bad()


def test_sequences_against_loops(spark):
    draw = random.Random(1)
    for _ in range(6):
        line = " ".join(f"{draw.choice('ABC')}{t}" for t in sorted(draw.randint(0, 12) for _ in range(9)))
        rows = [(x[0], int(x[1:])) for x in line.split()]
        want = sum(1 for i, (p, s) in enumerate(rows) for j, (q, t) in enumerate(rows) for k, (r, u) in enumerate(rows) if (p, q, r) == ("A", "B", "C") and s <= t <= u <= s + 5)
        assert count(spark, Seq(A, B, C), 5, line) == want


@pytest.mark.parametrize("order", ["time", "position"])
@pytest.mark.parametrize("metric", ["time", "events"])
def test_gaps_against_loops(spark, order, metric):
    draw = random.Random(3)
    seen = set()
    for _ in range(3):
        rows = [(i, draw.choice("ABC"), t * SECOND, draw.randint(1, 2)) for i, t in enumerate(sorted(draw.randint(0, 30) for _ in range(40)))]
        live = stream(spark.createDataFrame(rows, "event_id long, event_type string, ts long, user_id long"))
        size = 6 * SECOND if metric == "time" else 12
        for gap in ("strict", "next"):
            pattern = Pattern(Seq(Event("A", "a"), Or(Event("B", "b"), Event("C", "b")), Event("A", "c"), gap=gap), Window(size, metric), None, ("user_id",), order)
            want = set()
            for user in (1, 2):
                own = [r for r in rows if r[3] == user]
                for i, r in enumerate(own):
                    found, at = [r], i
                    for kinds in ("BC", "A"):
                        ahead = own[at + 1 : at + 2] if gap == "strict" else own[at + 1 :]
                        fits = [j for j, x in enumerate(ahead, at + 1) if x[1] in kinds]
                        if not fits:
                            break
                        at = fits[0]
                        found.append(own[at])
                    column = 2 if metric == "time" else 0
                    if r[1] == "A" and len(found) == 3 and found[-1][column] - r[column] <= size:
                        want.add(tuple(x[0] for x in found))
            assert {tuple(r.ids) for r in match(live, pattern).collect()} == want
            seen |= want
    assert seen


def test_gap_of_other_parts_is_an_error(spark):
    for bad in (lambda: Seq(A, Repeat(B, "k"), gap="strict"), lambda: Seq(A, And(B, C), gap="next"), lambda: Seq(A, Or(B, C), gap="next")):
        with pytest.raises(ValueError):
            bad()
    assert count(spark, Seq(A, B, gap="next"), 5, "A0 B1 B2") == 1
    assert count(spark, Seq(A, Not(Event("N", "n")), B, gap="next"), 5, "A0 N1 B2") == 0
    assert count(spark, Seq(A, B, gap="strict"), 5, "A0 C1 B2") == 0


def test_repetitions_have_no_cap(spark):
    between = Seq(A, Repeat(B, "k"), C)
    chain = " ".join(f"B{i}" for i in range(1, 10))
    assert count(spark, between, 60, f"A0 {chain} C10") == 2**9 - 1
    hot = " ".join(f"B{i}" for i in range(30))
    assert count(spark, between, 90, f"{hot} A30 B31 C32 {hot.replace('B', 'B5')}") == 1
    assert count(spark, Repeat(Seq(A, B), "k"), 5, "A0 B1 A2 B3") == 7
    assert count(spark, And(C, Repeat(B, "k")), 5, "B0 B1 C2 B3 B9") == 7
    rows = match(events(spark, "A0 B1 B2 C3"), Pattern(between, Window(5 * SECOND))).collect()
    assert sorted(r.ids for r in rows) == [[0, 1, 2, 3], [0, 1, 3], [0, 2, 3]]


def test_single_use_and_consumption_against_loops(spark):
    draw = random.Random(2)
    rows = []
    for user in range(5):
        for _ in range(40):
            ids = sorted(draw.sample(range(60), 3))
            rows.append((user, ids[0], ids[-1], ids))
    matches = spark.createDataFrame(rows, "user_id long, lo_pos long, hi_pos long, ids array<long>").distinct()
    every = sorted({(u, lo, hi, tuple(ids)) for u, lo, hi, ids in rows}, key=lambda r: (r[2], r[3]))
    single, consumed = set(), set()
    for user in range(5):
        used, cleared = set(), -1
        for r in (x for x in every if x[0] == user):
            if used.isdisjoint(r[3]):
                used |= set(r[3])
                single.add(r)
        own = [x for x in every if x[0] == user]
        while own:
            end = min(x[2] for x in own)
            consumed |= {x for x in own if x[2] == end}
            own = [x for x in own if x[1] > end]
    plain = lambda df: {(r.user_id, r.lo_pos, r.hi_pos, tuple(r.ids)) for r in df.collect()}
    assert plain(selection.single_use(matches, ["user_id"])) == single
    assert plain(selection.consume(matches, ["user_id"])) == consumed


def test_text_sources(spark, tmp_path):
    (tmp_path / "bars").write_text("IBM,202001010930,1,2,0.5,1.5,100\nGE,202001010931,1,2,0.5,1.5,100,0.9\n")
    bars = text.read_bars(spark, str(tmp_path / "bars")).orderBy("pos").collect()
    assert [(b.etype, b.volume, b.probability) for b in bars] == [("IBM", 100, None), ("GE", 100, 0.9)]
    (tmp_path / "taxi").write_text('// note\nTRIP(id=1, dropoff_datetime=5, pickup_zone="A / B", dropoff_zone=C, total_amount=2.5)\n\n')
    trip = text.read_keyed(spark, str(tmp_path / "taxi"), "taxi").first()
    assert (trip.etype, trip.pickup_zone, trip.total_amount, trip.ts) == ("TRIP", "AB", 2.5, 5)
    (tmp_path / "bad").write_text("a,b\n")
    with pytest.raises(Exception, match="7 or 8"):
        text.read_bars(spark, str(tmp_path / "bad")).collect()
    with pytest.raises(ValueError):
        text.write_matches(spark.range(1), str(tmp_path / "bars"), [str(tmp_path / "bars")])


def test_quotes_positions_and_declared_events(spark, tmp_path):
    (tmp_path / "stock").write_text('BUY(name="a, price=9", id=1, volume=2, price=3.5, timestamp=7)\n\n// x\nSELL(id=2, name="say ""hi""", volume=2, price=1, timestamp=8)\n')
    rows = text.read_keyed(spark, str(tmp_path / "stock"), "stock").orderBy("pos").collect()
    assert [(r.pos, r.etype, r.name, r.price, r.ts) for r in rows] == [(0, "BUY", "a, price=9", 3.5, 7), (1, "SELL", 'say "hi"', 1.0, 8)]
    (tmp_path / "home").write_text("LOAD(id=1, timestamp=5, value=2, householdId=3)\n")
    assert text.read_keyed(spark, str(tmp_path / "home"), "home").first().household_id == 3
    declared = {"A": {"id": "int", "ok": "boolean"}, "B": {"id": "int", "v": "double"}}
    (tmp_path / "n").write_text("A(id=1, ok=TRUE)\nB(id=2, v='1e2', timestamp='2020-01-01 00:00:01')\nB(__ts=9, id=3, v=4)\n")
    native = text.read_native(spark, str(tmp_path / "n"), declared).orderBy("pos").collect()
    assert [(r.etype, r.ts, r.id, r.ok, r.v) for r in native] == [("A", 0, 1, True, None), ("B", 1577836801000, 2, None, 100.0), ("B", 9, 3, None, 4.0)]
    (tmp_path / "c").write_text("event,time,id,ok,v\nA,5,1,false,\nB,6,2,,\"3\"\n")
    assert [(r.pos, r.ts, r.ok, r.v) for r in text.read_header_csv(spark, str(tmp_path / "c"), declared).orderBy("pos").collect()] == [(0, 5, False, None), (1, 6, None, 3.0)]
    (tmp_path / "d").write_text("S:FILE:n\nT:CSV:c\n")
    assert [(r.stream, r.ts) for r in text.read_streams(spark, str(tmp_path / "d"), declared).orderBy("seq").collect()] == [("S", 0), ("T", 5), ("T", 6), ("S", 9), ("S", 1577836801000)]
    for name, line in (("dup", "A(id=1, id=2, ok=true)"), ("unknown", "A(id=1, ok=true, z=3)"), ("lacks", "A(id=1)"), ("type", "C(id=1)"), ("nan", "B(id=1, v=NaN)"), ("time", "A(id=1, ok=true, time=soon)"), ("quote", 'A(id="1, ok=true)')):
        (tmp_path / name).write_text(line + "\n")
        with pytest.raises(Exception):
            text.read_native(spark, str(tmp_path / name), declared).collect()
    many = spark.range(5000).select(F.concat(F.lit("A(ok=true, id="), "id", F.lit(")")).alias("value"))
    many.repartitionByRange(7, "value").write.text(str(tmp_path / "many"))
    got = text.read_native(spark, str(tmp_path / "many"), declared)
    assert sorted(r.pos for r in got.collect()) == list(range(5000))


def test_other_layouts_and_match_texts(spark, tmp_path):
    (tmp_path / "s").write_text("PressTemp,01/02/2020 03:04:05,1,2,3\nMagnetometer,01/02/2020 03:04:06,1,4,5,6\n")
    rows = text.read_sensors(spark, str(tmp_path / "s")).orderBy("pos").collect()
    assert [(r.etype, r.Pressure, r.MagY) for r in rows] == [("PressTemp", 2.0, None), ("Magnetometer", None, 5.0)]
    (tmp_path / "j").write_text('{"id": 4, "type": "A", "timestamp": 5, "attributes": {"x": "1"}}\n')
    assert text.read_json_lines(spark, str(tmp_path / "j")).first()["attributes"] == {"x": "1"}
    (tmp_path / "t").write_text('{"created_at": "Wed Aug 27 13:08:45 +0000 2008", "id": 1, "text": "hi", "place": {"full_name": "Here"}, "retweeted_status": {"id": 9}}\n')
    tweet = text.read_tweets(spark, str(tmp_path / "t")).first()
    assert (tweet.etype, tweet.place_name, tweet.retweeted_id, tweet.ts.year) == ("Tweet", "Here", 9, 2008)
    assert text.generate_sensors(spark, 3, 1).count() == 3
    found = match(events(spark, "A0 B1"), Pattern(Seq(A, B), Window(5 * SECOND)))
    (line,) = [r.value for r in text.match_text(found, ["a", "b"], F.array(F.lit(3), F.lit(4))).collect()]
    assert line.startswith("3: {") and "\n4: {" in line
    text.write_text(found, ["a"], str(tmp_path / "out"), [str(tmp_path / "in")])
    assert text.summary(events(spark, "A0 B1"), found, 2.0) == {"events": 2, "matches": 1, "triggers": 1, "seconds": 2.0, "events_per_second": 1.0}


def test_conditions_by_name_and_place(spark):
    row = spark.sql("SELECT array(1, 3, 2) AS k, '7' AS v, named_struct('v', cast(null as int)) AS unset, named_struct('v', 5) AS r")
    k, less = F.col("k"), lambda x, y: x < y
    now, then = F.col, lambda a, c: F.col(f"{a}.{c}")
    own = lambda name, *more: conditions.predicate(name, *more, current=now, earlier=then)
    want = [
        (conditions.by_index(k, 0, 1, less), True), (conditions.by_index(k, 0, -1, less), True), (conditions.by_index(k, 0, 5, less), False),
        (conditions.by_offset(k, 1, less), False), (conditions.by_offset(k, 2, less), True), (conditions.by_offset(k, -2, less), False), (conditions.by_offset(k, 3, less), False),
        (conditions.by_value(k, less, F.lit(4)), True), (conditions.by_value(k, less, F.lit(2), 1), False),
        (own("GT", "v", 6), True), (own("GTAttr", "v", "r"), True), (own("GTAttr", "v", "unset"), False), (~own("GTAttr", "v", "unset"), True), (own("EQStr", "v", "7"), True), (own("EQAttrStr", "v", "r"), False),
    ]
    assert list(row.select(*(c.alias(f"c{i}") for i, (c, _) in enumerate(want))).first()) == [w for _, w in want]
    for bad in (lambda: own("NOPE"), lambda: own("GT", "v"), lambda: conditions.register("GT", 1, None)):
        with pytest.raises(ValueError):
            bad()


def test_values_of_text_and_arrays(spark):
    row = spark.sql("SELECT array(0, 1, 2, 3, 4, 5) AS a")
    a = F.col("a")
    cases = [(None, None, 1), (1, -1, 2), (-2, None, 1), (None, None, -1), (4, 1, -1), (9, None, 1), (None, -9, -2), (3, 3, 1)]
    got = row.select(*(values.sliced(a, *c).alias(f"c{i}") for i, c in enumerate(cases))).first()
    assert list(got) == [list(range(6))[slice(*c)] for c in cases]
    assert row.select(values.reshaped(a, 2)).first()[0] == [[0, 1], [2, 3], [4, 5]]
    with pytest.raises(Exception):
        row.select(values.reshaped(a, 4)).collect()
    numbers = spark.createDataFrame([("12",), ("1.5",), ("x",)], "t string").select(values.parsed(F.col("t")).alias("p")).collect()
    assert [tuple(r.p) for r in numbers] == [(12, None, None), (None, 1.5, None), (None, None, "x")]
    with pytest.raises(Exception):
        spark.sql("SELECT double('NaN') AS x").select(values.finite(F.col("x"))).collect()


def test_streams_of_three_parts_and_of_absence(spark, tmp_path):
    from eventloom.streaming.sequences import arriving, follow_all, listen, never_followed

    rows = [(0, "A", 0), (1, "B", 5), (2, "C", 9), (3, "A", 20), (4, "X", 300)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0").write_text("".join(f'{{"id": {i}, "type": "{t}", "timestamp": {(s + 1000) * 1000}, "attributes": {{"u": "1"}}}}\n' for i, t, s in rows))
    (tmp_path / "in" / "1").write_text('{"id": 5, "type": "X", "timestamp": 1900000, "attributes": {"u": "1"}}\n')
    live = arriving(spark, str(tmp_path / "in")).withColumn("user_id", F.col("attributes")["u"])
    is_ = lambda t: F.col("event_type") == t
    seen: dict[str, list] = {"abc": [], "alone": []}
    for name, df in (("abc", follow_all(live, [is_("A"), is_("B"), is_("C")], "10 SECONDS")), ("alone", never_followed(live, is_("A"), is_("B"), "10 SECONDS"))):
        q = listen(df, lambda batch, n, name=name: seen[name].extend(map(tuple, batch.collect())), str(tmp_path / f"cp-{name}"))
        q.processAllAvailable()
        q.stop()
    assert seen["abc"] == [(0, 1, 2)]
    assert set(seen["alone"]) <= {(3,)}


def test_stream_equals_batch(spark, tmp_path):
    from eventloom.catalog import QUERIES
    from eventloom.streaming.sequences import follow

    sf = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{sf}/events.parquet")
    source.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    found = follow(live, F.col("event_type") == "view", F.col("event_type") == "purchase", "24 HOURS", late="40 days")
    q = found.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    batch = QUERIES["seq2_incl_window"](spark, sf)
    assert sorted(map(tuple, spark.table("found").collect())) == sorted(map(tuple, batch.collect()))
