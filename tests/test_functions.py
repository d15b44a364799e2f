"""Values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from placelens.functions import columns as C
from placelens.operators import relational as R
from placelens.operators import rules as X
from placelens.operators import scoring as S
from placelens.operators import trips as T
from placelens.sources import tables
from placelens.streaming import profiles as P


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize("got,want", [
    (lambda: C.normalize_text(F.lit("Đà Nẵng Phở")), "da nang pho"), (lambda: C.clean_key(F.lit("Đà Nẵng")), "a_nang"), (lambda: C.clean_key(F.lit("!!")), "unknown"), (lambda: C.normalize_text(F.lit(None).cast("string")), ""),
    (lambda: C.optional_number(F.lit("12,5abc")), 12.5), (lambda: C.optional_number(F.lit("abc")), None), (lambda: C.parse_list(F.lit("a|nan; b")), ["a", "b"]),
    (lambda: C.image_urls(F.lit(" https://example.com/a.jpg,not-a-url,http://example.com/b.jpg, https://example.com/a.jpg, ftp://example.com/c.jpg, ")), ["https://example.com/a.jpg", "http://example.com/b.jpg"]),
    (lambda: C.image_urls(F.lit("")), []), (lambda: C.clamp01(F.lit(float("nan"))), 0.0), (lambda: C.rating_score(F.lit(0.0)), 0.35), (lambda: C.rating_score(F.lit(8.0)), 0.8), (lambda: C.js_round(F.lit(-0.5)), 0),
    (lambda: C.trapezoid(F.lit(0.0), 0, 0, 5, 15), 0.0), (lambda: C.trapezoid(F.lit(10.0), 0, 0, 5, 15), 0.5), (lambda: C.opening_status(F.lit("")), "unknown"), (lambda: C.opening_status(F.lit("06:00 - 21:00")), "known"),
    (lambda: F.size(C.opening_ranges(F.lit("09:30 - 14:00 | 16:00 - 21:00"))), 2), (lambda: C.opening_status(F.lit("always open maybe")), "unparseable"), (lambda: C.time_of(F.lit(1505)), "01:05"), (lambda: C.minutes_of(F.lit("07:30")), 450),
    (lambda: C.stop_minutes(F.lit("steak house")), 60), (lambda: C.stop_minutes(F.lit("museum bar")), 90), (lambda: C.leg_minutes(F.lit(None).cast("double")), None), (lambda: C.leg_minutes(F.lit(2200.0)), 9.0),
    (lambda: C.grid_key(F.lit(16.0544), F.lit(108.2022)), "16.056,108.198"), (lambda: X.level(X.centroid(F.lit(0.0), F.lit(0.0), F.lit(0.0))), "low"), (lambda: S.intent_column(F.lit("quán cà phê"))["intent"], "cafe"),
])
def test_column(spark, got, want):
    assert one(spark, got()) == want


def test_pages_and_cursor(spark):
    df, cursor = R.page(spark.range(45), [F.col("id")], 20)
    assert [r["id"] for r in df.collect()] == list(range(20)) and R.decode_cursor(cursor) == 20
    df, cursor = R.page(spark.range(45), [F.col("id")], 20, R.encode_cursor(40))
    assert df.count() == 5 and cursor is None
    with pytest.raises(ValueError):
        R.decode_cursor("xx")
    with pytest.raises(ValueError):
        R.page(spark.range(1), [F.col("id")], 101)


def test_greedy_order_does_not_depend_on_input_order():
    stops = [{"poi_id": i, "score": 0.5, "rank": 1, "lat": 16 + i / 100, "lon": 108.0} for i in range(6)] + [{"poi_id": 9, "score": 0.5, "rank": 0, "lat": None, "lon": None}]
    a = [r["poi_id"] for r in T.greedy_order(stops)]
    assert a == [r["poi_id"] for r in T.greedy_order(stops[::-1])] and a[0] == 9 and sorted(a) == sorted(r["poi_id"] for r in stops)


def test_schedule_fills_days_and_reports_the_rest():
    stops = [{"poi_id": i, "lat": 16.0, "lon": 108.0, "stay": 60} for i in range(7)]
    out = T.schedule(stops, (16.0, 108.0), days=2, per_day=3)
    assert [r["day"] for r in out] == [1, 1, 1, 2, 2, 2, None] and out[-1]["warnings"] == "MAX_STOPS_APPLIED"
    late = T.schedule(stops[:2], (16.0, 108.0), first=1000, last=1080)
    assert [r["status"] for r in late] == ["scheduled", "unscheduled"]
    assert late[1]["warnings"] == "DAILY_WINDOW_TIGHT"
    shut = T.schedule([s | {"hours": "known", "ranges": [{"start": 1200, "end": 1300}], "must": i == 0} for i, s in enumerate(stops[:2])], (16.0, 108.0))
    assert [r["status"] for r in shut] == ["scheduled", "dropped"] and shut[0]["warnings"] == "TRAVEL_TIME_ESTIMATED,OPENING_HOURS_CONFLICT"
    # A later day has no point to come from, and only the first stops take part, whether they fit or not.
    assert out[0]["travel"] == 4 and out[3]["travel"] is None and out[3]["warnings"].startswith("ORIGIN_NOT_PROVIDED")
    long = T.schedule([stops[0] | {"stay": 600}, *stops[1:]], (16.0, 108.0), days=1, per_day=2)
    assert [r["status"] for r in long] == ["unscheduled", "scheduled"] + ["unscheduled"] * 5 and long[2]["warnings"] == "MAX_STOPS_APPLIED"
    blind = T.schedule([stops[0], stops[1] | {"lat": None}], (16.0, 108.0))
    assert blind[1]["warnings"] == "COORDINATES_MISSING,OPENING_HOURS_UNKNOWN"


def test_stream_equals_batch(spark, sf, tmp_path):
    """The stream in one trigger, with redelivered rows, leaves the profiles of the batch."""
    from placelens.plans.people import online_events

    events = online_events(tables.profile_events(spark, sf)).where("user_id < 5")
    events.unionByName(events.where("event_id % 2 = 0")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = P.stream_profiles(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.outputMode("update").format("memory").queryName("profiles").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    key = lambda df: sorted((r["user_id"], r["kind"], r["key"], round(r["weight"], 9)) for r in df.collect())
    assert key(spark.table("profiles")) == key(P.batch_profiles(events))


def test_blend_forgets_and_keeps_the_largest():
    assert P.blend({"a": 1.0, "b": 0.001}, {"c": 1.0}, 0.5, 2) == {"a": 0.5, "c": 0.5}


def test_old_event_keys_are_forgotten():
    seen = {"a": 0.0, "b": 90.0, "c": 100.0, "d": None}
    P.forget(seen, 10.0)
    assert seen == {"b": 90.0, "c": 100.0, "d": None}
    none = {}
    P.forget(none)
    assert none == {}


def test_readers(spark, tmp_path):
    head = ",".join(tables.CANONICAL_COLUMNS)
    (tmp_path / "a.csv").write_text("﻿" + head + "\n" + ",".join(['"x ""y"""'] + [""] * 33) + "\n", encoding="utf-8")
    df = tables.read_canonical_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == tables.CANONICAL_COLUMNS and df.first()["Global_ID"] == 'x "y"'
    (tmp_path / "b.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        tables.read_canonical_csv(spark, str(tmp_path / "b.csv"))
    (tmp_path / "c.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert tables.read_jsonl(spark, str(tmp_path / "c.jsonl"), "a long", strict=False).count() == 2
    assert tables.read_artifact(spark, str(tmp_path / "none.json"), "a long").count() == 0
    assert tables.row_checksum(df).first()["checksum"] and tables.file_checksum(spark, str(tmp_path / "b.csv")).count() == 1


def test_one_way(spark):
    at = lambda b: one(spark, X.one_way_state(F.lit(16.0), F.lit(108.0), F.lit(16.01), F.lit(108.0), F.lit(b), F.lit(100.0)))
    assert (at(0.0), at(180.0), at(120.0)) == ("fine", "violation", "neither")


@pytest.mark.parametrize("order", [1, -1])
def test_mean_dwell_is_exact(spark, tmp_path, order):
    """The mean is 25 minutes, a style's bound; a sum of doubles in the first order is less."""
    from placelens.plans.people import dwell_preference

    values = [2.51, 35.08, 32.44, 17.24, 16.08, 64.52, 7.3, 31.08, 9.78, 33.97][::order] + [None, -1.0]
    spark.createDataFrame([(i, 7, v) for i, v in enumerate(values)], "event_id long, user_id long, value double").selectExpr("*", "timestamp'2024-01-01' as ts", "'view' as event_type", "'{}' as props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(3).write.parquet(f"{tmp_path}/customer.parquet")
    assert dwell_preference(spark, str(tmp_path)).collect() == [(7, 25, "standard_visit", 10)]


def odd_stops():
    import random

    dice = random.Random(5)
    point = lambda base: dice.choice([None, float("nan"), *[round(base + dice.randrange(-200, 200) * 1e-4, 4) for _ in range(8)]])
    rows = [(trip, i, dice.choice([0.1, 0.5, 0.9]), dice.randrange(3), point(16.0), point(108.0), dice.choice([20, 60, 200]), dice.choice([None, "", "08:00-12:00", "09:00-11:00 | 13:00-20:00", "always"]), dice.random() < 0.2) for trip in [*range(300), 10**12] for i in range(dice.choice([1, 2, 3, 5, 8, 13]) if trip < 300 else 90)]
    dice.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"days": 2, "per_day": 3}, {"start": (16.001, 108.002), "days": 3, "per_day": 2, "mode": "walk", "first": 500, "last": 900}])
def test_trips_of_a_table_are_those_done_one_by_one(spark, options):
    rows = odd_stops()
    df = spark.createDataFrame(rows, "trip_id long, poi_id long, score double, rank int, lat double, lon double, stay int, opening_hours string, must boolean").repartition(3)
    parsed = df.withColumn("hours", C.opening_status(F.col("opening_hours"))).withColumn("ranges", F.filter(C.opening_ranges(F.col("opening_hours")), lambda x: x.isNotNull()))
    trips = {}
    for r in parsed.collect():
        trips.setdefault(r["trip_id"], []).append(r.asDict() | {"ranges": [x.asDict() for x in r["ranges"] or []]})
    orders, days = set(), set()
    for trip, stops in trips.items():
        route = T.greedy_order(stops)
        orders |= {(trip, r["poi_id"], i + 1, r["leg_metres"]) for i, r in enumerate(route)}
        clock = lambda x: None if x is None else T.hhmm(x)
        days |= {(trip, r["poi_id"], r["day"], r.get("stop_order"), clock(r.get("arrival")), clock(r.get("departure")), r.get("travel"), r["status"], r["warnings"]) for r in T.schedule(route, **options)}
    # Tiny batches: trips reach over several.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got, placed = T.order_trips(df).collect(), T.schedule_trips(df, **options).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(placed) == len(rows)
    assert {tuple(r) for r in got} == orders and {tuple(r) for r in placed} == days


def test_opening_hours_in_python_are_the_columns(spark):
    texts = [None, "", "  ", "always", "06:00 - 21:00", "9:30-14:00|16:00 - 21:00 ", " 09:00-11:00 | 13:00-20:00", "10:00-09:00", "08:00-12:00|", "|", "8:00-12:00 | shut", "\t08:00-12:00", "24:00-25:99", "08:00–12:00", "٠٨:٠٠-١٢:٠٠", "108:00-12:00", "08:00-12:000"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    for r in df.select("t", C.opening_status(F.col("t")).alias("s"), F.filter(C.opening_ranges(F.col("t")), lambda x: x.isNotNull()).alias("r")).collect():
        status, ranges = T.opening_hours(r["t"])
        assert (status, ranges if status != "unknown" else []) == (r["s"], [tuple(x) for x in r["r"] or []]), r["t"]


def test_trips_take_no_call_each(spark, sf):
    from placelens.plans import quality

    for query in (quality.nearest_neighbour_route, quality.trip_schedule):
        plan = query(spark, sf)._jdf.queryExecution().toString()
        assert "MapInArrow" in plan and "FlatMapGroups" not in plan


@pytest.mark.parametrize("order", [1, -1])
def test_mean_dwell_is_that_of_its_sql_in_order_of_ids(spark, tmp_path, order):
    """In the second order the SQL's sum of doubles is less than 250, so its mean is under a style's bound; the rows lie largest id first, and times in another order. The last value has more decimals than 15."""
    import duckdb

    from placelens.plans.people import DWELL_SQL, dwell_preference

    values = [2.51, 35.08, 32.44, 17.24, 16.08, 64.52, 7.3, 31.08, 9.78, 33.97][::order]
    rows = [(i, 7, v) for i, v in enumerate(values)] + [(10, 8, 1.4999999999999998)]
    spark.createDataFrame(rows[::-1], "event_id long, user_id long, value double").selectExpr("*", "timestamp_seconds(event_id * 7 % 11) as ts", "'view' as event_type", "'{}' as props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(3).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.sql("create table customer as from range(3)")
    con.sql(f"create table events as from '{tmp_path}/events.parquet/*.parquet' order by event_id")
    want = sorted(con.sql(DWELL_SQL).fetchall())
    assert want == [(7, 25, "standard_visit" if order == 1 else "quick_stop", 10), (8, 1, "quick_stop", 1)]
    assert sorted(dwell_preference(spark, str(tmp_path)).collect()) == want
