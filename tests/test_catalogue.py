"""Sinks, merges and catalogue helpers on small tables."""

from pyspark.sql import functions as F

from placelens.operators import catalogue as K
from placelens.operators import relational as R
from placelens.sources.sinks import Versions, append, bulk_copy, profile_sink, write_artifact


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_upsert_takes_the_latest_and_can_set_nulls(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, v string, at int")
    new = spark.createDataFrame([(2, "c", 7), (2, None, 8), (3, "d", 9)], "k int, v string, at int")
    assert rows(R.upsert(old, new, ["k"], latest=[F.desc("at")]), "k", "v", "at") == [(1, "a", 5), (2, "b", 8), (3, "d", 9)]
    got = {r["k"]: r["v"] for r in R.upsert(old, new, ["k"], latest=[F.desc("at")], set_nulls=True).collect()}
    assert got == {1: "a", 2: None, 3: "d"}


def test_versions_merge_and_insert(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"))
    assert table.read() is None
    make = lambda *r: spark.createDataFrame(list(r), "k int, v string, at int")
    table.upsert(make((1, "a", 1), (1, "b", 2)), ["k"], latest=[F.desc("at")])
    table.upsert(make((2, "c", 3)), ["k"])
    table.insert_new(make((2, "x", 4), (3, "d", 5)), ["k"])
    assert rows(table.read(), "k", "v") == [(1, "b"), (2, "c"), (3, "d")]
    bulk_copy(make((4, "e", 1), (5, "f", 1)), table, ["k"], most=1)
    assert rows(table.read(), "k")[-1] == (4,)
    sink = profile_sink(str(tmp_path / "t"), ["k"], F.desc("at"))
    for _ in range(2):  # a batch that comes twice
        sink(make((1, "z", 9), (1, "y", 8)), 0)
    assert rows(table.read(), "k", "v")[0] == (1, "z")


def test_append_and_artifacts(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("a",)], "v string")
    for _ in range(2):
        append(df, str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).select("id").distinct().count() == 4
    write_artifact(df, str(tmp_path / "j"), single=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_small_helpers(spark):
    d = spark.createDataFrame([(["a", "b"], ["b"], None, "190,5", "7")], "must array<string>, no array<string>, lat double, Lat2 string, lng string")
    where = K.location({"lat": [F.col("lat"), F.lit(16.0)], "lon": [F.col("lng")]})
    r = d.select(K.overlap(F.col("must"), F.col("no")).alias("o"), K.history(F.lit("b"), F.col("must")).alias("h"), where.alias("p"), K.location({"lat": [F.lit(95.0)], "lon": [F.lit(1.0)]}).alias("q")).first()
    assert r["o"] == ["b"] and r["h"] == ["b", "a"] and tuple(r["p"]) == (16.0, 7.0) and r["q"] is None
    assert [K.stop_limit(m, 5) for m in (None, 0, 120, 210, 330, 331)] == [5, 5, 2, 3, 4, 5]
    stops = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12)], "trip_id int, position int, poi_id int")
    got = K.renumbered(stops, stops.where("poi_id = 11").select("trip_id", "poi_id"), spark.createDataFrame([(1, 1, 13)], "trip_id int, position int, poi_id int"))
    assert rows(got, "position", "poi_id") == [(1, 10), (2, 12), (3, 13)]
    at = spark.createDataFrame([(1, "2026-01-01 00:00:00"), (2, "2026-01-01 05:00:00"), (3, None)], "k int, t string").select("k", F.to_timestamp("t").alias("updated_at"))
    assert rows(K.stale(at, F.to_timestamp(F.lit("2026-01-01 07:00:00"))), "k") == [(1,), (3,)]
    assert rows(K.collection(stops, {"trip_id": 1}, 5, 2, [F.desc("position")]), "position") == [(2,), (3,)]
    roads = spark.createDataFrame([('"100A Lê Đại Hành, P. X"',), ("K12/5 Ông Ích Khiêm",), ("Số 4 AB",), (None,)], "a string").select(K.address_road(F.col("a")).alias("r"))
    assert [r["r"] for r in roads.collect()] == ["Lê Đại Hành", "Ông Ích Khiêm", None, None]


def test_place_issues_in_order(spark):
    from placelens.sources.tables import CANONICAL_COLUMNS

    made = {"Global_ID": "g", "City_ID": "da-nang", "Entity_Type": "poi", "Restaurant Name": "n", "Lat": "15.0", "Lon": "108.2"}
    raw = [tuple((made | x).get(c) for c in CANONICAL_COLUMNS) for x in ({}, {"Entity_Type": "void", "Restaurant Name": "nan", "Lat": "x"}, {"Lat": "16,05"})]
    got = [(r["issues"], r["valid"]) for r in K.normalize_places(spark.createDataFrame(raw, ", ".join(f"`{c}` string" for c in CANONICAL_COLUMNS))).collect()]
    assert got == [(["outside_da_nang_bbox"], True), (["non_poi_entity_type", "missing_name", "invalid_coordinates"], False), ([], True)]
