"""Golden vectors and edge cases of the operators."""

import json

import pytest
from pyspark.sql import functions as F

from cartulary.functions import geo
from cartulary.functions import scalars as S
from cartulary.operators import limits, lookup
from cartulary.sources import documents, provider


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_golden_scores(spark):
    km = S.haversine_km(*(F.lit(x) for x in (51.5007, -0.1246, 48.8584, 2.2945)))
    assert one(spark, F.round(km, 6))[0] == 340.538920
    assert one(spark, *(S.location_score(F.lit(float(k))) for k in (0, 1, 88, 340.53892, 1500, 20015.086796))) == (5000, 4997, 4715, 3985, 1839, 0)
    assert one(spark, *(S.time_score(F.lit(d), F.lit(t)) for d, t in ((0, 15), (-9, 15), (111, 15), (500, 200)))) == (5000, 2744, 3, 410)


def test_roman_years_longitudes(spark):
    assert one(spark, *(S.roman(F.lit(n)) for n in (1, 4, 9, 10, 14, 40))) == ("I", "IV", "IX", "X", "XIV", "XXXX")
    assert one(spark, *(S.format_year(F.lit(y)) for y in (-44, 0, 1066))) == ("44 BCE", "0 CE", "1066 CE")
    assert one(spark, *(S.wrap_longitude(F.lit(x)) for x in (-540, -181, -180, 180, 181, 540))) == (-180, 179, -180, -180, -179, -180)


def test_permutation_is_a_bijection(spark):
    assert sorted(one(spark, S.permutation(F.lit(158), 44))[0]) == list(range(44))


def test_image_scores(spark):
    cases = [(1.0, "image/jpeg", 1600, 1200, 0, 18.707310), (0.0, "image/jpeg", 6000, 4000, 1, 13.763127), (1.0, "image/png", 1600, 1200, 2, 14.207310), (0.0, "image/jpeg", None, None, 3, 10.686069)]
    for rel, mime, w, h, i, want in cases:
        got = one(spark, F.round(S.image_score(F.lit(rel), F.lit(mime), F.lit(w).cast("int"), F.lit(h).cast("int"), F.lit(i)), 6))[0]
        assert got == want


def test_junk_bounds_are_ascii(spark):
    titles = {"old map": True, "mapuche": False, "émap": True, "flagship": False, "cadastral": True, "emblematic": True, "Timeline x": True, "family tree": True, "plan_x": False}
    got = one(spark, *(S.is_junk(F.lit(t)) for t in titles))
    assert got == tuple(titles.values())


def test_inverse_projection(spark):
    x, y, near = S.orthographic(F.lit(12.0), F.lit(34.0), F.lit(30.0), F.lit(20.0))
    lat, lng = S.orthographic_inverse(x, y, F.lit(30.0), F.lit(20.0))
    assert one(spark, F.round(lat, 6), F.round(lng, 6), near) == (12.0, 34.0, True)
    assert one(spark, *S.orthographic_inverse(F.lit(0.9), F.lit(0.9), F.lit(0.0), F.lit(0.0))) == (None, None)


def test_limiter_edges(spark):
    rows = [(1, 0, 1), (1, 10, 2), (1, 59, 3), (1, 60, 4), (1, 60, 5)]
    got = limits.rate_limit(spark.createDataFrame(rows, "key long, at long, id long"), window_us=60, per_key=2).orderBy("id")
    assert [r.outcome for r in got.collect()] == ["ok", "ok", "key", "ok", "key"]


def test_limiter_never_admits_more(spark):
    rows = [(i % 3, i * 7 % 500, i) for i in range(400)]
    got = limits.rate_limit(spark.createDataFrame(rows, "key long, at long, id long"), window_us=50, per_key=4, overall=9).where("outcome = 'ok'").collect()
    times = sorted(r["at"] for r in got)
    assert all(b - a >= 50 for a, b in zip(times, times[9:]))


def test_debounce_null_cancels(spark):
    rows = [(1, 0, 1, "a"), (1, 5, 2, "b"), (1, 100, 3, "c"), (1, 105, 4, None)]
    assert [r.value for r in limits.debounce(spark.createDataFrame(rows, "key long, at long, id long, value string"), gap_us=50).collect()] == ["b"]


def test_greedy_is_distinct(spark):
    got = lookup.greedy_distinct(spark.createDataFrame([(1, [[1, 2], [1, 2], [1, 2], [3]])], "group int, queries array<array<bigint>>")).first()
    assert got.picks == [1, 2, None, 3]


def test_alias_shadows_exact_name(spark):
    index = lookup.name_index(spark.createDataFrame([("Korea", 0), ("US", 1), ("United States", 2), ("", 3), ("us", 4)], "name string, ordinal int"))
    asked = spark.createDataFrame([(" US ",), ("kor",), ("states",), ("",), ("none",)], "query string")
    got = {r["query"]: r["name"] for r in lookup.resolve_names(asked, index, spark.createDataFrame([("us", "united states")], "alias string, target string")).collect()}
    assert got == {" US ": "United States", "kor": "Korea", "states": "United States", "": None, "none": None}


def test_providers(spark):
    def broken(key):
        if key == "t":
            raise TimeoutError
        return ("not json", None) if key == "j" else provider.fixture(key)

    rows = {r["key"]: r["error"] for r in provider.enrich(spark.createDataFrame([(k,) for k in ("t", "j", "a", "a", "x7", None)], "key string"), broken).collect()}
    assert rows == {"t": "timeout", "j": "bad json", "a": None, "x7": "quota"}
    provider.register(spark)
    found = spark.read.format("keyed_provider").option("provider", "fixture").option("keys", json.dumps(["a", "b7"])).load().orderBy("key").collect()
    assert [(r["key"], r["error"]) for r in found] == [("a", None), ("b7", "quota")]


def test_geojson_to_countries(spark, tmp_path):
    square = [[[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], [[4, 4], [6, 4], [6, 6], [4, 6], [4, 4]]]
    feature = {"type": "Feature", "properties": {"ADMIN": "A", "SUBREGION": "s", "CONTINENT": "c"}, "geometry": {"type": "Polygon", "coordinates": square}}
    (tmp_path / "f.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature, {**feature, "geometry": {"type": "MultiPolygon", "coordinates": [square, [[[20, 0], [30, 0], [30, 10]]]]}}]}))
    v = documents.vertices(documents.features(spark, str(tmp_path / "f.json")))
    points = spark.createDataFrame([(1, 2.0, 2.0), (2, 5.0, 5.0), (3, 29.0, 1.0), (4, 50.0, 50.0)], "id int, lng double, lat double")
    assert {r["id"]: r["feature"] for r in geo.in_polygons(points, v).collect()} == {1: 0, 3: 1}
    assert [r["ring"] for r in geo.ring_centres(v).orderBy("feature").collect()] == [0, 0]


@pytest.mark.parametrize("name", ["daily_counts", "single_flight"])
def test_streams_run(spark, tmp_path, name):
    from cartulary.streaming import events

    rows = spark.createDataFrame([(i % 3, i, str(i)) for i in range(30)], "key long, s long, value string").selectExpr("key", "timestamp_seconds(s * 3600) as ts", "s as id", "value")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = getattr(events, name)(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert spark.table(name).count() >= 1


def test_stream_limiter_equals_batch(spark, tmp_path):
    from cartulary.streaming import events

    rows = spark.createDataFrame([(i % 3, 1_000_000 + i * 7 % 100, i) for i in range(120)], "key long, s long, id long").selectExpr("key", "timestamp_seconds(s) as ts", "id")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    # A late call moves the watermark past all others.
    spark.createDataFrame([(9, 1_010_000, 999)], "key long, s long, id long").selectExpr("key", "timestamp_seconds(s) as ts", "id").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = events.rate_limit(stream, window_us=20_000_000, per_key=3, watermark="1000 seconds").writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    want = limits.rate_limit(rows.selectExpr("key", "unix_micros(ts) as at", "id"), window_us=20_000_000, per_key=3).where("id <> 999")
    assert sorted(map(tuple, spark.table("limited").where("id <> 999").collect())) == sorted(map(tuple, want.collect()))
