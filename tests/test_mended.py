"""Cases that earlier fixtures never held, as literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.series import Series
from tidewatch.operators import areas, bitemporal, filters, mentions, metrics, track
from tidewatch.session import shared_folder
from tidewatch.sources import landing

DAY = 86_400_000_000


def test_far_event_keeps_its_area(spark):
    aois = spark.createDataFrame([("a", 0.0, 0.0, 5000.0, 0.25)], "aoi_id string, lon double, lat double, decay_km double, weight double")
    events = spark.createDataFrame([(1, 20.0, 0.0), (2, 179.0, 5.0), (3, None, None)], "event_id long, lon double, lat double")
    got = {r.event_id: r for r in areas.area_proximity(events, aois).collect()}
    assert got[1].aoi_id == "a" and got[1].proximity == pytest.approx(math.exp(-2223.9 / 5000), abs=1e-4) and got[1].area_weight == 0.25
    assert got[2].distance_km > 19_000 and got[2].proximity > 0
    assert got[3].aoi_id is None and got[3].proximity == 0 and got[3].area_weight == 1


def test_second_load_adds_nothing(spark):
    rows = spark.createDataFrame([("m", 1 * DAY, "k1"), ("m", 2 * DAY, "k2")], "ref_id string, observed_us long, dedupe_key string")
    path = shared_folder(spark)
    first = landing.bulk_load(rows, path, "1970-01-01", "1970-01-02", {}, ["dedupe_key"], 90.0).first()
    again = landing.bulk_load(rows, path, "1970-01-01", "1970-01-02", {}, ["dedupe_key"], 90.0).first()
    assert (first.loaded_rows, first.duplicate_rows) == (2, 0) and (again.loaded_rows, again.duplicate_rows) == (0, 2)
    assert spark.read.parquet(path).count() == 2


def test_window_over_a_table_with_strays(spark):
    rows = [("m", DAY + 5, 1), ("m", 9 * DAY, 2), ("n", DAY, 3)]
    path = shared_folder(spark)
    landing.write_observations(spark.createDataFrame(rows, "ref_id string, observed_us long, obs_id long"), path, "1970-01-01", "1970-01-03")
    table = spark.read.parquet(path)
    assert {r.obs_date for r in table.collect()} == {"1970-01-02", "stray"}
    assert [r.obs_id for r in filters.entity_window(table, "m", 9 * DAY, 24 * 9).collect()] == [2, 1]
    assert [r.obs_id for r in filters.entity_window(table, "m", 2 * DAY, 24).collect()] == [1]


def test_late_change_leaves_one_version_per_time(spark):
    current = spark.createDataFrame([("a", "two", 10, None)], "id string, v string, from_us long, to_us long")
    history = spark.createDataFrame([("a", "one", 1, 10)], current.schema)
    late = spark.createDataFrame([("a", 5, "upsert", "late")], "id string, at_us long, op string, v string")
    now, past = bitemporal.apply_changes(current, history, late, "id", ["v"])
    assert [(r.v, r.from_us) for r in now.collect()] == [("two", 10)]
    assert sorted((r.v, r.from_us, r.to_us) for r in past.collect()) == [("late", 5, 10), ("one", 1, 5)]
    assert [r.v for r in bitemporal.as_of(now, past, 7).collect()] == ["late"]
    gone = spark.createDataFrame([("a", 3, "delete", None), ("a", 10, "upsert", "new")], late.schema)
    now, past = bitemporal.apply_changes(current, history, gone, "id", ["v"])
    assert [(r.v, r.from_us) for r in now.collect()] == [("new", 10)] and [(r.v, r.to_us) for r in past.collect()] == [("one", 3)]


def test_sender_at_two_places_at_once(spark):
    rows = [("m", 1000, i, i, 50.0 * (i % 2), 0.0) for i in range(4)]
    obs = spark.createDataFrame(rows, "ref_id string, observed_us long, obs_id long, arrival long, lon double, lat double")
    found = track.duplicate_senders(track.flag_jumps(obs, at="observed_us")).collect()
    assert [(r.ref_id, r.jumps) for r in found] == [("m", 3)]


def test_place_with_two_names_is_one_hit(spark):
    reports = spark.createDataFrame([(1, "Ships left New Amsterdam. A very long name of nine words in all came.")], "report_id long, text string")
    names = [("p", "New Amsterdam", 1.0, 2.0, "city"), ("p", "Old York", 1.0, 2.0, "city"), ("q", "a very long name of nine words in all", 3.0, 4.0, "exact")]
    hits = mentions.geocode(reports, spark.createDataFrame(names, "ref_id string, name string, lon double, lat double, precision string"))
    assert sorted((r.ref_id, r.place_name) for r in hits.collect()) == [("p", "new amsterdam"), ("q", "a very long name of nine words in all")]


def test_corridor_and_small_and_large_areas(spark):
    kite = [(-10.0, 0.0), (0.0, 10.0), (10.0, 0.0), (0.0, -10.0), (-10.0, 0.0)]
    rows = [
        ("lane", "corridor", None, None, 20_000.0, [(0.0, 60.0), (10.0, 60.0), (10.0, 65.0)]),
        ("berth", "circle", 4.0, 4.0, 500.0, None),
        ("sea", "polygon", None, None, None, kite),
    ]
    aois = spark.createDataFrame(rows, "aoi_id string, kind string, lon double, lat double, radius_m double, ring array<struct<lon:double,lat:double>>")
    points = [(1, 5.0, 60.1), (2, 5.0, 60.3), (3, 10.3, 63.0), (4, 4.001, 4.001), (5, 4.1, 4.0), (6, 9.0, 0.0), (7, None, 1.0)]
    got = areas.match_areas(spark.createDataFrame(points, "obs_id long, lon double, lat double"), aois).select("obs_id", "area.aoi_id")
    assert sorted(map(tuple, got.collect())) == [(1, "lane"), (3, "lane"), (4, "berth"), (4, "sea"), (5, "sea"), (6, "sea")]


def test_quantiles_interpolate_between_counted_values(spark):
    rows = [("a", 10, 1), ("a", 20, 3), ("a", 70_000, 1), ("b", None, 4), ("b", 5, 1)]
    df = spark.createDataFrame(rows, "k string, v long, n long")
    got = {r.k: (r.p50, r.p90) for r in metrics.counted_quantiles(df, ["k"], "v", {"p50": 0.5, "p90": 0.9}, 1000).collect()}
    assert got["a"] == (20.0, pytest.approx(20 + 69_980 * 0.6)) and got["b"] == (5.0, 5.0)


def test_chain_of_series_steps_reads_its_table_once(spark):
    source = shared_folder(spark)
    spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"), F.col("id").alias("v")).write.parquet(source)
    series = Series(["k"], ["t"], F.floor(F.col("t") / 10))
    df = spark.read.parquet(source)
    out = series.with_last_known(series.add(df, series.previous(["v"], "p"), series.row_number("no")), F.col("p.v"), "known")
    plan = out._jdf.queryExecution().executedPlan().toString()
    # Only written tables are left in the plan; the source was read by the first step.
    assert source not in plan and plan.count("FileScan") <= 2
    assert out.filter("known IS NULL").count() == 3


def test_no_near_duplicate_at_the_threshold_is_missed(spark):
    import random

    from tidewatch.operators import dedupe

    rnd = random.Random(24)
    sets = []
    for g in range(60):
        base = [rnd.randrange(1 << 59) for _ in range(40)]
        sets += [(f"{g}a", base), (f"{g}b", base[:30] + [rnd.randrange(1 << 59) for _ in range(10)]), (f"{g}c", base[:24]), (f"{g}d", base[:23])]
    sets += [("one", [5]), ("none", [])]
    want = {(a, b): len(set(x) & set(y)) / len(set(x) | set(y)) for a, x in sets for b, y in sets if a < b and x and y}
    want = {k: v for k, v in want.items() if v >= 0.6}
    got = dedupe.near_dupes_exact(spark.createDataFrame(sets, "id string, items array<long>"), 0.6).collect()
    assert {(r.a, r.b): r.similarity for r in got} == pytest.approx(want) and len(got) == len(want)
