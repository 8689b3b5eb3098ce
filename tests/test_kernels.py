"""Kernels against plain windows and brute force, with a hot key."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.functions import geo, series, text
from tidewatch.operators import dedupe, movement, score, similarity


def hot_rows(n=600, seed=3):
    rnd = random.Random(seed)
    return [("hot" if rnd.random() < 0.4 else f"k{rnd.randrange(9)}", t * rnd.choice([1, 1, 50]), i, rnd.choice([None, i]))
            for i, t in enumerate(sorted(rnd.randrange(5000) for _ in range(n)))]


def test_series_equals_plain_windows(spark):
    df = spark.createDataFrame(hot_rows(), "key string, t long, id long, v long")
    s = series.Series(["key"], ["t", "id"], F.floor(F.col("t") / 700).cast("long"))
    w = Window.partitionBy("key").orderBy("t", "id")
    full = w.rowsBetween(Window.unboundedPreceding, 0)
    plain = df.select(
        "id", F.lag("id").over(w).alias("prev"), F.lead("id").over(w).alias("next"), F.row_number().over(w).cast("long").alias("no"),
        F.last("v", ignorenulls=True).over(full).alias("known"),
    )
    got = s.with_last_known(s.with_row_number(s.with_next(s.with_previous(df, ["id"], "p"), ["id"], "n"), "no"), F.col("v"), "known")
    got = got.select("id", F.col("p.id").alias("prev"), F.col("n.id").alias("next"), "no", "known")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_ranks_with_ties(spark):
    rnd = random.Random(5)
    rows = [(f"g{rnd.randrange(2)}", rnd.choice([0.1, 0.5, 0.5, 0.9]), i) for i in range(203)]
    df = spark.createDataFrame(rows, "g string, p double, id long")
    w, v = Window.partitionBy("g").orderBy(F.desc("p")), Window.partitionBy("g").orderBy(F.desc("p"), "id")
    plain = df.select("id", F.rank().over(w), F.dense_rank().over(w), F.row_number().over(v), F.ntile(4).over(v))
    got = score.rank_priority(df, "g", "p", "id").select("id", "rank_no", "dense_rank_no", "row_no", "tile")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_similar_sets_is_exact(spark):
    rnd = random.Random(7)
    # Item 0 is in almost every set: it must not blow up, nor hide a pair.
    sets = {i: {0} | {rnd.randrange(1, 14) for _ in range(rnd.randrange(1, 6))} for i in range(80)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, items array<long>")
    for threshold in (0.5, 0.8):
        want = {
            (a, b) for a in sets for b in sets
            if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold - 1e-9
        }
        got = {(r.id_a, r.id_b) for r in similarity.similar_sets(df, None, threshold).collect()}
        assert got == want


def test_connected_components_with_hub(spark):
    edges = [(0, i) for i in range(2, 40)] + [(100 + i, 101 + i) for i in range(30)] + [(500, 499)]
    got = dict(map(tuple, similarity.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[i] for i in range(2, 40)} == {0} and {got[100 + i] for i in range(31)} == {100} and got[500] == 499


def test_pointers_and_cycles(spark):
    rows = [(i, i - 1) for i in range(1, 20)] + [(100, 101), (101, 102), (102, 100), (200, 101)]
    got = {r.id: (r.root, r.in_cycle) for r in similarity.follow_pointers(spark.createDataFrame(rows, "id long, next long")).collect()}
    assert all(got[i] == (0, False) for i in range(1, 20))
    assert all(got[i] == (100, True) for i in (100, 101, 102, 200))


def test_simhash_pairs_are_complete(spark):
    rnd = random.Random(11)
    base = [rnd.getrandbits(64) for _ in range(12)]
    hashes = [(i, h) for i, h in enumerate(base + [h ^ sum(1 << rnd.randrange(64) for _ in range(3)) for h in base for _ in range(3)])]
    df = spark.createDataFrame([(i, h >> 32, h & 0xFFFFFFFF) for i, h in hashes], "report_id long, hi long, lo long")
    distinct = {}
    for i, h in hashes:
        distinct.setdefault(h, i)
    want = {(i, j) for h, i in distinct.items() for g, j in distinct.items() if i < j and (h ^ g).bit_count() <= 3}
    assert {(r.id_a, r.id_b) for r in dedupe.near_dupes_simhash(df, 3).collect()} == want


def test_cover_circle_misses_nothing(spark):
    rnd = random.Random(2)
    centres = [(179.9, 10.0, 90_000.0), (0.0, 89.5, 200_000.0), (-30.0, -60.0, 500_000.0), (12.0, 48.0, 3_000.0)]
    rows = []
    for i, (lon, lat, r) in enumerate(centres):
        for _ in range(150):
            rows.append((i, lon, lat, r, ((lon + rnd.uniform(-8, 8) + 540) % 360) - 180, max(-90.0, min(90.0, lat + rnd.uniform(-6, 6)))))
    df = spark.createDataFrame(rows, "c int, lon double, lat double, r double, x double, y double")
    near = geo.haversine_m(F.col("lon"), F.col("lat"), F.col("x"), F.col("y")) <= F.col("r")
    covered = F.array_contains(geo.cover_circle(F.col("lon"), F.col("lat"), F.col("r"), 2.0), geo.grid_cell(F.col("x"), F.col("y"), 2.0))
    assert df.filter(near).count() > 20 and df.filter(near & ~covered).count() == 0


def test_boxes():
    wrap = geo.Box(170, -10, -170, 10)
    assert wrap.split() == [geo.Box(170, -10, 180.0, 10), geo.Box(-180.0, -10, -170, 10)]
    assert geo.Box(175, 0, 179, 1).expand(2) == [geo.Box(173, 0 - 2, 180.0, 3), geo.Box(-180.0, -2, -179, 3)]


def test_simplified_line_stays_within_tolerance(spark):
    import numpy as np

    rnd = random.Random(4)
    points = [("t", i, i * 1000, 10 + i * 0.001, 50 + rnd.uniform(0, 0.02)) for i in range(300)]
    df = spark.createDataFrame(points, "track_id string, obs_id long, observed_us long, lon double, lat double")
    kept = sorted(r.obs_id for r in movement.simplify_tracks(df, 400.0, segment_us=64_000).collect())
    assert kept[0] == 0 and kept[-1] == 299 and len(kept) < 300
    k = movement.METRES_PER_DEGREE
    xy = {i: np.array([(lon - 10) * k * np.cos(np.radians(50.01)), (lat - 50) * k]) for _, i, _, lon, lat in points}
    for lo, hi in zip(kept, kept[1:]):
        d = xy[hi] - xy[lo]
        for i in range(lo + 1, hi):
            t = np.clip(np.dot(xy[i] - xy[lo], d) / np.dot(d, d), 0, 1)
            assert np.linalg.norm(xy[i] - xy[lo] - t * d) <= 404.0


def test_canonical_url(spark):
    urls = ["HTTP://A.example.COM/x?utm_source=f&page=2#top", "https://b.example.org/Y", "not a url"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(text.canonical_url(F.col("u"))).collect()] == [
        "http://a.example.com/x?page=2", "https://b.example.org/Y", "not a url",
    ]
