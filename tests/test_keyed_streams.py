"""Keyed streaming state: timers, bounds and restarts, against plain loops."""

import random

from pyspark.sql import functions as F

from tidewatch.streaming import jobs, keyed

S = 1_000_000
HOUR, DAY = 3600 * S, 24 * 3600 * S
#: Far from zero, where a stream's clock starts.
T0 = 1_704_067_200 * S


def fed(spark, tmp_path, rows, ddl, cuts, run):
    """Rows in time order, one restart per cut."""
    at = ddl.split(",")[0].split()[0]
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = [r for r in rows if (low is None or r[0] >= low) and (high is None or r[0] < high)]
        df = spark.createDataFrame(part, ddl).withColumn("at", F.timestamp_micros(at)).coalesce(2)
        df.write.mode("append").parquet(f"{tmp_path}/in")
        run(jobs.open_stream(spark, f"{tmp_path}/in", df.schema))


def test_alerts_end_without_a_further_row(spark, tmp_path):
    h = lambda x: T0 + x * HOUR
    rows = [
        (h(0), 1, "quiet", False, None),
        (h(1), 2, "quiet", False, None),
        (h(0), 3, "expires", False, h(5)),
        (h(4), 4, "expires", False, None),
        (h(2), 5, "solved", True, None),
        (h(3), 6, "solved", False, None),
        (h(60), 7, "open", False, None),
        (h(61), 8, "clock", True, None),
    ]
    ddl = "seen_us long, alert_id long, dedupe_key string, closes boolean, expires_us long"
    run = lambda stream: keyed.run_keyed(stream, "dedupe_key", "at", "1 minute", keyed.OpenAlerts(24 * HOUR), str(tmp_path))
    fed(spark, tmp_path, rows, ddl, [h(1), h(3), h(60)], run)
    got = {(r[0], r[1]): tuple(r)[2:] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {
        ("quiet", 1): (2, h(0), h(1), h(25), "quiet"),
        ("expires", 3): (2, h(0), h(4), h(5), "expired"),
        ("solved", 5): (1, h(2), h(2), h(2), "resolved"),
        ("solved", 6): (1, h(3), h(3), h(27), "quiet"),
        ("clock", 8): (1, h(61), h(61), h(61), "resolved"),
    }
    # Only what is open takes room.
    left = keyed.stored(spark, f"{tmp_path}/checkpoint", "alert").collect()
    assert [(r.dedupe_key, r.open_alert_id) for r in left] == [("open", 7)]


def test_state_of_senders_stays_flat(spark, tmp_path):
    """New senders every day, each seen for some hours: the store holds the last days' only."""
    rnd = random.Random(2)
    rows, n = [], 0
    for day in range(8):
        for sender in range(20):
            for _ in range(rnd.randrange(1, 6)):
                n += 1
                us = T0 + day * DAY + rnd.randrange(12 * HOUR)
                rows.append([us, n, f"s{day}-{sender}", us + rnd.randrange(-60, 60) * S, float(n % 7), 1.0])
    rows.sort()
    rows = [(us, i, key, i, eff, lon, lat) for i, (us, _, key, eff, lon, lat) in enumerate(rows)]
    ddl = "ingested_us long, obs_id long, ref_id string, arrival long, effective_us long, lon double, lat double"
    sizes = []

    def run(stream):
        keyed.run_keyed(stream, "ref_id", "at", "1 hour", keyed.PreviousPosition(6 * HOUR), str(tmp_path))
        sizes.append(keyed.stored(spark, f"{tmp_path}/checkpoint", "position").count())

    fed(spark, tmp_path, rows, ddl, [T0 + 2 * DAY, T0 + 4 * DAY, T0 + 6 * DAY], run)
    assert max(sizes) <= 20 and sizes[-1] > 0
    last, want = {}, {}
    for us, i, key, _, eff, lon, lat in rows:
        prev = last.get(key)
        want[i] = prev[1:] if prev and us - prev[0] <= 6 * HOUR else (None, None, None)
        last[key] = (us, eff, lon, lat)
    got = {r.obs_id: (r.prev_us, r.prev_lon, r.prev_lat) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == want


def test_silences(spark, tmp_path):
    rnd = random.Random(3)
    rows, times = [], {}
    for key in "abcd":
        t = T0
        while t < T0 + 20 * DAY:
            t += int(rnd.expovariate(1 / (2 * HOUR))) + 1
            if key == "d" and t > T0 + 5 * DAY:
                break
            rows.append((t, key))
            times.setdefault(key, []).append(t)
    rows += rows[:50]
    rnd.shuffle(rows)
    run = lambda stream: keyed.run_keyed(stream, "source_id", "at", "1 hour", keyed.Silences(6 * HOUR), str(tmp_path))
    fed(spark, tmp_path, rows, "at_us long, source_id string", [T0 + 4 * DAY, T0 + 9 * DAY, T0 + 14 * DAY], run)
    out = spark.read.parquet(f"{tmp_path}/out")
    got = sorted(map(tuple, out.groupBy("source_id", "gap_start_us").agg(F.max("gap_end_us")).collect()), key=str)
    mark = max(t for t, _ in rows) - HOUR
    want = []
    for key, seen in times.items():
        for a, b in zip(seen, [*seen[1:], None]):
            if a + 6 * HOUR < mark and (b is None or b - a > 6 * HOUR):
                want.append((key, a, b if b is not None and b <= mark else None))
    assert got == sorted(want, key=str)
    # The source that stopped has an open row; a gap is told at most twice.
    assert [g for g in got if g[0] == "d"][-1][2] is None
    assert max(r["count"] for r in out.groupBy("source_id", "gap_start_us").count().collect()) <= 2
    # Activity is kept as stretches, not as rows.
    kept = keyed.stored(spark, f"{tmp_path}/checkpoint", "activity")
    assert kept.count() == 4 and kept.agg(F.max(F.size("starts"))).first()[0] <= 2


def test_late_rows_stand_beside_the_windows(spark, tmp_path):
    base = [(T0 + i * HOUR, "s") for i in range(40)]
    late = [(T0 + 2 * HOUR + 5, "s")]

    def run(stream):
        ontime = jobs.split_late(stream, str(tmp_path), "at_us", 600 * S)
        counted = jobs.windowed_counts(ontime.withColumn("event_type", F.lit("x")), "at", "6 hours")
        jobs.write_append(counted, f"{tmp_path}/windows")

    for part in (base[:20], base[20:] + late):
        df = spark.createDataFrame(part, "at_us long, source_id string").withColumn("at", F.timestamp_micros("at_us"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(jobs.open_stream(spark, f"{tmp_path}/in", df.schema))
    assert [r.at_us for r in jobs.late_rows(spark, str(tmp_path)).collect()] == [late[0][0]]
    windows = jobs.results(spark, f"{tmp_path}/windows").collect()
    # Each finished window once; the last hours are not finished.
    assert sorted((r.start_us, r.n) for r in windows) == [(T0 + k * 6 * HOUR, 6) for k in range(6)]
