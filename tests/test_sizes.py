"""Steps that grow with the input: what they shuffle, and the same results."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewatch.functions.series import Series
from tidewatch.operators import bitemporal, canonical, dedupe, events, mentions, movement, vector_index
from tidewatch.session import shared_folder
from tidewatch.sources import envelopes
from tidewatch.streaming import jobs

DAY = 86_400_000_000


def logical(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def metres(a, b):
    (x, y), (u, v) = ([math.radians(d) for d in p] for p in (a, b))
    h = math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2
    return 2 * 6371008.8 * math.asin(min(1.0, math.sqrt(h)))


def test_site_pairs_are_not_joined_again(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice([10.0, 10.1, 10.3, -170.0]), rnd.choice([50.0, 50.12, 50.3]), rnd.randrange(6) * DAY) for i in range(150)]
    found = events.correlate_spacetime(spark.createDataFrame(rows, "event_id long, lon double, lat double, occurred_us long"), 2 * DAY, 20.0)
    # One join finds the pairs; the counts of both sites come with it.
    assert logical(found).count("Join Inner") == 1
    sites = {}
    for i, lon, lat, at in rows:
        sites.setdefault((lon, lat, at), []).append(i)
    want = {}
    for a, own in sites.items():
        for b, other in sites.items():
            if min(own) <= min(other) and abs(a[2] - b[2]) <= 2 * DAY and metres(a[:2], b[:2]) <= 20_000:
                n = len(own) * (len(own) - 1) // 2 if a == b else len(own) * len(other)
                if n:
                    want[min(own), min(other)] = n
    assert {(r.site_a, r.site_b): r.event_pairs for r in found.collect()} == want


def walkers(seed, entities, buckets):
    """Slow walks over cell borders; some rows missing."""
    rnd = random.Random(seed)
    rows = []
    for e in range(entities):
        lon, lat = rnd.choice([0.2, 0.3, 179.95]) + rnd.uniform(-0.05, 0.05), 50.0 + rnd.uniform(-0.05, 0.05)
        for t in range(buckets):
            lon, lat = lon + rnd.uniform(-0.02, 0.02), lat + rnd.uniform(-0.02, 0.02)
            if rnd.random() < 0.97:
                rows.append((f"e{e}", len(rows), t * 1000 + rnd.randrange(1000), (lon + 180) % 360 - 180, lat))
    return rows


OBS = "ref_id string, obs_id long, observed_us long, lon double, lat double"


def test_meetings_over_cells_and_pieces(spark):
    rows = walkers(3, 12, 150)
    spots = {(r[0], r[2] // 1000): r[3:] for r in rows}
    want = set()
    for a in {r[0] for r in rows}:
        for b in {r[0] for r in rows if r[0] > a}:
            run = []
            for t in range(151):
                here = (a, t) in spots and (b, t) in spots and metres(spots[a, t], spots[b, t]) <= 9_000
                run = run + [t] if here else run
                if not here:
                    if len(run) >= 2:
                        want.add((a, b, run[0] * 1000, (run[-1] + 1) * 1000, round(min(metres(spots[a, u], spots[b, u]) for u in run), 3)))
                    run = []
    found = movement.rendezvous(spark.createDataFrame(rows, OBS), 9_000.0, 1000, 2)
    assert {(r.from_ref, r.to_ref, r.from_us, r.to_us, round(r.closest_m, 3)) for r in found.collect()} == want
    assert len(want) > 50 and max(w[3] - w[2] for w in want) >= 15_000


def test_meetings_are_not_shuffled_by_bucket(spark, monkeypatch):
    rows = [(f"e{e}", 500 * e + t, t * 1000, 10.01, 50.01) for e in range(2) for t in range(500)]
    seen, add = [], Series.add

    def counted(self, df, *parts):
        if list(self.key) == ["a", "b"]:
            seen.append(df.count())
        return add(self, df, *parts)

    monkeypatch.setattr(Series, "add", counted)
    got = movement.rendezvous(spark.createDataFrame(rows, OBS), 9_000.0, 1000, 2).collect()
    assert [(r.buckets, r.from_us, r.to_us) for r in got] == [(500, 0, 500_000)]
    assert seen and max(seen) < 20


def test_series_cuts_busy_keys_only(spark):
    rnd = random.Random(6)
    rows = [("hot" if rnd.random() < 0.4 else f"k{rnd.randrange(30)}", rnd.randrange(5000), i, rnd.choice([None, i])) for i in range(600)]
    df = spark.createDataFrame([*rows, (None, 5, 601, 1), (None, 6, 602, None)], "key string, t long, id long, v long")
    got = []
    for busy in (0, 30, 10_000):
        s = Series(["key"], ["t", "id"], F.floor(F.col("t") / 700).cast("long"), busy)
        parts = [s.previous(["id"], "p"), s.next(["id"], "n"), s.row_number("no"), s.last_known(F.col("v"), "known")]
        out = s.add(df.filter("key IS NOT NULL") if busy == 0 else df, *parts)
        got.append({r.id: (r.p and r.p.id, r.n and r.n.id, r.no, r.known) for r in out.collect()})
    assert got[1] == got[2] and {k: v for k, v in got[1].items() if k < 600} == got[0]
    assert got[2][602] == (601, None, 2, 1)


def test_versions_take_one_shuffle(spark):
    """Two steps by one key, and the count by it, after one exchange."""
    rows = [(i % 40, i * DAY, f"s{i % 3}") for i in range(200)]
    versions = bitemporal.build_versions(spark.createDataFrame(rows, "object_id long, changed_us long, status string"), "object_id", "changed_us")
    audit = bitemporal.audit_versions(versions, "object_id")
    assert audit._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert [(r.versions, r.gaps, r.overlaps, r.open_ends, r.empty) for r in audit.collect()] == [(5, 0, 0, 1, 0)] * 40


def test_simhash_shuffles_sums_not_words(spark):
    rows = [(1, "a b b c c c"), (2, "c c c b b a"), (3, "x"), (4, "")]
    found = dedupe.simhash(spark.createDataFrame(rows, "report_id long, text string"))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1

    def want(words):
        votes = [0] * 64
        for w in words:
            bits = int(hashlib.md5(w.encode()).hexdigest()[:16], 16)
            votes = [v + (1 if bits >> i & 1 else -1) for i, v in enumerate(votes)]
        return sum(1 << i for i, v in enumerate(votes) if v > 0)

    assert {r.report_id: r.hi << 32 | r.lo for r in found.collect()} == {i: want(t.split()) for i, t in rows if t}


def test_ingest_writes_few_files_per_day(spark):
    folder = shared_folder(spark)
    lines = spark.range(0, 4000, numPartitions=4).select(F.format_string('{"id":%d}', "id").alias("value"))
    lines.write.parquet(f"{folder}/in")

    def normalize(rows):
        found = rows.select(F.get_json_object("value", "$.id").cast("long").alias("id"))
        return found.select("id", F.sha2(F.col("id").cast("string"), 256).alias("dedupe_key"), F.floor(F.col("id") / 100).alias("block"))

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        jobs.ingest(jobs.open_stream(spark, f"{folder}/in", lines.schema), folder, normalize, "block")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    silver = spark.read.parquet(f"{folder}/silver")
    assert silver.count() == 4000 and silver.select("block").distinct().count() == 40
    # A file per day, and one more for each border between tasks; each of 4 tasks had one of every day.
    assert len(silver.inputFiles()) <= 44


def test_near_copies_are_compared_in_blocks(spark, monkeypatch):
    # Many near copies of one text, each with changes of its own: sets are sent per block, not per pair.
    monkeypatch.setattr(dedupe, "BLOCK_SETS", 8)
    rnd = random.Random(11)
    base = [rnd.randrange(1 << 59) for _ in range(60)]
    sets = [(i, rnd.sample(base, 55) + [1000 + i]) for i in range(40)] + [(100 + i, rnd.sample(base, 30)) for i in range(20)]
    df = spark.createDataFrame(sets, "id long, items array<long>")
    alike = {(a, b): len(set(x) & set(y)) / len(set(x) | set(y)) for a, x in sets for b, y in sets if a < b}
    want = {k: v for k, v in alike.items() if v >= 0.6}
    got = dedupe.near_dupes_exact(df, 0.6)
    assert {(r.a, r.b): r.similarity for r in got.collect()} == want
    # Neither the whole items nor the classes are joined to pairs.
    plan = logical(got)
    assert "FlatMapCoGroups" in plan and "items" not in plan


def test_text_sets_travel_as_one_string_and_keep_their_hashes(spark):
    texts = [(1, "One two, three four five six"), (2, "one TWO three four five SIX!"), (3, "a b"), (4, "..."), (5, None), (6, "x " * 3000 + "ä ö ß 9")]
    df = spark.createDataFrame(texts, "report_id long, text string")
    assert "items" not in dedupe.fold_copies(df).columns
    got = {r.id: (r.members, set(r["items"])) for r in dedupe.content_sets(df).collect()}

    def runs(words):
        return {int(hashlib.md5(" ".join(words[i : i + 5]).encode()).hexdigest()[:15], 16) for i in range(max(1, len(words) - 4))}

    assert got == {
        1: (2, runs("one two three four five six".split())),
        3: (1, runs(["a", "b"])),
        4: (1, set()),
        5: (1, set()),
        6: (1, runs(["x"] * 3000 + ["ä", "ö", "ß", "9"])),
    }


def test_minhash_over_slices(spark, monkeypatch):
    rnd = random.Random(12)
    sets = [(i, [rnd.randrange(1 << 60) for _ in range(rnd.choice([1, 2, 30, 200]))]) for i in range(60)] + [(99, [])]
    values = [x for _, s in sets for x in s]
    out = {}
    for size in (7, 1 << 20):
        step = dedupe._least_permuted([dedupe.permutation(i) for i in range(3)])
        monkeypatch.setattr(dedupe, "SLICE_ITEMS", size)
        batch = pa.RecordBatch.from_arrays([pa.array([i for i, s in sets if s]), pa.array([s for _, s in sets if s])], names=["id", "items"])
        out[size] = {i: m for b in step([batch]) for i, m in zip(b["id"].to_pylist(), b["least"].to_pylist())}
    assert values and out[7] == out[1 << 20]
    for i, s in sets:
        if s:
            assert out[7][i] == [min((x % dedupe.PRIME * a + c) % dedupe.PRIME for x in s) for a, c in map(dedupe.permutation, range(3))]
    found = dedupe.minhash_bands(spark.createDataFrame(sets, "id long, items array<long>"))
    assert {r.id for r in found.collect()} == {i for i, s in sets if s} and "Generate explode(items" not in logical(found)


def test_probes_are_handed_on_in_bounded_batches():
    rnd = np.random.default_rng(5)
    vectors, centroids = rnd.normal(size=(300, 8)), vector_index._unit(rnd.normal(size=(100, 8)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(vectors.tolist(), pa.list_(pa.float64()))], names=["id", "embedding"])
    for probes in (1, 7, 100):
        out = list(vector_index._nearest_batches(centroids, probes, "id", [batch]))
        assert max(b.num_rows for b in out) <= vector_index.BLOCK_ROWS
        got = {}
        for b in out:
            for no, i in zip(b["list_no"].to_pylist(), b["id"].to_pylist()):
                got.setdefault(i, set()).add(no)
        best = np.argsort(-(vector_index._unit(vectors) @ centroids.T), axis=1)[:, :probes]
        assert got == {i: set(row.tolist()) for i, row in enumerate(best)}


def test_mentions_are_handed_on_in_bounded_batches():
    automaton = mentions.Automaton([("red", "sea"), ("sea",)])
    texts = ["Red sea, " * 9000, "no", "the sea"]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(texts)], names=["report_id", "text"])
    out = list(mentions.mention_batches(automaton, [batch]))
    assert max(b.num_rows for b in out) <= mentions.OUT_ROWS and sum(b.num_rows for b in out) == 18_001
    rows = [r for b in out for r in b.to_pylist()]
    assert rows[-1] == {"report_id": 3, "phrase": "sea", "mention_no": 1, "char_start": 4, "char_end": 7}
    assert max(r["mention_no"] for r in rows if r["phrase"] == "red sea") == 9000


def test_ids_nobody_reads_are_not_hashed(spark, tmp_path):
    spark.createDataFrame([('{"MessageType": "PositionReport"}', 1)], "value string, fetched_us long").write.parquet(str(tmp_path / "lines"))
    good, _ = envelopes.read_envelopes(spark.read.parquet(str(tmp_path / "lines")))
    parsed = envelopes.parse_envelopes(good)
    for rows in (canonical.ais_observations(parsed), canonical.ais_entities(parsed)):
        assert "sha2" not in logical(rows.agg(F.count("*"))) and logical(rows).count("sha2(") <= 2


def test_groups_of_shared_entities_are_made_once(spark):
    rnd = random.Random(21)
    sets = {e: frozenset(rnd.sample(["all", *(f"r{i}" for i in range(14))], rnd.randrange(1, 6))) for e in range(160)}
    rows = [(e, r, "actor") for e, s in sets.items() for r in s]
    found = events.correlate_shared(spark.createDataFrame(rows, "event_id long, ref_id string, role string"), 0.6)
    # Neither the sets nor their order by rarity are computed again for the other side.
    assert "collect" not in logical(found)
    groups = {}
    for e, s in sets.items():
        groups.setdefault(s, []).append(e)
    want = {(min(g), min(g), len(s), 1.0, len(g) * (len(g) - 1) // 2) for s, g in groups.items() if len(g) > 1}
    for s, g in groups.items():
        for t, h in groups.items():
            if min(g) < min(h) and len(s & t) / len(s | t) >= 0.6:
                want.add((min(g), min(h), len(s & t), round(len(s & t) / len(s | t), 9), len(g) * len(h)))
    got = [(r.id_a, r.id_b, r.shared, round(r.similarity, 9), r.event_pairs) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)


def test_a_shingle_travels_as_its_set_and_itself(spark):
    rnd = random.Random(13)
    sets = [(i, rnd.sample(range(60), rnd.randrange(1, 9))) for i in range(50)] + [(90, []), (91, [1000]), (92, None)]
    classes = dedupe.shared_classes(spark.createDataFrame(sets, "id long, items array<long>"))
    sent = []

    def walk(node):
        if node.nodeName() == "RepartitionByExpression":
            sent.append(node.output().size())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(classes._jdf.queryExecution().optimizedPlan())
    # The size of a set comes once, not with each shingle; the second shuffle is of shared shingles only.
    assert min(sent) == 2
    members = {}
    for i, s in sets:
        for x in s or []:
            members.setdefault(x, set()).add(i)
    want = {}
    for i, s in sets:
        for x in s or []:
            if len(members[x]) > 1:
                key = (i, len(s), frozenset(members[x]))
                want[key] = want.get(key, 0) + 1
    got = classes.collect()
    assert sorted((r.id, r.size, r.n, r.weight) for r in got) == sorted((i, n, len(m), w) for (i, n, m), w in want.items())
    for r in got:
        assert r.before == sum(1 for x in dict(sets)[r.id] if len(members[x]) == 1) + sum(o.weight for o in got if o.id == r.id and (o.n, o["class"]) < (r.n, r["class"]))
