"""Stored partitions past their limit, stop words, and equal times of one object."""

import os
from datetime import date, timedelta

from tidewatch.operators import bitemporal, quality, search
from tidewatch.session import shared_folder
from tidewatch.sources import landing

DAY = 86_400_000_000


def _files(path):
    return {f"{os.path.basename(d)}/{f}" for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_expired_partitions_are_dropped_and_only_touched_ones_rewritten(spark):
    # Today is day 100: the limit is 90 days, and 20 for the strict source.
    rows = [("lax", "m", i, d * DAY + 5) for i, d in enumerate([2, 9, 10, 50, 70, 85, 99])]
    rows += [("strict", "n", 10 + i, d * DAY + 5) for i, d in enumerate([9, 50, 60, 79, 80, 99])]
    rows += [("lax", "m", 30, 400 * DAY), ("strict", "n", 31, 1 * DAY), ("none", "o", 32, 50 * DAY)]
    path = shared_folder(spark)
    schema = "source_id string, ref_id string, obs_id long, observed_us long"
    landing.write_observations(spark.createDataFrame(rows, schema), path, "1970-01-03", "1970-04-20")
    sources = spark.createDataFrame([("lax", None), ("strict", 20)], "source_id string, retention_days int")
    before = _files(path)
    got = sorted((r.obs_date, r.action, r.n) for r in quality.drop_expired(spark, path, sources, 100 * DAY + 7).collect())
    day = lambda n: str(date(1970, 1, 1) + timedelta(n))
    assert got == sorted([(day(2), "dropped", None), (day(9), "dropped", None), (day(50), "rewritten", 1), (day(60), "rewritten", 1), (day(79), "rewritten", 1), ("stray", "rewritten", 1)])
    kept = {r.obs_id for r in spark.read.parquet(path).collect()}
    limit = {"lax": 90, "strict": 20, "none": 90}
    assert kept == {i for s, _, i, at in rows if at // DAY >= 100 - limit[s]}
    same = lambda files: {f for f in files if f.split("/")[0] in {f"obs_date={day(n)}" for n in (10, 70, 80, 85, 99)}}
    assert same(_files(path)) == same(before) != set()
    assert quality.drop_expired(spark, path, sources, 100 * DAY).count() == 0


def test_purge_dates(spark):
    rows = spark.createDataFrame([(1, True, 5), (2, True, 50), (3, True, None), (4, False, None), (5, False, 10), (6, None, None)], "id int, personal boolean, purge_us long")
    assert {r.id: r.verdict for r in quality.purge_due(rows, 10, "id").collect()} == {1: "purge", 3: "undated", 5: "purge"}


def test_stop_words_are_no_query_words(spark):
    reports = spark.createDataFrame([(1, "a port", "ship of the line", "en"), (2, "x", "ship", "de")], "report_id int, title string, text string, lang string")
    words = search.stop_words(spark, "english")
    assert "the" in words and search.stop_words(spark, "simple") == []
    assert [r.report_id for r in search.search(reports, "The SHIP at", lang="english", drop=words).collect()] == [1]
    assert search.search(reports, "The SHIP at", lang="english").count() == 0
    nothing = search.search(reports, "the of", drop=words)
    assert nothing.count() == 0 and "score" in nothing.columns


def test_equal_times_are_numbered_alike_in_every_run(spark):
    rows = [("a", 5, f"s{i}", {"k": i}) for i in range(6)] + [("a", 9, "last", None)]
    schema = "id string, at_us long, v string, m map<string,int>"
    runs = [bitemporal.build_versions(spark.createDataFrame(r, schema).repartition(n), "id", "at_us").collect() for r, n in ((rows, 1), (rows[::-1], 3))]
    first, second = ({r.v: (r.version, r.from_us, r.to_us) for r in run} for run in runs)
    assert first == second and first["last"] == (7, 9, None) and sorted(v[0] for v in first.values()) == list(range(1, 8))
