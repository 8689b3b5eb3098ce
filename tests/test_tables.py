"""Landing, versions, rules and plan shapes."""

import glob

import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from tidewatch.functions import ids
from tidewatch.operators import bitemporal, quality
from tidewatch.session import shared_folder
from tidewatch.sources import landing

HOUR = 3_600_000_000


def test_one_bundle_per_source_and_hour(spark):
    start = 480_000 * HOUR
    df = spark.range(1000).select(
        F.lit("s").alias("source_id"), (start + F.col("id") * 1000).alias("fetched_us"), F.concat(F.lit('{"ü":'), "id", F.lit("}")).alias("payload")
    )
    path = shared_folder(spark)
    landing.land_bronze(df, path)
    assert len(glob.glob(f"{path}/**/*.gz", recursive=True)) == 1
    back = {r.value for r in landing.read_bronze(spark, path).collect()}
    assert back == {r.payload for r in df.collect()}
    two = shared_folder(spark)
    landing.land_bronze(df.withColumn("fetched_us", start + (F.col("fetched_us") - start) % 2 * 0 + F.when(F.col("payload").contains("7"), HOUR).otherwise(0)), two)
    assert len(glob.glob(f"{two}/**/*.gz", recursive=True)) == 2
    split = shared_folder(spark)
    landing.land_bronze(df, split, max_records=100)
    assert len(glob.glob(f"{split}/**/*.gz", recursive=True)) >= 10


def test_dedupe_keys(spark):
    df = spark.createDataFrame([(1, "1", None), (1, "2", 3)], "a int, b string, c int")
    key, missing = ids.dedupe_key("p", ["a", "b"])
    as_text, _ = ids.dedupe_key("p", ["t", "b"])
    rows = df.withColumn("t", F.col("a").cast("string")).select(key.alias("k"), as_text.alias("kt")).collect()
    assert rows[0].k != rows[1].k and rows[0].k != rows[0].kt and rows[0].k.startswith("p:")
    strict, gone = ids.dedupe_key("p", ["a", "c"])
    loose, _ = ids.dedupe_key("p", ["a", "c"], allow_missing=True)
    got = df.select(strict.alias("s"), gone.alias("g"), loose.alias("l")).collect()
    assert got[0].s is None and got[0].g == ["c"] and got[0].l is not None and got[1].s == got[1].l
    with pytest.raises(ValueError):
        ids.dedupe_key("p", [])


def test_ulid_clamps_and_sorts(spark):
    df = spark.createDataFrame([(-5,), (0,), (1_700_000_000_000_000,), (2**62,)], "t long")
    got = [r[0] for r in df.select(ids.deterministic_ulid(F.col("t"), F.lit("x"))).collect()]
    assert got[0] == got[1] and got[1] < got[2] < got[3] and all(len(u) == 26 for u in got) and got[3].startswith("7ZZZZZZZZZ")


def test_version_chain(spark):
    rows = [("e", 100, "reported"), ("e", 200, "confirmed"), ("e", 300, "retracted")]
    versions = bitemporal.build_versions(spark.createDataFrame(rows, "id string, at long, status string"), "id", "at")
    current, history = bitemporal.split_current(versions)

    def status(t):
        return [r.status for r in bitemporal.as_of(current, history, t, "id", "e").collect()]

    assert [status(t) for t in (99, 100, 199, 200, 299, 300, 10**9)] == [
        [], ["reported"], ["reported"], ["confirmed"], ["confirmed"], ["retracted"], ["retracted"],
    ]
    audit = bitemporal.audit_versions(versions, "id").first()
    assert (audit.versions, audit.gaps, audit.overlaps, audit.open_ends) == (3, 0, 0, 1)


def test_delete_moves_last_version_to_history(spark):
    current = spark.createDataFrame([("a", "x", 1, None), ("b", "y", 1, None)], "id string, v string, from_us long, to_us long")
    changes = spark.createDataFrame([("a", 5, "upsert", "x2"), ("a", 6, "upsert", "x3"), ("b", 7, "delete", None)], "id string, at_us long, op string, v string")
    now, past = bitemporal.apply_changes(current, current.limit(0), changes, "id", ["v"])
    assert [(r.id, r.v, r.from_us) for r in now.collect()] == [("a", "x3", 6)]
    assert sorted((r.id, r.v, r.to_us) for r in past.collect()) == [("a", "x", 5), ("a", "x2", 6), ("b", "y", 7)]


def test_null_operands_pass(spark):
    df = spark.createDataFrame([(1, None), (2, 400.0), (3, 10.0)], "id int, cog_deg double")
    found = quality.check_rules(df, {"cog": (F.col("cog_deg") >= 0) & (F.col("cog_deg") < 360)}, "id").first()
    assert (found.violations, found.first_id) == (1, "2")


PAIR_JOINS = ["j3_match_areas", "j13_correlate_spacetime", "v3_rendezvous", "t2_fuzzy_names", "j20_alert_context", "d3_near_duplicates", "j16_area_proximity"]


@pytest.mark.parametrize("name", PAIR_JOINS)
def test_no_product_of_tables(spark, name):
    df = entry_points.queries()[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
