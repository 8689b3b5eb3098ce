"""Sets of few different items: blocks of bits, not a join of what meets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import resolve, set_blocks
from tidewatch.operators.similarity import similar_sets

SETS = "id long, items array<int>"


def draw(rnd, n, start, most):
    return [(start + i, rnd.sample(range(40), rnd.randrange(1, most))) for i in range(n)]


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.9, 1.0])
def test_blocks_equal_all_pairs(spark, monkeypatch, threshold):
    rnd = random.Random(5)
    a, b = draw(rnd, 150, 0, 14), draw(rnd, 90, 1000, 9)
    b += [(2000 + i, s) for i, (_, s) in enumerate(a[:40])]
    want = {}
    for x, s in a:
        for y, t in b:
            shared = len(set(s) & set(t))
            if shared and shared / (len(s) + len(t) - shared) >= threshold:
                want[x, y] = shared / (len(s) + len(t) - shared)
    monkeypatch.setattr(set_blocks, "MEETING_COST", 1e9)
    monkeypatch.setattr(set_blocks, "CHUNK_SETS", 50)
    monkeypatch.setattr(set_blocks, "OUT_PAIRS", 7)
    # A block then keeps two maps of bits at a time.
    monkeypatch.setattr(set_blocks, "MAP_BYTES", 32)
    for left, right in ((a, b), (b, a)):
        found = similar_sets(spark.createDataFrame(left, SETS), spark.createDataFrame(right, SETS), threshold)
        assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
        rows = found.collect()
        got = {(r.id_a, r.id_b) if left is a else (r.id_b, r.id_a): r.similarity for r in rows}
        assert got == want and len(rows) == len(want)


def test_least_shared_is_the_least():
    y = np.arange(1, 40)
    for threshold in (0.26, 0.28, 0.5, 2 / 3, 0.9, 1.0):
        for x in range(1, 40):
            least = set_blocks.least_shared(x, y, threshold)
            ok = lambda s: s / (x + y - s) >= threshold - 1e-9
            assert (ok(least)).all() and not (ok(least - 1) & (least > 1)).any()


def members(spark, rows):
    kinds = "member_id string, watchlist_id string, match_mode string, ref_id string, pattern string, attribute_path string, attribute_value string, weight double, default_weight double, min_similarity double, from_us long, to_us long"
    return spark.createDataFrame([(m, "l", "fuzzy_name", None, p, None, None, None, 0.5, low, None, None) for m, p, low in rows], kinds)


def test_hits_of_names_are_not_joined_again(spark):
    """Nearly all names are alike, so hits are far more than names: none is shuffled."""
    names = [(f"e{i}", None if i == 3 else f"Supplier#{i:09d}") for i in range(60)] + [("twin", "Supplier#000000007"), ("twin", "Supplier#000000007")]
    entities = spark.createDataFrame([(e, e, n, "{}") for e, n in names], "entity_id string, canonical_id string, display_name string, attributes string")
    listed = [("m1", "Supplier#000000007", 0.9), ("m2", "SUPPLIER#000000020", None), ("m2", "SUPPLIER#000000020", None), ("m3", None, 0.3), ("m4", "#", 0.3)]
    found = resolve.match_watchlists(entities, members(spark, listed), 5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    # Hits are not looked up by their names again, neither for entities nor for members.
    assert "name_a" not in plan and "name_b" not in plan

    def grams(name):
        return {f"  {w} "[i : i + 3] for w in name.lower().split("#") if w for i in range(len(w) + 1)}

    want = []
    for e, n in names:
        for m, p, low in listed:
            if n and p and grams(p):
                s = len(grams(n) & grams(p)) / len(grams(n) | grams(p))
                if s >= (0.25 if low is None else low):
                    want.append((e, m, round(s, 9)))
    got = [(r.entity_id, r.member_id, round(r.similarity, 9)) for r in found.collect()]
    assert sorted(got) == sorted(want) and len(got) > 100
    assert {(r.weight, r.watchlist_id, r.match_mode) for r in found.select("weight", "watchlist_id", "match_mode").distinct().collect()} == {(0.5, "l", "fuzzy_name")}


def test_a_join_stays_where_few_sets_meet(spark):
    sets = spark.range(3000).select("id", F.array(*[(F.col("id") * 5 + i).cast("int") for i in range(5)]).alias("items"))
    found = similar_sets(sets, sets.select((F.col("id") + 10_000).alias("id"), "items"), 0.9)
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 3000


@pytest.mark.parametrize("cost", [0, 1e9])
def test_sets_of_two_tables_are_made_once(spark, monkeypatch, cost):
    monkeypatch.setattr(set_blocks, "MEETING_COST", cost)
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<int>")
    def items(i):
        made.add(1)
        return [i % 7, 7 + i % 5, 12]

    left, right = (spark.range(lo, lo + 40).select("id", items("id").alias("items")) for lo in (0, 100))
    assert len(similar_sets(left, right, 0.9).collect()) == sum((i - j) % 35 == 0 for i in range(40) for j in range(100, 140))
    assert made.value == 80


def test_screened_names_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(set_blocks, "MEETING_COST", 1e9)
    names = spark.range(400).select(F.format_string("e%d", "id").alias("entity_id"), F.format_string("Customer#%09d", "id").alias("display_name"))
    aliases = names.select("entity_id", F.lit("imo").alias("id_type"), "entity_id", F.lit(None).cast("long").alias("from_us"), F.lit(None).cast("long").alias("to_us")).toDF("entity_id", "id_type", "id_value", "from_us", "to_us")
    listings = spark.createDataFrame([(None, "customer#000000123", None), (None, "customer#000000321", 4)], "imo string, name string, delisted_us long")
    relations = spark.createDataFrame([], "from_ref string, to_ref string, from_us long, to_us long, retracted_us long")
    screened = resolve.screen_at(names, aliases, listings, relations, names, 5, 0.8)
    assert "MapInArrow" in screened._jdf.queryExecution().optimizedPlan().toString()

    def grams(i):
        return {f"  {w} "[k : k + 3] for w in ("customer", f"{i:09d}") for k in range(len(w) + 1)}

    alike = {f"e{i}": len(grams(i) & grams(123)) / len(grams(i) | grams(123)) for i in range(400)}
    want = {e: round(s, 9) for e, s in alike.items() if s >= 0.8}
    assert {r.entity_id: round(r.confidence, 9) for r in screened.filter("sanction_status = 'possible_match'").collect()} == want and len(want) > 1
