"""Merges that can be taken back, and the stored version table."""

import os

from tidewatch.operators import merges
from tidewatch.sources.versions import VersionStore

DECISIONS = "decision_id long, action string, entity_id string, into_id string, merge_id long, at_us long, actor string"


def test_merge_split_merge(spark):
    groups = spark.createDataFrame([(e, e) for e in "abcdefg"], "entity_id string, canonical_id string")
    forest = spark.createDataFrame([], merges.FOREST)
    ids = spark.createDataFrame([("a", "imo", "1"), ("b", "imo", "2"), ("c", "imo", "1"), ("e", "imo", "9")], "entity_id string, id_type string, id_value string")

    def step(*rows):
        nonlocal groups, forest
        groups, forest, audit = merges.apply_decisions(groups, forest, spark.createDataFrame([(*r, 5, "x") for r in rows], DECISIONS))
        return {r.entity_id: r.canonical_id for r in groups.collect()}, audit.orderBy("decision_id").collect()

    def united():
        return {(r.canonical_id, r.id_value): r.origins for r in merges.reunite_identifiers(ids, groups).collect()}

    now, audit = step((1, "merge", "b", "a", None), (2, "merge", "c", "b", None), (3, "merge", "e", "d", None), (4, "merge", "x", "a", None))
    assert now == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f", "g": "g"}
    assert [(r.decision_id, r.applied, r.reason) for r in audit] == [(1, True, None), (2, True, None), (3, True, None), (4, False, "unknown_entity")]
    assert (audit[1].canonical_before, audit[1].canonical_after) == ("c", "a")
    merged = united()
    assert merged == {("a", "1"): ["a", "c"], ("a", "2"): ["b"], ("d", "9"): ["e"]}
    # The chain breaks in the middle: c leaves with b.
    now, audit = step((5, "split", None, None, 1), (6, "split", None, None, 77), (7, "split", None, None, 1))
    assert now == {"a": "a", "b": "b", "c": "b", "d": "d", "e": "d", "f": "f", "g": "g"}
    assert [(r.decision_id, r.reason, r.entity_id) for r in audit] == [(5, None, "b"), (6, "unknown_merge", None), (7, "already_undone", "b")]
    assert united() == {("a", "1"): ["a"], ("b", "1"): ["c"], ("b", "2"): ["b"], ("d", "9"): ["e"]}
    # A repeated batch changes nothing.
    before = sorted(map(tuple, forest.collect()), key=str)
    again, audit = step((5, "split", None, None, 1))
    assert again == now and [r.reason for r in audit] == ["known_decision"]
    assert sorted(map(tuple, forest.collect()), key=str) == before
    # Merged again, in one batch with a merge that is undone at once.
    now, _ = step((8, "merge", "a", "b", None), (9, "merge", "f", "g", None), (10, "split", None, None, 9))
    assert now == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f", "g": "g"} and united() == merged
    assert {r.merge_id: r.undone_by for r in forest.collect()} == {1: 5, 2: None, 3: None, 8: None, 9: 10}


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_batch_touches_its_buckets_only(spark, tmp_path):
    ddl = "k long, at_us long, op string, v string"
    first = spark.createDataFrame([(k, 10, "upsert", "a") for k in range(200)], ddl)
    store = VersionStore(f"{tmp_path}/table", "k", ["v"], first.schema, buckets=16)
    assert store.read(spark).count() == 0
    store.apply(first)
    before = files(store.path)
    batch = spark.createDataFrame([(7, 20, "upsert", "b"), (7, 15, "upsert", "late"), (9, 30, "delete", None)], ddl)
    store.apply(batch)
    after = files(store.path)
    touched = {r.bucket for r in store.read(spark).filter("k IN (7, 9)").select("bucket").distinct().collect()}
    gone = {os.path.basename(os.path.dirname(f)) for f in before - after}
    assert gone == {f"bucket={b}" for b in touched} and len(before & after) >= 14
    rows = lambda: sorted((r.k, r.v, r.from_us, r.to_us) for r in store.read(spark).filter("k IN (7, 8, 9)").collect())
    want = [(7, "a", 10, 15), (7, "b", 20, None), (7, "late", 15, 20), (8, "a", 10, None), (9, "a", 10, 30)]
    assert [(k, v, a, b) for k, v, a, b in rows()] == want
    # The batch comes again after a failure.
    store.apply(batch)
    assert rows() == want and store.read(spark).count() == 202
    store.apply(batch.limit(0))
    assert rows() == want
