"""The vector index against plain cosine similarities."""

import numpy as np
import pytest

from tidewatch.operators import vector_index


def plain(vectors, queries, k):
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-300)
    out = set()
    for q, a in queries:
        ranked = sorted((-round(float(unit(a) @ unit(v)), 12), i) for i, v in vectors)
        out |= {(q, i, n + 1) for n, (_, i) in enumerate(ranked[:k])}
    return out


def test_all_lists_give_the_exact_neighbours(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 20)
    monkeypatch.setattr(vector_index, "BLOCK_QUERIES", 7)
    rnd = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rnd.normal(size=6)]) for i in range(300)]
    # Many copies of one vector: a hot list, and ties.
    vectors += [(1000 + i, vectors[0][1]) for i in range(150)] + [(2000, [0.0] * 6)]
    table = spark.createDataFrame([*vectors, (3000, None)], "vec_id long, embedding array<double>")
    queries = [(i, v) for i, v in vectors if i % 25 == 0]
    index = vector_index.build_index(table)
    asked = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    got = vector_index.search_index(index, asked, 5)
    assert {(r.query_id, r.id, r.rank_no) for r in got.collect()} == plain(vectors, queries, 5)
    assert index.lists.count() == len(vectors)


def test_tuned_probes_reach_the_recall(spark):
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(30, 16)) * 3
    vectors = [(i, [float(x) for x in centres[i % 30] + rnd.normal(size=16)]) for i in range(3000)]
    index = vector_index.build_index(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))
    probes = vector_index.tune_probes(index, 10)
    assert 0 < probes < len(index.centroids) / 2
    asked = spark.createDataFrame([v for v in vectors if v[0] % 50 == 7], "query_id long, embedding array<double>")
    exact = vector_index.search_index(index, asked, 10)
    measured = vector_index.recall(vector_index.search_index(index, asked, 10, probes), exact).first()
    assert measured.queries == 60 and measured.wanted == 600 and measured.recall >= 0.9


def test_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    index = vector_index.build_index(none)
    assert vector_index.search_index(index, none.withColumnRenamed("vec_id", "query_id"), 3).count() == 0
    assert vector_index.tune_probes(index, 3) == 1
    one = vector_index.build_index(spark.createDataFrame([(1, [1.0, 0.0])], none.schema))
    got = vector_index.search_index(one, spark.createDataFrame([(9, [2.0, 0.0])], "query_id long, embedding array<double>"), 3).collect()
    assert [(r.query_id, r.id, r.rank_no) for r in got] == [(9, 1, 1)] and got[0].similarity == pytest.approx(1.0)
