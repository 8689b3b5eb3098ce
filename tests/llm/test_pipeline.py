"""The pipeline and the registered queries, on a small table of their own."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from tidewatch.llm import mixing, queries
from tests.llm.test_corpus import base_spans, grouped
from tests.llm.test_documents import contamination, measured


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Documents of every kind that a stage looks for, in a folder like the test data."""
    rnd = random.Random(10)
    word = lambda: rnd.choice("ka lo mi tu re so ne va".split()) + rnd.choice("bri dom fen gul hast".split()) + str(rnd.randrange(40))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(20)) for i in range(5)]
    docs = [[i, text(rnd.randrange(55, 150)), "en", f"s{i % 4}"] for i in range(80)]
    for i in range(80, 100):  # near copies
        words = docs[i - 80][1].split()
        words[rnd.randrange(len(words))] = "changed"
        docs.append([i, " ".join(words), "en", "s1"])
    docs += [[i, docs[40][1], "en", "s2"] for i in range(100, 106)]
    docs += [[110 + i, text(30) + " " + items[i][1] + " " + text(30), "en", "s0"] for i in range(5)]
    docs += [[120 + i, text(60) + f" mail me{i}@mail.example.org or +49 30 1234567{i} " + text(5), "en", "s3"] for i in range(5)]
    docs += [[130, "too short", "en", "s0"], [131, "again and again " * 40, "en", "s0"], [132, None, "en", None], [133, "", None, "s1"]]
    folder = str(tmp_path_factory.mktemp("tables"))
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    table.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, items


def test_stages(spark, small):
    folder, docs, items = small
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"]
    rows = out.collect()
    # Brute force, stage by stage, each on what the one before has kept.
    left = [d for d in docs if not measured(d[1])[5]]
    kept = {i for i, _, root, first in grouped([(d[0], d[1]) for d in left], 5, 80) if first}
    left = [d for d in left if d[0] in kept]
    left = [d for d in left if not contamination(d[1], items)[3]]
    assert {r.doc_id for r in rows} <= {d[0] for d in left} and len(left) == 85
    assert not any(base_spans(r.text) for r in rows)
    clean = {d[0]: d[1] for d in left if not base_spans(d[1])}
    assert all(r.text == clean[r.doc_id] for r in rows if r.doc_id in clean)
    marked = {r.doc_id: r.text for r in rows if r.doc_id not in clean}
    assert all(t.count("<EMAIL>") == 1 and t.count("<PHONE>") == 1 for t in marked.values())
    # Copies follow the plan over what reached the last stage.
    texts = {**{i: t for i, t in clean.items()}, **marked}
    table = spark.createDataFrame([(d[0], texts.get(d[0], d[1]), d[3]) for d in left], "doc_id long, text string, source string")
    plan = {r.doc_id: r.copies for r in mixing.plan_mix(table).collect()}
    found = Counter(r.doc_id for r in rows)
    assert all(found[i] == n for i, n in plan.items() if i in texts)


def test_each_stage_returns_documents(spark, small):
    folder, _, _ = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_queries_run_without_rows(spark, small, tmp_path):
    folder, _, _ = small
    empty = {
        "documents": "doc_id long, text string, lang string, source string, n_chars long",
        "benchmark": "item_id long, text string",
        "labels": "doc_id long, quality int, toxic int",
        "pages": "page_id long, url string, html string",
        "conversations": "conv_id long, turn long, role string, text string",
    }
    for name, schema in empty.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, build in queries.QUERIES.items():
        assert build(spark, str(tmp_path)).count() == 0, name


def test_mix_matches_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = sorted(con.execute(queries.SQL["op7_mix_sources"]).fetchall())
    got = entry_points.queries()["op7_mix_sources"](spark, folder)
    assert sorted(map(tuple, got.collect())) == want
