"""Full text, vectors and hybrid ranking."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import text
from tidewatch.functions.plan import computed_once

# Weights of the classes A title, B summary, C place, D body.
CLASS_WEIGHT = {"title": 1.0, "summary": 0.4, "place": 0.2, "text": 0.1}
# The usual BM25 parameters and rank-fusion constant.
BM25_K1, BM25_B, FUSION_K = 1.2, 0.75, 60


def query_terms(query: str, stop_words: Sequence[str] = ()) -> list[str]:
    words = "".join(c if c.isalnum() else " " for c in query.lower()).split()
    return [w for w in dict.fromkeys(words) if w not in stop_words]


def stop_words(spark: SparkSession, lang: str) -> list[str]:
    """The stop words of a text configuration (``english``, ``german`` ...), as Spark
    ships them; none for ``simple`` and for languages it has no list of."""
    from pyspark.ml.feature import StopWordsRemover

    if lang not in text.TEXT_CONFIG.values():
        return []
    return [w.lower() for w in StopWordsRemover.loadDefaultStopWords(lang)]


def _count(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def search(
    reports: DataFrame,
    query: str,
    fields: Sequence[str] = ("title", "text"),
    lang: str | None = None,
    drop: Sequence[str] = (),
) -> DataFrame:
    """Reports with every query word, scored by weighted occurrences.

    One pass over the text with no shuffle. ``lang`` narrows to one language;
    words are taken as they stand in every language. The stop words in ``drop`` are
    no query words; a query that has no other words finds nothing.
    """
    terms = query_terms(query, drop)
    if not terms:
        return reports.filter(F.lit(False)).withColumn("score", F.lit(0.0))
    rows = reports if lang is None else reports.filter(text.text_config(F.col("lang")) == lang)
    for field in fields:
        rows = computed_once(rows, f"__{field}", text.tokens(F.col(field)))
    score, every = F.lit(0.0), F.lit(True)
    for term in terms:
        hits = [(_count(F.col(f"__{f}"), term), CLASS_WEIGHT[f]) for f in fields]
        for n, weight in hits:
            score = score + n * weight
        every = every & (sum((n for n, _ in hits), F.lit(0)) > 0)
    return rows.filter(every).withColumn("score", score).drop(*[f"__{f}" for f in fields])


def inverted_index(reports: DataFrame, fields: Sequence[str] = ("title", "text")) -> DataFrame:
    """``(term, report_id, weight, n)``: the postings for many queries at once."""
    lists = F.array(
        *[F.struct(F.lit(CLASS_WEIGHT[f]).alias("weight"), text.tokens(F.col(f)).alias("words")) for f in fields]
    )
    postings = reports.select("report_id", F.explode(lists).alias("p")).select(
        "report_id", "p.weight", F.explode("p.words").alias("term")
    )
    return postings.groupBy("term", "report_id", "weight").agg(F.count("*").alias("n"))


def search_many(index: DataFrame, queries: DataFrame) -> DataFrame:
    """Score many queries ``(query_id, term)`` against an index in one join."""
    wanted = queries.groupBy("query_id").agg(F.count_distinct("term").alias("terms"))
    hits = index.join(queries.select("query_id", "term").distinct(), "term")
    return (
        hits.groupBy("query_id", "report_id")
        .agg(F.sum(F.col("weight") * F.col("n")).alias("score"), F.count_distinct("term").alias("found"))
        .join(wanted, "query_id")
        .filter(F.col("found") == F.col("terms"))
        .select("query_id", "report_id", "score")
    )


def bm25(reports: DataFrame, query: str, body: str = "text") -> DataFrame:
    """BM25 of each report that has at least one query word."""
    terms = query_terms(query)
    words = computed_once(reports.select("report_id", body), "words", text.tokens(F.col(body)))
    counted = words.select(
        "report_id",
        F.size("words").alias("length"),
        *[_count(F.col("words"), t).alias(f"tf{i}") for i, t in enumerate(terms)],
    )
    stats = counted.agg(
        F.count("*").alias("docs"),
        F.avg("length").alias("mean_length"),
        *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))],
    )
    # The corpus statistics are one value, from a scalar subquery.
    both = counted.withColumn("corpus", stats.select(F.struct("*")).scalar()).select("*", "corpus.*").drop("corpus")
    score = F.lit(0.0)
    norm = BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / F.col("mean_length"))
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("docs") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (BM25_K1 + 1) / (tf + norm)
    return both.withColumn("bm25", score).filter(F.col("bm25") > 0).select("report_id", "bm25")


MAX_QUERY_VECTORS = 4096


def knn(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id") -> DataFrame:
    """Exact cosine neighbours: ``(query_id, id, similarity, rank_no)``.

    Each task multiplies its batches with the query matrix and passes on only
    its own best ``k`` per query; a second step merges those. Query batches over
    ``MAX_QUERY_VECTORS`` are worked off in slices of different vectors, so what a
    task holds never grows with either table.
    """
    from tidewatch.functions.series import top_k_per

    spark = vectors.sparkSession
    queries = queries.select("query_id", "embedding").distinct()
    rows = queries.limit(MAX_QUERY_VECTORS + 1).collect()
    if len(rows) > MAX_QUERY_VECTORS:
        slices = -(-queries.count() // (MAX_QUERY_VECTORS // 2))
        # By id and vector: also one id with very many vectors is sliced.
        part = F.pmod(F.xxhash64("query_id", "embedding", F.lit(slices)), F.lit(slices))
        results = [knn(vectors, queries.filter(part == i), k, id_col) for i in range(slices)]
        merged = results[0]
        for r in results[1:]:
            merged = merged.unionByName(r)
        return merged
    ids = [r["query_id"] for r in rows]
    matrix = np.array([r["embedding"] for r in rows], dtype=np.float64).reshape(len(ids), -1)
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    shared = spark.sparkContext.broadcast((ids, matrix))

    def best(batches):
        names, m = shared.value
        keep = None
        for pdf in batches:
            if not len(pdf):
                continue
            v = np.array(pdf["embedding"].tolist(), dtype=np.float64)
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            sims = v @ m.T
            key = pdf[id_col].to_numpy()
            parts = []
            for q in range(len(names)):
                order = np.lexsort((key, -sims[:, q]))[:k]
                parts.append(pd.DataFrame({"query_id": names[q], "id": key[order], "similarity": sims[order, q]}))
            found = pd.concat(parts, ignore_index=True)
            keep = found if keep is None else pd.concat([keep, found], ignore_index=True)
            keep = keep.sort_values(["query_id", "similarity", "id"], ascending=[True, False, True]).groupby("query_id").head(k)
        if keep is not None:
            yield keep

    kind = queries.schema["query_id"].dataType.simpleString()
    near = vectors.select(id_col, "embedding").mapInPandas(best, f"query_id {kind}, id long, similarity double")
    return top_k_per(near, ["query_id"], [F.desc("similarity"), F.asc("id")], k)


def label_centroids(vectors: DataFrame, label: str = "label") -> DataFrame:
    """Mean vector per label: ``(query_id, embedding)``, position by position."""
    sums = (
        vectors.select(label, F.posexplode("embedding").alias("pos", "x"))
        .groupBy(label, "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
    )
    ordered = sums.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("parts"))
    return ordered.select(F.col(label).alias("query_id"), F.transform("parts", lambda p: p["x"]).alias("embedding"))


def hybrid_search(
    reports: DataFrame, vectors: DataFrame, query: str, query_vector: DataFrame, depth: int, k: int
) -> DataFrame:
    """Reciprocal-rank fusion of BM25 and cosine over the best ``depth`` of each."""
    from tidewatch.functions.series import top_k_per

    one = F.lit(1).alias("q")
    words = top_k_per(bm25(reports, query).withColumn("q", one), ["q"], [F.desc("bm25"), F.asc("report_id")], depth)
    near = knn(vectors, query_vector, depth)
    ranks = words.select("report_id", F.col("rank_no").alias("word_rank")).join(
        near.select(F.col("id").alias("report_id"), F.col("rank_no").alias("vector_rank")), "report_id", "full_outer"
    )
    fused = F.coalesce(1.0 / (FUSION_K + F.col("word_rank")), F.lit(0.0)) + F.coalesce(
        1.0 / (FUSION_K + F.col("vector_rank")), F.lit(0.0)
    )
    return ranks.withColumn("score", fused).orderBy(F.desc("score"), "report_id").limit(k)
