"""Inverted lists of vectors around centroids.

The centroids are fitted on a bounded sample; every vector is put into the list of
its nearest one. A search looks into the lists nearest to each query and ranks
what they hold by exact cosine similarity, so a probe of all lists is an exact
search. Queries and vectors meet by list, in blocks of bounded size: the vectors
are read once for any number of queries.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.series import top_k_per
from tidewatch.session import cut_lineage

#: Rows the centroids are fitted on, most lists, and rows of a block.
SAMPLE_ROWS, MOST_LISTS, ROUNDS = 20_000, 4096, 12
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024
#: Similarities that a task holds at once when it looks for the nearest lists or ranks a block.
SIMILARITIES = 1 << 20


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-300)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(values.reshape(len(column), -1)) if len(column) else np.zeros((0, 1))


@dataclass
class VectorIndex:
    #: list_no, id, embedding: every vector of the indexed table.
    lists: DataFrame
    centroids: np.ndarray
    #: list_no, slices: lists of many vectors are met slice by slice.
    sizes: DataFrame


def fit_centroids(vectors: DataFrame, n_lists: int, id_col: str = "vec_id", sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Spherical k-means on the ``sample_rows`` vectors with the lowest hash of their id."""
    rows = vectors.select(id_col, "embedding").orderBy(F.xxhash64(id_col), id_col).limit(sample_rows).collect()
    if not rows:
        return np.zeros((0, 1))
    sample = _unit(np.array([r["embedding"] for r in rows], dtype=np.float64))
    rnd = np.random.default_rng(1)
    centroids = sample[rnd.choice(len(sample), min(n_lists, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        nearest = np.argmax(sample @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        empty = np.bincount(nearest, minlength=len(centroids)) == 0
        centroids = np.where(empty[:, None], centroids, _unit(sums))
    return centroids


def _nearest_batches(centroids: np.ndarray, probes: int, id_name: str, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows are taken by what they grow into: a similarity per list, and a copy per probe."""
    n = len(centroids)
    probes = min(probes, n)
    step = max(1, min(BLOCK_ROWS // probes, SIMILARITIES // n))
    for whole in batches:
        for at in range(0, whole.num_rows, step):
            batch = whole.slice(at, step)
            sims = _matrix(batch.column("embedding")) @ centroids.T
            near = np.argpartition(-sims, probes - 1, axis=1)[:, :probes] if probes < n else np.tile(np.arange(n), (len(sims), 1))
            where = pa.array(np.repeat(np.arange(len(sims)), probes))
            yield pa.RecordBatch.from_arrays(
                [pa.array(near.ravel(), pa.int32()), batch.column(id_name).take(where), batch.column("embedding").take(where)],
                names=["list_no", id_name, "embedding"],
            )


def _nearest(centroids: np.ndarray, probes: int, id_name: str, kind: str, df: DataFrame) -> DataFrame:
    """Each row with its ``probes`` nearest lists."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)

    return df.mapInArrow(lambda batches: _nearest_batches(shared.value, probes, id_name, batches), f"list_no int, {id_name} {kind}, embedding array<double>")


def build_index(vectors: DataFrame, n_lists: int | None = None, id_col: str = "vec_id", sample_rows: int = SAMPLE_ROWS) -> VectorIndex:
    """Index of all rows of ``vectors`` (id, embedding) that have a vector.

    The number of lists is the root of the number of rows, 4,096 at most.
    """
    rows = vectors.filter(F.col("embedding").isNotNull()).select(F.col(id_col).alias("id"), F.col("embedding").cast("array<double>"))
    if n_lists is None:
        n_lists = int(min(MOST_LISTS, max(1, round(rows.count() ** 0.5))))
    centroids = fit_centroids(rows, n_lists, "id", sample_rows)
    kind = rows.schema["id"].dataType.simpleString()
    if not len(centroids):
        lists = rows.limit(0).select(F.lit(0).alias("list_no"), "id", "embedding")
    else:
        lists = _nearest(centroids, 1, "id", kind, rows)
    lists = cut_lineage(lists)
    sizes = cut_lineage(lists.groupBy("list_no").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("slices")))
    return VectorIndex(lists, centroids, sizes)


def search_index(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """``query_id, id, similarity, rank_no``: the ``k`` nearest vectors of each query
    in its ``probes`` nearest lists; ``probes=None`` looks into all, which is exact.

    Equal similarities go by id. ``queries``: query_id, embedding.
    """
    asked = queries.select("query_id", F.col("embedding").cast("array<double>")).filter(F.col("embedding").isNotNull()).distinct()
    kind = asked.schema["query_id"].dataType.simpleString()
    id_kind = index.lists.schema["id"].dataType.simpleString()
    out = f"query_id {kind}, id {id_kind}, similarity double"
    if not len(index.centroids):
        return top_k_per(queries.sparkSession.createDataFrame([], out), ["query_id"], [F.desc("similarity"), F.asc("id")], k)
    probed = cut_lineage(_nearest(index.centroids, probes or len(index.centroids), "query_id", kind, asked))
    blocks = probed.groupBy("list_no").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("blocks")).join(index.sizes, "list_no")
    # A block is a slice of a list's vectors and a slice of the queries that look into it.
    mine = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.lists.join(blocks, "list_no").select("list_no", mine("id", "slices").alias("slice"), upto("blocks").alias("block"), "id", "embedding")
    right = probed.join(blocks, "list_no").select("list_no", upto("slices").alias("slice"), mine("query_id", "blocks").alias("block"), "query_id", "embedding")
    key = ["list_no", "slice", "block"]

    def rank(vectors: pa.Table, wanted: pa.Table) -> pa.Table:
        ids, names = vectors.column("id").combine_chunks(), wanted.column("query_id").combine_chunks()
        picked, asking, sims_ = [], [], []
        if len(ids) and len(names):
            held, asked_ = _matrix(vectors.column("embedding").combine_chunks()).T, _matrix(wanted.column("embedding").combine_chunks())
            step = max(1, SIMILARITIES // len(ids))
            for first in range(0, len(asked_), step):
                for q, sims in enumerate(asked_[first : first + step] @ held, first):
                    # All that could be among the best, ties included.
                    least = np.partition(sims, -k)[-k] if len(sims) > k else -np.inf
                    at = np.flatnonzero(sims >= least - 1e-12)
                    picked.append(at)
                    asking.append(np.full(len(at), q))
                    sims_.append(sims[at])
        flat = lambda parts, t: np.concatenate(parts) if parts else np.zeros(0, dtype=t)
        return pa.table(
            [names.take(pa.array(flat(asking, np.int64))), ids.take(pa.array(flat(picked, np.int64))), pa.array(flat(sims_, np.float64))],
            names=["query_id", "id", "similarity"],
        )

    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(rank, out)
    return top_k_per(near, ["query_id"], [F.desc(F.round("similarity", 12)), F.asc("id")], k)


def tune_probes(index: VectorIndex, k: int, target: float = 0.95, sample_queries: int = 200) -> int:
    """The number of lists that holds ``target`` of the exact neighbours.

    Measured with the ``sample_queries`` indexed vectors of lowest hash: a neighbour is
    found from the probe on that reaches its list. What is collected is bounded by
    ``sample_queries * k`` pairs.
    """
    sample = index.lists.orderBy(F.xxhash64("id", F.lit("probe")), "id").limit(sample_queries).select(F.col("id").alias("query_id"), "embedding")
    sample = cut_lineage(sample)
    exact = search_index(index, sample, k)
    where = exact.join(index.lists.select("id", "list_no"), "id").select("query_id", "list_no").collect()
    order = {}
    for r in sample.collect():
        sims = index.centroids @ _unit(np.array(r["embedding"], dtype=np.float64))
        order[r["query_id"]] = np.argsort(np.argsort(-sims))
    needed = sorted(int(order[r["query_id"]][r["list_no"]]) + 1 for r in where)
    return needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)] if needed else 1


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: ``queries``, ``wanted``, ``recall`` of the pairs (query_id, id)."""
    both = exact.select("query_id", "id", F.lit(1).alias("one")).join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("wanted"), (F.count("hit") / F.count("*")).alias("recall"))

