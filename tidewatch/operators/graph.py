"""Point-in-time traversal of the relation graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.filters import valid_at
from tidewatch.session import cut_lineage


def edges_at(relations: DataFrame, at_us: int, types: Sequence[str] = ()) -> DataFrame:
    """Distinct arcs that hold at ``at_us``; undirected ones run both ways."""
    live = valid_at(relations, at_us).filter(F.col("retracted_us").isNull() | (F.col("retracted_us") > at_us))
    if types:
        live = live.filter(F.col("relation_type").isin(*types))
    arcs = live.select(
        F.explode(
            F.when(F.col("directed"), F.array(F.struct(F.col("from_ref").alias("src"), F.col("to_ref").alias("dst"))))
            .otherwise(
                F.array(
                    F.struct(F.col("from_ref").alias("src"), F.col("to_ref").alias("dst")),
                    F.struct(F.col("to_ref").alias("src"), F.col("from_ref").alias("dst")),
                )
            )
        ).alias("arc")
    )
    return arcs.select("arc.src", "arc.dst").distinct()


def neighbours(
    relations: DataFrame, seeds: DataFrame, at_us: int, hops: int, types: Sequence[str] = ()
) -> DataFrame:
    """``(ref, hop)``: everything within ``hops`` of the seeds, at its nearest hop.

    Breadth first. A node is expanded once, in the round it is first reached;
    each round is written out, so a lost executor repeats one round at most.
    """
    arcs = cut_lineage(edges_at(relations, at_us, types))
    reached = cut_lineage(seeds.select("ref").distinct().withColumn("hop", F.lit(0)))
    for hop in range(1, hops + 1):
        frontier = reached.filter(F.col("hop") == hop - 1).select(F.col("ref").alias("src"))
        fresh = (
            arcs.join(frontier, "src", "left_semi")
            .select(F.col("dst").alias("ref"))
            .distinct()
            .join(reached, "ref", "left_anti")
            .withColumn("hop", F.lit(hop))
        )
        fresh = cut_lineage(fresh)
        if fresh.isEmpty():
            break
        reached = reached.unionByName(fresh)
    return reached
