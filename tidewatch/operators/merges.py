"""Merges of entities that can be taken back.

A merge is an edge of a forest and is never deleted: a split notes which decision
undid it. Who belongs together follows from the edges that are not undone, and is
computed anew only for the groups that a batch of decisions touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.plan import large
from tidewatch.operators.similarity import connected_components
from tidewatch.session import cut_lineage

FOREST = "merge_id long, entity_id string, into_id string, at_us long, actor string, undone_by long"


def apply_decisions(groups: DataFrame, forest: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(groups, forest, audit)`` after a batch of merges and splits.

    ``groups``: entity_id, canonical_id of every entity. ``forest``: the merges so
    far, as in ``FOREST``. ``decisions``: decision_id, action ('merge' or 'split'), entity_id,
    into_id, merge_id (the merge that a split undoes), at_us, actor. A merge takes its
    decision's id. Decisions count in the order of their ids.

    The audit has a row per decision, in order: whether it was applied, why not
    (``unknown_entity``, ``unknown_merge``, ``already_undone``, ``known_decision``),
    and the canonical ids of its two entities before and after the batch. A
    repeated batch changes nothing. The smallest id of a group is its canonical one.
    """
    d = decisions.select("decision_id", "action", "entity_id", "into_id", "merge_id", "at_us", "actor")
    seen = forest.select(F.col("merge_id").alias("decision_id")).unionByName(
        forest.filter("undone_by IS NOT NULL").select(F.col("undone_by").alias("decision_id"))
    )
    d = d.join(large(seen.distinct().withColumn("known", F.lit(True))), "decision_id", "left")
    alive = groups.select(F.col("entity_id"), F.lit(True).alias("e_known"))
    merges = (
        d.filter("action = 'merge'")
        .join(large(alive), "entity_id", "left")
        .join(large(alive.select(F.col("entity_id").alias("into_id"), F.col("e_known").alias("i_known"))), "into_id", "left")
        .withColumn("reason", F.when(F.col("known"), "known_decision").when(F.col("e_known").isNull() | F.col("i_known").isNull(), "unknown_entity"))
        .drop("e_known", "i_known")
    )
    merges = cut_lineage(merges)
    fresh = merges.filter("reason IS NULL").select(
        F.col("decision_id").alias("merge_id"), "entity_id", "into_id", "at_us", "actor", F.lit(None).cast("long").alias("undone_by")
    )
    stored = forest.unionByName(fresh)
    # A split takes the entities of the merge that it names, and the first split wins.
    splits = (
        d.filter("action = 'split'")
        .drop("entity_id", "into_id")
        .join(large(stored.select("merge_id", "entity_id", "into_id", "undone_by", F.lit(True).alias("m_known"))), "merge_id", "left")
        .withColumn("late", F.col("m_known") & (F.col("merge_id") > F.col("decision_id")))
    )
    first = splits.filter("known IS NULL AND m_known AND undone_by IS NULL AND NOT late").groupBy("merge_id").agg(F.min("decision_id").alias("first"))
    splits = cut_lineage(
        splits.join(large(first), "merge_id", "left").withColumn(
            "reason",
            F.when(F.col("known"), "known_decision")
            .when(F.col("m_known").isNull() | F.col("late"), "unknown_merge")
            .when(F.col("undone_by").isNotNull() | (F.col("first") != F.col("decision_id")), "already_undone"),
        )
    )
    undone = splits.filter("reason IS NULL").select("merge_id", F.col("decision_id").alias("now_undone"))
    after = cut_lineage(
        stored.join(large(undone), "merge_id", "left").withColumn("undone_by", F.coalesce("undone_by", "now_undone")).drop("now_undone")
    )
    told = ["decision_id", "action", "entity_id", "into_id", "at_us", "actor", "reason"]
    log = merges.select(*told).unionByName(splits.select(*told))
    ends = log.filter("reason IS NULL").select(F.explode(F.array("entity_id", "into_id")).alias("entity_id"))
    groups_hit = groups.join(large(ends.distinct()), "entity_id", "left_semi").select("canonical_id").distinct()
    members = cut_lineage(groups.join(large(groups_hit), "canonical_id", "left_semi").select("entity_id"))
    edges = after.filter("undone_by IS NULL").join(large(members), "entity_id", "left_semi")
    placed = connected_components(edges.select(F.col("entity_id").alias("a"), F.col("into_id").alias("b")))
    again = members.join(large(placed.withColumnRenamed("node", "entity_id")), "entity_id", "left").select(
        "entity_id", F.coalesce("component", "entity_id").alias("canonical_id")
    )
    rest = groups.join(large(groups_hit), "canonical_id", "left_anti").select("entity_id", "canonical_id")
    now = cut_lineage(rest.unionByName(again))

    def named(table: DataFrame, end: str, out: str) -> DataFrame:
        return table.select(F.col("entity_id").alias(end), F.col("canonical_id").alias(out))

    audit = log.withColumn("applied", F.col("reason").isNull())
    for table, when in ((groups, "before"), (now, "after")):
        audit = audit.join(large(named(table, "entity_id", f"canonical_{when}")), "entity_id", "left")
        audit = audit.join(large(named(table, "into_id", f"into_canonical_{when}")), "into_id", "left")
    return now, after, audit


def reunite_identifiers(identifiers: DataFrame, groups: DataFrame) -> DataFrame:
    """Identifiers of each canonical entity, and which entities brought them.

    ``identifiers``: entity_id, id_type, id_value. They stay with the entity they came with,
    so a split hands them back.
    """
    return (
        identifiers.join(large(groups.select("entity_id", "canonical_id")), "entity_id")
        .groupBy("canonical_id", "id_type", "id_value")
        .agg(F.array_sort(F.collect_set("entity_id")).alias("origins"))
    )
