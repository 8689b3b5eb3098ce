"""Events: corroboration, contradictions, correlation, links."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.series import first_per
from tidewatch.operators.areas import nearby
from tidewatch.operators.similarity import similar_sets
from tidewatch.session import cut_lineage


def corroborate(claims: DataFrame) -> DataFrame:
    """Independent and contradicting source counts per event.

    Sources that only relay one agency count once. The leading value is the one
    most agencies back; agencies that only back another value contradict it.
    """
    backing = claims.groupBy("event_id", "agency", "value").agg(F.min("at_us").alias("at_us"))
    per_value = backing.groupBy("event_id", "value").agg(F.count("*").alias("agencies"))
    leading = per_value.groupBy("event_id").agg(
        F.max_by("value", F.struct("agencies", "value")).alias("leading_value")
    )
    sides = (
        backing.join(leading, "event_id")
        .groupBy("event_id", "leading_value", "agency")
        .agg(F.max(F.col("value") == F.col("leading_value")).alias("agrees"))
        .groupBy("event_id", "leading_value")
        .agg(F.count("*").alias("independent_sources"), F.count_if(~F.col("agrees")).alias("contradicting_sources"))
    )
    first = claims.groupBy("event_id").agg(
        F.min_by(F.struct("source_id", "at_us"), F.struct("at_us", "source_id")).alias("first")
    )
    return sides.join(first, "event_id").select(
        "event_id",
        "leading_value",
        "independent_sources",
        "contradicting_sources",
        F.col("first.source_id").alias("first_seen_source"),
        F.col("first.at_us").alias("first_seen_us"),
    )


def contradictions(claims: DataFrame) -> DataFrame:
    """Disputed fields: how many values and claims, and how far apart in support.

    No winner is picked; ``disputed_claims`` gives the claims themselves.
    """
    per_value = claims.groupBy("event_id", "field_path", "value").agg(F.count("*").alias("claims"))
    return (
        per_value.groupBy("event_id", "field_path")
        .agg(
            F.count("*").alias("values"),
            F.sum("claims").alias("claims"),
            (F.max("claims") / F.sum("claims")).alias("support"),
        )
        .filter(F.col("values") > 1)
        .withColumn("status", F.lit("disputed"))
    )


def disputed_claims(claims: DataFrame) -> DataFrame:
    """Every claim about a disputed field, with its source, none left out."""
    keys = contradictions(claims).select("event_id", "field_path")
    return claims.join(keys, ["event_id", "field_path"], "left_semi")


def dispute_events(events: DataFrame, contradictory: DataFrame) -> DataFrame:
    """Disputed events get the status and a confidence lowered by the support."""
    worst = contradictory.groupBy("event_id").agg(F.min("support").alias("support"))
    return (
        events.join(worst, "event_id", "left")
        .withColumn("status", F.when(F.col("support").isNotNull(), "disputed").otherwise(F.col("status")))
        .withColumn("confidence", F.col("confidence") * F.coalesce("support", F.lit(1.0)))
        .drop("support")
    )


def link_reports(links: DataFrame, reports: DataFrame) -> DataFrame:
    """Event-report links with exactly one first report per event.

    The first report is found by an aggregate and matched back, so an event with
    very many reports is not sorted in one task.
    """
    dated = links.join(reports.select("report_id", "published_us"), "report_id")
    first = first_per(dated.select("event_id", "report_id", "published_us"), ["event_id"], ["published_us", "report_id"])
    mark = first.select("event_id", "report_id", F.lit(True).alias("is_first_report"))
    return dated.join(mark, ["event_id", "report_id"], "left").withColumn(
        "is_first_report", F.coalesce("is_first_report", F.lit(False))
    )


def correlate_spacetime(events: DataFrame, window_us: int, km: float) -> DataFrame:
    """Places and times whose events lie within ``window_us`` and ``km``.

    Events at one place and time are counted first, and it is those sites that
    are compared. A site with very many events is still one row, and
    ``event_pairs`` says how many event pairs each row stands for; the pairs
    themselves follow by joining events to both sites.
    """
    sites = (
        events.groupBy("lon", "lat", F.col("occurred_us").alias("at_us"))
        .agg(F.count("*").alias("n"), F.min("event_id").alias("site"))
    )
    here = sites.withColumnRenamed("n", "n_a")
    there = sites.withColumnsRenamed({"site": "site_b", "n": "n_b"})
    # The counts come with the sites: no pair is shuffled.
    pairs = nearby(here, there, km, window_us, "site", "site_b", ["n_a"], ["n_b"])
    strength = (1 - F.abs("lag_s") * 1_000_000 / window_us) * (1 - F.col("distance_m") / (km * 1000.0))
    return (
        pairs.filter(F.col("site") <= F.col("site_b"))
        .withColumn(
            "event_pairs",
            F.when(F.col("site") == F.col("site_b"), F.col("n_a") * (F.col("n_a") - 1) / 2)
            .otherwise(F.col("n_a") * F.col("n_b"))
            .cast("long"),
        )
        .filter(F.col("event_pairs") > 0)
        .withColumn("strength", strength)
        .select(F.col("site").alias("site_a"), "site_b", "event_pairs", "lag_s", "distance_m", "strength")
    )


def correlate_shared(event_entities: DataFrame, min_similarity: float) -> DataFrame:
    """Groups of events that name nearly the same entities.

    Events with the same set of entities form one group; groups are compared by
    the Jaccard similarity of their sets, exactly, through their rarest
    entities. An entity that a third of all events name never becomes a key
    unless it is all an event has.
    """
    sets = event_entities.groupBy("event_id").agg(F.array_sort(F.collect_set("ref_id")).alias("items"))
    # Written: the comparison and the result read the groups six times.
    groups = cut_lineage(sets.groupBy("items").agg(F.min("event_id").alias("id"), F.count("*").alias("n")))
    sizes = groups.select("id", "n", "items")
    across = similar_sets(groups, None, min_similarity)
    a = sizes.select(F.col("id").alias("id_a"), F.col("n").alias("n_a"), F.col("items").alias("items_a"))
    b = sizes.select(F.col("id").alias("id_b"), F.col("n").alias("n_b"), F.col("items").alias("items_b"))
    between = across.join(a, "id_a").join(b, "id_b").select(
        "id_a",
        "id_b",
        F.size(F.array_intersect("items_a", "items_b")).alias("shared"),
        "similarity",
        (F.col("n_a") * F.col("n_b")).alias("event_pairs"),
    )
    within = sizes.filter(F.col("n") > 1).select(
        F.col("id").alias("id_a"),
        F.col("id").alias("id_b"),
        F.size("items").alias("shared"),
        F.lit(1.0).alias("similarity"),
        (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("event_pairs"),
    )
    return between.unionByName(within)


def root_events(up: DataFrame) -> DataFrame:
    """``(event_id, root)``: every root that ``(from_event, to_event)`` leads to.

    An event may have several parents, so several roots; each is listed once,
    however many ways lead there. The way doubles each round: a pair knows the
    events twice as far up, so depth n takes log2(n) rounds. Events that only lead into a
    cycle have the cycle's smallest event as their root.
    """
    edges = up.select(F.col("from_event").alias("id"), F.col("to_event").alias("next")).filter("id <> next").distinct()
    state = cut_lineage(edges.select("id", "next", F.least("id", "next").alias("low")))
    inner = edges.select(F.col("id").alias("next")).distinct()
    done = state.join(inner, "next", "left_anti").select("id", "next")
    state = state.join(inner, "next", "left_semi").select("id", "next", "low")
    rounds = max(1, math.ceil(math.log2(max(2, edges.select("id").distinct().count()))) + 1)
    for _ in range(rounds):
        known = cut_lineage(done.distinct())
        state = cut_lineage(state)
        if state.isEmpty():
            break
        # On from where the pair stands: to a root within reach, or as far again.
        roots = known.select(F.col("id").alias("next"), F.col("next").alias("far"))
        done = known.unionByName(state.join(roots, "next").select("id", F.col("far").alias("next")))
        on = state.select(F.col("id").alias("next"), F.col("next").alias("far"), F.col("low").alias("far_low"))
        state = (
            state.join(on, "next")
            .groupBy("id", F.col("far").alias("next"))
            .agg(F.min(F.least("low", "far_low")).alias("low"))
        )
    else:
        # What still goes on is in a cycle, or leads into one.
        cycles = cut_lineage(state)
        lows = cycles.groupBy(F.col("id").alias("next")).agg(F.min("low").alias("cycle_low"))
        lost = cycles.join(lows, "next").groupBy("id").agg(F.min("cycle_low").alias("next"))
        done = done.unionByName(lost.join(done.select("id").distinct(), "id", "left_anti"))
    return done.select(F.col("id").alias("event_id"), F.col("next").alias("root")).distinct()


def roll_up_links(events: DataFrame, links: DataFrame) -> DataFrame:
    """Children of each root event, following duplicate_of and part_of.

    An event under several roots counts for each, and once for each. Causal
    links are hypotheses: they are counted with their strength and never
    followed.
    """
    up = links.filter(F.col("link_type").isin("duplicate_of", "part_of"))
    kinds = up.groupBy("from_event").agg(F.count_if(F.col("link_type") == "duplicate_of").alias("dup")).withColumnRenamed("from_event", "event_id")
    causal = (
        links.filter(F.col("link_type") == "caused_by_hypothesis")
        .groupBy(F.col("from_event").alias("event_id"))
        .agg(F.max("strength").alias("hypothesis_strength"))
    )
    placed = (
        events.join(root_events(up), "event_id", "left")
        .join(kinds, "event_id", "left")
        .join(causal, "event_id", "left")
        .withColumn("root", F.coalesce("root", "event_id"))
    )
    return placed.groupBy("root").agg(
        F.count_if(F.col("event_id") != F.col("root")).alias("children"),
        F.count_if(F.col("dup") > 0).alias("duplicates"),
        F.max("severity").alias("max_severity"),
        F.min("occurred_us").alias("first_us"),
        F.max("occurred_us").alias("last_us"),
        F.max("hypothesis_strength").alias("strongest_hypothesis"),
    )
