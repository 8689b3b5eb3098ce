"""Join sides that grow with the input are not gathered in the driver."""

from pyspark.sql import functions as F

from tidewatch.operators import merges, resolve


def plan(df):
    return df._jdf.queryExecution().toString()


def test_decisions_are_not_broadcast(spark):
    groups = spark.range(50).select(F.format_string("e%02d", "id").alias("entity_id")).withColumn("canonical_id", F.col("entity_id"))
    asked = spark.createDataFrame(
        [(1, "merge", "e07", "e03", None, 5, "x"), (2, "split", None, None, 1, 6, "x"), (3, "merge", "e09", "e02", None, 7, "x")],
        "decision_id long, action string, entity_id string, into_id string, merge_id long, at_us long, actor string",
    )
    now, _, audit = merges.apply_decisions(groups, spark.createDataFrame([], merges.FOREST), asked)
    assert "BroadcastHashJoin" not in plan(audit)
    assert {r.entity_id: r.canonical_id for r in now.filter("entity_id <> canonical_id").collect()} == {"e09": "e02"}
    assert {r.decision_id: r.applied for r in audit.collect()} == {1: True, 2: True, 3: True}


def test_names_and_screening_are_not_broadcast(spark):
    names = spark.range(300).select(F.format_string("Customer#%09d", "id").alias("name"))
    others = spark.range(300).select(F.format_string("Supplier#%09d", "id").alias("name"))
    found = resolve.fuzzy_names(others, names, 0.26)
    physical = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in physical

    def grams(name):
        return {f"  {w} "[i : i + 3] for w in name.lower().split("#") for i in range(len(w) + 1)}

    want = {}
    for a in (r.name for r in others.collect()):
        for b in (r.name for r in names.collect()):
            x, y = grams(a), grams(b)
            if len(x & y) / len(x | y) >= 0.26:
                want[a, b] = len(x & y) / len(x | y)
    assert {(r.name_a, r.name_b): r.similarity for r in found.collect()} == want
    entities = names.select(F.col("name").alias("entity_id"), F.col("name").alias("display_name"))
    aliases = entities.select(
        "entity_id", F.lit("imo").alias("id_type"), F.substring("entity_id", -3, 3).alias("id_value"), F.lit(0).cast("long").alias("from_us"), F.lit(None).cast("long").alias("to_us")
    )
    listings = spark.createDataFrame([("007", "x", None)], "imo string, name string, delisted_us long")
    relations = spark.createDataFrame([], "from_ref string, to_ref string, from_us long, to_us long, retracted_us long")
    screened = resolve.screen_at(entities, aliases, listings, relations, entities, 5, 0.9)
    assert "BroadcastHashJoin" not in screened._jdf.queryExecution().executedPlan().toString()
    assert [r.entity_id for r in screened.filter("sanction_status = 'listed'").collect()] == ["Customer#000000007"]
