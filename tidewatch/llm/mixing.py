"""Mixing sources to target weights, with DataFrame functions only.

Words are summed per source, targets follow from weights and a ceiling, and a
source's rate is its target over its size. A document is taken ``floor(rate)``
times and once more with the rate's fraction as probability; the draw is a hash
of its id and text, so every run draws alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.session import cut_lineage

WEIGHTS = (3, 1, 2)
#: All targets together, and each source's ceiling, as a multiple of the sizes.
SHARE = 1.5
MOST = 2
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """``(source, source_size)`` with ``weight`` and ``target``.

    Sources in code point order, null last, take the weights in turn. All
    targets sum to ``share`` times all sizes; a source stops at ``most`` times
    its size and the excess goes to the others by weight until none is above.
    Ranks are counted per sorted partition, so no task sees all sources.
    """
    spark = sizes.sparkSession
    # A sorted table, written once: partition and place in it are then fixed.
    placed = cut_lineage(
        sizes.withColumn("last", F.col("source").isNull())
        .repartitionByRange(F.col("last"), F.col("source"))
        .sortWithinPartitions("last", "source")
        .withColumn("place", F.monotonically_increasing_id())
    )
    part = F.shiftright("place", 33)
    before = (
        placed.groupBy(part.alias("part"))
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("n")
    )
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = cut_lineage(
        placed.withColumn("part", part)
        .join(before, "part")
        .withColumn("rank", F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)))
        .select("source", "source_size", turn.cast("long").alias("weight"))
    )
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    capped_size, open_weight, seen = 0, None, None
    while True:
        # The level at which the open sources share what the full ones leave.
        if open_weight is None:
            full = F.lit(False)
        else:
            full = F.col("source_size") * most * open_weight <= F.col("weight") * (share * total - most * capped_size)
        row = ranked.agg(
            F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("open"),
        ).first()
        capped_size, open_weight = row["capped"], row["open"]
        if (capped_size, open_weight) == seen or not open_weight:
            break
        seen = (capped_size, open_weight)
    level = F.col("weight") * F.lit(float(share * total - most * capped_size)) / F.lit(float(open_weight or 1))
    ceiling = (F.col("source_size") * most).cast("double")
    target = ceiling if not open_weight else F.when(level >= ceiling, ceiling).otherwise(level)
    return ranked.withColumn("target", target)


def _draw(doc_id: Column, text: Column, seed: str) -> Column:
    """Uniform in [0, 1): 52 bits of a hash that other engines have as well."""
    told = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(told), 1, 13), 16, 10).cast("double") / float(1 << 52)


def plan_mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    seed: str = SEED,
) -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, copies, taken``.

    Sizes are numbers of words of the whole text, 0 for a null or empty one; a
    null source is a source of its own. A source without words gets the target 0
    and no copies. Repeated rows draw alike. An empty table gives no rows.
    """
    sized = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), _draw(F.col("doc_id"), F.col("text"), seed).alias("draw")
    )
    return _planned(sized, weights, share, most).select("doc_id", "size", "source_size", "target", "copies", "taken")


def _planned(sized: DataFrame, weights, share, most) -> DataFrame:
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most).drop("weight").withColumnRenamed("source", "its_source")
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("its_source")), "left").drop("its_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = (whole + F.when(F.col("draw") < rate - whole, 1).otherwise(0)).cast("long")
    return joined.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, seed: str = SEED) -> DataFrame:
    """``docs`` with each row as often as the plan takes it, numbered by ``copy``."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        "row",
        F.col("row.source").alias("source"),
        word_count(F.col("row.text")).alias("size"),
        _draw(F.col("row.doc_id"), F.col("row.text"), seed).alias("draw"),
    )
    return (
        _planned(inner, weights, share, most)
        .filter("copies > 0")
        .select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
        .select("row.*", *([] if "copy" in docs.columns else ["copy"]))
    )
