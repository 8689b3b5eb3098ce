"""Priority as a sum of factors that stays taken apart."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.series import Series, latest_per, top_k_per
from tidewatch.session import cut_lineage

# Our weights. Factors without a definition of their own enter as given inputs.
WEIGHTS = {"severity": 0.3, "recency": 0.2, "corroboration": 0.2, "proximity": 0.2, "reliability": 0.1}
WEIGHTS_VERSION = "w1"


def recency(age_s: Column, tau_s: float) -> Column:
    return F.when(age_s >= 0, F.exp(-age_s / tau_s)).otherwise(1.0)


def corroboration(independent: Column) -> Column:
    return independent / (independent + 1)


def factor_rows(
    inputs: DataFrame, weights: Mapping[str, float] = WEIGHTS, ids: Sequence[str] = ("event_id",)
) -> DataFrame:
    """One row per object and factor: raw value, weight, contribution."""
    names = list(weights)
    table = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(float(weights[n])))])
    long = inputs.unpivot([F.col(c) for c in ids], names, "factor", "raw")
    return (
        long.filter(F.col("raw").isNotNull())
        .withColumn("weight", F.element_at(table, F.col("factor")))
        .withColumn("contribution", F.col("raw") * F.col("weight"))
    )


def score(
    inputs: DataFrame,
    area_weight: str = "area_weight",
    weights: Mapping[str, float] = WEIGHTS,
    profile: str = "",
) -> DataFrame:
    """Priority 0..100 per object.

    ``100 * min(1, area weight * sum of contributions / sum of weights)``. A
    factor that is unknown takes no part on either side. Factors and priority
    are columns of one row, so nothing is shuffled.
    """
    total = used = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.coalesce(F.col(name) * w, F.lit(0.0))
        used = used + F.when(F.col(name).isNotNull(), w).otherwise(0.0)
    share = F.when(used > 0, F.col(area_weight) * total / used)
    return inputs.withColumns(
        {
            "priority": 100 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)),
            "weights_version": F.lit(WEIGHTS_VERSION),
            "profile_id": F.lit(profile),
        }
    )


def dominant_factor(factors: DataFrame, ids: Sequence[str] = ("event_id",)) -> DataFrame:
    """The factor that contributed most to each object."""
    return factors.groupBy(*ids).agg(
        F.max_by(F.struct("factor", "contribution"), F.struct("contribution", "factor")).alias("top")
    ).select(*ids, F.col("top.factor").alias("factor"), F.col("top.contribution").alias("contribution"))


def latest_scores(scores: DataFrame) -> DataFrame:
    return latest_per(scores, ["object_kind", "object_id", "profile_id"], ["computed_us"])


def top_events(scored: DataFrame, k: int = 20) -> DataFrame:
    """Highest priority first, unknown last, newest first among equals."""
    return scored.orderBy(F.col("priority").desc_nulls_last(), F.desc("occurred_us"), F.asc("event_id")).limit(k)


def top_per_area(matched: DataFrame, k: int) -> DataFrame:
    """Best ``k`` events per area, above the area's own minimum priority."""
    allowed = matched.filter(F.col("min_priority").isNull() | (F.col("priority") >= F.col("min_priority")))
    return top_k_per(allowed, ["aoi_id"], [F.desc("priority"), F.asc("event_id")], k)


def rank_priority(df: DataFrame, group: str, value: str, unique: str, tiles: int = 4) -> DataFrame:
    """rank, dense rank, percent rank and tile of each row in its group.

    No window ever holds a whole group. Equal values are counted first; their
    ranks come from running sums over value bands, and only ties are numbered,
    in blocks of ids.
    """
    df = cut_lineage(df)  # used three times
    counts = df.groupBy(group, value).agg(F.count("*").alias("n")).withColumn("__down", -F.col(value))
    bands = Series([group], ["__down"], F.floor(F.col("__down") * 50).cast("long"))
    ranked = bands.add(counts, bands.running_sum(F.col("n"), "__upto"), bands.row_number("dense_rank_no"))
    totals = df.groupBy(group).agg(F.count("*").alias("__total"))
    ties = Series([group, value], [unique], F.floor(F.col(unique) / 100_000).cast("long"))
    numbered = ties.with_row_number(df, "__tie")
    placed = numbered.join(
        ranked.select(group, value, (F.col("__upto") - F.col("n") + 1).alias("rank_no"), "dense_rank_no"), [group, value]
    ).join(totals, group)
    row_no = F.col("rank_no") + F.col("__tie") - 1
    total = F.col("__total")
    small, extra = F.floor(total / tiles), total % tiles
    in_large = row_no <= extra * (small + 1)
    tile = F.when(in_large, F.floor((row_no - 1) / (small + 1)) + 1).otherwise(
        extra + F.floor((row_no - 1 - extra * (small + 1)) / F.greatest(F.lit(1), small)) + 1
    )
    percent = F.when(total > 1, (F.col("rank_no") - 1) / (total - 1)).otherwise(0.0)
    return placed.withColumns({"row_no": row_no, "percent_rank": percent, "tile": tile}).drop("__tie", "__total")


def assessment_outcomes(assessments: DataFrame, now_us: int) -> DataFrame:
    """Verdict shares and forecast error per author; overdue forecasts expire."""
    overdue = (F.col("kind") == "forecast") & F.col("verdict").isNull() & (F.col("valid_to_us") < now_us)
    judged = assessments.withColumn("verdict", F.when(overdue, "expired").otherwise(F.col("verdict")))
    return judged.groupBy("author_type", "author_id").agg(
        F.count("*").alias("assessments"),
        F.count_if(F.col("verdict") == "confirmed").alias("confirmed"),
        F.count_if(F.col("verdict") == "refuted").alias("refuted"),
        F.count_if(F.col("verdict") == "expired").alias("expired"),
        F.count_if(F.col("verdict").isNull()).alias("pending"),
        F.avg("outcome_error").alias("mean_error"),
    )
