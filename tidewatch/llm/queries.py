"""The registered queries of the package, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.plan import computed_once
from tidewatch.llm import (
    blocks,
    chat,
    collocations,
    decontaminate,
    html_text,
    language,
    licences,
    mixing,
    near_dups,
    periodic,
    pii,
    quality,
    repeats,
    sql,
    toxicity,
)

QUERIES = {}
SQL: dict[str, str] = {}


def query(name: str, text: str | None = None):
    def register(build):
        QUERIES[name] = build
        if text is not None:
            SQL[name] = text
        return build

    return register


@query("op1_decontaminate", sql.DECONTAMINATE)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_passages(
        blocks.documents(spark, folder).select("doc_id", "text"), blocks.documents(spark, folder, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        "contaminated",
    )


@query("op3_quality_rules", sql.QUALITY)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    measured = quality.measure(blocks.documents(spark, folder).select("doc_id", "text"))
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op7_mix_sources", sql.MIX)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.plan_mix(blocks.documents(spark, folder)).select("doc_id", "size", "source_size", "target", "taken")


@query("op8_near_duplicates", sql.NEAR_DUPLICATES)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return near_dups.group_near_duplicates(blocks.documents(spark, folder), words=2, percent=80)


@query("op6_personal_data")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_spans(blocks.documents(spark, folder).select("doc_id", "text"))
    kinds = F.transform("base_spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(pii.told(F.col("base_spans")), 256).alias("base_sha256"), pii.told(F.col("spans")).alias("spans")
    )


@query("op2_suffix_dedup")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.find_repeats(blocks.documents(spark, folder))


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


@query("op10_toxicity")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = blocks.documents(spark, folder).select("doc_id", "text")
    labels = blocks.documents(spark, folder, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs.filter(~_held_out()), labels.filter(~_held_out()))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", _held_out().alias("held_out"), "score", "predicted")


@query("op4_language")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = blocks.documents(spark, folder).select("doc_id", "text", "lang")
    trees = language.fit(docs.filter(F.col("doc_id").isNotNull() & ~_held_out()))
    found = language.identify(docs.select("doc_id", "text"), trees)
    return found.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")


@query("op9_html_text")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(blocks.documents(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


@query("op5_chat_turns")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Roles are learnt from three quarters of the conversations and recovered for
    all of them, whose rows are cut where another speaker is marked; the given roles
    are no input of that."""
    rows = blocks.documents(spark, folder, "conversations").select(F.col("conv_id").alias("id"), "turn", "role", "text")
    held_out = F.coalesce(F.crc32(F.col("id").cast("string")) % 4 == 2, F.lit(False))
    found = chat.recover(chat.speakers(rows.drop("role")), chat.fit(rows.filter(F.col("id").isNotNull() & ~held_out)))
    return found.select(F.col("id").alias("conv_id"), held_out.alias("held_out"), "turn", "role", "n_parts", "rendered")


@query("op11_collocations", sql.COLLOCATIONS)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine_phrases(blocks.documents(spark, folder))


@query("op12_licences", sql.licences())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    index = licences.build_index(licences.templates(spark))
    found = licences.find_licences(blocks.documents(spark, folder).select("doc_id", "text"), index)
    starts = F.transform("base_places", lambda p: p["start"])
    base = F.transform("base_places", lambda p: p["label"])
    own = F.transform("matches", lambda m: m["label"])
    named = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    covered = F.coalesce(F.array_max(F.transform("matches", lambda m: m["covered"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base_places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        named(base).alias("base_labels"),
        named(F.concat(base, own)).alias("labels"),
        F.when(F.size("base_places") > 0, 1.0).otherwise(covered).alias("score"),
    )


def _with_planted_periods(docs: DataFrame) -> DataFrame:
    """Texts of a tenth of the ids repeat some of their words from a place on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    cut = computed_once(docs.select("doc_id", "text"), "words", words)
    n, g = F.size("words").cast("long"), F.floor(h / 10)
    a = F.try_mod(g, n)
    period = 1 + F.floor((n - a) / (3 + g % 8))
    at = lambda i: F.when(i < a, i).otherwise(a + F.try_mod(i - a, period))
    repeated = F.array_join(
        F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("words", at(i).cast("int"))), " "
    )
    return cut.select("doc_id", F.when(n > 0, repeated).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs", sql.PERIODIC)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.find_runs(_with_planted_periods(blocks.documents(spark, folder)))
    ahead = lambda x, y: x["length"] * y["period"] - y["length"] * x["period"]
    later = lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["period"] - y["period"])
    order = lambda x, y: F.signum(F.when(ahead(x, y) != 0, -ahead(x, y)).otherwise(later(x, y))).cast("int")
    top = F.get(F.array_sort("runs", order), F.lit(0))
    told = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    ended = F.array_join(F.transform(told, lambda t: F.concat(t, F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), ended.alias("told"), "collapsed").select(
        "doc_id",
        "n_runs",
        "top.start",
        "top.length",
        "top.period",
        F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        F.sha2("told", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
