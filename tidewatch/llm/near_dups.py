"""Near duplicates by MinHash.

Many universal hash minima per document, cut into bands; documents that agree in
a whole band are candidates, their minima are compared, and what remains is
confirmed on the full shingle sets. Links become groups by alternating
large-star and small-star steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import blocks
from tidewatch.llm.collocations import FILTER_BITS, make_filter
from tidewatch.session import cut_lineage

BANDS = 28
ROWS = 4
#: Longs of the signature that pairs are verified by: one bit of each of 64 minima.
SIGNATURE = 16

_rng = np.random.default_rng(8)
_FACTORS = _rng.integers(1, 1 << 63, 64 * SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _rng.integers(0, 1 << 63, 64 * SIGNATURE, dtype=np.uint64) * np.uint64(2)


def _sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document, sorted, and where each set begins."""
    data = blocks.LOWER[data]
    words = blocks.Words(data, offsets, blocks.SPACED)
    n = len(offsets) - 1
    values = blocks.mixed(blocks.hashes(blocks.sums(data), words.starts, words.ends))
    at, grams = words.grams(values, size)
    doc = words.doc[at]
    few = np.flatnonzero((np.diff(words.bounds) > 0) & (np.diff(words.bounds) < size))
    if len(few):
        # Too few words for a shingle: the whole sequence is one.
        whole = values[words.bounds[few]].copy()
        for k in range(1, size - 1):
            more = words.bounds[few] + k < words.bounds[few + 1]
            whole[more] = whole[more] * np.uint64(blocks.BASE) + values[words.bounds[few][more] + k]
        doc, grams = np.concatenate([doc, few]), np.concatenate([grams, blocks.mixed(whole + np.uint64(1))])
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    return grams[new], np.searchsorted(doc[new], np.arange(n + 1))


def _minima(grams: np.ndarray, bounds: np.ndarray, many: int) -> np.ndarray:
    """One row per non-empty set: the least value of every hash function."""
    filled = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(filled), many), dtype=np.uint32)
    for k in range(many if len(filled) else 0):
        values = (grams * _FACTORS[k] + _TERMS[k]) >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(values.astype(np.uint32), filled)
    return out


def _keys(minima: np.ndarray) -> np.ndarray:
    """One key per set and band."""
    out = np.zeros((len(minima), BANDS), dtype=np.uint64)
    for k in range(ROWS):
        out = out * np.uint64(blocks.BASE) + minima[:, k::ROWS].astype(np.uint64) + np.uint64(1)
    return blocks.mixed(out ^ blocks.mixed(np.arange(1, BANDS + 1, dtype=np.uint64)))


def _set_hashes(grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit hashes of each set."""
    out = []
    for salt in (1, 2):
        running = np.concatenate([[np.uint64(0)], np.cumsum(blocks.mixed(grams + np.uint64(salt)))])
        out.append((running[bounds[1:]] - running[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def _described(docs: DataFrame, size: int, full: bool) -> DataFrame:
    """``doc_id, n_shingles, set_a, set_b`` and band keys, or signature and set."""
    tail = "keys array<long>" + ", signature array<long>, shingles array<long>" * full
    kind = docs.schema["doc_id"].dataType.simpleString()

    def lists(present: np.ndarray, values: np.ndarray, width: int, type_):
        ends = np.concatenate([[0], np.cumsum(np.where(present, width, 0))]).astype(np.int32)
        return pa.ListArray.from_arrays(ends, pa.array(values.ravel(), type_))

    def run(batches):
        for rows, data, offsets in blocks.text_blocks(batches, "text"):
            grams, bounds = _sets(data, offsets, size)
            counts = np.diff(bounds)
            first, second = _set_hashes(grams, bounds)
            minima = _minima(grams, bounds, len(_FACTORS) if full else BANDS * ROWS)
            columns = [rows.column("doc_id"), pa.array(counts), pa.array(first), pa.array(second)]
            columns.append(lists(counts > 0, _keys(minima[:, : BANDS * ROWS]).view(np.int64), BANDS, pa.int64()))
            names = ["doc_id", "n_shingles", "set_a", "set_b", "keys"]
            if full:
                bits = np.packbits((minima & 1).astype(np.uint8), axis=1).view(np.int64)
                columns.append(lists(counts > 0, bits, SIGNATURE, pa.int64()))
                columns.append(pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(grams.view(np.int64))))
                names += ["signature", "shingles"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, set_a long, set_b long, {tail}")


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` from ``(a, b)``: the least node that can be reached.

    Large star: every node ties its larger neighbours to the least node around
    it. Small star: every node ties its smaller neighbours, and itself, to the
    least of them. They alternate until neither changes a link. A node's links are
    only ever aggregated to a minimum, never listed in one place.
    """
    links = cut_lineage(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )

    def print_of(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = print_of(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lower, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        links = cut_lineage(small)
        after = print_of(links)
        if after == before:
            break
        before = after
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _alike(percent: int):
    """Condition that enough bits of two signatures agree.

    Bits of sets with similarity s agree with probability (1 + s) / 2; the limit is
    5.5 standard deviations under what is expected at the threshold.
    """
    bits = 64 * SIGNATURE
    p = (1 + percent / 100) / 2
    most = int(bits * (1 - p) + 5.5 * (bits * p * (1 - p)) ** 0.5)
    differ = [F.bit_count(F.col(f"bits{k}").bitwiseXOR(F.col(f"other_bits{k}"))) for k in range(SIGNATURE)]
    total = differ[0]
    for d in differ[1:]:
        total = total + d
    return total <= most


def _may_be_among(ids: DataFrame, column: str, most: int = FILTER_BITS):
    """Condition on ``column``: true for all values in ``ids`` and for few others.

    Rows that fail it need not be shuffled with their texts to be joined with
    ``ids``. The filter takes 16 bits an id, up to ``most``; when that is too few, more
    rows pass, and the join that follows decides.
    """
    bits = min(most, max(1 << 18, 1 << (16 * ids.count()).bit_length()))
    seen = make_filter(ids.select(F.xxhash64(column).alias("mark")), bits)

    @F.arrow_udf("boolean")
    def among(marks: pa.Array) -> pa.Array:
        return pa.array(seen.may_hold(marks.to_numpy(zero_copy_only=False).view(np.uint64)))

    return among(F.xxhash64(column))


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, shared, total``: overlap and sizes of the full sets."""
    full = sets.select("rep", "shingles")
    return (
        pairs.join(full.toDF("a", "set_a"), "a")
        .join(full.toDF("b", "set_b"), "b")
        .select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("shared"), (F.size("set_a") + F.size("set_b")).alias("total"))
    )


def group_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked when ``100 * shared >= percent * all`` holds for their
    sets of distinct ``words``-word shingles (ASCII lower case, words end at white
    space; a text with fewer words is one shingle). ``component_id`` is the least
    ``doc_id`` that can be reached, ``kept`` marks the row with that id.

    Equal sets are one class and only its least id goes on. In a band's bucket all
    are compared with one, the head, and groups are formed; then those members are
    compared that are still in different groups, whose overlaps with the head leave
    room for a link, and whose signatures agree. A bucket of copies is one group after the first round, so
    its members are never paired with each other. A link at the threshold is missed
    with a chance of 4e-7 (28 bands of 4).

    A null or empty text, or a null id, is linked with nothing and kept; a row
    that occurs twice keeps both, as they share the id. Other columns are ignored.
    An empty table gives no rows.
    """
    docs = blocks.lean(docs.select("doc_id", "text"))
    rows = cut_lineage(_described(docs, words, full=False))
    filled = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = filled.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"))
    reps = filled.groupBy("set_a", "set_b").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")
    )
    entries = reps.select("rep", "n", "set_a", "set_b", F.posexplode("keys").alias("band", "key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1").select("key")
    buckets = cut_lineage(entries.join(shared, "key"))
    wanted = buckets.select(F.col("rep").alias("doc_id"), "set_a", "set_b").distinct()
    candidates = cut_lineage(wanted.select("doc_id").distinct())
    near = docs.filter(_may_be_among(candidates, "doc_id")).join(candidates, "doc_id", "left_semi")
    sets = cut_lineage(
        _described(near, words, full=True)
        .join(wanted, ["doc_id", "set_a", "set_b"], "left_semi")
        .withColumnRenamed("doc_id", "rep")
        .drop("n_shingles")
    )
    # A shingle that no other candidate has is shared with none of them. What is
    # left bounds every overlap, so a set that is mostly its own needs no partner.
    own = (
        sets.select("rep", F.explode("shingles").alias("shingle"))
        .groupBy("shingle")
        .agg(F.count("*").alias("sets"), F.min("rep").alias("rep"))
        .filter("sets = 1")
        .groupBy("rep")
        .agg(F.count("*").alias("own"))
    )
    entered = cut_lineage(
        buckets.select("key", "band", "rep", "n")
        .join(own, "rep", "left")
        .withColumn("common", F.col("n") - F.coalesce("own", F.lit(0)))
        .filter(100 * F.col("common") >= percent * F.col("n"))
        .drop("own")
    )
    # First everyone is compared with the head of its buckets: the set with the
    # least share of its own, as the text is that the others were copied from.
    alone = (F.col("n") - F.col("common")) / F.col("n")
    heads = entered.groupBy("key").agg(F.min(F.struct(alone.alias("alone"), "rep", "n", "common")).alias("head")).select(
        "key", F.col("head.rep").alias("head"), F.col("head.n").alias("head_n"), F.col("head.common").alias("head_common")
    )
    led = entered.join(heads, "key")
    enough = lambda overlap, total: (100 + percent) * overlap >= percent * total
    to_heads = (
        led.filter("rep <> head")
        .filter(enough(F.least("common", "head_common"), F.col("n") + F.col("head_n")))
        .select(F.col("head").alias("a"), F.col("rep").alias("b"))
        .distinct()
    )
    first = cut_lineage(_compared(to_heads, sets))
    links = first.filter(enough(F.col("shared"), F.col("total"))).select("a", "b")
    groups = cut_lineage(components(links))
    # Then members of one bucket that are still in different groups. Two sets share
    # at most the lesser overlap with the head, and the lesser rest that is not
    # their own: that leaves few pairs of a family's distant members.
    members = (
        led.join(first.select(F.col("a").alias("head"), F.col("b").alias("rep"), "shared"), ["head", "rep"], "left")
        .withColumn("inner", F.when(F.col("rep") == F.col("head"), F.col("common")).otherwise(F.coalesce("shared", F.least("common", "head_common"))))
        .withColumn("outer", F.when(F.col("rep") != F.col("head"), F.col("common") - F.coalesce("shared", F.lit(0))).otherwise(0))
        .join(groups.toDF("rep", "grp"), "rep", "left")
        .withColumn("grp", F.coalesce("grp", "rep"))
        .select("key", "band", "rep", "n", "inner", "outer", "grp")
    )
    sizes = members.groupBy("key", "grp").agg(F.count("*").alias("size"))
    # Of two members in different groups one is not in the largest group.
    split = sizes.groupBy("key").agg(F.count("*").alias("grps"), F.max_by("grp", "size").alias("largest")).filter("grps > 1").drop("grps")
    bits = sets.select("rep", "keys", *[F.col("signature")[k].alias(f"bits{k}") for k in range(SIGNATURE)])
    members = cut_lineage(members.join(split, "key").join(bits, "rep"))
    apart = members.filter("grp <> largest").drop("largest", "band")
    apart = apart.select("key", *[F.col(c).alias(f"other_{c}") for c in apart.columns if c != "key"])
    pairs = (
        members.join(apart, "key")
        .filter(F.col("grp") != F.col("other_grp"))
        .filter(enough(F.least("n", "other_n"), F.col("n") + F.col("other_n")))
        .filter(enough(F.least("inner", "other_inner") + F.least("outer", "other_outer"), F.col("n") + F.col("other_n")))
        .filter(_alike(percent))
        # Of the bands that both agree in, the first one has the pair, once.
        .filter((F.col("grp") == F.col("largest")) | (F.col("rep") < F.col("other_rep")))
        .filter(F.array_position(F.zip_with("keys", "other_keys", lambda x, y: x == y), True) == F.col("band") + 1)
        .select(F.least("rep", "other_rep").alias("a"), F.greatest("rep", "other_rep").alias("b"))
        .distinct()
        .join(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    )
    second = cut_lineage(_compared(cut_lineage(pairs), sets).filter(enough(F.col("shared"), F.col("total"))).select("a", "b"))
    if not second.isEmpty():
        groups = cut_lineage(components(links.unionByName(second)))
    # Written, so that the join with all rows can be split at a set of many copies.
    named = cut_lineage(
        classes.join(groups.toDF("rep", "grp"), "rep", "left").select("set_a", "set_b", F.coalesce("grp", "rep").alias("grp"))
    )
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("grp")).otherwise(F.col("doc_id"))
    return (
        rows.drop("keys")
        .join(named, ["set_a", "set_b"], "left")
        .withColumn("component_id", component)
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, that of the least id.

    Rows are told apart by id and text: of an id that stands on different texts only
    the copies go, and copies without an id are copies as well; both come after all
    other ids in the order. Of rows equal in id and text the first one in the order
    of their columns stays. Rows without words are never copies. An empty table
    gives no rows.
    """
    row = blocks.row_key()
    shared = cut_lineage(
        docs.select("doc_id", row.alias("row")).filter("doc_id IS NOT NULL").groupBy("doc_id")
        .agg(F.min("row").alias("low"), F.max("row").alias("high")).filter("low <> high").select("doc_id", F.lit(True).alias("__shared"))
    )
    own = F.when(F.col("doc_id").isNull() | F.col("__shared"), F.shiftrightunsigned(row, 2) + F.lit(1 << 62)).otherwise(F.col("doc_id").cast("long"))
    # Mostly no id is on several texts: then texts are not shuffled to learn that.
    marked = docs.withColumn("__shared", F.lit(False)) if shared.isEmpty() else docs.join(shared, "doc_id", "left")
    named = marked.withColumn("__node", own)
    decided = cut_lineage(group_near_duplicates(named.select(F.col("__node").alias("doc_id"), "text"), words, percent))
    gone = cut_lineage(decided.filter(~F.col("kept")).select(F.col("doc_id").alias("__node")).distinct())
    # Rows that surely stay are not shuffled.
    may_go = _may_be_among(gone, "__node")
    left = named.filter(~may_go).unionByName(named.filter(may_go).join(gone, "__node", "left_anti")).select("__node", *docs.columns)
    twice = cut_lineage(
        decided.filter("kept AND n_shingles > 0").groupBy(F.col("doc_id").alias("__node")).agg(F.count("*").alias("n")).filter("n > 1").select("__node")
    )
    if not twice.isEmpty():
        whole = F.struct(*docs.columns)
        once = left.join(twice, "__node", "left_semi").groupBy("__node").agg(F.min_by(whole, F.to_json(whole)).alias("__row")).select("__node", "__row.*")
        left = left.join(twice, "__node", "left_anti").unionByName(once)
    return left.select(*docs.columns)
