"""Phrases whose words come together more often than their parts let expect.

Stripes: each prefix owns a counter of the words that follow it. A task counts
the stripes of its texts and passes them on; equal stripes are merged entry by
entry. The entries are the counts of the longer phrases, the stripes of the next
shorter prefix hold the totals of the prefixes, and the largest entry of a stripe
says how much of a phrase is used up by a longer one.

The stripes of hot prefixes are kept in slices by their next word, so that no task
has all of one. Phrases that are too rare cannot be part of a
frequent one: each level drops what a Bloom filter of the level before excludes.
The filter has a fixed size and never excludes a frequent phrase.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.series import top_k_per
from tidewatch.llm import blocks
from tidewatch.session import cut_lineage

LEAST, BEST, WORDS = 10, 2000, 3
#: Bytes of texts counted at once, entries merged and sent at once, bits of a filter.
COUNTED_BYTES, MERGED_ENTRIES, SENT_ENTRIES, FILTER_BITS = 4 << 20, 150_000, 20_000, 1 << 27
#: Slices of the stripe of the empty prefix, and of any other hot prefix: one that
#: holds one in ``HOT`` or more of its language's words, so at most ``HOT`` a language.
FIRST_SLICES, SLICES, HOT = 4096, 64, 10_000
#: Parts in which a language's phrases are ranked before the last step.
RANK_PARTS = 64
PROBES = 4

#: Bytes that end a piece, and bytes of words.
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".,;:!?"]] = _ENDS[10:14] = True
_WORD = ~_ENDS
_WORD[[9, 32]] = False

_STRIPE = pa.schema(
    [
        ("lang", pa.string()),
        ("prefix", pa.string()),
        ("slice", pa.int32()),
        ("next", pa.list_(pa.string())),
        ("n", pa.list_(pa.int64())),
    ]
)
_STRIPE_DDL = "lang string, prefix string, slice int, next array<string>, n array<long>"
_ENTRY_DDL = "lang string, prefix string, next string, n long, mark long"


def _lang_mark(lang: str) -> np.uint64:
    return blocks.mixed(np.array([zlib.crc32(lang.encode())], dtype=np.uint64))[0]


def _marks(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of a phrase from the hashes of its language and words."""
    out = columns[0].copy()
    for c in columns[1:]:
        out = blocks.mixed(out * np.uint64(blocks.BASE) + c)
    return out


def _string_marks(strings: pa.Array) -> np.ndarray:
    raw = strings.cast(pa.large_binary())
    _, where, store = raw.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(store, dtype=np.uint8)[offsets[0] : offsets[-1]] if len(raw) and store is not None else np.zeros(0, dtype=np.uint8)
    offsets = offsets - offsets[0] if len(raw) else np.zeros(1, dtype=np.int64)
    return blocks.mixed(blocks.short_hashes(blocks.short_sums(data), offsets[:-1], offsets[1:]))


class Seen:
    """Bloom filter over phrase marks."""

    def __init__(self, bits: np.ndarray, size: int):
        self.bits, self.size = bits, size

    def may_hold(self, marks: np.ndarray) -> np.ndarray:
        out = np.ones(len(marks), dtype=bool)
        first, step = marks & np.uint64(0x7FFFFFFF), (marks >> np.uint64(32)) | np.uint64(1)
        for i in range(PROBES):
            at = (first + np.uint64(i) * step) % np.uint64(self.size)
            out &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def make_filter(entries: DataFrame, bits: int) -> Seen:
    """The filter of all entries. Spark builds it as bitmaps of 4 KB; at most
    ``bits / 8`` bytes reach the driver, however many entries there are."""
    first = F.col("mark").bitwiseAND(0x7FFFFFFF)
    step = F.shiftrightunsigned("mark", 32).bitwiseOR(F.lit(1).cast("long"))
    at = F.explode(F.array(*[(first + i * step) % bits + 1 for i in range(PROBES)])).alias("at")
    maps = (
        entries.select(at)
        .groupBy(F.bitmap_bucket_number("at").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    )
    out = np.zeros(bits // 8 + 4096, dtype=np.uint8)
    for row in maps.toLocalIterator():
        # Places count from one here: bucket b has those up to b * 32768.
        begin = (row["bucket"] - 1) * 4096
        out[begin : begin + 4096] |= np.frombuffer(row["bits"], dtype=np.uint8)
    return Seen(out, bits)


def _gathered(batches, limit: int):
    """Batches joined until they have about ``limit`` bytes: fuller stripes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _counted(level: int, seen: Seen | None, hot: np.ndarray, limit: int):
    """Stripes of prefixes of ``level`` words in a task's texts."""
    slices = SLICES if level else FIRST_SLICES

    def run(batches):
        for rows, raw, offsets in blocks.text_blocks(_gathered(batches, limit), "text", limit):
            data = blocks.LOWER[raw]
            words = blocks.Words(data, offsets, _WORD)
            count = len(words.starts)
            if count <= level:
                continue
            # Distinct words, compared as strings.
            lengths = words.ends - words.starts
            store = data[_WORD[data]]
            where = np.concatenate([[0], np.cumsum(lengths)])
            coded = pa.Array.from_buffers(
                pa.large_binary(), count, [None, pa.py_buffer(where), pa.py_buffer(store)]
            ).cast(pa.large_string()).dictionary_encode()
            ids, known = coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.string())
            marks, size = _string_marks(known), len(known)
            tongues = pc.fill_null(rows.column(rows.schema.get_field_index("lang")), "und").dictionary_encode()
            tongue_marks = np.array([_lang_mark(t) for t in tongues.dictionary.to_pylist()], dtype=np.uint64)
            tongue = tongues.indices.to_numpy().astype(np.int64)[words.doc]
            # Word i and the next one stand in one piece.
            ended = np.concatenate([[0], np.cumsum(_ENDS[data])])
            joined = (words.doc[1:] == words.doc[:-1]) & (ended[words.starts[1:]] == ended[words.starts[:-1]])
            own = tongue * size + ids
            if level == 0:
                at, prefix, parts = np.arange(count), tongue, []
            else:
                single, of = np.unique(own, return_inverse=True)
                if level == 1:
                    own_marks = _marks([tongue_marks[single // size], marks[single % size]])
                    fine = seen.may_hold(own_marks)[of]
                    at = np.flatnonzero(joined & fine[:-1] & fine[1:])
                    prefix, parts = own[at], [ids[at]]
                else:
                    pairs, of = np.unique(own[:-1] * size + ids[1:], return_inverse=True)
                    left = pairs // size
                    own_marks = _marks([tongue_marks[left // size], marks[left % size], marks[pairs % size]])
                    fine = seen.may_hold(own_marks)[of] & joined
                    at = np.flatnonzero(fine[:-1] & fine[1:])
                    prefix, parts = of[at], [ids[at], ids[at + 1]]
            if not len(at):
                continue
            follow = ids[at + level]
            _, first, rank = np.unique(prefix, return_index=True, return_inverse=True)
            slice_of = (marks % np.uint64(slices)).astype(np.int64)[follow]
            if level:
                slice_of[~np.isin(own_marks, hot)[of[at]]] = 0
            entry, n = np.unique((rank * slices + slice_of) * size + follow, return_counts=True)
            stripe, follow = entry // size, entry % size
            begin = np.flatnonzero(np.concatenate([[True], stripe[1:] != stripe[:-1]]))
            stripe = stripe[begin]
            where = first[stripe // slices]
            named = [known.take(pa.array(p[where])) for p in parts]
            text = pc.binary_join_element_wise(*named, " ") if named else pa.array([""] * len(begin))
            lists = pa.array(np.append(begin, len(entry)), pa.int32())
            table = pa.Table.from_arrays(
                [
                    tongues.dictionary.take(pa.array(tongue[at[where]])),
                    text,
                    pa.array(stripe % slices, pa.int32()),
                    pa.ListArray.from_arrays(lists, known.take(pa.array(follow))),
                    pa.ListArray.from_arrays(lists, pa.array(n, pa.int64())),
                ],
                schema=_STRIPE,
            )
            yield from table.to_batches(max_chunksize=max(1, SENT_ENTRIES * len(begin) // len(entry)))

    return run


def _flat(table: pa.Table) -> pa.Table:
    """One row per entry of the stripes."""
    nexts, counts = table.column("next").combine_chunks(), table.column("n").combine_chunks()
    where = pc.list_parent_indices(nexts)
    return pa.table(
        {
            "lang": table.column("lang").combine_chunks().take(where),
            "prefix": table.column("prefix").combine_chunks().take(where),
            "next": pc.list_flatten(nexts),
            "n": pc.list_flatten(counts),
        }
    )


def _merged(least: int, totals: bool):
    """Adds up equal stripes of a sorted partition; keeps entries of ``least`` or
    more, and the stripe's total as an entry without a word if asked for."""

    def finish(table: pa.Table) -> pa.RecordBatch:
        entries = _flat(table).group_by(["lang", "prefix", "next"]).aggregate([("n", "sum")])
        kept = entries.filter(pc.greater_equal(entries.column("n_sum"), least))
        out = [kept.column(c).combine_chunks() for c in ("lang", "prefix", "next", "n_sum")]
        tongues = out[0].dictionary_encode()
        columns = [np.array([_lang_mark(t) for t in tongues.dictionary.to_pylist()], dtype=np.uint64)[tongues.indices.to_numpy()]]
        if len(kept):
            prefix = pc.split_pattern(out[1], " ")
            for k in range(len(prefix[0]) if out[1][0].as_py() else 0):
                columns.append(_string_marks(pc.list_element(prefix, k)))
            columns.append(_string_marks(out[2]))
        mark = _marks(columns).view(np.int64) if len(kept) else np.zeros(0, dtype=np.int64)
        batch = pa.table(out + [pa.array(mark)], names=["lang", "prefix", "next", "n", "mark"])
        if totals:
            whole = entries.group_by(["lang", "prefix"]).aggregate([("n_sum", "sum")])
            none = pa.nulls(len(whole), pa.string())
            extra = pa.table(
                [whole.column("lang"), whole.column("prefix"), none, whole.column("n_sum_sum"), pa.nulls(len(whole), pa.int64())],
                names=["lang", "prefix", "next", "n", "mark"],
            )
            batch = pa.concat_tables([batch, extra])
        return batch

    def run(batches):
        held, waiting = [], 0

        def step(table: pa.Table, last: bool):
            if last or not len(table):
                return table, None
            end = len(table) - 1
            same = None
            for c in ("slice", "lang", "prefix"):
                equal = pc.equal(table.column(c), table.column(c)[end])
                same = equal if same is None else pc.and_(same, equal)
            return table.filter(pc.invert(same)), table.filter(same)

        def pack(open_: pa.Table) -> pa.Table:
            # The stripe that may go on is added up at once: it holds each word once.
            entries = _flat(open_).group_by(["next"]).aggregate([("n", "sum")])
            ends = pa.array([0, len(entries)], pa.int32())
            return pa.Table.from_arrays(
                [
                    open_.column("lang").slice(0, 1),
                    open_.column("prefix").slice(0, 1),
                    open_.column("slice").slice(0, 1),
                    pa.ListArray.from_arrays(ends, entries.column("next").combine_chunks()),
                    pa.ListArray.from_arrays(ends, entries.column("n_sum").combine_chunks()),
                ],
                schema=_STRIPE,
            )

        def flush(last: bool):
            nonlocal held, waiting
            done, open_ = step(pa.concat_tables(held), last)
            held, waiting = ([pack(open_)] if open_ is not None and len(open_) else []), 0
            if len(done):
                yield from finish(done).to_batches(max_chunksize=SENT_ENTRIES)

        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]).cast(_STRIPE))
                waiting += len(held[-1].column("n").combine_chunks().flatten())
            if waiting >= MERGED_ENTRIES:
                yield from flush(False)
        if held:
            yield from flush(True)

    return run


def hot_marks(entries: DataFrame, words: DataFrame) -> np.ndarray:
    """Marks of the phrases that hold one in ``HOT`` of their language's words."""
    rows = entries.join(words, "lang").filter(HOT * F.col("n") >= F.col("words")).select("mark").collect()
    return np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64)


def stripes(
    docs: DataFrame, level: int, seen: Seen | None, hot: np.ndarray, least: int, totals: bool, limit: int = COUNTED_BYTES
) -> DataFrame:
    """Entries ``lang, prefix, next, n`` of the merged stripes of one prefix length."""
    counted = docs.mapInArrow(_counted(level, seen, hot, limit), _STRIPE_DDL)
    key = ["slice", "lang", "prefix"]
    return counted.repartition(*key).sortWithinPartitions(*key).mapInArrow(_merged(least, totals), _ENTRY_DDL)


def mine_phrases(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST,
    best: int | None = BEST,
    max_words: int = WORDS,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """The best ``best`` phrases of two or three words of each language.

    Returns ``lang, rank, phrase, a, l, r, n, score``: ``a`` occurrences of the
    phrase (at least ``least``), ``l`` and ``r`` those of the two parts of its
    weakest cut, ``n`` words of the language, ``score`` the millionth parts of
    a*a / (l*r), rounded down. Phrases that lie in a longer one with half of their
    occurrences or more are left out. ``best=None`` returns all, without a rank limit.

    Counts are exact. A null language is ``und``; a null or empty text has no
    words. Repeated rows count as often as they stand. Equal scores go by
    occurrences, then by the phrase's bytes. Only the two named columns are
    read; an empty table gives no rows.
    """
    if max_words not in (2, 3):
        raise ValueError("phrases have two or three words")
    docs = blocks.lean(docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")))
    levels, n, seen, hot = [], None, None, np.zeros(0, dtype=np.uint64)
    for level in range(max_words):
        if level:
            known = levels[-1].filter(F.col("next").isNotNull())
            seen, hot = make_filter(known, filter_bits), hot_marks(known, n.withColumnRenamed("n", "words"))
        levels.append(cut_lineage(stripes(docs, level, seen, hot, least, totals=level == 0)))
        if n is None:
            n = cut_lineage(levels[0].filter(F.col("next").isNull()).groupBy("lang").agg(F.sum("n").alias("n")))
    phrase = F.concat_ws(" ", F.nullif("prefix", F.lit("")), "next").alias("phrase")
    counts = [e.filter(F.col("next").isNotNull()).select("lang", "prefix", "next", phrase, F.col("n").alias("f")) for e in levels]
    parts = counts[0].select("lang", "phrase", "f")
    first, rest = F.substring_index("prefix", " ", 1), F.substring_index("prefix", " ", -1)
    cut = lambda k, left, right: F.struct(F.lit(k).alias("k"), left.alias("left"), right.alias("right"))
    candidates = counts[1].select("lang", "phrase", F.col("f").alias("a"), F.array(cut(1, F.col("prefix"), F.col("next"))).alias("cuts"))
    if max_words == 3:
        parts = parts.unionByName(counts[1].select("lang", "phrase", "f"))
        tail = F.concat_ws(" ", rest, F.col("next"))
        longer = (
            counts[2].groupBy("lang", F.col("prefix").alias("phrase")).agg(F.max("f").alias("longest"))
            .unionByName(counts[2].groupBy("lang", tail.alias("phrase")).agg(F.max("f").alias("longest")))
            .groupBy("lang", "phrase").agg(F.max("longest").alias("longest"))
        )
        free = candidates.join(longer, ["lang", "phrase"], "left").filter(F.col("longest").isNull() | (2 * F.col("longest") < F.col("a")))
        candidates = free.drop("longest").unionByName(
            counts[2].select("lang", "phrase", F.col("f").alias("a"), F.array(cut(1, first, tail), cut(2, F.col("prefix"), F.col("next"))).alias("cuts"))
        )
    cuts = candidates.select("lang", "phrase", "a", F.explode("cuts").alias("c")).select("lang", "phrase", "a", "c.k", "c.left", "c.right")
    sized = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(
        parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]
    )
    # Whole numbers of up to 38 digits: exact for counts up to 10^16.
    big = lambda c: F.col(c).cast("decimal(16,0)")
    score = F.expr("(CAST(1000000 AS DECIMAL(7,0)) * aa) DIV lr")
    scored = sized.withColumn("aa", (big("a") * big("a")).cast("decimal(31,0)")).withColumn("lr", (big("l") * big("r")).cast("decimal(38,0)")).select(
        "lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("weakest")
    )
    weakest = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min("weakest").alias("w"))
    flat = weakest.select("lang", "phrase", "a", "w.l", "w.r", "w.score")
    if best is not None:
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        dealt = flat.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
        flat = top_k_per(dealt, ["lang", "part"], order, best).drop("rank_no", "part")
        flat = top_k_per(flat, ["lang"], order, best).withColumnRenamed("rank_no", "rank")
        out = ["lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"]
    else:
        out = ["lang", "phrase", "a", "l", "r", "n", "score"]
    return flat.join(n, "lang").select(*out)
