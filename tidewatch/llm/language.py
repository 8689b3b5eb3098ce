"""Language identification by prediction by partial matching.

Every language has a tree of byte contexts of up to four bytes with the counts of
the bytes that followed. A byte seen in its context costs its share of
``count / (total + kinds)``; else an escape, ``kinds / (total + kinds)``, is paid
and the next shorter context decides, down to one of 256 equal bytes. The counts
are frozen after training, and a text's language is the one whose tree gives the
shortest exact code of the whole text. No count is left out: trees that are too
large for one table are searched in slices, one after the other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import blocks
from tidewatch.session import cut_lineage

ORDER = 4
#: Table cells of a slice of the trees (sequences times languages), and languages
#: that are looked up together. They say how many slices there are, not what is kept.
SLICE_CELLS = 8_000_000
TOGETHER = 16
#: Slices whose sums are written together.
ROUND = 8
UNKNOWN = "und"
#: Distinct sequences that a task gathers before it passes their counts on.
GATHERED = 2_000_000

_BREAK = 10  # stands for what is before a text


def _padded(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block with ``ORDER`` breaks before each text; places of its bytes."""
    n = len(offsets) - 1
    place = np.arange(len(raw)) + ORDER * np.repeat(np.arange(1, n + 1), np.diff(offsets))
    data = np.full(len(raw) + ORDER * n, _BREAK, dtype=np.uint8)
    data[place] = raw
    return data, place


def _sequences(data: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """The last ``length`` bytes up to each place, as one number."""
    out = np.zeros(len(place), dtype=np.int64)
    for k in range(length - 1, -1, -1):
        out = (out << 8) | data[place - k]
    return out


def count_sequences(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, seq, n)``: how often each five-byte sequence occurs in the texts
    of each language. Counted over all rows, first within each task."""

    def run(batches):
        names: dict[str, int] = {}
        held, size = [], 0

        def out(parts):
            if not parts:
                return
            key = np.concatenate([p[0] for p in parts])
            order = np.argsort(key, kind="stable")
            key, n = key[order], np.concatenate([p[1] for p in parts])[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            key, n = key[first], np.add.reduceat(n, first)
            told = list(names)
            for a in range(0, len(key), 100_000):
                part = key[a : a + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(told).take(pa.array(part >> 40)), pa.array(part & ((1 << 40) - 1)), pa.array(n[a : a + 100_000])],
                    names=["lang", "seq", "n"],
                )

        for rows, raw, offsets in blocks.text_blocks(batches, text):
            data, place = _padded(raw, offsets)
            codes = np.array([names.setdefault(v, len(names)) for v in rows.column(rows.schema.get_field_index(lang)).to_pylist()], dtype=np.int64)
            keys = (np.repeat(codes, np.diff(offsets)) << 40) | _sequences(data, place, ORDER + 1)
            part = np.unique(keys, return_counts=True)
            held.append(part)
            size += len(part[0])
            if size > GATHERED:
                yield from out(held)
                held, size = [], 0
        yield from out(held)

    counted = blocks.lean(docs).select(text, lang).mapInArrow(run, "lang string, seq long, n long")
    return counted.groupBy("lang", "seq").agg(F.sum("n").alias("n"))


class Trees:
    """The frozen context trees of some languages, as tables of natural logarithms.

    ``lang, seq, n`` may be a slice: all sequences whose two bytes before the last
    are in a range. ``pairs`` then has the counts of all two-byte sequences, and a
    place of that range costs what it costs in the whole trees.
    """

    def __init__(self, langs: list[str], lang: np.ndarray, seq: np.ndarray, n: np.ndarray, pairs: tuple | None = None):
        self.langs = langs
        whole = (lang, seq, n)
        shorter = np.full((1, len(langs)), -np.log(256.0))
        shorter_keys = np.zeros(1, dtype=np.int64)
        self.levels = []
        # From single bytes to the longest sequences; a shorter sequence ends as
        # the longer one does, so its count is the sum over all that go before.
        for length in range(1, ORDER + 2):
            lang, seq, n = pairs if pairs is not None and length <= 2 else whole
            own = seq & ((1 << (8 * length)) - 1)
            both, where = np.unique(own * len(langs) + lang, return_inverse=True)
            counts = np.bincount(where, weights=n, minlength=len(both))
            of_lang = both % len(langs)
            keys, row = np.unique(both // len(langs), return_inverse=True)
            contexts, of = np.unique(keys >> 8, return_inverse=True)
            total, kinds = np.zeros((len(contexts), len(langs))), np.zeros((len(contexts), len(langs)))
            np.add.at(total, (of[row], of_lang), counts)
            np.add.at(kinds, (of[row], of_lang), 1)
            known = total > 0
            escape = np.zeros_like(total)
            escape[known] = np.log(kinds[known] / (total + kinds)[known])
            # What a sequence costs where only its shorter form was seen.
            tail = keys & ((1 << (8 * (length - 1))) - 1)
            costs = escape[of] + shorter[np.searchsorted(shorter_keys, tail)]
            costs[row, of_lang] = np.log(counts / (total + kinds)[of[row], of_lang])
            self.levels.append((keys, costs.astype(np.float32), contexts, escape.astype(np.float32)))
            shorter, shorter_keys = costs, keys

    def costs(self, data: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Log probability of the byte at each place, per language."""
        out = np.zeros((len(place), len(self.langs)), dtype=np.float32)
        open_ = np.arange(len(place))
        sequences = _sequences(data, place, ORDER + 1)
        for length in range(ORDER + 1, 0, -1):
            keys, costs, contexts, escape = self.levels[length - 1]
            if not len(keys):
                continue
            own = sequences[open_] & ((1 << (8 * length)) - 1)
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            seen = keys[at] == own
            out[open_[seen]] += costs[at[seen]]
            open_, own = open_[~seen], own[~seen] >> 8
            at = np.minimum(np.searchsorted(contexts, own), len(contexts) - 1)
            met = contexts[at] == own
            out[open_[met]] += escape[at[met]]
        out[open_] -= np.float32(np.log(256.0))
        return out


class Slices:
    """Trees that are too large for one table: read by group of languages and range
    of the two bytes before the last, one slice at a time."""

    def __init__(self, counted: DataFrame, langs: list[str]):
        self.langs = langs
        together = min(len(langs), TOGETHER)
        self.groups = [(a, langs[a : a + together]) for a in range(0, len(langs), together)]
        self.codes = counted.sparkSession.createDataFrame(list(enumerate(langs)), "no int, lang string")
        pair = F.shiftright("seq", 8).bitwiseAND(F.lit(0xFFFF).cast("long")).cast("int")
        counted = counted.join(self.codes, "lang").select("no", F.floor(F.col("no") / together).cast("int").alias("grp"), pair.alias("pair"), "seq", "n")
        # In order of the slices, so that each is read by itself.
        self.counted = cut_lineage(counted.repartitionByRange("grp", "pair", "seq").sortWithinPartitions("grp", "pair"))
        sizes = self.counted.groupBy("grp", "pair").count().groupBy("pair").agg(F.max("count").alias("n")).orderBy("pair").collect()
        self.edges, size = [0], 0
        for r in sizes:
            if size and size + r["n"] > SLICE_CELLS // together:
                self.edges.append(r["pair"])
                size = 0
            size += r["n"]
        self.edges.append(1 << 16)

    @staticmethod
    def _arrays(rows: DataFrame, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = rows.toArrow()
        return rows.column(0).to_numpy().astype(np.int64) - first, rows.column(1).to_numpy(), rows.column(2).to_numpy().astype(np.float64)

    def parts(self):
        """``(first language, from pair, to pair, trees)`` of every slice."""
        for g, (first, langs) in enumerate(self.groups):
            own = self.counted.filter(F.col("grp") == g)
            last = F.col("seq").bitwiseAND(F.lit(0xFFFF).cast("long"))
            pairs = self._arrays(own.groupBy("no", last.alias("seq")).agg(F.sum("n").alias("n")), first)
            for lo, hi in zip(self.edges[:-1], self.edges[1:]):
                rows = own.filter((F.col("pair") >= lo) & (F.col("pair") < hi)).select("no", "seq", "n")
                yield first, lo, hi, Trees(langs, *self._arrays(rows, first), pairs)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Trees | Slices | None:
    """The trees of all languages in ``lang``; None without a text to learn from.

    Rows with a null text or language are not used. All others are counted, and
    all counts are kept: in one table if they fit, else in slices.
    """
    learn = docs.filter(F.col(text).isNotNull() & (F.col(text) != "") & F.col(lang).isNotNull())
    counted = cut_lineage(count_sequences(learn, text, lang))
    langs = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    if not langs:
        return None
    if len(langs) > TOGETHER or counted.count() * len(langs) > SLICE_CELLS:
        return Slices(counted, langs)
    rows = counted.select("lang", "seq", "n").toArrow()
    code = {name: i for i, name in enumerate(langs)}
    lang_no = np.array([code[v] for v in rows.column("lang").to_pylist()], dtype=np.int64)
    return Trees(langs, lang_no, rows.column("seq").to_numpy(), rows.column("n").to_numpy().astype(np.float64))


def _added(known: Trees, raw: np.ndarray, offsets: np.ndarray, lo: int = 0, hi: int = 1 << 16) -> np.ndarray:
    """Log probability of each text of a block, per language: its places with two
    bytes before them in ``[lo, hi)``."""
    data, place = _padded(raw, offsets)
    total = np.zeros((len(offsets) - 1, len(known.langs)))
    # A long text is added up in steps, as a block has it as a whole.
    for a in range(0, len(place), 1 << 19):
        at = place[a : a + (1 << 19)]
        doc = np.searchsorted(offsets, np.arange(a, a + len(at)), "right") - 1
        if (lo, hi) != (0, 1 << 16):
            before = _sequences(data, at - 1, 2)
            inside = (before >= lo) & (before < hi)
            at, doc = at[inside], doc[inside]
            if not len(at):
                continue
        costs = known.costs(data, at)
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        total[doc[first]] += np.add.reduceat(costs.astype(np.float64), first, axis=0)
    return total


def _by_slices(docs: DataFrame, slices: Slices, text: str, keep: list[str]) -> DataFrame:
    """``identify`` with every slice in a pass of its own over the texts."""
    key = F.md5(F.coalesce(F.col(text), F.lit("")))
    texts = docs.select(key.alias("_key"), F.col(text).alias("_text"))

    def part_of(no, first, lo, hi, trees):
        shared = docs.sparkSession.sparkContext.broadcast(trees)

        def run(batches):
            for rows, raw, offsets in blocks.text_blocks(batches, "_text", limit=1 << 19):
                total = _added(shared.value, raw, offsets, lo, hi)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([no] * len(total), pa.int32()), pa.array([first] * len(total), pa.int32()), pa.array(list(total))],
                    names=["_key", "part", "first", "total"],
                )

        return shared, texts.mapInArrow(run, "_key string, part int, first int, total array<double>")

    written, held = [], []

    def write():
        both = held[0][1]
        for _, more in held[1:]:
            both = both.unionByName(more)
        written.append(cut_lineage(both))
        for shared, _ in held:
            shared.destroy()
        held.clear()

    for no, part in enumerate(slices.parts()):
        held.append(part_of(no, *part))
        if len(held) == ROUND:
            write()
    if held:
        write()
    sums = written[0]
    for more in written[1:]:
        sums = sums.unionByName(more)
    each = sums.dropDuplicates(["_key", "part"]).select("_key", "part", "first", F.posexplode("total").alias("at", "total"))
    # Added in one order, so that equal languages stay equal.
    in_order = F.array_sort(F.collect_list(F.struct("part", "total")))
    whole = each.groupBy("_key", (F.col("first") + F.col("at")).alias("no")).agg(
        F.aggregate(in_order, F.lit(0.0), lambda s, x: s + x["total"]).alias("total")
    )
    best = whole.groupBy("_key").agg(
        F.max_by("no", F.struct("total", -F.col("no"))).alias("no"), F.max("total").alias("top"), F.sort_array(F.collect_list("total")).alias("all")
    )
    share = 1 / F.aggregate("all", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    told = best.select("_key", "no", share.alias("_share")).join(slices.codes.withColumnRenamed("lang", "_lang"), "no").drop("no")
    return docs.withColumn("_key", key).join(told, "_key", "left").select(
        *keep, F.when(F.col("_letters"), F.col("_lang")).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("_letters"), F.col("_share")).otherwise(0.0).alias("score")
    )


def identify(docs: DataFrame, trees: Trees | Slices | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, its share of all languages'
    probability for the whole text, if all are as likely before.

    One pass without shuffle; with slices one pass for each, and the sums are joined
    by the hash of the text. A null text, or one without a letter, is ``und``
    with score 0, as is every text if nothing was learnt. Equal codes go to the
    first language by name. Repeated rows get equal results; an empty table gives
    no rows; columns named like the added ones are replaced.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = blocks.lean(docs).select(*keep, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    if trees is None:
        return docs.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if isinstance(trees, Slices):
        return _by_slices(docs, trees, text, keep)
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        known = shared.value
        for rows, raw, offsets in blocks.text_blocks(batches, text, limit=1 << 19):
            total = _added(known, raw, offsets)
            best = total.argmax(axis=1)
            share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            letters = np.array(rows.column(len(keep)).to_pylist(), dtype=bool)
            names = [known.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
            yield pa.RecordBatch.from_arrays(
                [rows.column(i) for i in range(len(keep))] + [pa.array(names, pa.string()), pa.array(np.where(letters, share, 0.0))],
                names=keep + ["lang_pred", "score"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "_letters")
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double")
