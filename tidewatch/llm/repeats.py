"""Repeated byte strings by suffix arrays.

A byte goes when a 400-byte string over it also starts somewhere else. Equal
strings pick equal anchors: of the 201 grams of 200 bytes inside a string, the
one with the least hash. So strings are only compared where their anchors meet,
and each string belongs to one anchor. Anchors that occur once need no look;
occurrences with equal surroundings settle each other by counting; what is left
is dealt out by anchor, and each task sorts the suffixes of its pieces in two
stages and reads repeats from adjacent common prefixes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import blocks
from tidewatch.session import cut_lineage

LENGTH = 400
#: Pieces per suffix array. An anchor with more different surroundings is spread
#: over several arrays, whose strings are then counted across.
PIECES = 128
#: Strings next to each other whose common core is counted before they are.
CELL = 16
#: Never part of UTF-8, so no string reaches over the end of a piece.
END = 0xFF

_PLACE = np.uint64((1 << 26) - 1)


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Anchors of all strings in a block: document, place, first and last string
    that picks it (places within the document), and hashes of gram and piece."""
    gram = length // 2
    span = length - gram + 1
    n = len(data) - gram + 1
    if n < span:
        return {}
    # Grams only say which strings meet; what is taken as equal has the safe hash.
    running = blocks.short_sums(data)
    at = np.arange(n)
    values = (running[gram:] - running[:n]) * blocks.powers(len(running), blocks.BASE_INVERSE)[:n]
    keys = (blocks.mixed(values) & ~_PLACE) | (at.astype(np.uint64) & _PLACE)
    # Least key of every run of span grams: suffix minima of one block of span
    # and prefix minima of the next.
    rows = -(-n // span)
    padded = np.full(rows * span, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = keys
    padded = padded.reshape(rows, span)
    prefix = np.minimum.accumulate(padded, axis=1).ravel()
    suffix = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    first = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(offsets[:-1], offsets[1:]) if b - a >= length] or [at[:0]])
    if not len(first):
        return {}
    least = np.minimum(suffix[first], prefix[first + span - 1])
    anchor = first + ((least - first.astype(np.uint64)) & _PLACE).astype(np.int64)
    doc = np.searchsorted(offsets, first, "right") - 1
    new = np.ones(len(first), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    lo, hi = first[begin], first[np.concatenate([begin[1:], [len(first)]]) - 1]
    anchor, doc = anchor[begin], doc[begin]
    running = blocks.sums(data)
    left = blocks.hashes(running, lo, anchor)
    right = blocks.hashes(running, anchor, hi + length)
    piece = blocks.mixed(blocks.mixed(left + (anchor - lo).astype(np.uint64)) * np.uint64(blocks.BASE) + right)
    base = offsets[doc]
    return {
        "doc": doc,
        "place": anchor - base,
        "lo": lo - base,
        "hi": hi - base,
        "gram": blocks.mixed(values[anchor]).view(np.int64),
        "piece": piece.view(np.int64),
    }


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``data`` in the order of their suffixes, by two-stage sorting.

    Suffixes smaller than their successors are sorted directly, as far as
    ``depth`` bytes. All others are induced: going through the buckets of first
    bytes in order, each suffix puts its predecessor, if that is a larger one, at
    the end of what its own bucket has so far.
    """
    n = len(data)
    raw = data.tobytes()
    change = np.flatnonzero(data[1:] != data[:-1])
    nearest = np.searchsorted(change, np.arange(n))
    rising = np.zeros(n, dtype=bool)
    inside = nearest < len(change)
    turn = change[nearest[inside]]
    rising[inside] = data[turn] < data[turn + 1]
    direct = np.array(sorted(np.flatnonzero(rising).tolist(), key=lambda p: raw[p : p + depth]), dtype=np.int64)
    firsts = data[direct]
    queues: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n:
        queues[data[n - 1]].append(np.array([n - 1]))  # induced by the empty suffix
    order = []

    def induce(places: np.ndarray, byte: int) -> np.ndarray:
        """Queues the larger predecessors; returns those of the same bucket."""
        before = places[places > 0] - 1
        before = before[~rising[before]]
        bytes_ = data[before]
        for other in np.unique(bytes_):
            if other != byte:
                queues[other].append(before[bytes_ == other])
        return before[bytes_ == byte]

    for byte in range(256):
        wave = np.concatenate(queues[byte]) if queues[byte] else np.zeros(0, dtype=np.int64)
        while len(wave):
            order.append(wave)
            wave = induce(wave, byte)
        a, b = np.searchsorted(firsts, [byte, byte + 1]) if byte < 255 else (np.searchsorted(firsts, byte), len(firsts))
        if b > a:
            order.append(direct[a:b])
            induce(direct[a:b], byte)
    return np.concatenate(order) if order else np.zeros(0, dtype=np.int64)


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each place in ``order`` with the one before, up to ``most``."""
    out = np.zeros(len(order), dtype=np.int64)
    padded = np.concatenate([data, np.full(most, END, dtype=np.uint8)])
    views = np.lib.stride_tricks.sliding_window_view(padded, most)
    for a in range(1, len(order), 4096):
        now, last = order[a : a + 4096], order[a - 1 : a - 1 + len(order[a : a + 4096])]
        differs = views[now] != views[last]
        out[a : a + 4096] = np.where(differs.any(axis=1), differs.argmax(axis=1), most)
    return out


def _runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of every run of consecutive places."""
    cut = np.flatnonzero(np.diff(places) != 1) + 1
    return places[np.concatenate([[0], cut])], places[np.concatenate([cut, [len(places)]]) - 1]


def _resolve(pieces: list[tuple], length: int) -> list[tuple]:
    """Repeated strings of a batch of pieces.

    A piece is ``(id, key, lo, gram, spread, ask, bytes, anchor)``. Gives rows
    ``(id, key, lo, hi, gram, core, strings, checks, places, mine)``: ranges of strings that
    repeat within the batch, and for spread anchors the different strings, to be
    counted, by piece and cell with a hash of what all strings of the cell share.
    """
    data = np.frombuffer(b"".join(p[6] + bytes([END]) for p in pieces), dtype=np.uint8)
    sizes = np.array([len(p[6]) + 1 for p in pieces])
    base = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(pieces)), sizes)
    within = np.arange(len(data)) - base[owner]
    begins = within + length < sizes[owner]
    order = suffix_order(data, length)
    order = order[begins[order]]
    same = common_prefixes(data, order, length) >= length
    class_ = np.cumsum(~same)
    several = np.bincount(class_)[class_] > 1
    out = []
    repeated = np.sort(order[several])
    for o in np.unique(owner[repeated]):
        doc, key, lo, gram, _, ask, *_ = pieces[o]
        if ask:
            starts, ends = _runs(within[repeated[owner[repeated] == o]])
            out += [(doc, key, lo + int(a), lo + int(b), gram, None, None, None, None, None) for a, b in zip(starts, ends)]
    spread = np.array([p[4] for p in pieces])
    if spread.any():
        first = order[~same]
        first = first[spread[owner[first]]]
        alone = np.zeros(len(data), dtype=bool)
        alone[order[~several]] = True
        first = np.sort(first)
        strings = blocks.mixed(blocks.hashes(blocks.sums(data), first, first + length)).view(np.int64)
        running = blocks.short_sums(data)
        checks = blocks.mixed(blocks.short_hashes(running, first, first + length)).view(np.int64)
        anchor = np.array([p[7] for p in pieces])[owner[first]]
        cell = (within[first] - anchor) // CELL
        core = base[owner[first]] + anchor + cell * CELL
        cores = blocks.mixed(blocks.short_hashes(running, core + CELL - 1, core + length) ^ blocks.mixed(cell.astype(np.uint64))).view(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], (np.diff(cores) != 0) | (np.diff(owner[first]) != 0), [True]])) if len(first) else []
        for a, b in zip(edge[:-1], edge[1:]):
            doc, key, lo, gram, _, ask, *_ = pieces[owner[first[a]]]
            places = (lo + within[first[a:b]]).tolist()
            out.append((doc, key, None, None, gram, int(cores[a]), strings[a:b].tolist(), checks[a:b].tolist(), places, (alone[first[a:b]] & ask).tolist()))
    return out


def _covers(size: int, lo: np.ndarray, hi: np.ndarray, length: int) -> np.ndarray:
    edge = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi + length, -1)
    return np.cumsum(edge[:-1]) > 0


def find_repeats(docs: DataFrame, length: int = LENGTH, pieces: int = PIECES, with_text: bool = False) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Judges the bytes of whole texts; ``with_text`` adds ``kept``, the remaining
    bytes. Equal hashes of gram and surroundings (64 and 61 bits) stand for equal
    surroundings; in the suffix arrays bytes are compared, and across the arrays of
    one anchor two independent hashes of the whole string (61 and 64 bits).

    A null or empty text has no bytes; a text shorter than ``length`` loses none.
    Rows that occur twice repeat each other. An empty table gives no rows. Other
    columns are ignored.
    """
    docs = blocks.lean(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), blocks.row_key().alias("key"), "text")
    long_ = docs.filter(F.octet_length("text") >= length).select("id", "key", "text")

    def anchors(batches):
        for rows, data, offsets in blocks.text_blocks(batches, "text"):
            found = _anchors(data, offsets, length)
            if found:
                where = pa.array(found["doc"])
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id").take(where), rows.column("key").take(where)]
                    + [pa.array(found[k].astype(np.int32)) for k in ("lo", "hi", "place")]
                    + [pa.array(found[k]) for k in ("gram", "piece")],
                    names=["id", "key", "lo", "hi", "place", "gram", "piece"],
                )

    met = cut_lineage(long_.mapInArrow(anchors, "id long, key long, lo int, hi int, place int, gram long, piece long"))
    # Counts are written before they are joined: a join with a written table can
    # be split where a key is hot, one with an aggregate cannot.
    often = cut_lineage(met.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"))
    shared = cut_lineage(met.join(often, "gram"))
    # One row per anchor and surroundings, then per anchor.
    kinds = cut_lineage(shared.groupBy("gram", "piece").agg(F.count("*").alias("n"), F.min(F.struct("id", "key", "lo")).alias("first")))
    mixed = cut_lineage(kinds.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("n").alias("least")))
    state = cut_lineage(kinds.join(mixed, "gram").select("gram", "piece", "first", "n", "kinds", ((F.col("kinds") > 1) & (F.col("least") == 1)).alias("open")))
    marked = (
        shared.join(state, ["gram", "piece"])
        .withColumn("ask", F.col("n") == 1)
        .withColumn("send", F.col("open") & (F.struct("id", "key", "lo") == F.col("first")))
        .groupBy("id", "key")
        .agg(F.collect_list(F.struct("lo", "hi", "place", "gram", "piece", "kinds", "ask", "send")).alias("found"))
    )
    some = cut_lineage(long_.dropDuplicates(["id", "key"]).join(marked, ["id", "key"]))

    def cut_pieces(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                raw = None
                out = []
                for f in batch.column("found")[row].as_py():
                    if f["send"]:
                        raw = raw if raw is not None else batch.column("text")[row].as_py().encode()
                        out.append((batch.column("id")[row].as_py(), batch.column("key")[row].as_py(), f["lo"], f["gram"], f["piece"], f["kinds"], f["ask"], raw[f["lo"] : f["hi"] + length], f["place"] - f["lo"]))
                for a in range(0, len(out), 2000):
                    yield pa.RecordBatch.from_pylist([dict(zip(cut_schema.names, r)) for r in out[a : a + 2000]], schema=cut_schema)

    cut_schema = pa.schema(
        [("id", pa.int64()), ("key", pa.int64()), ("lo", pa.int32()), ("gram", pa.int64()), ("piece", pa.int64()), ("kinds", pa.int64()), ("ask", pa.bool_()), ("bytes", pa.binary()), ("anchor", pa.int32())]
    )
    sent = some.mapInArrow(cut_pieces, "id long, key long, lo int, gram long, piece long, kinds long, ask boolean, bytes binary, anchor int")
    parts = F.ceil(F.col("kinds") / pieces)
    sent = sent.select("id", "key", "lo", "gram", "ask", "bytes", "anchor", (parts > 1).alias("spread"), F.pmod("piece", parts).alias("part"))
    out_schema = pa.schema(
        [("id", pa.int64()), ("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("gram", pa.int64()), ("core", pa.int64())]
        + [("strings", pa.list_(pa.int64())), ("checks", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("mine", pa.list_(pa.bool_()))]
    )

    def resolve(batches):
        held, last = [], None
        for batch in batches:
            for r in batch.to_pylist():
                group = (r["gram"], r["part"])
                if len(held) >= pieces and group != last:
                    yield from told(_resolve(held, length))
                    held = []
                held.append((r["id"], r["key"], r["lo"], r["gram"], r["spread"], r["ask"], r["bytes"], r["anchor"]))
                last = group
        if held:
            yield from told(_resolve(held, length))

    def told(rows):
        for a in range(0, len(rows), 10_000):
            columns = list(zip(*rows[a : a + 10_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out_schema)], schema=out_schema)

    resolved = cut_lineage(
        sent.repartition("gram", "part")
        .sortWithinPartitions("gram", "part")
        .mapInArrow(resolve, "id long, key long, lo int, hi int, gram long, core long, strings array<long>, checks array<long>, places array<int>, mine array<boolean>")
    )
    # Strings of spread anchors: only cells whose core was seen twice are opened.
    cells = resolved.filter("core IS NOT NULL")
    twice = cells.groupBy("gram", "core").agg(F.count("*").alias("n")).filter("n > 1").select("gram", "core")
    strings = cells.join(twice, ["gram", "core"]).select("id", "key", "gram", F.explode(F.arrays_zip("strings", "checks", "places", "mine")).alias("s"))
    strings = strings.select("id", "key", "gram", F.col("s.strings").alias("string"), F.col("s.checks").alias("check"), F.col("s.places").alias("lo"), F.col("s.mine").alias("mine"))
    across = strings.groupBy("gram", "string", "check").agg(F.count("*").alias("n")).filter("n > 1").select("gram", "string", "check")
    apart = strings.filter("mine").join(across, ["gram", "string", "check"]).select("id", "key", "lo", F.col("lo").alias("hi"))
    ranges = (
        resolved.filter("core IS NULL").select("id", "key", "lo", "hi").unionByName(apart)
        .groupBy("id", "key")
        .agg(F.collect_list(F.struct("lo", "hi")).alias("more"))
    )

    def remove(batches):
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                raw = np.frombuffer(batch.column("text")[row].as_py().encode(), dtype=np.uint8)
                hits = [(f["lo"], f["hi"]) for f in batch.column("found")[row].as_py() if not f["ask"]]
                hits += [(m["lo"], m["hi"]) for m in batch.column("more")[row].as_py() or []]
                lo, hi = np.array(hits, dtype=np.int64).reshape(-1, 2).T
                gone = _covers(len(raw), lo, hi, length)
                kept = raw[~gone].tobytes()
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((batch.column("id")[row].as_py(), batch.column("key")[row].as_py(), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()) + ((kept,) if with_text else ()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), removed)], schema=removed)

    removed = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.binary())] * with_text)
    changed = some.select("id", "key", "text", F.transform("found", lambda f: F.struct(f["lo"].alias("lo"), f["hi"].alias("hi"), f["ask"].alias("ask"))).alias("found")).join(
        ranges, ["id", "key"], "left"
    ).mapInArrow(remove, "id long, key long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
    body = F.col("text").cast("binary")
    whole = docs.select("doc_id", "id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(body, 256).alias("sha"), *([body.alias("body")] if with_text else []))
    return whole.join(changed, ["id", "key"], "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        *([F.coalesce("kept", "body").alias("kept")] if with_text else []),
    )
