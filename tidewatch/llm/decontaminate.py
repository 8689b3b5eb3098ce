"""Benchmark passages in documents, by Wu-Manber multi-pattern search.

A window of 13 consecutive benchmark words (or a whole shorter item) is a
pattern over word symbols. The search looks at the last two words of a window
position: a shift table says how far the position may jump without passing a
pattern; where it says zero, the pair's suffix bucket names the patterns, their
words are compared, and what is left is confirmed byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import blocks

WINDOW = 13
#: Benchmark words in one broadcast table; a larger benchmark takes several tables.
SLICE_WORDS = 1_000_000
#: Window positions that one lane of the search walks over.
LANE = 256
ADDED = ("n_words", "n_hit", "hit_starts", "hit_ends", "item_ids", "contaminated")


def _pieces(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of all bytes of the pieces, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class Patterns:
    """The windows of one length in a slice of the benchmark, ready to search."""

    def __init__(self, length: int, first: np.ndarray, owner: np.ndarray, words: np.ndarray):
        self.length = length
        self.pair = min(2, length)
        grams = words[first].copy()
        for k in range(1, length):
            grams = grams * np.uint64(blocks.BASE) + words[first + k]
        _, at, group = np.unique(grams, return_index=True, return_inverse=True)
        self.first = first[at]
        pairs = np.unique(np.stack([group, owner], axis=1), axis=0)
        self.owner_bounds = np.searchsorted(pairs[:, 0], np.arange(len(at) + 1))
        self.owners = pairs[:, 1]
        self.bits = np.uint64(64 - max(10, int(np.ceil(np.log2(4 * len(at) * length + 1)))))
        self.shift = np.full(1 << int(64 - self.bits), length - self.pair + 1, dtype=np.uint8)
        for end in range(self.pair - 1, length):
            np.minimum.at(self.shift, (self.block(words, self.first + end) >> self.bits).astype(np.int64), length - 1 - end)
        suffix = self.block(words, self.first + length - 1)
        order = np.argsort(suffix, kind="stable")
        self.first, self.suffix = self.first[order], suffix[order]
        sizes = np.diff(self.owner_bounds)[order]
        self.owners = self.owners[_pieces(self.owner_bounds[:-1][order], sizes)]
        self.owner_bounds = np.concatenate([[0], np.cumsum(sizes)])

    def block(self, words: np.ndarray, last: np.ndarray) -> np.ndarray:
        if self.pair == 1:
            return blocks.mixed(words[last])
        return blocks.mixed(words[last - 1] * np.uint64(blocks.BASE) + words[last])

    def candidates(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word in the text and pattern number wherever all words agree."""
        n, lanes, stops = self.length, [], []
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= n:
                begin = np.arange(a + n - 1, b, LANE)
                lanes.append(begin)
                stops.append(np.minimum(begin + LANE, b))
        none = np.zeros(0, dtype=np.int64)
        if not lanes:
            return none, none
        at, stop, found = np.concatenate(lanes), np.concatenate(stops), []
        while len(at):
            jump = self.shift[(self.block(words, at) >> self.bits).astype(np.int64)]
            found.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        last = np.concatenate(found)
        suffix = self.block(words, last)
        low = np.searchsorted(self.suffix, suffix, "left")
        sizes = np.searchsorted(self.suffix, suffix, "right") - low
        text, pattern = np.repeat(last - n + 1, sizes), _pieces(low, sizes)
        return text, pattern


class Slice:
    """A bounded part of the benchmark."""

    def __init__(self, pieces: list[tuple[int, list[bytes]]], ids: list[str | None], window: int):
        self.ids = ids
        flat = [w for _, words in pieces for w in words]
        self.data = np.frombuffer(b"".join(flat), dtype=np.uint8)
        lengths = np.array([len(w) for w in flat], dtype=np.int64)
        self.starts = np.cumsum(lengths) - lengths
        self.lengths = lengths
        self.words = blocks.mixed(blocks.hashes(blocks.sums(self.data), self.starts, self.starts + lengths))
        by_length: dict[int, tuple[list, list]] = {}
        at = 0
        for owner, words in pieces:
            size = min(window, len(words))
            first = np.arange(at, at + len(words) - size + 1)
            firsts, owners = by_length.setdefault(size, ([], []))
            firsts.append(first)
            owners.append(np.full(len(first), owner))
            at += len(words)
        self.groups = [
            Patterns(size, np.concatenate(f), np.concatenate(o), self.words) for size, (f, o) in sorted(by_length.items())
        ]

    def search(self, data: np.ndarray, words: blocks.Words, values: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Marks hit words; returns ``(document, item)`` pairs."""
        pairs = []
        for group in self.groups:
            text, pattern = group.candidates(values, words.bounds)
            for k in range(group.length):
                same = values[text + k] == self.words[group.first[pattern] + k]
                text, pattern = text[same], pattern[same]
            good = np.ones(len(text), dtype=bool)
            for k in range(group.length if len(text) else 0):
                a, b = text + k, group.first[pattern] + k
                lengths = words.ends[a] - words.starts[a]
                equal = lengths == self.lengths[b]
                lengths = np.where(equal, lengths, 0)
                differs = data[_pieces(words.starts[a], lengths)] != self.data[_pieces(self.starts[b], lengths)]
                good &= equal & (np.bincount(np.repeat(np.arange(len(a)), lengths), weights=differs, minlength=len(a)) == 0)
            text, pattern = text[good], pattern[good]
            hit |= blocks.covered(text, group.length, len(hit))
            sizes = np.diff(group.owner_bounds)[pattern]
            owners = group.owners[_pieces(group.owner_bounds[pattern], sizes)]
            pairs.append(np.stack([np.repeat(words.doc[text], sizes), owners], axis=1))
        return np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), dtype=np.int64)


def _slices(benchmark: DataFrame, item_id: str, item_text: str, window: int, slice_words: int) -> Iterator[Slice]:
    """The benchmark in bounded parts; a long item is cut with an overlap."""
    rows = benchmark.select(
        F.col(item_id).cast("string").alias("item"),
        F.regexp_extract_all(F.translate(item_text, *_AZ), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)).alias("words"),
    ).filter(F.size("words") > 0)
    pieces, ids, total = [], [], 0
    for row in rows.toLocalIterator():
        words = [w.encode() for w in row["words"]]
        for a in range(0, max(1, len(words) - window + 1), slice_words):
            part = words[a : a + slice_words + window - 1]
            if total and total + len(part) > slice_words + window:
                yield Slice(pieces, ids, window)
                pieces, ids, total = [], [], 0
            pieces.append((len(ids), part))
            ids.append(row["item"])
            total += len(part)
    if pieces:
        yield Slice(pieces, ids, window)


_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    slice_words: int = SLICE_WORDS,
) -> DataFrame:
    """``docs`` with the benchmark passages found in each whole text.

    Adds ``n_words``, ``n_hit`` (words inside an occurrence), ``hit_starts`` and
    ``hit_ends`` (word numbers of the hit runs, end exclusive), ``item_ids``
    (distinct ids of items with an occurrence, sorted strings) and
    ``contaminated`` (a hit, and at least a twentieth of the words hit).

    One pass over ``docs`` without shuffle. The benchmark is broadcast in tables
    of at most ``slice_words`` words, as many as it takes, one after the other.
    A null or empty text has no words and is clean; an item without words gives
    no pattern; an item with a null id marks words but is not listed. Repeated
    rows and items change nothing. An empty benchmark leaves all clean. Columns
    of ``docs`` named like an added one are replaced.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in ADDED]
    docs = blocks.lean(docs.select(*keep))
    added = {
        "n_words": pa.int64(),
        "n_hit": pa.int64(),
        "hit_starts": pa.list_(pa.int32()),
        "hit_ends": pa.list_(pa.int32()),
        "item_ids": pa.list_(pa.string()),
        "contaminated": pa.bool_(),
    }
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
        + [
            "n_words long",
            "n_hit long",
            "hit_starts array<int>",
            "hit_ends array<int>",
            "item_ids array<string>",
            "contaminated boolean",
        ]
    )

    def step(part, chained: bool):
        def run(batches):
            table = part.value if part is not None else None
            for rows, raw, offsets in blocks.text_blocks(batches, text):
                data = blocks.LOWER[raw]
                words = blocks.Words(data, offsets, blocks.LETTERS)
                n = len(offsets) - 1
                hit = np.zeros(len(words.starts), dtype=bool)
                items = [set() for _ in range(n)]
                if chained:
                    for d, (a, b, ids) in enumerate(
                        zip(*(rows.column(rows.schema.get_field_index(c)).to_pylist() for c in ADDED[2:5]))
                    ):
                        items[d].update(ids)
                        for x, y in zip(a, b):
                            hit[words.bounds[d] + x : words.bounds[d] + y] = True
                if table is not None:
                    values = blocks.mixed(blocks.hashes(blocks.sums(data), words.starts, words.ends))
                    for d, owner in table.search(data, words, values, hit):
                        items[d].add(table.ids[owner])
                edge = np.zeros(len(hit) + 1, dtype=bool)
                edge[words.bounds] = True
                edge = edge[:-1]
                starts = np.flatnonzero(hit & (edge | ~np.concatenate([[False], hit[:-1]])))
                stops = np.flatnonzero(hit & np.concatenate([edge[1:] | ~hit[1:], [True]])) + 1
                owner = words.doc[starts]
                lists = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
                base = words.bounds[owner]
                n_words = np.diff(words.bounds)
                n_hit = blocks.counts_per(words.doc[hit], n)
                new = {
                    "n_words": n_words,
                    "n_hit": n_hit,
                    "hit_starts": pa.ListArray.from_arrays(lists, pa.array(starts - base, pa.int32())),
                    "hit_ends": pa.ListArray.from_arrays(lists, pa.array(stops - base, pa.int32())),
                    "item_ids": pa.array([sorted(i for i in s if i is not None) for s in items], pa.list_(pa.string())),
                    "contaminated": (n_hit > 0) & (20 * n_hit >= n_words),
                }
                yield pa.RecordBatch.from_arrays(
                    [rows.column(i) for i in range(len(keep))] + [pa.array(v, added[k]) if isinstance(v, np.ndarray) else v for k, v in new.items()],
                    names=keep + list(added),
                )

        return run

    out, chained = docs, False
    for part in _slices(benchmark, item_id, item_text, window, slice_words):
        out = out.mapInArrow(step(spark.sparkContext.broadcast(part), chained), schema)
        chained = True
    return out if chained else docs.mapInArrow(step(None, False), schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their own columns."""
    return find_passages(docs, benchmark, **names).filter(~F.col("contaminated")).select(*[c for c in docs.columns if c not in ADDED])
