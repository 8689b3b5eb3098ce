"""Similar sets where most pairs meet: blocks of sets compared bit by bit."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sets of one block (a bit each), of one chunk that visits it, and the most items of a set.
BLOCK_SETS = 1 << 18
CHUNK_SETS = 1 << 16
MOST_ITEMS = 64
#: Bytes of bit maps that a block keeps at a time, and pairs handed on at a time.
MAP_BYTES = 1 << 26
OUT_PAIRS = 1 << 16
#: A pair that meets through a join costs about as much as so many pairs of bits.
MEETING_COST = 1000
#: What a join's result may be off by.
SLACK = 1e-9


def least_shared(x: int, y: np.ndarray, threshold: float) -> np.ndarray:
    """The fewest items that sets of ``x`` and ``y`` must share, one at least."""
    low = threshold - SLACK
    s = np.ceil(low / (1 + low) * (x + y)).astype(np.int64)
    s = np.where((s - 1) / (x + y - s + 1) >= low, s - 1, s)
    return np.maximum(1, np.where(s / np.maximum(1, x + y - s) < low, s + 1, s))


def _packed(held: np.ndarray) -> np.ndarray:
    return np.packbits(held, bitorder="little").view("<u8")


class Block:
    """Sets as columns of bits, and the counts of items shared with one visitor.

    The counters of all sets lie in planes, one per binary digit: adding an item adds its
    map of bits to all of them. They begin at ``2 ** digits`` less what must be shared, so
    a carry out of the last plane says that a set is similar enough. Visitors come sorted,
    and what two of them begin with is added once.
    """

    def __init__(self, sizes: np.ndarray, offsets: np.ndarray, items: np.ndarray, threshold: float):
        self.sizes, self.threshold = sizes.astype(np.int64), threshold
        lengths = np.diff(offsets)
        self.words = max(1, -(-len(sizes) // 64))
        self.digits = int(lengths.max(initial=1)).bit_length()
        codes, at = np.unique(items, return_inverse=True)
        self.sets = np.repeat(np.arange(len(sizes)), lengths)[np.argsort(at, kind="stable")]
        ends = np.cumsum(np.bincount(at, minlength=len(codes)))
        self.spans = dict(zip(codes.tolist(), zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True), strict=True))
        self.maps, self.most_maps = {}, max(1, MAP_BYTES // (8 * self.words))
        # The planes after each item of a visitor, the last of them with the sets found.
        self.planes = []
        self.size, self.path, self.level = None, [], [0]

    def _map(self, code: int) -> np.ndarray | None:
        found = self.maps.get(code)
        if found is None and code in self.spans:
            held = np.zeros(64 * self.words, dtype=np.uint8)
            lo, hi = self.spans[code]
            held[self.sets[lo:hi]] = 1
            if len(self.maps) >= self.most_maps:
                self.maps.pop(next(iter(self.maps)))
            found = self.maps[code] = _packed(held)
        return found

    def _level(self, no: int) -> list[np.ndarray]:
        if no == len(self.planes):
            self.planes.append([np.zeros(self.words, dtype="<u8") for _ in range(self.digits + 1)])
        return self.planes[no]

    def _begin(self, size: int) -> None:
        self.size, self.path, self.level = size, [], [0]
        self.least = least_shared(size, self.sizes, self.threshold)
        start = np.zeros(64 * self.words, dtype=np.int64)
        start[: len(self.least)] = np.maximum(0, (1 << self.digits) - self.least)
        for digit, plane in enumerate(self._level(0)[:-1]):
            plane[:] = _packed((start >> digit & 1).astype(np.uint8))
        self.spare = np.zeros(self.words, dtype="<u8")

    def visit(self, size: int, items: list[int]) -> tuple[np.ndarray, np.ndarray] | None:
        """Numbers of the sets similar to the visitor, and how many items each shares."""
        if size != self.size:
            self._begin(size)
        path, level = self.path, self.level
        same = 0
        for known, item in zip(path, items):
            if known != item:
                break
            same += 1
        del path[same:], level[same + 1 :]
        for item in items[same:]:
            carry, no = self._map(item), level[-1]
            if carry is not None:
                old, new = self._level(no), self._level(no + 1)
                for digit in range(self.digits):
                    np.bitwise_xor(old[digit], carry, new[digit])
                    carry = np.bitwise_and(old[digit], carry, self.spare)
                np.bitwise_or(old[-1], carry, new[-1])
                no += 1
            path.append(item)
            level.append(no)
        planes = self.planes[level[-1]]
        found = planes[-1]
        if not level[-1] or not found.any():
            return None
        word = np.flatnonzero(found)
        row, bit = np.nonzero(np.unpackbits(found[word].view(np.uint8), bitorder="little").reshape(-1, 64))
        word, shift = word[row], bit.astype(np.uint64)
        more = np.zeros(len(word), dtype=np.int64)
        for digit in range(self.digits):
            more |= ((planes[digit][word] >> shift) & np.uint64(1)).astype(np.int64) << digit
        no = 64 * word + bit
        return no, self.least[no] + more


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy()


def _joined(parts: list) -> pa.Array:
    return pa.concat_arrays(parts) if len(parts) > 1 else parts[0]


def compare(threshold: float, held: str, visiting: str):
    """Batches of pairs from rows sorted by group, side (held sets first), size and items."""

    def walk(batches):
        group, waiting, block = None, [], None
        for batch in batches:
            keys = batch.column("part").to_numpy().astype(np.int64) * 2 + batch.column("side").to_numpy()
            cuts = np.flatnonzero(np.diff(keys)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                part, side = divmod(int(keys[lo]), 2)
                if part != group:
                    group, waiting, block = part, [], None
                rows = batch.slice(lo, hi - lo)
                if side == 0:
                    waiting.append(rows)
                    continue
                if block is None:
                    if not waiting:
                        continue
                    whole = _joined([w.column("items") for w in waiting])
                    sizes = _joined([w.column("size") for w in waiting]).to_numpy()
                    ids, waiting = _joined([w.column(held) for w in waiting]), []
                    block = Block(sizes, *_lists(whole), threshold)
                yield from visits(block, ids, rows)

    def visits(block, ids, rows):
        offsets, items = _lists(rows.column("items"))
        offsets, items, sizes = offsets.tolist(), items.tolist(), rows.column("size").to_numpy().tolist()
        out, n = [], 0
        for row in range(rows.num_rows):
            got = block.visit(sizes[row], items[offsets[row] : offsets[row + 1]])
            if got is not None:
                for lo in range(0, len(got[0]), OUT_PAIRS):
                    out.append((row, got[0][lo : lo + OUT_PAIRS], got[1][lo : lo + OUT_PAIRS]))
                    n += len(out[-1][1])
                    if n >= OUT_PAIRS:
                        yield pairs(block, ids, rows, out, sizes)
                        out, n = [], 0
        if out:
            yield pairs(block, ids, rows, out, sizes)

    def pairs(block, ids, rows, out, sizes):
        no, shared = (np.concatenate([o[i] for o in out]) for i in (1, 2))
        who = np.repeat([o[0] for o in out], [len(o[1]) for o in out])
        both = np.asarray(sizes)[who] + block.sizes[no]
        columns = {held: ids.take(pa.array(no)), visiting: rows.column(visiting).take(pa.array(who))}
        columns["similarity"] = pa.array(shared / (both - shared))
        return pa.RecordBatch.from_arrays([columns[n] for n in ("id_a", "id_b", "similarity")], names=["id_a", "id_b", "similarity"])

    return walk


def similar_in_blocks(a: DataFrame, b: DataFrame, count_a: int, count_b: int, threshold: float) -> DataFrame:
    """Pairs ``(id_a, id_b, similarity)`` of sets ``(id, size, items)``, items in one order, rarest first.

    The larger side is dealt to blocks of at most about ``BLOCK_SETS`` sets, the other visits each of
    them; both are shuffled, pairs are not, and a task holds one block whatever the result's size.
    """
    spark = a.sparkSession
    held, visiting = ("id_a", "id_b") if count_a >= count_b else ("id_b", "id_a")
    n_held, n_visits = max(count_a, count_b), min(count_a, count_b)
    # A visit has its own cost, so small sides are not dealt out finer than the tasks need.
    tasks = spark.sparkContext.defaultParallelism
    wanted = max(min(4 * tasks, max(tasks, n_held / (1 << 15))), n_held / BLOCK_SETS)
    blocks = math.ceil(min(wanted, max(1, n_held / 1024)))
    chunks = math.ceil(n_visits / CHUNK_SETS)

    def rows(df: DataFrame, name: str) -> DataFrame:
        mine = name == held
        own = F.pmod(F.xxhash64("id"), F.lit(blocks if mine else chunks))
        other = F.explode(F.sequence(F.lit(0), F.lit((chunks if mine else blocks) - 1)))
        part = (F.col("own") * chunks + F.col("other")) if mine else (F.col("other") * chunks + F.col("own"))
        kinds = {"id_a": a.schema["id"].dataType, "id_b": b.schema["id"].dataType}
        ids = [F.col("id").alias(i) if i == name else F.lit(None).cast(kinds[i]).alias(i) for i in ("id_a", "id_b")]
        sent = df.select("id", "size", F.reverse("items").alias("items"), own.alias("own"), other.alias("other"))
        return sent.select(part.cast("int").alias("part"), F.lit(0 if mine else 1).alias("side"), *ids, F.col("size").cast("int").alias("size"), "items")

    both = rows(a, "id_a").unionByName(rows(b, "id_b"))
    dealt = both.repartitionById(blocks * chunks, F.col("part")).sortWithinPartitions("part", "side", "size", "items")
    kind = ", ".join(f"{n} {df.schema['id'].dataType.simpleString()}" for n, df in (("id_a", a), ("id_b", b)))
    return dealt.mapInArrow(compare(threshold, held, visiting), f"{kind}, similarity double")
