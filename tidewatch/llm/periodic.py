"""Periodic runs of words, found on the grammar of a text.

Re-Pair turns the word ids of a text into a grammar: the most frequent pair of
neighbours becomes a nonterminal until no pair comes twice. A run of words with
a period lies whole within some derivation node and crosses the border between
that node's two halves. So the runs across a border are computed once per
nonterminal, on its first place in the text, and hold at all places where it is
derived; the maximal ones of those intervals are the runs of the text.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.llm import blocks

#: A run has at least so many words, and its period at least so many times.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Pairs that come less often stay as they are.
LEAST_COUNT = 2
ADDED = ("n_words", "runs", "collapsed")


def repair(ids: list[int], least_count: int = LEAST_COUNT) -> tuple[list[tuple[int, int, list[int]]], list[int]]:
    """Re-Pair of a sequence.

    Returns the rules as ``(length of the left half, length of the whole, places
    in derivation)`` and the places where the symbols of the last sequence start.
    Of equally frequent pairs the one seen first is replaced first; occurrences of
    a pair are taken from left to right, without overlap.
    """
    n = len(ids)
    symbols, following, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
    length = {}
    counts, places = {}, {}
    last = None
    for at, pair in enumerate(zip(ids, ids[1:])):
        # aaa holds the pair aa once.
        if pair == last:
            last = None
            continue
        last = pair if pair[0] == pair[1] else None
        if pair in counts:
            counts[pair] += 1
            places[pair].append(at)
        else:
            counts[pair] = 1
            places[pair] = [at]
    turn = 0
    queue = []
    for pair, count in counts.items():
        if count >= least_count:
            turn += 1
            queue.append((-count, turn, pair))
    heapify(queue)
    rules, new = [], (max(ids) + 1 if n else 0)
    while queue:
        count, _, pair = heappop(queue)
        now = counts.get(pair, 0)
        if now != -count:
            if now >= least_count:
                turn += 1
                heappush(queue, (-now, turn, pair))
            continue
        a, b = pair
        found, done = places.pop(pair), []
        del counts[pair]
        fresh = {}
        for at in sorted(found):
            if symbols[at] != a:
                continue
            to = following[at]
            if to >= n or symbols[to] != b:
                continue
            after, ahead = following[to], before[at]
            if ahead >= 0:
                old = (symbols[ahead], a)
                if old in counts:
                    counts[old] -= 1
                fresh.setdefault((symbols[ahead], new), []).append(ahead)
            if after < n:
                old = (b, symbols[after])
                if old in counts:
                    counts[old] -= 1
                fresh.setdefault((new, symbols[after]), []).append(at)
                before[after] = at
            symbols[at], symbols[to] = new, -1
            following[at] = after
            done.append(at)
        left = length.get(a, 1)
        length[new] = left + length.get(b, 1)
        if done:
            rules.append((left, length[new], done))
        for pair, spots in fresh.items():
            # A neighbour replaced in the same sweep makes a spot stale.
            spots = [s for s in spots if symbols[s] == pair[0] and following[s] < n and symbols[following[s]] == pair[1]]
            if pair[0] == pair[1]:
                apart, end = [], -1
                for s in spots:
                    if s >= end:
                        apart.append(s)
                        end = following[following[s]]
                spots = apart
            if spots:
                counts[pair], places[pair] = len(spots), spots
                if len(spots) >= least_count:
                    turn += 1
                    heappush(queue, (-len(spots), turn, pair))
        new += 1
    root, at = [], 0
    while at < n:
        root.append(at)
        at = following[at]
    return rules, root


def _next_equal(names: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense names, and the distance to the next place of the same name (0: none)."""
    order = np.argsort(names, kind="stable")
    ranked = names[order]
    change = np.concatenate([[False], ranked[1:] != ranked[:-1]])
    dense = np.empty(len(names), dtype=np.int64)
    dense[order] = np.cumsum(change)
    gap = np.zeros(len(names), dtype=np.int64)
    same = ~change[1:]
    gap[order[:-1][same]] = at[order[1:][same]] - at[order[:-1][same]]
    return dense, gap


def across_borders(ids: np.ndarray, low: np.ndarray, border: np.ndarray, high: np.ndarray, times: int = LEAST_TIMES) -> list[np.ndarray]:
    """Periodic stretches within ``[low, high)`` that cross ``border``.

    Returns rows ``(number of the border, start, end, period)``, each with its
    smallest period at least ``times`` (four or more) times in it. Grams of 2 * l
    words have names by doubling. A run of period q, l <= q < 2 * l, holds a gram
    of one of eleven grid places around the border, together with its next
    occurrence, and that one is exactly q words on.
    """
    n = len(ids)
    found = []
    if not len(border):
        return found
    at = np.arange(n)
    l = 1
    name = ids.astype(np.int64)
    while True:
        # Names of 2 * l words, where both halves come again.
        slot = np.full(n + 1, -1, dtype=np.int64)
        slot[at] = np.arange(len(at))
        second = np.where(at + l < n, slot[np.minimum(at + l, n)], -1)
        both = second >= 0
        if not both.any():
            break
        at, pair = at[both], name[both] * (int(name.max()) + 1) + name[second[both]]
        name, gap = _next_equal(pair, at)
        reach = np.zeros(n + 1, dtype=np.int64)
        reach[at] = gap
        tested = np.flatnonzero(high - low >= times * l)
        if not len(tested):
            break
        for step in range(-8, 3):
            p = border[tested] + step * l
            inside = (p >= low[tested]) & (p < high[tested])
            which, p = tested[inside], p[inside]
            q = reach[p]
            good = (q >= l) & (q < 2 * l)
            if good.any():
                found.append(np.stack([which[good], p[good], q[good]], axis=1))
        # A longer gram that comes again within a text starts where this one does.
        size = np.bincount(name)
        again = size[name] > 1
        at, name = at[again], name[again]
        l *= 2
        if not len(at):
            break
    if not found:
        return []
    seen = np.unique(np.concatenate(found), axis=0)
    out = []
    for q in np.unique(seen[:, 2]):
        mine = seen[seen[:, 2] == q]
        differs = np.flatnonzero(ids[q:] != ids[:-q])
        k = np.searchsorted(differs, mine[:, 1])
        start = np.where(k > 0, differs[np.maximum(k - 1, 0)] + 1 if len(differs) else 0, 0)
        stop = np.where(k < len(differs), differs[np.minimum(k, max(len(differs) - 1, 0))] if len(differs) else n - q, n - q) + q
        which = mine[:, 0]
        start, stop = np.maximum(start, low[which]), np.minimum(stop, high[which])
        good = (stop - start >= times * q) & (start < border[which]) & (border[which] < stop)
        out.append(np.stack([which, start, stop, np.full(len(which), q)], axis=1)[good])
    return out


def runs_of(ids: list[int], least_words: int = LEAST_WORDS, times: int = LEAST_TIMES, least_count: int = LEAST_COUNT) -> np.ndarray:
    """Runs ``(start, length, period)`` of a sequence, by start, then period."""
    none = np.zeros((0, 3), dtype=np.int64)
    n = len(ids)
    if n < max(least_words, times):
        return none
    rules, root = repair(ids, least_count)
    if not rules:
        # A run would hold some pair of neighbours at least twice.
        return none
    # Borders of the rules at their first place, then those of the last sequence.
    low = [places[0] for _, _, places in rules] + [0] * (len(root) - 1)
    border = [places[0] + left for left, _, places in rules] + root[1:]
    high = [places[0] + whole for _, whole, places in rules] + [n] * (len(root) - 1)
    found = across_borders(np.array(ids), np.array(low), np.array(border), np.array(high), times)
    if not found:
        return none
    rows = []
    for which, start, stop, period in np.unique(np.concatenate(found), axis=0).tolist():
        if stop - start < least_words:
            continue
        if which < len(rules):
            places = rules[which][2]
            rows += [(period, start - places[0] + p, stop - places[0] + p) for p in places]
        else:
            rows.append((period, start, stop))
    if not rows:
        return none
    spans = np.unique(np.array(rows), axis=0)
    # Only intervals that no other one of the same period holds.
    spans = spans[np.lexsort((-spans[:, 2], spans[:, 1], spans[:, 0]))]
    reach = spans[:, 0] * (n + 1) + spans[:, 2]
    maximal = np.concatenate([[True], reach[1:] > np.maximum.accumulate(reach)[:-1]])
    spans = spans[maximal]
    spans = spans[np.lexsort((spans[:, 0], spans[:, 1]))]
    return np.stack([spans[:, 1], spans[:, 2] - spans[:, 1], spans[:, 0]], axis=1)


def find_runs(
    docs: DataFrame, text: str = "text", least_words: int = LEAST_WORDS, times: int = LEAST_TIMES, least_count: int = LEAST_COUNT
) -> DataFrame:
    """``docs`` with the periodic runs of each whole text.

    Words are what ASCII white space leaves. Adds ``n_words``, ``runs``
    (array of start, length, period: maximal stretches of at least ``least_words``
    words that hold their smallest period at least ``times`` times, by start,
    then period) and ``collapsed`` (the words that no run holds after its first
    period, joined by one space).

    One pass without shuffle; a text is worked off alone, so memory follows the
    longest one. ``times`` is four or more. A null or empty text has no words, no runs and an
    empty ``collapsed``. Rows do not meet, so repeated rows and ids have no
    effect. Columns of ``docs`` named like an added one are replaced.
    """
    if times < LEAST_TIMES:
        raise ValueError("the search needs a period four times or more")
    keep = [c for c in docs.columns if c not in ADDED]
    docs = blocks.lean(docs.select(*keep))
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
        + ["n_words long", "runs array<struct<start:long,length:long,period:long>>", "collapsed string"]
    )

    def run(batches):
        for rows, raw, offsets in blocks.text_blocks(batches, text):
            n_words, runs, kept = [], [], []
            for a, b in zip(offsets[:-1], offsets[1:]):
                words = raw[a:b].tobytes().split()
                known: dict[bytes, int] = {}
                spans = runs_of([known.setdefault(w, len(known)) for w in words], least_words, times, least_count)
                n_words.append(len(words))
                runs.append(spans)
                if len(spans):
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(edge, spans[:, 0] + spans[:, 2], 1)
                    np.add.at(edge, spans[:, 0] + spans[:, 1], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                kept.append(b" ".join(words))
            flat = np.concatenate(runs)
            ends = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
            listed = pa.StructArray.from_arrays([pa.array(flat[:, i], pa.int64()) for i in range(3)], fields=list(run_type))
            yield pa.RecordBatch.from_arrays(
                [rows.column(i) for i in range(len(keep))]
                + [
                    pa.array(n_words, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), listed),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=keep + list(ADDED),
            )

    return docs.mapInArrow(run, schema)
