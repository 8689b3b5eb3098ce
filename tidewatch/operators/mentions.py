"""Dictionary names in whole texts, every place of each.

The names of one part of the dictionary form a trie over words; failure links lead
from each state to the longest other beginning of a name that the words read so far
end in. One walk over a text's words thus meets every mention, overlapping and
nested ones too, whatever lengths the names have.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of names in one automaton; a larger dictionary takes several.
PART_WORDS = 500_000
#: Mentions that a task holds before it hands them on.
OUT_ROWS = 8_192
#: Runs of letters and digits.
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


class Automaton:
    def __init__(self, names: Iterable[tuple[str, ...]]):
        self.step: list[dict[str, int]] = [{}]
        #: Name that ends in a state (its length in words and text), or None.
        self.ends: list[tuple[int, str] | None] = [None]
        for name in names:
            state = 0
            for word in name:
                after = self.step[state].get(word)
                if after is None:
                    after = self.step[state][word] = len(self.step)
                    self.step.append({})
                    self.ends.append(None)
                state = after
            self.ends[state] = (len(name), " ".join(name))
        self.fail = [0] * len(self.step)
        #: Next state along the failure links in which a name ends, 0 for none.
        self.shorter = [0] * len(self.step)
        queue = deque(self.step[0].values())
        while queue:
            state = queue.popleft()
            for word, after in self.step[state].items():
                back = self.fail[state]
                while back and word not in self.step[back]:
                    back = self.fail[back]
                self.fail[after] = self.step[back].get(word, 0)
                self.shorter[after] = self.fail[after] if self.ends[self.fail[after]] else self.shorter[self.fail[after]]
                queue.append(after)

    def walk(self, words: list[str]) -> Iterator[tuple[int, int, str]]:
        """``(first word, last word, name)`` of each mention, by last word."""
        state = 0
        for i, word in enumerate(words):
            while state and word not in self.step[state]:
                state = self.fail[state]
            state = self.step[state].get(word, 0)
            end = state if self.ends[state] else self.shorter[state]
            while end:
                length, name = self.ends[end]
                yield i - length + 1, i, name
                end = self.shorter[end]


def mentions_in(automaton: Automaton, text: str) -> Iterator[tuple[str, int, int, int]]:
    """``(name, mention_no, char_start, char_end)`` of each mention in one text."""
    spans, said = [], []
    for m in _WORD.finditer(text):
        spans.append(m.span())
        said.append(m.group().lower())
    seen: dict[str, int] = {}
    for first, last, name in automaton.walk(said):
        seen[name] = seen.get(name, 0) + 1
        yield name, seen[name], spans[first][0], spans[last][1]


def mention_batches(automaton: Automaton, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mentions in all texts, ``OUT_ROWS`` at a time: what a task holds does not grow with them."""
    for batch in batches:
        kinds = [batch.schema.field("report_id").type, pa.string(), pa.int32(), pa.int32(), pa.int32()]

        def table(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                names=["report_id", "phrase", "mention_no", "char_start", "char_end"],
            )

        out = []
        for rid, body in zip(batch.column("report_id"), batch.column("text")):
            for found in mentions_in(automaton, body.as_py()):
                out.append((rid.as_py(), *found))
                if len(out) == OUT_ROWS:
                    yield table(out)
                    out = []
        if out:
            yield table(out)


def phrases(names: DataFrame) -> DataFrame:
    """``names`` with ``phrase``: the words of the name as the walk compares them."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in names.schema] + ["phrase string"])

    def run(batches):
        for batch in batches:
            said = [" ".join(words_of(n)) if n is not None else "" for n in batch.column("name").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string())], names=[*batch.schema.names, "phrase"])

    return names.mapInArrow(run, schema).filter("phrase <> ''")


def find_mentions(reports: DataFrame, names: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """A row per mention: ``report_id, ref_id, phrase, mention_no, char_start, char_end``.

    ``names``: ref_id, name. Spans count characters of the text, punctuation
    between the words of a name included, end exclusive; ``mention_no`` counts
    the mentions of one phrase in one report from one. A name of several entities is a row
    for each. The dictionary is dealt into parts of about ``part_words`` words;
    each part is one automaton, so what a task holds does not grow with it.
    """
    spark = reports.sparkSession
    keyed = phrases(names.select("ref_id", "name")).select("ref_id", "phrase").distinct()
    listed = keyed.select("phrase").distinct()
    size = listed.agg(F.sum(F.size(F.split("phrase", " ")))).first()[0] or 0
    parts = max(1, math.ceil(size / part_words))
    texts = reports.select("report_id", "text").filter(F.col("text").isNotNull())
    kind = reports.schema["report_id"].dataType.simpleString()

    def search(shared):
        return lambda batches: mention_batches(shared.value, batches)

    found = None
    for i in range(parts):
        mine = listed.filter(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == i)
        automaton = Automaton(tuple(r["phrase"].split(" ")) for r in mine.toLocalIterator())
        hits = texts.mapInArrow(
            search(spark.sparkContext.broadcast(automaton)),
            f"report_id {kind}, phrase string, mention_no int, char_start int, char_end int",
        )
        found = hits if found is None else found.unionByName(hits)
    return found.join(keyed, "phrase").select("report_id", "ref_id", "phrase", "mention_no", "char_start", "char_end")


def geocode(reports: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Places named in texts, with the span of their first mention. A country or
    region never becomes a bare point.

    ``gazetteer``: ref_id, name, lon, lat, precision. Coarser than a building, a
    point is marked as derived; for a whole country it is left out.
    """
    hits = find_mentions(reports, gazetteer).filter("mention_no = 1")
    exact = F.col("precision").isin("exact", "building")
    whole = F.col("precision") == "country"
    # A place may have several names; its own columns are the same for all.
    places = gazetteer.select("ref_id", "lon", "lat", "precision").distinct()
    return hits.join(places, "ref_id").select(
        "report_id",
        "ref_id",
        F.col("phrase").alias("place_name"),
        F.col("precision").alias("geo_precision"),
        F.when(~whole, F.col("lon")).alias("lon"),
        F.when(~whole, F.col("lat")).alias("lat"),
        (~exact & ~whole).alias("point_is_derived"),
        "char_start",
        "char_end",
    )
