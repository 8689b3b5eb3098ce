"""Transcripts to chat turns, by a hidden Markov model.

A transcript is a series of paragraphs, cut at blank lines and before speaker
markers. Each has a marker, or none, and line features; the hidden state is the
role that speaks. Counts over labelled turns give the model, Viterbi the roles,
and paragraphs of one role in a row become one canonical turn.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import cut_lineage

ROLES = ("system", "user", "assistant")
# Names that speakers are marked with.
MARKERS = {
    "system": ["system", "instruction", "instructions"],
    "user": ["user", "human", "customer", "question", "q"],
    "assistant": ["assistant", "ai", "bot", "model", "answer", "a"],
}
#: Rows of a transcript that are decoded together. Of a longer one, each piece is
#: summarised by its best scores between first and last role, and decoded once the
#: roles at its ends are known, which gives the roles of the whole series.
PIECE = 256
#: Values of each feature: marker, words, lines, question, list or code.
SIZES = (5, 8, 5, 2, 2)
#: Share of the marker statistics that is not counted: a marker names its role.
TRUST = 0.1

_NAMES = "|".join(n for names in MARKERS.values() for n in names)
_MARK = rf"(?i)^\s*(?:\*\*|###?\s*|<\|?|\[)?({_NAMES})(?:\*\*|\|?>|\])?\s*(?::|>|\n|$)(?:\*\*)?[ \t]*"


def paragraphs(transcripts: DataFrame, id_column: str, text: str = "text") -> DataFrame:
    """``id, turn, part, text`` from raw transcripts, in their order."""
    cut = rf"\n[ \t]*\n|\n(?=\s*(?:\*\*|###?\s*|<\|?|\[)?(?i:{_NAMES})(?:\*\*|\|?>|\])?\s*:)"
    return transcripts.select(
        F.col(id_column).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), cut)).alias("turn", "text")
    ).select("id", F.col("turn").cast("long").alias("turn"), F.lit(0).alias("part"), "text")


def speakers(turns: DataFrame) -> DataFrame:
    """``turns`` cut before each speaker marker at the start of a line; ``part`` counts
    the pieces of a row. Other columns stay; a row without a marker is one piece, a
    null text stays null."""
    cut = rf"\n(?=\s*(?:\*\*|###?\s*|<\|?|\[)?(?i:{_NAMES})(?:\*\*|\|?>|\])?\s*:)"
    rest = [c for c in turns.columns if c not in ("part", "text")]
    return turns.select(*rest, F.posexplode_outer(F.split("text", cut)).alias("part", "text")).withColumn("part", F.coalesce("part", F.lit(0)))


def _bucket(value: Column, edges: list[int]) -> Column:
    out = F.lit(0)
    for edge in edges:
        out = out + F.when(value >= edge, 1).otherwise(0)
    return out


def _features(units: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    named = F.lower(F.regexp_extract(text, _MARK, 1))
    marker = F.when(named == "", F.when(text.rlike(r"^\s*[A-Z][\w ]{0,20}:\s"), 4).otherwise(0))
    for i, role in enumerate(ROLES):
        marker = marker.when(named.isin(MARKERS[role]), i + 1)
    words = F.regexp_count(text, F.lit(r"\S+"))
    lines = F.regexp_count(text, F.lit(r"\n")) + 1
    seen = [
        marker.otherwise(0),
        _bucket(words, [8, 16, 32, 48, 64, 128, 256]),
        _bucket(lines, [2, 3, 5, 9]),
        F.when(text.rlike(r"\?\s*$"), 1).otherwise(0),
        F.when(text.rlike(r"(?m)^\s*(?:[-*]\s|\d+[.)]\s|```)"), 1).otherwise(0),
    ]
    return units.withColumn("seen", F.array(*[s.cast("int") for s in seen]))


class Model:
    """Logarithms: first role, role after role, and features given the role."""

    def __init__(self, first: np.ndarray, follow: np.ndarray, emit: list[np.ndarray]):
        self.first, self.follow, self.emit = np.log(first), np.log(follow), [np.log(e) for e in emit]

    def _told(self, seen: np.ndarray) -> np.ndarray:
        return sum(e[:, seen[:, k]] for k, e in enumerate(self.emit)).T

    def between(self, seen: np.ndarray) -> np.ndarray:
        """Best score of a series from each first role to each last one."""
        told = self._told(seen)
        best = np.where(np.eye(len(ROLES), dtype=bool), told[0], -np.inf)
        for row in told[1:]:
            best = (best[:, :, None] + self.follow).max(axis=1) + row
        return best

    def ends(self, pieces: list[np.ndarray]) -> list[tuple[int, int]]:
        """First and last role of each piece of a transcript on its likeliest way."""
        into, back = self.first, []
        for score in pieces:
            ways = into[:, None] + score
            enter, last = ways.argmax(axis=0), ways.max(axis=0)
            after = last[:, None] + self.follow
            back.append((enter, after.argmax(axis=0)))
            into = after.max(axis=0)
        out, leave = [], int(last.argmax())
        for k in range(len(pieces) - 1, -1, -1):
            enter = int(back[k][0][leave])
            out.append((enter, leave))
            leave = int(back[k - 1][1][enter]) if k else 0
        return out[::-1]

    def decode(self, seen: np.ndarray, enter: int | None = None, leave: int | None = None) -> np.ndarray:
        """The likeliest roles of a series of paragraphs (Viterbi): of a whole
        transcript, or of a piece with these roles at its ends."""
        told = self._told(seen)
        best = told[0] + self.first if enter is None else np.where(np.arange(len(ROLES)) == enter, told[0], -np.inf)
        back = np.zeros(told.shape, dtype=np.int8)
        for t in range(1, len(told)):
            ways = best[:, None] + self.follow
            back[t] = ways.argmax(axis=0)
            best = ways.max(axis=0) + told[t]
        roles = np.zeros(len(told), dtype=np.int64)
        roles[-1] = best.argmax() if leave is None else leave
        for t in range(len(told) - 1, 0, -1):
            roles[t - 1] = back[t, roles[t]]
        return roles


def _in_runs(run, columns: list[str], size: int = 1000):
    """For mapInArrow: ``run`` gives the output rows of each run of equal values in
    the first column; the batches it reads are sorted by that."""

    def mapped(batches):
        held, out, fields = [], [], None

        def batch_of(rows):
            kinds = [fields.get(c, t) for c, t in (x.rsplit(" ", 1) for x in columns)]
            kinds = [k if isinstance(k, pa.DataType) else {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "scores": pa.list_(pa.float64())}[k] for k in kinds]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.rsplit(" ", 1)[0] for x in columns])

        for batch in batches:
            fields = {"id": batch.schema.field("id").type}
            for r in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                if held and r[0] != held[0][0]:
                    out += run(held)
                    held = []
                held.append(r)
                if len(out) >= size:
                    yield batch_of(out)
                    out = []
        if held:
            out += run(held)
        if out:
            yield batch_of(out)

    return mapped


def fit(turns: DataFrame) -> Model:
    """The model from labelled turns ``id, turn, role, text``.

    Every count is an aggregate over all rows; what comes to the driver is a table
    of roles and feature values. Roles that are not in ``ROLES`` and null roles are
    not used. Without any row the markers alone decide.
    """
    code = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role")) - 1
    known = _features(turns.filter(F.col("role").isin(*ROLES))).select("id", "turn", code.cast("int").alias("role"), "seen")
    first, follow = np.ones(len(ROLES)), np.ones((len(ROLES), len(ROLES)))
    emit = [np.full((len(ROLES), n), 0.5) for n in SIZES]
    emit[0][:] = 1e-6
    for row in known.select("role", F.posexplode("seen").alias("k", "v")).groupBy("role", "k", "v").count().collect():
        emit[row["k"]][row["role"], row["v"]] += row["count"]
    # The next turn of the same transcript, joined by its number; a number that stands
    # on many rows is counted before.
    told = known.groupBy("id", "turn", "role").agg(F.count("*").cast("double").alias("n"))
    after = told.select("id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next"), F.col("n").alias("m"))
    for row in told.join(after, ["id", "turn"]).groupBy("role", "next").agg(F.sum(F.col("n") * F.col("m")).alias("pairs")).collect():
        follow[row["role"], row["next"]] += row["pairs"]
    opening = known.groupBy("id").agg(F.min_by("role", "turn").alias("role"))
    for row in opening.groupBy("role").count().collect():
        first[row["role"]] += row["count"]
    emit = [e / e.sum(axis=1, keepdims=True) for e in emit]
    own = np.full(emit[0].shape, 0.005)
    own[range(len(ROLES)), range(1, len(ROLES) + 1)] = 0.98
    emit[0] = (1 - TRUST) * emit[0] + TRUST * own
    return Model(first / first.sum(), follow / follow.sum(axis=1, keepdims=True), emit)


def recover(units: DataFrame, model: Model) -> DataFrame:
    """Canonical turns ``id, turn, role, n_parts, content, rendered`` of paragraphs
    ``id, turn, part, text``.

    Paragraphs of one role in a row are one turn, numbered by its first one;
    markers are taken off; ``rendered`` is ``<|role|>``, the content and
    ``<|end|>``, each on lines of its own. A null or empty text is an empty
    paragraph. Equal numbers are ordered by text, so repeated rows follow each
    other. A null id is a transcript of its own; an empty table gives no rows.
    The rows are put in order by range and numbered in pieces of ``PIECE``, so a
    long transcript has many tasks, whatever its turn numbers are; per transcript
    only one small row for each piece comes together, and a turn that crosses
    pieces is put together in the end.
    """
    kind = units.schema["id"].dataType.simpleString()
    bare = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), _MARK, "")
    ready = (
        _features(units.select("id", F.col("turn").cast("long").alias("turn"), "part", "text"))
        .withColumn("bare", bare)
        .select("id", "turn", "part", "text", "bare", "seen")
    )
    order = ["id", "turn", "part", "text"]
    # Equal rows may be in any order: a number lets the ranges cut between them.
    ready = cut_lineage(ready.withColumn("tie", F.monotonically_increasing_id()))
    in_order = ready.repartitionByRange(*order, "tie").sortWithinPartitions(*order, "tie").select("id", "turn", "bare", "seen")

    def number(batches):
        # A task has a range of its own, and pieces follow each other as the rows do.
        piece, at, last = TaskContext.get().partitionId() << 40, 0, None
        for batch in batches:
            pieces, places = [], []
            for value in batch.column(0).to_pylist():
                if at == PIECE or (at and value != last):
                    piece, at = piece + 1, 0
                pieces.append(piece)
                places.append(at)
                at, last = at + 1, value
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces, pa.int64()), pa.array(places, pa.int32())], names=["id", "turn", "bare", "seen", "piece", "at"])

    rows = cut_lineage(in_order.mapInArrow(number, f"id {kind}, turn long, bare string, seen array<int>, piece long, at int"))

    # The pieces of transcripts that have several, each as its scores.
    several = rows.filter("at = 0").groupBy("id").agg(F.count("*").alias("k")).filter("k > 1").select("id")
    long = rows.select("id", "piece", "at", "seen").join(several.withColumnRenamed("id", "long_id"), F.col("id").eqNullSafe(F.col("long_id")), "left_semi")

    def summed(held):
        return [(held[0][2], held[0][0], model.between(np.array([h[3] for h in held], dtype=np.int64)).ravel().tolist())]

    scores = (
        long.select("piece", "at", "id", "seen").repartition("piece").sortWithinPartitions("piece", "at")
        .mapInArrow(_in_runs(summed, ["id long", "piece long", "scores scores"]), f"id {kind}, piece long, scores array<double>")
    )

    def scanned(held):
        ends = model.ends([np.array(h[2]).reshape(len(ROLES), -1) for h in held])
        return [(h[0], h[1], *e) for h, e in zip(held, ends)]

    ends = (
        scores.repartition("id").sortWithinPartitions("id", "piece")
        .mapInArrow(_in_runs(scanned, ["id long", "piece long", "enter int", "leave int"]), f"id {kind}, piece long, enter int, leave int")
        .drop("id")
    )

    def decoded(held):
        roles = model.decode(np.array([h[4] for h in held], dtype=np.int64), *held[0][5:7])
        edges = [0, *(np.flatnonzero(np.diff(roles)) + 1).tolist(), len(held)]
        for no, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            cut = None if held[0][5] is None else len(edges) - 1
            yield held[0][2], held[0][0], no, cut, held[a][3], int(roles[a]), b - a, "\n\n".join(h[7] for h in held[a:b])

    fields = ["id long", "piece long", "no int", "cut int", "turn long", "role int", "n_parts long", "content string"]
    turns = cut_lineage(
        rows.join(ends, "piece", "left").select("piece", "at", "id", "turn", "seen", "enter", "leave", "bare")
        .repartition("piece").sortWithinPartitions("piece", "at")
        .mapInArrow(_in_runs(decoded, fields), f"id {kind}, piece long, no int, cut int, turn long, role int, n_parts long, content string")
    )

    # Where a piece begins with the role that the one before ends with, its first
    # part belongs to a turn that began in an earlier piece.
    def begun(held):
        last = None
        for id_, piece, cut, enter, leave in held:
            head = last[:2] if last and last[2] == enter else (piece, 0)
            yield id_, piece, *head
            last = (*(head if cut == 1 else (piece, cut - 1)), leave)

    sides = turns.filter("cut IS NOT NULL").groupBy("id", "piece").agg(F.max("cut").alias("cut"), F.min_by("role", "no").alias("enter"), F.max_by("role", "no").alias("leave"))
    heads = (
        sides.repartition("id").sortWithinPartitions("id", "piece")
        .mapInArrow(_in_runs(begun, ["id long", "piece long", "head long", "head_no int"]), f"id {kind}, piece long, head long, head_no int")
        .select("piece", F.lit(0).alias("no"), "head", "head_no")
    )
    cut = turns.filter("cut IS NOT NULL").join(heads, ["piece", "no"], "left")
    merged = (
        cut.groupBy("id", "role", F.coalesce("head", "piece").alias("head"), F.coalesce("head_no", "no").alias("head_no"))
        .agg(
            F.min_by("turn", "piece").alias("turn"),
            F.sum("n_parts").alias("n_parts"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "content"))), lambda x: x["content"]), "\n\n").alias("content"),
        )
        .select("id", "turn", "role", "n_parts", "content")
    )

    def rendered(held):
        for id_, turn, role, n, content in held:
            content = content.strip()
            yield id_, turn, ROLES[role], n, content, f"<|{ROLES[role]}|>\n{content}\n<|end|>"

    whole = turns.filter("cut IS NULL").select("id", "turn", "role", "n_parts", "content").unionByName(merged)
    names = ["id long", "turn long", "role string", "n_parts long", "content string", "rendered string"]
    return whole.mapInArrow(_in_runs(rendered, names), f"id {kind}, turn long, role string, n_parts long, content string, rendered string")
