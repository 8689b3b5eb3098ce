"""Toxicity by averaged subword embeddings and a linear softmax, trained jointly.

A word's vector is the average of the embeddings of its hashed character n-grams,
so an unseen misspelling shares most of them with the word it distorts. A passage
of 20 words is the average of its words, a linear softmax scores it, and the text
has the score of its worst passage: one insult counts the same in a long text and
in a short one. Training knows labels of whole texts only; it first gives every
passage its text's label, then moves the worst passages alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import blocks

PASSAGE = 20
GRAMS = (3, 4, 5, 6)
BUCKETS = 1 << 17
DIMENSIONS = 12
THRESHOLD = 0.3
#: Bounds of the training sample: labelled rows of each label, and bytes of text.
ROWS_PER_LABEL = {1: 2000, 0: 4000}
BYTES = 18_000_000
PASSES = (2, 20)
STEP = 0.5

_LETTER = blocks.LETTERS


def _subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words, and where each word's begin.

    ``data`` must have a byte before and after every word; both are taken as the
    word's edge.
    """
    edged = data.copy()
    edged[starts - 1] = edged[ends] = 32
    running = blocks.short_sums(edged)
    sizes = ends - starts + 2
    found, owner = [], []
    for n in GRAMS:
        count = np.maximum(sizes - n + 1, 0)
        word = np.repeat(np.arange(len(starts)), count)
        at = (starts - 1)[word] + np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
        found.append(blocks.mixed(blocks.short_hashes(running, at, at + n) + np.uint64(n)))
        owner.append(word)
    # The word as a whole.
    found.append(blocks.mixed(blocks.short_hashes(running, starts, ends) + np.uint64(1)))
    owner.append(np.arange(len(starts)))
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    buckets = (np.concatenate(found)[order] & np.uint64(BUCKETS - 1)).astype(np.int32)
    return buckets, np.searchsorted(owner[order], np.arange(len(starts) + 1))


def _passages(raw: np.ndarray, offsets: np.ndarray):
    """Distinct words of a block with their subwords; word and document of each
    passage place."""
    # A blank around every document gives each word its edges.
    n = len(offsets) - 1
    place = np.arange(len(raw)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))
    data = np.full(len(raw) + n + 1, 32, dtype=np.uint8)
    data[place] = blocks.LOWER[raw]
    words = blocks.Words(data, offsets + np.arange(n + 1), _LETTER)
    keys = blocks.short_hashes(blocks.short_sums(data), words.starts, words.ends)
    _, first, word = np.unique(keys, return_index=True, return_inverse=True)
    buckets, bounds = _subwords(data, words.starts[first], words.ends[first])
    inside = np.arange(len(words.starts)) - words.bounds[:-1][words.doc]
    new = inside % PASSAGE == 0
    begins = np.flatnonzero(new)
    return buckets, bounds, word, begins, words.doc[begins]


def _mean(values: np.ndarray, begins: np.ndarray, total: int) -> np.ndarray:
    sizes = np.diff(np.append(begins, total))
    return np.add.reduceat(values, begins, axis=0) / (sizes if values.ndim == 1 else sizes[:, None])


def _gathered(sample: pa.Table) -> tuple[np.ndarray, ...]:
    """Passages of the sample as in ``_passages``, and the labels of its texts.

    Made block by block: only bucket numbers stay, four bytes each.
    """
    parts, labels, n_words, n_subs, n_places, n_docs = [], [], 0, 0, 0, 0
    for rows, raw, offsets in blocks.text_blocks(sample.to_batches(max_chunksize=200), "text"):
        buckets, bounds, word, begins, owner = _passages(raw, offsets)
        parts.append(
            (buckets, (bounds[:-1] + n_subs).astype(np.int32), (word + n_words).astype(np.int32), (begins + n_places).astype(np.int32), (owner + n_docs).astype(np.int32))
        )
        n_subs, n_words, n_places, n_docs = n_subs + len(buckets), n_words + len(bounds) - 1, n_places + len(word), n_docs + rows.num_rows
        labels.append(rows.column(rows.schema.get_field_index("label")).to_numpy())
    if not parts:
        none = np.zeros(0, dtype=np.int32)
        return none, np.zeros(1, dtype=np.int32), none, none, none, none
    buckets, bounds, word, begins, owner = (np.concatenate(p) for p in zip(*parts))
    return buckets, np.append(bounds, np.int32(n_subs)), word, begins, owner, np.concatenate(labels)


def train(sample: pa.Table, seed: int = 1) -> np.ndarray:
    """Score of every bucket: the embeddings seen through the softmax, and its bias.

    As word and passage vectors are averages and the last layer is linear, the
    difference of the two logits is the average of one number per bucket.
    """
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer = rng.normal(0, 0.3, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    buckets, bounds, word, begins, owner, labels = _gathered(sample)
    table_g, layer_g, bias_g = np.full(BUCKETS, 1e-3, np.float32), np.full(layer.shape, 1e-3, np.float32), np.full(2, 1e-3, np.float32)
    if not len(begins) or not 0 < labels.sum() < len(labels):
        return np.append(np.zeros(BUCKETS), -np.inf).astype(np.float32)
    if len(begins):
        limits = np.append(begins, len(word)).astype(np.int64)
        target = labels[owner]
        # Both labels weigh alike while training; half the way back comes at the end.
        odds_seen = labels.sum() / (len(labels) - labels.sum())
        share = np.where(labels == 1, 1 + 1 / odds_seen, 1 + odds_seen) / 2
        first_passage = np.searchsorted(owner, np.unique(owner))
        for turn in range(sum(PASSES)):
            if turn < PASSES[0]:
                chosen = np.arange(len(begins))
            else:
                scores = _scored(_bucket_scores(table, layer), float(bias[1] - bias[0]), buckets, bounds, word, begins)
                sizes = np.diff(np.append(first_passage, len(begins)))
                best = np.maximum.reduceat(scores, first_passage)
                chosen = np.flatnonzero(scores == np.repeat(best, sizes))
                # Clean texts are clean all over: their other passages stay in sight.
                clean = np.flatnonzero(target == 0)
                chosen = np.union1d(chosen, rng.choice(clean, min(len(clean), len(chosen)), replace=False))
            rng.shuffle(chosen)
            # Few passages make small steps, so that a small sample has enough of them.
            for part in np.array_split(chosen, max(1, len(chosen) // int(np.clip(len(chosen) // 30, 32, 1024)))):
                sizes = limits[part + 1] - limits[part]
                places = np.repeat(limits[part] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                used, local = np.unique(word[places], return_inverse=True)
                w_sizes = bounds[used + 1] - bounds[used]
                w_first = np.cumsum(w_sizes) - w_sizes
                subs = buckets[np.repeat(bounds[used] - w_first, w_sizes) + np.arange(w_sizes.sum())]
                vectors = np.add.reduceat(table[subs], w_first, axis=0) / w_sizes[:, None]
                p_first = np.cumsum(sizes) - sizes
                bags = np.add.reduceat(vectors[local], p_first, axis=0) / sizes[:, None]
                logits = bags @ layer + bias
                odds = np.exp(logits - logits.max(axis=1, keepdims=True))
                odds /= odds.sum(axis=1, keepdims=True)
                error = odds
                error[np.arange(len(part)), target[part]] -= 1
                error *= (share[owner[part]] / len(part))[:, None]
                bag_error = error @ layer.T
                word_error = np.zeros((len(used), DIMENSIONS), dtype=np.float32)
                per_place = np.repeat(bag_error / sizes[:, None], sizes, axis=0)
                ids, where = np.unique(subs, return_inverse=True)
                for d in range(DIMENSIONS):
                    word_error[:, d] = np.bincount(local, weights=per_place[:, d], minlength=len(used)) / w_sizes
                sub_error = np.empty((len(ids), DIMENSIONS), dtype=np.float32)
                spread = np.repeat(np.arange(len(used)), w_sizes)
                for d in range(DIMENSIONS):
                    sub_error[:, d] = np.bincount(where, weights=word_error[spread, d], minlength=len(ids))
                layer_error, bias_error = bags.T @ error, error.sum(axis=0)
                table_g[ids] += (sub_error**2).mean(axis=1) * 1e4
                layer_g += layer_error**2
                bias_g += bias_error**2
                table[ids] -= STEP * 10 * sub_error / np.sqrt(table_g[ids])[:, None]
                layer -= STEP * layer_error / np.sqrt(layer_g)
                bias -= STEP * bias_error / np.sqrt(bias_g)
        bias[1] += 0.5 * np.log(odds_seen)
    return np.append(_bucket_scores(table, layer), bias[1] - bias[0]).astype(np.float32)


def _bucket_scores(table: np.ndarray, layer: np.ndarray) -> np.ndarray:
    return table @ (layer[:, 1] - layer[:, 0])


def _scored(scores: np.ndarray, bias: float, buckets, bounds, word, begins) -> np.ndarray:
    """Logit of every passage."""
    words = np.add.reduceat(scores[buckets], bounds[:-1]) / np.diff(bounds)
    return _mean(words[word], begins, len(word)) + bias


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label") -> np.ndarray:
    """The model, trained on a bounded sample of the labelled rows.

    The sample is the rows with the least text hashes: ``ROWS_PER_LABEL`` of each
    label, less those that do not fit into ``BYTES`` bytes any more. It is chosen by hash and size
    alone, so texts are only moved for the chosen rows, whose keys are broadcast.
    Rows with a null key, text or label are not used; a row that occurs twice is
    used once. Without both labels the model knows nothing and scores 0.
    """
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    texts = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    rows = texts.select("key", "h", F.octet_length("text").alias("bytes")).join(known, "key").distinct()
    rows = rows.filter(F.col("bytes") <= BYTES)
    parts = [rows.filter(F.col("label") == k).orderBy("h", "key").limit(n) for k, n in ROWS_PER_LABEL.items()]
    # A text that does not fit any more is passed over, and the next ones are tried.
    left, fitting = BYTES, []
    listed = parts[0].unionByName(parts[1]).orderBy("h", "key", "label")
    for r in listed.collect():
        if r["bytes"] <= left:
            left -= r["bytes"]
            fitting.append((r["key"], r["h"], r["label"]))
    chosen = docs.sparkSession.createDataFrame(fitting, listed.select("key", "h", "label").schema)
    # At most sum(ROWS_PER_LABEL) rows of three numbers.
    taken = texts.join(F.broadcast(chosen), ["key", "h"]).dropDuplicates(["key", "h", "label"])
    return train(taken.select("text", "label").orderBy(F.xxhash64("text")).toArrow())


def score(docs: DataFrame, model: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 at ``THRESHOLD``).

    One pass over whole texts without shuffle. A text without a word, empty or
    null, has no passage and the score 0. Repeated rows score alike; an empty
    table gives no rows; columns named like the added ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    docs = blocks.lean(docs.select(*keep))

    def run(batches):
        scores, bias = shared.value[:-1], float(shared.value[-1])
        for rows, raw, offsets in blocks.text_blocks(batches, text):
            out = np.zeros(rows.num_rows)
            buckets, bounds, word, begins, owner = _passages(raw, offsets)
            if len(begins):
                logits = _scored(scores, bias, buckets, bounds, word, begins)
                first = np.searchsorted(owner, np.unique(owner))
                out[np.unique(owner)] = 1 / (1 + np.exp(-np.maximum.reduceat(logits, first).astype(np.float64)))
            yield pa.RecordBatch.from_arrays(
                rows.columns + [pa.array(out), pa.array((out >= THRESHOLD).astype(np.int32))], names=keep + ["score", "predicted"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, score double, predicted int")
