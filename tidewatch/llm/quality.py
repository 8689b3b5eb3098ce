"""Quality rules by repetition coverage.

Counts that describe a text, and the share of its characters that lies in
duplicated word n-grams of several lengths and in duplicated lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.llm import blocks

#: Largest allowed share of characters inside duplicated n-grams, by n.
GRAM_LIMITS = {5: 0.15, 7: 0.13, 10: 0.10}
#: Largest allowed share of characters inside lines equal to an earlier line.
LINE_LIMIT = 0.30
MIN_WORDS = 50
SYMBOLS = b"[#*$%&|<>]"
#: Spark field list of what ``measure`` adds.
FIELDS = {
    "n_words": pa.int64(),
    "word_chars": pa.int64(),
    "n_symbols": pa.int64(),
    "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(),
    "dup_gram_share": pa.float64(),
    "dup_line_share": pa.float64(),
    "base_failed": pa.bool_(),
    "kept": pa.bool_(),
}

_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_IS_CHAR = np.ones(256, dtype=bool)
_IS_CHAR[0x80:0xC0] = False  # continuation bytes: one code point is counted once


def _measure_block(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    words = blocks.Words(data, offsets, blocks.SPACED)
    running = blocks.sums(data)
    values = blocks.mixed(blocks.hashes(running, words.starts, words.ends))
    chars_before = np.concatenate([[0], np.cumsum(_IS_CHAR[data])])
    chars = chars_before[words.ends] - chars_before[words.starts]
    n_words = np.diff(words.bounds)
    word_chars = blocks.counts_per(words.doc, n, chars)

    symbols_before = np.concatenate([[0], np.cumsum(_IS_SYMBOL[data])])
    n_symbols = symbols_before[offsets[1:]] - symbols_before[offsets[:-1]]

    # Lines end at \n or at the end of their document.
    cut = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
    starts, ends = cut[:-1], cut[1:].copy()
    ends[data[ends - 1] == 10] -= 1
    first_word = np.searchsorted(words.starts, starts)
    has_word = np.searchsorted(words.starts, ends) > first_word
    starts, ends = starts[has_word], ends[has_word]
    line_doc = np.searchsorted(offsets, starts, "right") - 1
    _, repeated = blocks.copied(line_doc, blocks.mixed(blocks.hashes(running, starts, ends)))
    n_dup_lines = blocks.counts_per(line_doc[repeated], n)
    line_chars = chars_before[ends] - chars_before[starts]
    all_line_chars = blocks.counts_per(line_doc, n, line_chars)
    dup_line_chars = blocks.counts_per(line_doc[repeated], n, line_chars[repeated])
    dup_line_share = dup_line_chars / np.maximum(all_line_chars, 1)

    def inside(size: int) -> np.ndarray:
        at, grams = words.grams(values, size)
        twice, _ = blocks.copied(words.doc[at], grams)
        return blocks.covered(at[twice], size, len(values))

    n_repeat_words = blocks.counts_per(words.doc[inside(3)], n)
    worst = np.zeros(n)
    passes = dup_line_share <= LINE_LIMIT
    for size, limit in GRAM_LIMITS.items():
        hit = inside(size)
        share = blocks.counts_per(words.doc[hit], n, chars[hit]) / np.maximum(word_chars, 1)
        worst = np.maximum(worst, share)
        passes &= share <= limit
    base_failed = (n_words < MIN_WORDS) | (100 * n_repeat_words > 50 * n_words)
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": n_symbols,
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat_words,
        "dup_gram_share": worst,
        "dup_line_share": dup_line_share,
        "base_failed": base_failed,
        "kept": ~base_failed & passes,
    }


def measure(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with the measures in ``FIELDS`` and the verdict ``kept``.

    One pass without shuffle; each text is measured by itself. A null or empty
    text has no words and fails the base rule (under 50 words), as does a text
    whose words lie for more than half in repeated 3-word windows. Columns of
    ``docs`` with the name of a measure are replaced by it; all others stay.
    Repeated rows get equal results; an empty table gives no rows.
    """
    keep = [c for c in docs.columns if c not in FIELDS]
    docs = blocks.lean(docs.select(*keep))
    kinds = {"int64": "long", "double": "double", "bool": "boolean"}
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
        + [f"{name} {kinds[str(kind)]}" for name, kind in FIELDS.items()]
    )

    def run(batches):
        for rows, data, offsets in blocks.text_blocks(batches, column):
            found = _measure_block(data, offsets)
            yield pa.RecordBatch.from_arrays(
                rows.columns + [pa.array(found[k], FIELDS[k]) for k in FIELDS], names=keep + list(FIELDS)
            )

    return docs.mapInArrow(run, schema)
