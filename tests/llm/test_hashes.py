"""Hashes of patterned texts, and repeats against a plain comparison."""

import numpy as np
import pytest

from tests.llm.compare_repeats import plain_removed
from tidewatch.llm import blocks, decontaminate, near_dups, quality, repeats


def thue_morse(size: int) -> tuple[str, str]:
    """A word over a and b, and its complement: equal modulo 2**64 for every base."""
    bits = [bin(k).count("1") % 2 for k in range(size)]
    return "".join("ab"[k] for k in bits), "".join("ba"[k] for k in bits)


WORD, OTHER = thue_morse(2048)


def _hash(text: str) -> int:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return int(blocks.hashes(blocks.sums(data), np.array([0]), np.array([len(data)]))[0])


def test_hash_is_the_polynomial_modulo_the_prime():
    prime = int(blocks.PRIME)
    data = np.random.default_rng(3).integers(0, 256, 3 * blocks.STEP // 2).astype(np.uint8)
    starts, ends = np.array([0, 7, 16000, 500]), np.array([len(data), 7, 17000, 501])
    want = [
        sum(int(blocks.PLACE_VALUES[v]) * pow(blocks.PLACE_BASE, k, prime) for k, v in enumerate(data[a:b])) % prime
        for a, b in zip(starts, ends)
    ]
    assert blocks.hashes(blocks.sums(data), starts, ends).tolist() == want


def test_hash_tells_patterned_words_apart():
    assert _hash(WORD) != _hash(OTHER)
    assert _hash(WORD[:1024]) != _hash(OTHER[:1024])


def test_patterned_lines_are_no_copies(spark):
    docs = spark.createDataFrame([(1, f"{WORD}\n{OTHER}"), (2, f"{WORD}\n{WORD}")], "doc_id int, text string")
    assert {r.doc_id: r.n_dup_lines for r in quality.measure(docs).collect()} == {1: 0, 2: 1}


def test_patterned_words_are_no_near_copies(spark):
    docs = spark.createDataFrame([(1, f"{WORD} end"), (2, f"{OTHER} end"), (3, f"{WORD} end")], "doc_id int, text string")
    got = near_dups.group_near_duplicates(docs, words=2, percent=80)
    assert {r.doc_id: r.component_id for r in got.collect()} == {1: 1, 2: 2, 3: 1}


def test_patterned_benchmark_words_are_both_found(spark):
    docs = spark.createDataFrame([(1, f"x {WORD} x"), (2, f"x {OTHER} x"), (3, "x")], "doc_id int, text string")
    items = spark.createDataFrame([("p", WORD), ("q", OTHER)], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, len(r.item_ids)) for r in decontaminate.find_passages(docs, items).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 0)}


@pytest.mark.parametrize("pieces", [repeats.PIECES, 2])
def test_patterned_strings_are_no_repeats(spark, pieces):
    tail = "".join(f"{k:03d}" for k in range(150))
    texts = [WORD, OTHER + tail, "." + WORD[:700], tail, tail[7:] + "!", *[f"{k}{tail[5:]}{k}" for k in range(6)], "short", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.n_removed for r in repeats.find_repeats(docs, pieces=pieces).collect()}
    assert got == dict(enumerate(plain_removed([(t or "").encode() for t in texts], repeats.LENGTH)))
