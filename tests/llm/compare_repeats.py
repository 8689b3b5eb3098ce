"""Removed bytes by plain comparison of all strings, and a tool that holds
``find_repeats`` against it on a whole table:

    python -m tests.llm.compare_repeats FOLDER [FILES]

Every string is named by a 64-bit rolling sum over random byte values; strings
with equal names are sorted together and their bytes compared with the first of
them. Shares no code with the operator.
"""

from __future__ import annotations

import sys

import numpy as np


def plain_removed(texts: list[bytes], length: int) -> list[int]:
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    gone = np.zeros(len(data) + 1, dtype=np.int64)
    if len(data) < length:
        return [0] * len(texts)
    # The name of a string: its bytes in eights, each times an odd number.
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eights = np.zeros(len(data), dtype=np.uint64)
    for k in range(8):
        eights |= padded[k : k + len(data)].astype(np.uint64) << np.uint64(8 * k)
    odd = np.random.default_rng(9).integers(1, 1 << 62, length // 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    n = len(data) - length + 1
    name = np.zeros(n, dtype=np.uint64)
    for k, factor in enumerate(odd):
        part = eights[8 * k : 8 * k + n] * factor
        name += part ^ (part >> np.uint64(29))
    inside = np.zeros(n, dtype=bool)
    for a, b in zip(ends - [len(t) for t in texts], ends):
        inside[a : max(a, b - length + 1)] = True
    starts = np.flatnonzero(inside)
    names = name[starts]
    order = np.argsort(names, kind="stable")
    starts, names = starts[order], names[order]
    head = np.ones(len(starts), dtype=bool)
    head[1:] = names[1:] != names[:-1]
    size = np.bincount(np.cumsum(head) - 1) if len(starts) else np.zeros(0, dtype=np.int64)
    several = np.repeat(size > 1, size)
    first = np.repeat(starts[head], size)[several]
    found = starts[several]
    views = np.lib.stride_tricks.sliding_window_view(data, length)
    for a in range(0, len(found), 1 << 16):
        if (views[found[a : a + (1 << 16)]] != views[first[a : a + (1 << 16)]]).any():
            raise ValueError("different strings of one name: take another seed")
    np.add.at(gone, found, 1)
    np.add.at(gone, found + length, -1)
    removed = np.concatenate([[0], np.cumsum(np.cumsum(gone[:-1]) > 0)])
    return [int(removed[b] - removed[b - len(t)]) for b, t in zip(ends, texts)]


def main(folder: str, files: int = 200) -> None:
    import tempfile

    import pyarrow.parquet as pq

    from tidewatch.llm import repeats
    from tidewatch.session import build_session

    table = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"])
    texts = [(t or "").encode() for t in table.column("text").to_pylist()]
    want = plain_removed(texts, repeats.LENGTH)
    spark = build_session()
    cut = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/documents"
    spark.read.parquet(f"{folder}/documents.parquet").repartition(files).write.parquet(cut)
    got = {}
    for r in repeats.find_repeats(spark.read.parquet(cut)).select("doc_id", "n_removed").toLocalIterator():
        got.setdefault(r.doc_id, []).append(r.n_removed)
    told = {}
    for i, n in zip(table.column("doc_id").to_pylist(), want):
        told.setdefault(i, []).append(n)
    differ = [i for i in told if sorted(told[i]) != sorted(got.get(i, []))]
    print(
        f"{len(texts)} rows, {sum(map(len, texts))} bytes; removed {sum(want)} of {sum(n > 0 for n in want)} rows; "
        f"{len(differ)} ids differ, {len(got.keys() - told.keys())} ids too many"
    )


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:]))
