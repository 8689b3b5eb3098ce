"""Counting operators against brute force on literal texts."""

import hashlib
import random
import re

from tidewatch.llm import decontaminate, quality, repeats

SCHEMA = "doc_id long, text string"


def words_text(rnd, n, pool=("alpha", "bét", "Gam", "δελτα", "e", "ffff")):
    return " ".join(rnd.choice(pool) + str(rnd.randrange(99)) for _ in range(n))


# Quality rules


def measured(text):
    text = text or ""
    words = re.findall(r"[^ \t-\r]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^ \t-\r]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {g for g in grams if grams.count(g) > 1}
    hit = {i + k for i, g in enumerate(grams) if g in twice for k in range(3)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


def test_quality_counts(spark, clashing):
    rnd = random.Random(1)
    texts = [None, "", " \n\t ", "a b c a b c", "x\n\nx\nx \n", "é# é#\né# é#", "one two " * 40, words_text(rnd, 400)]
    texts += ["\n".join(rnd.choice(["same line here", words_text(rnd, 5)]) for _ in range(30)) for _ in range(5)]
    texts += [texts[-1], "z\v\f\rz", "long " * 30000]
    rows = list(enumerate(texts))
    got = quality.measure(clashing(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(got) == len(rows) and all(r["copy"] == "own copy" for r in got)
    for r in got:
        if r.doc_id < len(rows) - 1:
            want = measured(r.text)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want, r.text
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id: r.kept for r in got}
    assert kept[7] and not kept[6] and not kept[0]


def test_quality_rejects_repeated_passages_and_lines(spark):
    rnd = random.Random(2)
    clean, part = words_text(rnd, 300), words_text(rnd, 60)
    rows = [(1, clean), (2, clean + " " + part + " x " + part), (3, "\n".join(["a line of its own"] * 20 + [words_text(rnd, 60)]))]
    kept = {r.doc_id: r.kept for r in quality.measure(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == {1: True, 2: False, 3: False}
    assert quality.measure(spark.createDataFrame([], SCHEMA)).count() == 0


# Benchmark passages


def contamination(text, items, window=13):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words, hit, ids = pattern.findall(lower(text)), set(), set()
    for item, body in items:
        own = pattern.findall(lower(body))
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if size else 0):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == own[i : i + size]:
                    hit.update(range(j, j + size))
                    ids.add(item)
    return len(words), len(hit), sorted(str(i) for i in ids if i is not None), bool(hit) and 20 * len(hit) >= len(words)


def test_decontamination(spark, clashing):
    rnd = random.Random(3)
    pool = ["ab", "C", "dé", "x1", "YZ"]
    text = lambda n: " ".join(rnd.choice(pool) for _ in range(n))
    items = [(1, words_text(rnd, 30)), (2, "Ab c DÉ"), (3, None), (4, "... !"), (5, words_text(rnd, 13)), (10, words_text(rnd, 40)), (None, "zz qq"), (1, "ab ab ab ab")]
    items.append((6, items[0][1]))
    docs = [(i, text(rnd.randrange(0, 60))) for i in range(25)]
    docs += [(30, "Start " + items[0][1].upper().lower() + " end"), (31, " ".join(items[5][1].split()[5:20])), (32, None), (33, ""), (34, "zz,qq")]
    docs += [(35, ". ".join(items[4][1].split()) + " " + words_text(rnd, 500)), (30, docs[25][1]), (36, words_text(rnd, 3000))]
    df, bench = clashing(spark.createDataFrame(docs, SCHEMA)), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((d, *contamination(t, items)) for d, t in docs)
    for slice_words in (1_000_000, 20):
        got = decontaminate.find_passages(df, bench, slice_words=slice_words)
        assert sorted((r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in got.collect()) == want
    spans = {r.doc_id: (r.hit_starts, r.hit_ends) for r in got.collect()}
    assert spans[30] == ([1], [31])
    assert decontaminate.find_passages(df, bench.limit(0)).filter("contaminated").count() == 0
    left = decontaminate.drop_contaminated(spark.createDataFrame(docs, SCHEMA), bench)
    assert left.columns == ["doc_id", "text"] and {r.doc_id for r in left.collect()} == {w[0] for w in want if not w[4]}


# Repeated strings


def without_repeats(rows, length):
    starts = {}
    bodies = [(i, (t or "").encode()) for i, t in rows]
    for _, body in bodies:
        for p in range(len(body) - length + 1):
            starts[body[p : p + length]] = starts.get(body[p : p + length], 0) + 1
    out = []
    for i, body in bodies:
        gone = bytearray(len(body))
        for p in range(len(body) - length + 1):
            if starts[body[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(body, gone) if not g)
        spans = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(gone)))
        out.append((i, len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_order():
    import numpy as np

    rnd = random.Random(4)
    for n in [0, 1, 2, *(rnd.randrange(1, 200) for _ in range(30))]:
        data = np.array([rnd.choice(b"aab\xff") for _ in range(n)], dtype=np.uint8)
        raw = data.tobytes()
        assert repeats.suffix_order(data, 400).tolist() == sorted(range(n), key=lambda p: raw[p:])


def test_repeats(spark, clashing):
    rnd = random.Random(5)
    common, rows = words_text(rnd, 30), []
    for i in range(60):
        t = words_text(rnd, rnd.randrange(5, 120))
        if i % 3 == 0:
            t += common + words_text(rnd, rnd.randrange(10, 60))
        if i % 10 == 1:
            t = "For " * rnd.randrange(50, 300)
        if i % 7 == 2:
            u = rows[rnd.randrange(len(rows))][1] or ""
            k = rnd.randrange(len(u) + 1)
            t = u[:k] + "X" + u[k + 1 :]
        rows.append((i, None if i % 20 == 5 else t))
    rows += [rows[3], (None, "zz" * 300), (None, None), (77, "")]
    df = clashing(spark.createDataFrame(rows, SCHEMA))
    # Few pieces per array: the common passage is spread over many.
    for length, pieces in ((400, 128), (100, 4), (40, 2)):
        got = repeats.find_repeats(df, length=length, pieces=pieces)
        assert sorted(map(tuple, got.collect()), key=str) == without_repeats(rows, length)
    assert repeats.find_repeats(df.limit(0)).count() == 0


def test_kept_text_is_returned(spark):
    passage = "".join(chr(97 + i % 26) * (i % 5 + 1) for i in range(200))
    rows = [(1, "one " + passage + " ä"), (2, passage + " two"), (3, "three")]
    got = {r.doc_id: bytes(r.kept).decode() for r in repeats.find_repeats(spark.createDataFrame(rows, SCHEMA), with_text=True).collect()}
    # The blank after the passage is shared as well.
    assert got == {1: "one ä", 2: "two", 3: "three"}
