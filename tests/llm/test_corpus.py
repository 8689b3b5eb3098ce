"""Operators over many documents: groups, mixes, trained models, pages, chats."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import blocks, chat, html_text, language, mixing, near_dups, pii, toxicity

SCHEMA = "doc_id long, text string"
DATA = "/root/testdata/sf0.01"


# Near duplicates


def shingle_set(text, size):
    words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if len(words) >= size else frozenset([tuple(words)])


def grouped(rows, size, percent):
    sets = [(i, shingle_set(t, size)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return sorted(((i, len(x), root(i) if x else i, i is None or (root(i) if x else i) == i) for i, x in sets), key=str)


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, clashing, size):
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, base = [], [rnd.choice(vocabulary) for _ in range(60)]
    for i in range(150):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 80))]
        if i % 2:
            # A large family of changed and cut copies, many of them far apart.
            words = list(base[: rnd.randrange(45, 61)])
            for _ in range(rnd.randrange(0, 9)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary).upper()
        rows.append((i + 100, " ".join(words)))
    rows += [(7, rows[1][1]), (8, rows[3][1].upper()), (9, None), (10, ""), (11, " \n "), (12, "One"), (13, "one"), (14, "b c d"), (15, "B C d")]
    rows += [(None, rows[1][1]), (101, rows[1][1]), (16, " ".join(vocabulary * 100)), (17, " ".join(vocabulary * 100) + " more")]
    got = near_dups.group_near_duplicates(clashing(spark.createDataFrame(rows, SCHEMA)), words=size)
    assert sorted(map(tuple, got.collect()), key=str) == grouped(rows, size, 80)
    assert near_dups.group_near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(5, 5)]
    got = dict(map(tuple, near_dups.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert near_dups.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Mixing


def test_mixing(spark, clashing):
    rnd = random.Random(7)
    rows = [(i, " ".join("w" for _ in range(rnd.randrange(1, 60))), rnd.choice(["a", "b", "c", "hot", "hot", "hot", None])) for i in range(3000)]
    rows += [(3001, None, "empty"), (3002, "", "empty"), (None, "x y", "b"), (5, rows[5][1], rows[5][2])]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    plan = mixing.plan_mix(df)
    got = plan.collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        level = {s: left * weights[s] / sum(weights[o] for o in sizes if o not in full) for s in sizes if s not in full}
        over = {s for s in level if level[s] >= 2 * sizes[s]}
        if not over:
            break
        full |= over
    target = {s: level[s] if s in level else 2 * sizes[s] for s in sizes}
    by_size = {}
    for r in got:
        by_size.setdefault(r.source_size, []).append(r)
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
    for s in sizes:
        same = by_size[sizes[s]]
        assert same[0].target == pytest.approx(target[s])
        assert sum(r.taken for r in same) == pytest.approx(target[s], rel=0.12, abs=1)
    assert sorted(map(tuple, mixing.plan_mix(df).collect()), key=str) == sorted(map(tuple, got), key=str)
    emitted = mixing.mix(df)
    assert emitted.count() == sum(r.copies for r in got) and emitted.filter("copy = 'own copy'").count() == emitted.count()
    assert mixing.plan_mix(df.limit(0)).count() == 0


# Personal data

RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v, d: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v, d: all(int(p) <= 255 for p in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda v, d: 16 <= len(d) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v, d: 8 <= len(d) <= 15),
]


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p, ok in RULES for m in re.finditer(p, text or "") if ok(m[0], re.sub("[^0-9]", "", m[0]))]


def test_base_spans(spark, clashing):
    rnd = random.Random(8)
    alphabet = ["a@b.c", "a@b.c_x@y.z", "é", "😀", "1", "22", ".", "255.1.02.3", "256.1.1.1", "1.2.3.4.5.6.7.8", "+49 (30) 123-4567", "+1", "4111 1111-1111 1111", "4111111111111112", " ", "-", "@", "x", "(", "0", "\n"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 30))) for _ in range(300)]
    texts += [None, "", "a" * 50_000, "1" * 50_000, "a." * 20_000, "a@" + "b." * 5000 + "c", "+1" + "(" * 20_000, "x@y.z " * 300]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, "p@q.rs")]
    found = pii.find_spans(clashing(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(found) == len(rows)
    for r in found:
        assert [tuple(s) for s in r.base_spans] == base_spans(r.text), r.text
        assert set(map(tuple, r.base_spans)) <= set(map(tuple, r.spans)) and r.copy == "own copy"
    assert pii.find_spans(spark.createDataFrame([], SCHEMA)).count() == 0


def test_redaction_and_added_spans(spark):
    rows = [(i, f"please call us: (212) 555-{1000 + i} or +1 212 555 {2000 + i}, mail bob{i}@mail.example.com") for i in range(60)]
    rows += [(100, "nothing here"), (101, None), (102, "card 4111111111111111 and version 1.2.3.4"), (103, "write to eve [at] mail [dot] org")]
    out = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[3] == "please call us: <PHONE> or <PHONE>, mail <EMAIL>"
    assert out[100] == "nothing here" and out[101] is None and out[102].startswith("card <CARD> and")
    assert out[103] == "write to <EMAIL>"


# Trained operators, on held-out rows


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_language(spark, clashing):
    docs = blocks.documents(spark, DATA)
    trees = language.fit(docs.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "123 ... 4"), (-4, "the"), (-4, "the"), (-5, "that and the " * 50_000)], SCHEMA)
    got = language.identify(clashing(docs.select("doc_id", "text").unionByName(extra)), trees).collect()
    by_id = {r.doc_id: r for r in got}
    assert [by_id[-i].lang_pred for i in (1, 2, 3, 4, 5)] == ["und", "und", "und", "en", "en"]
    assert all(0 <= r.score <= 1 for r in got)
    truth = [(r.doc_id, r.lang) for r in docs.select("doc_id", "lang").collect() if r.lang and held_out(r.doc_id)]
    assert sum(by_id[i].lang_pred == lang for i, lang in truth) >= 0.97 * len(truth)
    nothing = language.identify(extra, language.fit(docs.limit(0)))
    assert {(r.lang_pred, r.score) for r in nothing.collect()} == {("und", 0.0)}


def test_code_lengths_are_exact(spark):
    """Against the recursive definition with dictionaries."""
    import math

    import numpy as np

    rows = [("x", "abcabcabd"), ("x", "abd"), ("y", "ccab")]
    trees = language.fit(spark.createDataFrame(rows, "lang string, text string"))
    counts = {}
    for lang, text in rows:
        padded = b"\n" * language.ORDER + text.encode()
        for i in range(language.ORDER, len(padded)):
            for n in range(language.ORDER + 1):
                after = counts.setdefault((lang, padded[i - n : i]), {})
                after[padded[i]] = after.get(padded[i], 0) + 1

    def cost(lang, context, byte):
        after = counts.get((lang, context))
        shorter = (lambda: cost(lang, context[1:], byte)) if context else (lambda: -math.log(256))
        if after is None:
            return shorter()
        total = sum(after.values()) + len(after)
        return math.log(after[byte] / total) if byte in after else math.log(len(after) / total) + shorter()

    text = "abcdé ab"
    padded = b"\n" * language.ORDER + text.encode()
    data = np.frombuffer(padded, dtype=np.uint8)
    got = trees.costs(data, np.arange(language.ORDER, len(data))).sum(axis=0)
    want = [sum(cost(lang, padded[i - language.ORDER : i], padded[i]) for i in range(language.ORDER, len(padded))) for lang in ("x", "y")]
    assert got == pytest.approx(want, rel=1e-5)


def test_toxicity(spark, clashing):
    rnd = random.Random(9)
    plain = [f"{a}{b}" for a in ("ver", "lon", "mit", "sal", "tor") for b in ("an", "ig", "osto", "um", "ela")]
    insults = ["blorgface", "snarfhead", "glimkopf"]
    rows = []
    for i in range(900):
        words = [rnd.choice(plain) for _ in range(rnd.randrange(20, 300))]
        if i % 5 == 0:
            for _ in range(rnd.randrange(1, 4)):
                words[rnd.randrange(len(words))] = rnd.choice(insults)
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(df.filter("doc_id < 600").select("doc_id", "text"), df.select("doc_id", "label"))
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "..."), (-4, "veran blorgfase lonum"), (-5, " ".join(plain * 2000))], SCHEMA)
    got = {r.doc_id: r for r in toxicity.score(clashing(df.select("doc_id", "text").unionByName(extra)), model).collect()}
    late = [(got[i].predicted, label) for i, _, label in rows if i >= 600]
    assert sum(p == y for p, y in late) >= 0.95 * len(late)
    assert got[-1].score == got[-2].score == got[-3].score == 0 and got[-4].predicted == 1 and got[-5].predicted == 0
    assert toxicity.train(df.limit(0).select("text", "label").toArrow()).shape == (toxicity.BUCKETS + 1,)


# Pages

LONG = "One of the first things that was said in the article is that it has words and more, for all of those who have time to read what is in it, and that there was not a day on which they had not been at the work."
ARTICLE = "<h1>A title &amp; more</h1><p>" + LONG.replace("words", "<b>words</b>") + "<p>Short.</p><ul><li>An item</ul>"
WANT = "A title & more\n" + LONG + "\nShort.\nAn item"


def test_pages(spark, clashing):
    menu = "<nav><ul><li><a href='/a'>Home</a></li></ul></nav><header>The name of the site and all that is in it</header>"
    ad = "<div class='ad'>Buy this now, it is the best of all and you will be happy with it for years, as we are.</div>"
    talk = "<section id='comments'><p>I think that this is the best article that was written on the site and I have read it all.</p></section>"
    form = "<form><label>Your name</label><input></form><script>var t = '</p>';</script><style>p{}</style>"
    pages = [f"<html><head><title>x</title></head><body>{menu}{ad}<article>{ARTICLE}{form}{ad}</article>{talk}<footer>&copy; us</footer></body></html>"]
    pages += [pages[0].replace("article>", "div>"), "<body>" + menu + "<!-- <p>gone --><article>" + ARTICLE, None, "", "<p", "<nav>a</nav>", "plain words only"]
    rows = [(i, f"u{i}", p) for i, p in enumerate(pages)] + [(9, "u", "<p>" + "the of and to a word " * 20_000)]
    got = {r.page_id: r for r in html_text.extract(clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()}
    assert got[0].text == WANT and got[2].text == WANT
    # Without an article tag the rules alone decide; a lone title needs a good block.
    assert got[1].text.startswith("One of the first") or got[1].text.startswith("A title")
    assert "Buy this" not in got[1].text and "best article" not in got[1].text and "Home" not in got[1].text
    assert [got[i].text for i in (3, 4, 5, 6)] == [""] * 4 and got[9].n_chars == len(got[9].text) > 100_000


# Chats


def test_chat_roles(spark):
    rows = blocks.documents(spark, DATA, "conversations").select(F.col("conv_id").alias("id"), "turn", "role", F.lit(0).alias("part"), "text")
    out = F.crc32(F.col("id").cast("string")) % 4 == 2
    model = chat.fit(rows.filter(~out))
    found = {(r.id, r.turn): r.role for r in chat.recover(rows.filter(out).drop("role"), model).collect()}
    truth = [r for r in rows.filter(out).collect()]
    assert sum(found.get((r.id, r.turn)) == r.role for r in truth) >= 0.9 * len(truth)
    raw = [(1, "System: be nice\nUser: hi there\nAssistant: hello\nUser: bye?"), (2, None), (3, ""), (None, "Q: x\nA: y")]
    turns = chat.recover(chat.paragraphs(spark.createDataFrame(raw, "i int, text string"), "i"), model).collect()
    assert [r.rendered for r in sorted(turns, key=lambda r: r.turn) if r.id == 1] == [
        "<|system|>\nbe nice\n<|end|>", "<|user|>\nhi there\n<|end|>", "<|assistant|>\nhello\n<|end|>", "<|user|>\nbye?\n<|end|>"
    ]
    assert {r.id for r in turns} == {1, 2, 3, None}
    assert chat.recover(rows.limit(0).drop("role"), chat.fit(rows.limit(0))).count() == 0
