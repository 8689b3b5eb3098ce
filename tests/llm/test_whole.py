"""Operators do the whole job: nothing is left out by size or by place."""

import random

import numpy as np
import pytest

from tidewatch.llm import chat, language, pii

LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def test_language_keeps_sequences_that_occur_once(spark):
    rnd = random.Random(21)
    rows = [(lang, "".join(rnd.choices(LETTERS, k=3000))) for lang in ("x", "y") for _ in range(85)]
    trees = language.fit(spark.createDataFrame(rows, "lang string, text string"))
    pieces = [(lang, text[k : k + 40]) for lang, text in rows for k in (100, 2000)]
    got = language.identify(spark.createDataFrame(pieces, "told string, text string"), trees).collect()
    assert all(r.lang_pred == r.told and r.score > 0.99 for r in got)


def test_language_slices_score_as_the_whole_trees(spark, monkeypatch):
    rnd = random.Random(22)
    rows = [(lang, "".join(rnd.choices(letters, k=60))) for lang, letters in [("a", "abc"), ("b", "bcd"), ("c", "xyzé"), ("d", "ab de")] for _ in range(8)]
    rows += [("e", text) for lang, text in rows if lang == "a"]
    learn = spark.createDataFrame(rows, "lang string, text string")
    texts = [(i, text) for i, (_, text) in enumerate(rows[::3])] + [(1, None), (2, ""), (3, "12"), (4, "abcab"), (4, "abcab"), (5, "Q"), (6, "abc" * 300_000)]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    whole = language.fit(learn)
    assert isinstance(whole, language.Trees)
    monkeypatch.setattr(language, "SLICE_CELLS", 500)
    monkeypatch.setattr(language, "TOGETHER", 2)
    slices = language.fit(learn)
    assert len(slices.groups) == 3 and len(slices.edges) > 3
    want, got = ({(r.doc_id, r.text): r for r in language.identify(docs, t).collect()} for t in (whole, slices))
    assert language.identify(docs, slices).count() == len(texts)
    assert {k: r.lang_pred for k, r in got.items()} == {k: r.lang_pred for k, r in want.items()}
    assert [got[k].score for k in want] == pytest.approx([r.score for r in want.values()], abs=1e-6)
    assert got[4, "abcab"].lang_pred == "a"


def test_chat_of_many_pieces_is_decoded_as_a_whole(spark, monkeypatch):
    rnd = random.Random(23)
    draw = np.random.default_rng(23)
    model = chat.Model(draw.dirichlet([1] * 3), draw.dirichlet([1] * 3, 3), [draw.dirichlet([1] * n, 3) for n in chat.SIZES])

    def said():
        text = rnd.choice([" ", "\n", "\n- "]).join(f"w{rnd.randrange(999)}" for _ in range(rnd.randrange(1, 140)))
        return rnd.choice(["", "", "", "User: ", "Bot: ", "Else: "]) + text + rnd.choice(["", "?"])

    # Repeated, null and far numbers; unmarked rows; a null id.
    rows = [("long", k // 3, 0, said()) for k in range(90)]
    rows += [("none", None, 0, said()) for _ in range(40)]
    rows += [(None, 7, 0, said()) for _ in range(40)]
    rows += [("one", 1000 + k, 0, "Assistant: " + str(k)) for k in range(25)] + [("short", 0, 0, "why?"), ("equal", 1, 0, "same"), *[("equal", 1, 0, "same")] * 30]
    units = spark.createDataFrame(rows, "id string, turn long, part int, text string")

    def found():
        return sorted(map(tuple, chat.recover(units, model).collect()), key=str)

    whole = found()
    monkeypatch.setattr(chat, "PIECE", 4)
    assert found() == whole
    assert sum(r[3] for r in whole) == len(rows)


def test_chat_pieces_give_the_best_score():
    """Also where many ways are equally likely."""
    model = chat.Model(np.array([0.1, 0.6, 0.3]), np.array([[0.1, 0.8, 0.1], [0.0001, 0.1999, 0.8], [0.1, 0.7, 0.2]]), [np.full((3, n), 1 / n) for n in chat.SIZES])
    model.emit[1] = np.log(np.random.default_rng(1).dirichlet([1] * 8, 3))
    for size in (1, 2, 5):
        seen = np.stack([np.random.default_rng(size).integers(0, n, 41) for n in chat.SIZES], axis=1)
        seen[10:30] = seen[10]
        pieces = [seen[k : k + size] for k in range(0, len(seen), size)]
        ends = model.ends([model.between(p) for p in pieces])
        roles = np.concatenate([model.decode(p, *e) for p, e in zip(pieces, ends)])

        def score(roles):
            told = sum(e[roles, seen[:, k]] for k, e in enumerate(model.emit))
            return model.first[roles[0]] + told.sum() + model.follow[roles[:-1], roles[1:]].sum()

        assert score(roles) == pytest.approx(score(model.decode(seen)), abs=1e-9)


def test_chat_turn_goes_on_over_the_256th_number(spark):
    model = chat.fit(spark.createDataFrame([("a", 0, "user", "x")], "id string, turn long, role string, text string"))
    units = spark.createDataFrame([("a", k, 0, f"Bot: {k}") for k in range(300)], "id string, turn long, part int, text string")
    (got,) = chat.recover(units, model).collect()
    assert got.n_parts == 300 and got.content == "\n\n".join(map(str, range(300)))


def test_phone_whose_digits_stand_apart(spark):
    texts = ["+1 (2) (3) (4) (5) (6) (7) (8)", "call +1--2--3--4--5--6--7--8 now", "+1 (2)"]
    found = pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: [tuple(x) for x in r.base_spans] for r in found} == {0: [("phone", 0, 29)], 1: [("phone", 5, 28)], 2: []}
