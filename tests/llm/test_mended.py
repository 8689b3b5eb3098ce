"""Pages whose class names mislead, very long pages, samples that do not fit."""

import time

import numpy as np
import pytest

from tidewatch.llm import chat, html_text, near_dups, toxicity

PROSE = "The ship of the port was in the sea and it is for the people of the town that he had not been at the harbour with all of them. "


@pytest.mark.parametrize(
    "name",
    ["content has-sidebar", "content no-sidebar", "post category-social", "entry ad-free", "article-body search-result", "page-header-offset", "post"],
)
def test_names_of_states_and_topics_keep_the_text(name):
    page = f"<body><div class='{name}'><p>{PROSE * 2}</p><p>{PROSE * 3}</p></div></body>"
    assert html_text.main_text(page) == f"{(PROSE * 2).strip()}\n{(PROSE * 3).strip()}"


@pytest.mark.parametrize("name", ["sidebar", "site-footer", "comment-list", "cookie-banner", "related-posts", "post comments", "social-share"])
def test_names_of_what_is_beside_the_article(name):
    page = f"<body><div class='content'><p>{PROSE * 2}</p></div><div class='{name}'><p>{PROSE * 3}</p></div></body>"
    assert html_text.main_text(page) == (PROSE * 2).strip()


def test_an_article_that_is_but_a_teaser():
    page = f"<body><article><h2>Teaser</h2><p>Short.</p></article><div><p>{PROSE * 2}</p><p>{PROSE * 3}</p></div></body>"
    assert html_text.main_text(page).endswith(f"{(PROSE * 2).strip()}\n{(PROSE * 3).strip()}")


def test_neighbours_by_plain_search():
    """Short blocks take the nearest decided label, by a search from each block."""
    rnd = np.random.default_rng(5)
    for _ in range(60):
        parts = []
        for _ in range(rnd.integers(1, 25)):
            text = [PROSE * 2, "few words", "<a href=x>" + PROSE + "</a>", PROSE[:90], "xylo " * 50][rnd.integers(5)]
            tag = ["p", "h2", "div"][rnd.integers(3)]
            parts.append(f"<{tag}>{text}</{tag}>")
        blocks = html_text.cut_blocks("<body>" + "".join(parts) + "</body>")
        html_text.label_blocks(blocks)
        sure = {}
        for i, b in enumerate(blocks):
            stop = np.mean([w in html_text.STOP_WORDS for w in html_text._WORD.findall(b.text.lower())] or [0])
            if b.links > html_text.LINKS * len(b.text):
                sure[i] = "bad"
            elif b.heading or len(b.text) < html_text.SHORT:
                continue
            elif stop >= html_text.STOP_HIGH and len(b.text) >= html_text.LONG:
                sure[i] = "good"
            elif stop < html_text.STOP_LOW and len(b.text) < html_text.LONG:
                sure[i] = "bad"
        for i, b in enumerate(blocks):
            assert b.label == sure.get(i, b.label)
            near = sorted(sure, key=lambda j: abs(j - i))
            if i not in sure and near and not b.heading and (len(near) == 1 or abs(near[0] - i) < abs(near[1] - i)):
                sides = {s: next((sure[j] for j in near if (j - i) * s > 0), None) for s in (-1, 1)}
                assert b.label == (sure[near[0]] if None not in sides.values() else next(v for v in sides.values() if v))


def test_very_long_pages_take_linear_time():
    for page in ("<div>" * 100_000 + "x", "<span>" * 100_000 + "x", "<p>short one</p>" * 100_000):
        started = time.time()
        html_text.main_text(page)
        assert time.time() - started < 10


def test_a_long_text_does_not_shut_others_out(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "BYTES", 20_000)
    texts = [(i, ("kind words here " if i % 2 else "vile grobnak insult ") * 3 + f"n{i}") for i in range(120)]
    texts += [(1000 + i, "long " * 3500 + str(i)) for i in range(6)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in texts], "doc_id long, label int")
    found = toxicity.score(docs.filter("doc_id < 1000"), toxicity.fit(docs, labels)).collect()
    assert sum((r.score > 0.5) == (r.doc_id % 2 == 0) for r in found) >= 110


def test_one_label_only_scores_zero(spark):
    docs = spark.createDataFrame([(i, f"word{i} other") for i in range(10)], "doc_id long, text string")
    for label in (0, 1):
        labels = spark.createDataFrame([(i, label) for i in range(10)], "doc_id long, label int")
        rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
        assert {(r.score, r.predicted) for r in rows} == {(0.0, 0)}
    none = toxicity.fit(docs.limit(0), spark.createDataFrame([], "doc_id long, label int"))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}


def test_an_id_on_several_texts_loses_only_its_copies(spark):
    copy, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(1, copy, "a"), (2, copy, "b"), (2, other, "c"), (None, copy, "d"), (None, "alone " * 9, "e"), (None, "alone " * 9, "e"), (3, None, "f"), (3, None, "f")]
    rows += [(7, "same words here now and then", "y"), (7, "same words here now and then", "x"), (None, None, "g"), (None, "", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = sorted(near_dups.keep_one(docs).collect(), key=str)
    want = [rows[0], rows[2], rows[4], rows[6], rows[7], rows[9], rows[10], rows[11]]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert near_dups.keep_one(docs).columns == docs.columns and near_dups.keep_one(docs.limit(0)).count() == 0


def test_a_row_with_several_speakers_is_cut(spark):
    text = "User: where is it?\nAssistant: over there, and\n\nnot a new turn\nUser: thanks"
    rows = spark.createDataFrame([("c", 0, text, 5), ("c", 1, None, 5), ("d", 0, "", 5)], "id string, turn long, text string, extra int")
    cut = sorted(map(tuple, chat.speakers(rows).select("id", "turn", "part", "text").collect()), key=str)
    assert [c[2:] for c in cut if c[:2] == ("c", 0)] == [(0, "User: where is it?"), (1, "Assistant: over there, and\n\nnot a new turn"), (2, "User: thanks")]
    assert ("c", 1, 0, None) in cut and ("d", 0, 0, "") in cut
    model = chat.fit(spark.createDataFrame([], "id string, turn long, role string, text string"))
    turns = sorted(chat.recover(chat.speakers(rows.limit(1)), model).collect(), key=lambda r: r.rendered)
    assert sorted((r.role, r.content) for r in turns) == [("assistant", "over there, and\n\nnot a new turn"), ("user", "thanks"), ("user", "where is it?")]


def test_turn_numbers_that_repeat_are_counted_as_pairs(spark):
    rows = [("c", 0, "user", "a")] * 3 + [("c", 1, "assistant", "b")] * 2
    model = chat.fit(spark.createDataFrame(rows, "id string, turn long, role string, text string"))
    assert np.exp(model.follow)[1] == pytest.approx([1 / 9, 1 / 9, 7 / 9])


def test_texts_that_stay_are_not_shuffled(spark, tmp_path):
    """Three copies of each of 20 texts among 400 others: only candidates' texts meet by shuffle."""
    rnd = np.random.default_rng(11)
    rows = [(i, " ".join(f"{w:x}" for w in rnd.integers(1 << 60, 1 << 62, 300))) for i in range(420)]
    rows += [(1000 + i, rows[i % 20][1]) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/docs")
    sc, size = spark.sparkContext, sum(len(t) for _, t in rows)

    def shuffled():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before, threshold = shuffled(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = near_dups.keep_one(spark.read.parquet(f"{tmp_path}/docs")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sorted(map(tuple, left)) == rows[:420]
    assert shuffled() - before < size


@pytest.mark.parametrize("most", [1 << 18, 8])
def test_a_full_filter_still_lets_every_id_pass(spark, most):
    ids = spark.range(0, 3000, 3).withColumnRenamed("id", "doc_id")
    rows = spark.range(6000).withColumnRenamed("id", "doc_id")
    passed = {r.doc_id for r in rows.filter(near_dups._may_be_among(ids, "doc_id", most)).collect()}
    assert passed >= set(range(0, 3000, 3)) and len(passed) < (1200 if most > 8 else 6001)
    assert rows.filter(near_dups._may_be_among(ids.limit(0), "doc_id", most)).count() == 0
