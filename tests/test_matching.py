"""Mentions, patterns, nested attributes and links with several parents."""

import random
import re

from tidewatch.operators import events, mentions, resolve


def test_every_mention_with_its_span(spark):
    rnd = random.Random(1)
    words = ["a", "B", "c", "é", "straße", "x1"]
    names = {f"r{i}": " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 5))) for i in range(60)}
    names |= {"n": None, "e": " - ", "same": names["r1"].upper() + "!", "long": " ".join(["a"] * 30)}
    texts = {i: "".join(rnd.choice(words) + rnd.choice([" ", " ", "-", ". ", "_"]) for _ in range(rnd.randrange(0, 60))) for i in range(40)}
    texts |= {100: None, 101: "", 102: "a " * 40}
    want = set()
    for ref, name in names.items():
        said = re.findall(r"[^\W_]+", (name or "").lower())
        for i, body in texts.items():
            spans = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W_]+", body or "")]
            no = 0
            for k in range(len(spans) - len(said) + 1):
                if said and [s[2] for s in spans[k : k + len(said)]] == said:
                    no += 1
                    want.add((i, ref, " ".join(said), no, spans[k][0], spans[k + len(said) - 1][1]))
    reports = spark.createDataFrame(list(texts.items()), "report_id long, text string")
    listed = spark.createDataFrame(list(names.items()), "ref_id string, name string")
    for size in (1_000_000, 40):
        got = mentions.find_mentions(reports, listed, part_words=size).collect()
        assert set(map(tuple, got)) == want and len(got) == len(want)
    assert mentions.find_mentions(reports, listed.limit(0)).count() == 0


def test_required_literals():
    cases = {
        "^customer#0+7[37]$": "customer#0", "abc?def": "def", "ab(cd|ef)gh": "", "ab(cd)?ghi": "ghi", r"a\.b\dwxyz": "wxyz", r"abc\x41bc": "", r"\pLetter": "", r"port\.of": "port.of",
        "(?i)abc": "", "abc{0,2}de": "ab", "[abc]def[^]x]gh": "def", ".*": "", "x(a(b)c)yz": "yz", "[a[bc]d]efg": "efg", "ab+cde": "cde", "": "",
    }
    for pattern, literal in cases.items():
        assert resolve.required_literal(pattern) == literal, pattern


def test_patterns_equal_all_pairs(spark):
    rnd = random.Random(2)
    names = ["".join(rnd.choice("abcd. ") for _ in range(rnd.randrange(0, 14))) for _ in range(300)] + ["sea star", "north sea star ii"]
    parts = ["abc", "a.c", "[ab]+", "d?", "bcd", "(cd|a)", r"\.", "ab*", "^", "$", "c{2}", "sea star"]
    patterns = [(f"m{i}", "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 4)))) for i in range(120)]
    patterns = [(m, p) for m, p in patterns if "^" not in p[1:] and "$" not in p[:-1]] + [("none", "zzzz")]
    got = resolve.match_patterns(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(patterns, "member_id string, pattern string"))
    want = {(n, m) for n in names for m, p in patterns if re.search(p, n)}
    rows = got.collect()
    assert set(map(tuple, rows)) == want and len(rows) == len(want)


def test_nested_attributes(spark):
    rows = [("e", '{"owner": {"country": "DE", "flags": ["x", {"k": 1}]}, "country": "FR"}'), ("f", "[1, 2]"), ("g", None), ("h", "not json"), ("i", '{"owner": null}')]
    entities = spark.createDataFrame(rows, "entity_id string, attributes string")
    paths = ["$.owner.country", "$.country", "$.owner.flags[0]", "$.owner.flags[1].k", "$[1]", "$.missing.deep.er"]
    got = resolve.attribute_values(entities, spark.createDataFrame([(p,) for p in paths], "attribute_path string"))
    found = {(r.entity_id, r.attribute_path, r.val) for r in got.collect() if r.attribute_path in paths}
    assert found == {("e", paths[0], "DE"), ("e", paths[1], "FR"), ("e", paths[2], "x"), ("e", paths[3], "1"), ("f", paths[4], "2")}


def test_roots_over_several_parents(spark):
    """A diamond, a duplicate that is also a part, two roots, a chain and a cycle."""
    links = [
        (4, 2, "part_of"), (4, 3, "part_of"), (2, 1, "part_of"), (3, 1, "part_of"),
        (5, 1, "duplicate_of"), (5, 1, "part_of"), (6, 1, "part_of"), (6, 10, "part_of"),
        (21, 22, "part_of"), (22, 23, "part_of"), (23, 21, "part_of"), (24, 23, "part_of"),
        (31, 32, "part_of"), (32, 31, "part_of"), (32, 1, "part_of"),
    ]
    links += [(i + 1, i, "part_of") for i in range(100, 140)]
    ids = sorted({i for a, b, _ in links for i in (a, b)})
    got = {(r.event_id, r.root) for r in events.root_events(spark.createDataFrame(links, "from_event long, to_event long, link_type string")).collect()}
    want = {(4, 1), (2, 1), (3, 1), (5, 1), (6, 1), (6, 10), (31, 1), (32, 1)} | {(i, 21) for i in (21, 22, 23, 24)} | {(i, 100) for i in range(101, 141)}
    assert got == want
    rows = spark.createDataFrame([(i, float(i), i) for i in ids], "event_id long, severity double, occurred_us long")
    typed = spark.createDataFrame([(*link, None) for link in links], "from_event long, to_event long, link_type string, strength double")
    rolled = {r.root: (r.children, r.duplicates) for r in events.roll_up_links(rows, typed).collect()}
    assert rolled == {1: (7, 1), 10: (1, 0), 21: (3, 0), 100: (40, 0)}


def test_screening_goes_by_what_holds_at_the_time(spark):
    ents = [(i, f"ship {n}") for i, n in [("a", "alpha one"), ("b", "beta two"), ("c", "gamma three"), ("d", "delta four"), ("e", "epsilon five"), ("f", "zeta six"), ("g", "eta seven")]]
    entities = spark.createDataFrame(ents, "entity_id string, display_name string")
    aliases = spark.createDataFrame(
        [("imo", "1", "a", None, None), ("imo", "2", "b", None, None), ("imo", "1", "c", 0, 50), ("imo", "2", "d", None, None)],
        "id_type string, id_value string, entity_id string, from_us long, to_us long",
    )
    listings = spark.createDataFrame(
        [("1", "nobody", None), ("2", "no one", 90), (None, "ship delta fours", None), (None, "ship eta seven", 100)], "imo string, name string, delisted_us long"
    )
    relations = spark.createDataFrame(
        [("a", "e", 0, 200, None), ("f", "a", 0, 100, None), ("a", "g", 0, 200, 60), ("b", "a", 0, None, None)],
        "from_ref string, to_ref string, from_us long, to_us long, retracted_us long",
    )

    def status(at):
        got = resolve.screen_at(entities, aliases, listings, relations, entities.filter("entity_id < 'g'"), at, 0.7).collect()
        return {r.entity_id: (r.sanction_status, r.matched_on) for r in got}

    # Of the past listing and the running relation or name, what holds now counts.
    assert status(100) == {
        "a": ("listed", "imo"), "b": ("associated", "relation"), "c": ("none", None), "d": ("possible_match", "name"),
        "e": ("associated", "relation"), "f": ("none", None), "g": ("not_checked", None),
    }
    early = status(40)
    assert early["b"] == early["c"] == ("listed", "imo") and early["g"] == ("possible_match", "name")
    assert early["f"] == ("associated", "relation")
