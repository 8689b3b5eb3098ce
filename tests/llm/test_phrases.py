"""Collocations, licence notices and periodic runs, against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from tidewatch.llm import collocations, licences, periodic, queries

SCHEMA = "doc_id long, text string"


# Collocations


def counted(rows, least, best):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang or "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        rows = []
        for phrase, a in counts.items():
            if len(phrase) == 1 or a < least:
                continue
            if any(len(x) == 3 and len(phrase) == 2 and phrase in (x[:2], x[1:]) and c >= least and 100 * c >= 50 * a for x, c in counts.items()):
                continue
            cuts = [(10**6 * a * a // (counts[phrase[:k]] * counts[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(phrase).encode(), counts[phrase[:k]], counts[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("best", [7, 2000])
def test_collocations(spark, clashing, best):
    rnd = random.Random(3)
    words = ["The", "of", "é", "new", "york", "z\x00", "state", "univer"] + [f"w{i}" for i in range(30)]
    rows = []
    for i in range(400):
        text = ""
        for _ in range(rnd.randrange(0, 40)):
            text += rnd.choice(words[:8] if rnd.random() < 0.7 else words) + rnd.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "!?"])
        rows.append((i, text, rnd.choice(["en", "en", "de", None, "und"])))
    rows += [(None, None, "en"), (401, "", None), (402, "...", "xx"), (5, *rows[5][1:]), (403, "new york state " * 3000, "en"), (404, "a a a a " * 20, "fr")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = collocations.mine_phrases(df, best=best)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == counted(rows, 10, best)


def test_collocations_in_small_steps(spark, monkeypatch):
    """Blocks, merges and filters of a few rows give the same counts."""
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["a", "b", "c", f"x{rnd.randrange(50)}"]) for _ in range(60)), "en") for i in range(120)]
    monkeypatch.setattr(collocations, "MERGED_ENTRIES", 5)
    monkeypatch.setattr(collocations, "SLICES", 2)
    monkeypatch.setattr(collocations, "FIRST_SLICES", 3)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    # A filter far too small lets phrases through, and loses none.
    for bits in (1 << 15, 1 << 20):
        assert sorted(map(tuple, collocations.mine_phrases(df, filter_bits=bits).collect())) == counted(rows, 10, 2000)
    assert collocations.mine_phrases(df.limit(0)).count() == 0
    two = collocations.mine_phrases(df, max_words=2, best=None)
    assert two.columns == ["lang", "phrase", "a", "l", "r", "n", "score"] and two.filter("phrase LIKE '% % %'").count() == 0


# Licences


def plain_scan(text, index_rows, slack, percent):
    """Labels and best share, from all pairs of file and template words."""
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    cut = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", s)
    words = cut(lowered)
    known = [(label, cut(re.sub("[A-Z]", lambda m: m[0].lower(), t)), [cut(p) for p in phrases]) for label, t, phrases in index_rows]
    df = Counter(w for _, t, _ in known for w in set(t))
    labels, best = set(), 0.0
    for label, t, phrases in known:
        weight = {j: math.floor(1000 * math.log(len(known) / df[w])) for j, w in enumerate(t) if 4 * df[w] <= len(known)}
        pairs = [(i - j, j) for i, w in enumerate(words) for j in weight if t[j] == w]
        spots = []
        for p in phrases:
            k = next(j for j in range(len(t)) if t[j : j + len(p)] == p)
            spots.append([i - k for i in range(len(words)) if words[i : i + len(p)] == p])
        for o in {o for o, _ in pairs} | {o for s in spots for o in s}:
            covered = sum(weight[j] for j in {j for x, j in pairs if o <= x <= o + slack})
            if covered and 100 * covered >= percent * sum(weight.values()) and all(any(o <= x <= o + slack for x in s) for s in spots):
                labels.add(label)
                best = max(best, covered / sum(weight.values()))
    base = sorted((i, label) for p, label in licences.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    return len(words), base, labels, best


def test_licences(spark, clashing):
    rnd = random.Random(5)
    filler = ["the", "of", "license", "public", "version", "free", "general", "cc", "by", "all", "rights", "Wort", "é", "2"]
    rows = []
    for i in range(150):
        parts = [" ".join(rnd.choice(filler) for _ in range(rnd.randrange(0, 30)))]
        for _ in range(rnd.randrange(0, 3)):
            words = rnd.choice(licences.TEMPLATES)[1].split()
            for _ in range(rnd.randrange(0, 4)):
                at = rnd.randrange(len(words) + 1)
                words[at : at + rnd.randrange(0, 2)] = [rnd.choice(filler)] * rnd.randrange(0, 3)
            parts += [" ".join(words).upper() if rnd.random() < 0.3 else " ".join(words), rnd.choice(filler)]
        rows.append((i, " \n".join(parts)))
    rows += [(None, None), (200, ""), (201, " . "), (5, rows[5][1]), (202, "all rights reserved " * 4000), (203, "general public license")]
    index = licences.build_index(licences.templates(spark))
    got = licences.find_licences(clashing(spark.createDataFrame(rows, SCHEMA)), index).collect()
    key = lambda r: (str(r[0]), r[1] or "")
    for (i, text), row in zip(sorted(rows, key=key), sorted(got, key=lambda r: key((r.doc_id, r.text)))):
        n, base, labels, best = plain_scan(text, licences.TEMPLATES, licences.SLACK, licences.PERCENT)
        assert (row.doc_id, row.n_words) == (i, n)
        assert [(p.start, p.label) for p in row.base_places] == base
        assert {m.label for m in row.matches} == labels
        assert max([m.covered for m in row.matches], default=0.0) == pytest.approx(best)
    assert licences.find_licences(spark.createDataFrame([], SCHEMA), index).count() == 0


def test_licence_notices_in_prose(spark):
    """Whole notices are found where they stand, each time; talk about licences is not."""
    mit, apache = licences.TEMPLATES[0][1], licences.TEMPLATES[3][1]
    rows = [(1, f"one two {mit} three {apache}. {apache}!"), (2, "the license of version two is a public matter and a general copy"), (3, mit.replace("hereby", "not"))]
    index = licences.build_index(licences.templates(spark))
    got = {r.doc_id: [(m.label, m.start) for m in r.matches] for r in licences.find_licences(spark.createDataFrame(rows, SCHEMA), index).collect()}
    n = len(licences.words_of(mit.encode()))
    assert got == {1: [("apache-2.0", n + 3), ("apache-2.0", n + 11), ("mit", 2)], 2: [], 3: []}
    with pytest.raises(ValueError):
        licences.build_index(licences.templates(spark), most_words=10)
    with pytest.raises(ValueError):
        licences.build_index(spark.createDataFrame([("x", "a b c", ["a c"])], licences.templates(spark).schema))
    none = licences.build_index(licences.templates(spark).limit(0))
    assert licences.find_licences(spark.createDataFrame([(1, "all rights reserved")], SCHEMA), none).first().base_places[0].label == "reserved"


# Periodic runs


def plain_runs(ids, least=6, times=4):
    out = []
    for q in range(1, len(ids) // times + 1):
        i = 0
        while i + q < len(ids):
            if ids[i] != ids[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(ids) and ids[j] == ids[j + q]:
                j += 1
            piece = ids[i : j + q]
            if len(piece) >= max(least, times * q) and not any(piece[r:] == piece[:-r] for r in range(1, q)):
                out.append((i, len(piece), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_texts():
    rnd = random.Random(8)
    for k in range(400):
        letters = rnd.choice([1, 2, 3, 6])
        ids = [rnd.randrange(letters) for _ in range(rnd.randrange(0, 60))]
        for _ in range(rnd.randrange(0, 4)):
            unit = [rnd.randrange(letters + 1) for _ in range(rnd.randrange(1, 17))]
            ids += (unit * 8)[: rnd.randrange(3 * len(unit), 8 * len(unit) + 1)] * rnd.choice([1, 1, 2])
            ids += [rnd.randrange(letters) for _ in range(rnd.randrange(0, 4))]
        yield ids
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    yield b
    yield [bin(i).count("1") % 2 for i in range(512)]
    yield [0] * 700


def test_runs_of_sequences():
    for ids in periodic_texts():
        assert [tuple(r) for r in periodic.runs_of(ids).tolist()] == plain_runs(ids)
        # The rules derive what the text has at their places.
        rules, root = periodic.repair(ids)
        for left, whole, places in rules:
            assert 0 < left < whole and len({tuple(ids[p : p + whole]) for p in places}) == 1
        assert root == sorted(root)


def test_runs_in_texts(spark, clashing):
    rows = [(i, " ".join("äbCdefgh"[x] for x in ids).replace(" ", "\n" if i % 3 else "  ")) for i, ids in enumerate(periodic_texts())]
    rows += [(None, None), (1000, ""), (1001, " \t"), (5, rows[5][1]), (1002, "x y " * 50_000)]
    got = periodic.find_runs(clashing(spark.createDataFrame(rows, SCHEMA))).collect()
    key = lambda r: (str(r[0]), r[1] or "")
    for (i, text), row in zip(sorted(rows, key=key), sorted(got, key=lambda r: key((r.doc_id, r.text)))):
        words = (text or "").split()
        runs = [(0, 100_000, 2)] if i == 1002 else plain_runs(words)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        assert [tuple(r) for r in row.runs] == runs and row.n_words == len(words)
        assert row.collapsed == " ".join(w for k, w in enumerate(words) if k not in gone)
    assert periodic.find_runs(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(spark.createDataFrame([], SCHEMA), times=2)


def test_runs_of_words_with_equal_plain_hashes(spark):
    """Words are told apart as bytes, also where polynomial hashes agree."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    text = " ".join([word, other] * 2 + [word] * 2)
    row = periodic.find_runs(spark.createDataFrame([(1, text)], SCHEMA)).first()
    assert row.runs == [] and row.collapsed == text


def test_the_digest_of_runs(spark, tmp_path):
    """The query's ties, nulls and hashes on a table with a null id."""
    rows = [(None, "a a a a a a b b b b b b"), (1, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert tuple(got[None])[1:] == (2, 0, 6, 1, 6000, sha("0,6,1\n6,6,1\n"), sha("a b"))
    assert tuple(got[1])[1:] == (0, None, None, None, None, sha(""), sha(""))
    assert got[1].asDict().keys() == {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"}
