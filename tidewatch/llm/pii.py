"""Personal data by weak supervision, with DataFrame and SQL functions only.

Exact rules give the base spans. For every candidate, those that fail a rule and
looser forms as well, four labelers vote yes, no or nothing: the rule itself, a
check of the number, a gazetteer, and the words before it. Expectation-
maximisation over the counted vote patterns of the whole table estimates how far
each labeler can be trusted; its soft labels train a logistic span classifier.
Candidates that the classifier accepts are added to the base spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.7
EM_ROUNDS = 25
FIT_ROUNDS = 200

# The contract's patterns, written so that no input makes Java's matcher go back
# over a run again and again: a match can only begin where a run begins or where
# the match before has ended, and runs give nothing back.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[({] ?(?:at|AT) ?[\])}] ?[A-Za-z0-9-]++(?: ?[\[({] ?(?:dot|DOT) ?[\])}] ?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:.])",
    "card": r"(?<![0-9+.-])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+().-])(?:\([0-9]{2,4}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9A-Za-z])",
}
#: A text without a match of this has no candidate of the kind.
HINT = {"email": "@|(?:at|AT) ?[\\])}]", "ip": "[0-9]\\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]", "card": "[0-9][ -]?[0-9]", "phone": "\\+[0-9]|[0-9][-. ()]?[0-9]"}

# Common top-level domains, and words that go before personal data or before other numbers.
DOMAINS = ["com", "org", "net", "edu", "gov", "info", "io", "eu", "de", "fr", "es", "uk", "ch", "at", "it", "nl", "us"]
FOR = {
    "email": r"mail|contact|write|reach|schreib|kontakt|écri|correo|escrib",
    "ip": r"\bip\b|address|host|server|login|client|adress|direcci",
    "card": r"card|visa|master|amex|credit|pay|karte|carte|tarjeta",
    "phone": r"phone|\btel|call|mobile|cell|fax|whatsapp|dial|anruf|appel|llam",
}
AGAINST = r"version|\bv\b|isbn|issn|order|invoice|\bref|\bpart\b|build|release|section|chapter|§|\bno\b|\bid\b|serial|rechnung|facture|pedido"


def _located(text: Column, pattern: str) -> tuple[Column, Column]:
    """All matches and the pieces between them."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def _length(texts: Column) -> Column:
    return F.aggregate(texts, F.lit(0), lambda total, t: total + F.length(t))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def weight(i):
        digit = F.substr(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(digit > 9, digit - 9).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), lambda s, i: s + F.coalesce(weight(i), F.lit(0))) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    """The rule that a match of the base pattern has to pass."""
    n = F.length(_digits(value))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        bare = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(bare, lambda p: (F.length(p) <= 3) & (p.cast("int") <= 255))
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(_digits(value))).otherwise(False)
    return n.between(8, 15)


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, 1)
    if no is not None:
        out = out.when(no, -1)
    return out.otherwise(0)


def _votes(kind: str, value: Column, rule: Column, exact: bool, before: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "email":
        end = F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)$", 1))
        check = _vote(end.rlike("^[a-z]{2,}$"), ~end.rlike("[a-z]"))
        known = _vote(end.isin(DOMAINS))
    elif kind == "ip":
        small = value.rlike(r"^[0-9](?:\.[0-9]){3}$")
        check = _vote(rule if exact else F.lit(True), F.lit(True))
        known = _vote(value.rlike(r"^(?:10|127|172|192)\."), small | value.rlike(r"^0|\.0[0-9]"))
    elif kind == "card":
        check = _vote(_luhn(_digits(value)), F.lit(True))
        known = _vote(_digits(value).rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), F.lit(True))
    else:
        check = _vote(n.between(8, 15), n < 7)
        known = _vote(_digits(value).rlike("^(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])") & (n >= 10), F.lit(False))
    told = _vote(before.rlike(FOR[kind]), before.rlike(AGAINST))
    first = _vote(rule, ~rule) if exact else F.lit(0)
    return F.array(first, check, known, told)


def _candidates(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``_found``: all candidates with place, votes and features."""
    body = F.coalesce(F.col(text), F.lit(""))
    forms = [(k, exact, (BASE if exact else LOOSE)[k]) for k in KINDS for exact in (True, False)]
    # Stepwise columns: a match list is used several times and must be made once.
    parts = {}
    for i, (kind, exact, pattern) in enumerate(forms):
        hits, pieces = _located(body, pattern)
        possible = body.rlike(HINT[kind])
        parts[f"_h{i}"] = F.when(possible, hits).otherwise(F.array().cast("array<string>"))
        parts[f"_p{i}"] = pieces
    docs = docs.withColumns({k: v for k, v in parts.items() if k[1] == "h"})
    docs = docs.withColumns({f"_p{i}": F.when(F.size(f"_h{i}") > 0, parts[f"_p{i}"]).otherwise(F.array().cast("array<string>")) for i in range(len(forms))})

    def placing(pieces: str, hits: str):
        def place(value, no):
            start = _length(F.slice(F.col(pieces), F.lit(1), no + 1)) + _length(F.slice(F.col(hits), F.lit(1), no))
            return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"))

        return place

    placed = {f"_s{i}": F.transform(f"_h{i}", placing(f"_p{i}", f"_h{i}")) for i in range(len(forms))}
    docs = docs.withColumns(placed)

    def describing(kind: str, exact: bool):
        def describe(s):
            rule = _passes(kind, s["value"]) if exact else F.lit(False)
            before = F.lower(F.substr(body, F.greatest(s["start"] - 31, F.lit(1)), F.least(s["start"], F.lit(32))))
            last = F.substr(body, s["start"], F.lit(1))
            after = F.substr(body, s["end"] + 1, F.lit(1))
            free = F.array(
                F.when((s["start"] == 0) | last.rlike(r"[\s:;,(<\[\"']"), 1).otherwise(0),
                F.when((after == "") | after.rlike(r"[\s:;,.)>\]\"']"), 1).otherwise(0),
                F.when(s["value"].rlike(r"[ ()\[-]"), 1).otherwise(0),
            )
            return F.struct(
                F.lit(kind).alias("kind"),
                s["start"].alias("start"),
                s["end"].alias("end"),
                rule.alias("base"),
                F.concat(_votes(kind, s["value"], rule, exact, before), free).alias("votes"),
            )

        return describe

    described = []
    for i, (kind, exact, _) in enumerate(forms):
        # Numbers too short for a card are no candidates.
        spans = F.col(f"_s{i}")
        if kind == "card":
            spans = F.filter(spans, lambda s: F.length(_digits(s["value"])).between(13, 19))
        described.append(F.transform(spans, describing(kind, exact)))
    return docs.withColumn("_found", F.concat(*described)).drop(*parts, *placed)


def _pattern(span: Column) -> Column:
    return F.concat_ws(":", span["kind"], F.array_join(F.transform(span["votes"], lambda v: v.cast("string")), ","))


def fit(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(pattern, score)``: the trained classifier on every vote pattern.

    Patterns are counted over all rows; there are at most 4 x 3**4 x 2**3 of them,
    so what follows the count is bounded, whatever the size of ``docs``.
    """
    spans = _candidates(docs.select(text), text).select(F.explode("_found").alias("s"))
    counted = spans.groupBy(_pattern(F.col("s")).alias("pattern"), F.col("s.kind").alias("kind"), F.col("s.votes").alias("x")).agg(
        F.count("*").cast("double").alias("n")
    )
    kinds = counted.groupBy("kind").agg(F.collect_list(F.struct("pattern", "n", "x")).alias("p"))
    soft = kinds.withColumn(
        "trust",
        F.expr(f"""
        aggregate(sequence(1, {EM_ROUNDS}), named_struct('prior', 0.5D, 'sure', array(0.9D, 0.8D, 0.7D, 0.7D)), (s, i) ->
          aggregate(array(transform(p, q -> named_struct('n', q.n, 'x', q.x, 'yes', 1 / (1 + exp(-(
              ln(s.prior / (1 - s.prior)) + aggregate(zip_with(slice(q.x, 1, 4), s.sure, (v, a) -> v * ln(a / (1 - a))), 0D, (t, y) -> t + y)))))
          )), s, (old, w) -> named_struct(
            'prior', (1 + aggregate(w, 0D, (t, y) -> t + y.n * y.yes)) / (2 + aggregate(w, 0D, (t, y) -> t + y.n)),
            'sure', transform(sequence(0, 3), j ->
              (8 + aggregate(w, 0D, (t, y) -> t + y.n * CASE y.x[j] WHEN 1 THEN y.yes WHEN -1 THEN 1 - y.yes ELSE 0D END))
              / (10 + aggregate(w, 0D, (t, y) -> t + y.n * abs(y.x[j])))))))"""),
    ).withColumn(
        "p",
        F.expr("""
        transform(p, q -> named_struct('pattern', q.pattern, 'n', q.n, 'x', q.x, 'yes', 1 / (1 + exp(-(
            ln(trust.prior / (1 - trust.prior))
            + aggregate(zip_with(slice(q.x, 1, 4), trust.sure, (v, a) -> v * ln(a / (1 - a))), 0D, (t, y) -> t + y))))))"""),
    )
    total = "aggregate(p, 0D, (t, q) -> t + q.n)"
    raw = "(w[0] + aggregate(zip_with(q.x, slice(w, 2, 7), (v, a) -> v * a), 0D, (t, y) -> t + y))"
    fitted = soft.withColumn("total", F.expr(total)).withColumn(
        "w",
        F.expr(f"""
        aggregate(sequence(1, {FIT_ROUNDS}), array_repeat(0D, 8), (w, i) ->
          aggregate(array(transform(p, q -> named_struct('x', q.x, 'off', q.n * (q.yes - 1 / (1 + exp(-{raw}))) / total))), w, (old, e) ->
            transform(w, (c, j) -> c + 2 * aggregate(e, 0D, (t, y) -> t + y.off * IF(j = 0, 1, y.x[j - 1])))))"""),
    )
    return fitted.select(
        F.explode(F.expr(f"transform(p, q -> named_struct('pattern', q.pattern, 'score', 1 / (1 + exp(-{raw}))))")).alias("r")
    ).select("r.*")


def find_spans(docs: DataFrame, text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``, arrays of ``(kind, start, end)``.

    Places count code points, the end is exclusive. Spans are in the order of
    ``KINDS``, then of their start. ``spans`` holds all base spans and every other
    accepted candidate that meets none of them or of the accepted ones before it.

    The scores of all vote patterns, a few thousand at most, come in as one map.
    A null or empty text has no spans; repeated rows have equal spans; an empty
    table gives no rows. Columns named like the added ones are replaced.
    """
    model = fit(docs, text).agg(F.map_from_entries(F.collect_list(F.struct("pattern", "score"))).alias("m"))
    found = _candidates(docs.drop("base_spans", "spans"), text).withColumn("_scores", model.scalar())
    base = F.filter("_found", lambda s: s["base"])
    fair = F.filter("_found", lambda s: ~s["base"] & (F.coalesce(F.try_element_at(F.col("_scores"), _pattern(s)), F.lit(0.0)) >= accept))
    plain = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    found = found.withColumns({"base_spans": F.transform(base, plain), "_fair": F.transform(fair, plain)})
    more = F.aggregate(
        "_fair",
        F.col("base_spans"),
        lambda have, s: F.when(F.exists(have, lambda h: (h["start"] < s["end"]) & (s["start"] < h["end"])), have).otherwise(
            F.array_append(have, s)
        ),
    )
    rank = F.map_from_arrays(F.array(*[F.lit(k) for k in KINDS]), F.array(*[F.lit(i) for i in range(len(KINDS))]))

    def ordered(spans):
        keyed = F.transform(spans, lambda s: F.struct(F.element_at(rank, s["kind"]).alias("r"), s["start"].alias("start"), s.alias("s")))
        return F.transform(F.array_sort(keyed), lambda k: k["s"])

    return found.withColumn("spans", more).withColumns({"base_spans": ordered(F.col("base_spans")), "spans": ordered(F.col("spans"))}).drop("_found", "_scores", "_fair")


def told(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """``docs`` with each found span replaced by its kind, such as ``<EMAIL>``.

    Spans of several kinds that overlap are replaced together, under the kind of
    the first. Texts without a span, and null texts, stay as they are.
    """
    found = find_spans(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text}`").alias("_text")), "_text", accept)
    in_order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(state, s):
        gap = F.substr(F.col("_text"), state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        apart = s["start"] >= state["at"]
        return F.struct(
            F.when(apart, F.concat(state["done"], gap, F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(state["done"]).alias("done"),
            F.greatest(state["at"], s["end"]).alias("at"),
        )

    end = F.aggregate(in_order, start, step, lambda state: F.concat(state["done"], F.substr(F.col("_text"), state["at"] + 1, F.length("_text"))))
    new = F.when(F.size("spans") > 0, end).otherwise(F.col("_text"))
    return found.select(*[(new if c == text else F.col("_row")[c]).alias(c) for c in docs.columns])
