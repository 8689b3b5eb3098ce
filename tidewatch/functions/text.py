"""Tokens, shingles, hashes and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track where a reader came from.
TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "fbclid", "gclid"]

# Languages with their own full-text configuration.
TEXT_CONFIG = {
    "de": "german",
    "en": "english",
    "fr": "french",
    "es": "spanish",
    "it": "italian",
    "pt": "portuguese",
    "nl": "dutch",
    "ru": "russian",
    "sv": "swedish",
    "no": "norwegian",
    "da": "danish",
    "fi": "finnish",
    "tr": "turkish",
}


def text_config(lang: Column) -> Column:
    two = F.lower(F.substring(lang, 1, 2))
    entries = ", ".join(f"{k!r}, {v!r}" for k, v in TEXT_CONFIG.items())
    return F.coalesce(F.try_element_at(F.expr(f"map({entries})"), two), F.lit("simple"))


def tokens(text: Column) -> Column:
    """Lower-case words: runs of letters and digits."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " ")
    return F.filter(words, lambda w: w != "")


def normalized_text(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def shingles(text: Column, n: int) -> Column:
    """Distinct runs of ``n`` words; a shorter text is one shingle."""
    return shingles_of(tokens(text), n)


def shingles_of(words: Column, n: int) -> Column:
    runs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (n - 1))),
        lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "),
    )
    return F.array_distinct(F.filter(runs, lambda s: s != ""))


def trigrams(name: Column) -> Column:
    """Padded three-letter grams of each word, as trigram indexes cut them."""
    words = F.transform(tokens(name), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(
        words,
        lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))
        ),
    )
    return F.array_distinct(F.flatten(grams))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, no tracking parameters."""
    plain = F.regexp_replace(url, "#.*$", "")
    head = F.lower(F.regexp_extract(plain, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    path = F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1)
    query = F.regexp_extract(plain, r"\?(.*)$", 1)
    kept = F.filter(
        F.split(query, "&"),
        lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING_PARAMS),
    )
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(head == "", plain).otherwise(F.concat(head, path, tail))


def hash60(value: Column) -> Column:
    """Non-negative 60-bit hash, reproducible outside Spark (MD5 prefix)."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("long")
