"""Text expressions: truncation, canonical forms, tokens, hashes and hash embeddings, all on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMBEDDING_SIZE = 1536

# Words that carry no similarity between memories.
SIMILARITY_STOPWORDS = (
    "also", "and", "about", "after", "agent", "agents", "around", "before", "build", "change", "changes", "code",
    "details", "debug", "debugging", "during", "error", "errors", "file", "files", "fix", "fixed", "from", "into",
    "issue", "issues", "memory", "need", "needs", "now", "output", "project", "request", "review", "reviewed",
    "reviewing", "session", "summary", "that", "the", "then", "this", "test", "tests", "update", "updated", "using",
    "with", "work",
)
# Words that are no sub-goal.
GOAL_STOPWORDS = (
    "the", "and", "for", "with", "from", "that", "this", "what", "which", "who", "how", "why", "was", "were", "has",
    "have", "had", "are", "can", "all", "any", "but", "not", "our", "your", "his", "her", "its", "ours",
)


def clip(x: Column, n: int, ending: str = "") -> Column:
    """The first n characters; a longer text gets the ending after them."""
    short = F.left(x, F.lit(n))
    return short if not ending else F.when(F.length(x) > n, F.concat(short, F.lit(ending))).otherwise(x)


def canonical(x: Column) -> Column:
    """Lower case with everything but a-z and _ as single blanks."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z_]+", " "))


def claim_text(x: Column) -> Column:
    """The first ten tokens of three characters or more, joined by _."""
    tokens = F.regexp_extract_all(F.lower(x), F.lit("([a-z0-9_]+)"), F.lit(1))
    return F.array_join(F.slice(F.filter(tokens, lambda t: F.length(t) >= 3), 1, 10), "_")


def word_tokens(x: Column) -> Column:
    """Distinct tokens of three characters or more. \u0130 becomes a plain i, as in SQL; ``lower`` adds a dot to it that would end the token."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.replace(x, F.lit("\u0130"), F.lit("i"))), F.lit("([a-z0-9_]{3,})"), F.lit(1)))


def similarity_tokens(x: Column) -> Column:
    """Distinct tokens that count for the similarity of two memories."""
    return F.array_except(word_tokens(x), F.array(*map(F.lit, SIMILARITY_STOPWORDS)))


def distinctive(tokens: Column) -> Column:
    """How many tokens have six characters or more, or a digit."""
    return F.size(F.filter(tokens, lambda t: (F.length(t) >= 6) | t.rlike("[0-9]")))


def sub_goals(x: Column) -> Column:
    """Distinct query tokens of three characters or more, in order, without stop words."""
    found = F.regexp_extract_all(F.lower(x), F.lit("([a-z0-9_./:+-]+)"), F.lit(1))
    return F.array_except(F.array_distinct(F.filter(found, lambda t: F.length(t) >= 3)), F.array(*map(F.lit, GOAL_STOPWORDS)))


def error_signature(x: Column, blank: str = " ", size: int = 160) -> Column:
    """Lower case without hexadecimal runs of seven or more, blanks collapsed, cut."""
    bare = F.regexp_replace(F.lower(x), "[0-9a-f]{7,}", "")
    return F.left(F.trim(F.regexp_replace(bare, r"\s+", blank)), F.lit(size))


def fnv1a(x: Column) -> Column:
    """FNV-1a of the UTF-8 bytes, 32 bits, as a long."""
    pairs = F.regexp_extract_all(F.hex(x.cast("binary")), F.lit("(..)"), F.lit(1))
    step = lambda h, b: (h.bitwiseXOR(F.conv(b, 16, 10).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(pairs, F.lit(2166136261).cast("long"), step)


def embedding_terms(x: Column, size: int = EMBEDDING_SIZE) -> Column:
    """Each token as (dim, sign): the hash picks a dimension, its top bit the sign."""
    tokens = F.regexp_extract_all(F.lower(x), F.lit("([a-z0-9_]+)"), F.lit(1))

    def place(t: Column) -> Column:
        h = fnv1a(t)
        return F.struct((h % size).cast("int").alias("dim"), F.when(F.shiftright(h, 31) == 1, -1.0).otherwise(1.0).alias("sign"))

    return F.transform(tokens, place)


def estimate_tokens(x: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.octet_length(x) / 4).cast("int"))


def stable_id(x: Column, size: int = 32) -> Column:
    return F.left(F.sha2(x, 256), F.lit(size))


def capitalised(x: Column) -> Column:
    return F.concat(F.upper(F.left(x, F.lit(1))), F.substring(x, 2, 1 << 20))


def contains_any(x: Column, words: tuple[str, ...] | list[str]) -> Column:
    """Whether any of the words occurs, as one alternation over literal text."""
    import re

    return x.rlike("|".join(re.escape(w).replace("\\ ", " ") for w in words))


def basename(x: Column) -> Column:
    return F.element_at(F.split(x, "/"), -1)


def extension(x: Column) -> Column:
    return F.lower(F.regexp_extract(basename(x), r"\.([^.]+)$", 1))


def line_number(text: Column, offset: Column) -> Column:
    """The 1-based line of a 0-based character offset."""
    return F.size(F.split(F.left(text, offset), "\n", -1))


def clean_nul(x: Column, most: int = 200_000) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(x, "\\x00", ""), r"\\u0000", ""), F.lit(most))


def xml_text(x: Column) -> Column:
    """Tags dropped and the five entities decoded."""
    out = F.regexp_replace(x, "<[^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def instant(x: Column, default: Column) -> Column:
    """An RFC 3339 time, or the default where it can't be read."""
    return F.coalesce(F.try_to_timestamp(x), default)


def age_days(at: Column, now: Column) -> Column:
    return F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(at)) / F.lit(86400.0)


def clamp01(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def normal_path(x: Column) -> Column:
    """A relative path with / between parts, and . and .. resolved."""
    parts = F.filter(F.split(F.replace(x, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    done = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda s, p: F.when(p == "..", F.slice(s, 1, F.greatest(F.lit(0), F.size(s) - 1))).otherwise(F.array_append(s, p)),
    )
    return F.array_join(done, "/")
