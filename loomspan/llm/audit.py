"""Filter interaction audit: mask counts of each part, a subset-zeta transform, and every order of the filters read off it."""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.plans.lineage import cut, read

#: Filters at most: a part's table has 2**n counts and n! orders of n steps.
MOST_FILTERS = 6
_BLANK = r"[ \t-\r]+"


def text_filters(text: Column) -> dict[str, Column]:
    """Letter to failure condition of filters that see one text: A few words, B repeated words, C capitals, D marks."""
    words = F.split(F.btrim(text, F.lit(" \t\n\v\f\r")), _BLANK)
    words = F.when(text.rlike(r"[^ \t-\r]"), words).otherwise(F.array().cast("array<string>"))
    n = F.size(words)
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * n,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def mask_of(filters: dict[str, Column]) -> Column:
    """Bit k is set if the k-th filter fails."""
    bits = [F.when(c, 1 << k).otherwise(0) for k, c in enumerate(filters.values())]
    return sum(bits[1:], bits[0]).cast("int")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic of each document: filters A to D, and E for a text that a smaller doc_id has as well.

    One shuffle of digests finds the least doc_id of each text. It meets the
    documents by (digest, doc_id), where copies of a text have no key in common,
    so no group of copies is gathered; then labels come by doc_id.

    Nulls: a text is empty, a source the empty part; a null doc_id passes E,
    makes no other fail it and has no labels. Empty texts have no words: they
    fail A, and E after the first. Rows that repeat a doc_id count each, none
    smaller than the other; of repeated labels any 1 holds. Other columns are
    ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    filters = text_filters(F.col("_t"))
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("_t"))
    own = cut(own.select("doc_id", "part", mask_of(filters).alias("mask"), F.unhex(F.sha2("_t", 256)).alias("digest")))
    least = own.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    # An id that is null is smaller than none, and none is smaller than it.
    first = F.col("first").isNotNull() | F.col("doc_id").isNull()
    both = own.join(least, ["digest", "doc_id"], "left").select("doc_id", "part", (F.col("mask") + F.when(first, 0).otherwise(1 << len(filters))).alias("mask"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    return both.join(marks, "doc_id", "left").select("part", "mask", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])


def zeta(counts: Column, n: int) -> Column:
    """Sums over subsets: entry s of the result is the sum of the entries at all subsets of s, by n passes of halves."""
    step = lambda acc, bit: F.transform(F.sequence(F.lit(0), F.lit((1 << n) - 1)), lambda s: F.get(acc, s) + F.when(s.bitwiseAND(bit) != 0, F.get(acc, s - bit)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(n)]), counts, step)


def audit(rows: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """What each filter removes in each order of the filters, for each part.

    ``rows`` has ``part``, ``mask`` (bit k: fails the k-th filter), ``good`` and
    ``toxic`` (0 or 1), a row a document. Returns ``part, filter_order, step,
    kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``: a
    row for each part, order of ``letters`` and step of that order.

    Rows are counted by part and mask, at most 2**n counts a part, combined
    before the shuffle, so a part that holds most rows is no more to one task
    than any other. The subset-zeta transform turns a part's counts into those
    that survive each set of filters: a document survives S if its mask is a
    subset of S's complement. A step of an order goes from a set to one with a
    filter more, so what it removes is the difference of two neighbouring
    subsets; labels go the same way. ``shapley``, the filter's removed summed
    over all orders, needs no order either: neighbours S and S + f are a step of
    |S|! * (n - 1 - |S|)! of them. Orders meet only the finished counts, so n! is
    a factor of the result alone.

    A null part or mask counts as the empty string or 0, a null label as 0. No
    rows give no rows. Other columns are ignored.
    """
    n = len(letters)
    if not 1 <= n <= MOST_FILTERS or len(set(letters)) < n:
        raise ValueError(f"filters are 1 to {MOST_FILTERS} distinct letters")
    size, full = 1 << n, (1 << n) - 1
    cells = rows.groupBy(F.coalesce("part", F.lit("")).alias("part"), F.coalesce("mask", F.lit(0)).alias("mask")).agg(
        F.count("*").alias("n"), *[F.sum(F.coalesce(c, F.lit(0)).cast("long")).alias(c) for c in ("good", "toxic")]
    )
    per = cells.groupBy("part").agg(*[F.map_from_entries(F.collect_list(F.struct("mask", c))).alias(c) for c in ("n", "good", "toxic")])
    dense = lambda c: F.transform(F.sequence(F.lit(0), F.lit(full)), lambda m: F.coalesce(F.try_element_at(c, m), F.lit(0).cast("long")))
    counts = per.select("part", *[dense(F.col(c)).alias(c) for c in ("n", "good", "toxic")])
    # Entry s: what survives all filters outside s.
    live = counts.select("part", F.col("n").alias("exact"), *[zeta(F.col(c), n).alias(c) for c in ("n", "good", "toxic")])
    # What the filter of bit f removes in all orders: sets s of survivors with f in it, weighed by the orders that have this step.
    weight = F.array(*[F.lit(factorial(n - bin(s).count("1")) * factorial(max(bin(s).count("1") - 1, 0))).cast("long") for s in range(size)])
    drop = lambda bit: F.aggregate(
        F.filter(F.sequence(F.lit(0), F.lit(full)), lambda s: s.bitwiseAND(bit) != 0), F.lit(0).cast("long"), lambda acc, s: acc + F.get(weight, s) * (F.get(F.col("n"), s) - F.get(F.col("n"), s - bit))
    )
    live = live.withColumn("worth", F.array(*[drop(F.lit(1 << k)) for k in range(n)]))
    steps = F.from_json(F.lit(json.dumps(_steps(letters))), "array<struct<filter_order: string, step: int, before: int, bit: int>>")
    each = live.select("*", F.inline(steps)).withColumns({"after": F.col("before").bitwiseOR(F.col("bit"))})
    left = lambda c, gone: F.get(F.col(c), F.lit(full).bitwiseXOR(gone))
    removed = lambda c: left(c, F.col("before")) - left(c, F.col("after"))
    fails = left("n", F.lit(0)) - left("n", F.col("bit"))
    return each.select(
        "part",
        "filter_order",
        "step",
        left("n", F.col("after")).alias("kept"),
        removed("n").alias("removed"),
        (fails - removed("n")).alias("redundant"),
        F.get("exact", F.col("bit")).alias("unique_fails"),
        removed("good").alias("good_lost"),
        removed("toxic").alias("toxic_lost"),
        F.get("worth", F.log2("bit").cast("int")).alias("shapley"),
    )


def _steps(letters: str) -> list[dict]:
    """Each step of each order: the set of filters before it and its own bit."""
    out = []
    for order in permutations(letters):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << letters.index(letter)
            out.append({"filter_order": "".join(order), "step": step, "before": before, "bit": bit})
            before |= bit
    return out


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


OP13_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
least AS (SELECT t, min(doc_id) AS low FROM docs GROUP BY t),
flags AS (
  SELECT part,
    len(w) < 50 AS a,
    100 * len(list_distinct(w)) < 65 * len(w) AS b,
    100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(doc_id > low, false) AS e,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good,
    doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic
  FROM docs JOIN least USING (t)),
masks AS (
  SELECT part, (CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END) AS fails,
    count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM flags GROUP BY ALL),
orders(o) AS (
  SELECT '' UNION ALL
  SELECT o || x FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS v(x) WHERE NOT contains(o, x)),
steps AS (SELECT o AS filter_order, s::INTEGER AS step, o[s] AS f, o[:s - 1] AS earlier FROM orders, generate_series(1, 5) AS g(s) WHERE len(o) = 5),
each AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN NOT contains(fails, f) AND translate(fails, earlier, '') = fails THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN contains(fails, f) AND translate(fails, earlier, '') = fails THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN contains(fails, f) AND translate(fails, earlier, '') <> fails THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails = f THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN contains(fails, f) AND translate(fails, earlier, '') = fails THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN contains(fails, f) AND translate(fails, earlier, '') = fails THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM masks, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM each
"""
