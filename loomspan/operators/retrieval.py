"""Retrieval: weighted full-text search, hash embeddings, vector search by partitions, query intents."""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loomspan.functions.stemming import Wanted, lexemes, prefix
from loomspan.functions.text import EMBEDDING_SIZE, embedding_terms

# Weights of the fields title, summary and content.
FIELD_WEIGHTS = {"title": 1.0, "summary": 0.4, "content": 0.2}


def index(docs: DataFrame, key: str = "id", fields: dict[str, float] = FIELD_WEIGHTS) -> DataFrame:
    """An inverted index: term, key, field, weight, positions. Positions of a term in a field are one row.

    Positions go on from field to field, in order, as those of one text. Written
    partitioned or sorted by term, it is what ``search_index`` reads.
    """
    kind = dict(docs.dtypes)[key]
    names, weights = list(fields), list(fields.values())

    def run(batches):
        for batch in batches:
            out: list[tuple[int, str, int, list[int]]] = []
            for i, texts in enumerate(zip(*(batch.column(k + 1).to_pylist() for k in range(len(names))), strict=True)):
                found: dict[tuple[int, str], list[int]] = {}
                for pos, field, term in placed_terms(texts):
                    found.setdefault((field, term), []).append(pos)
                out += [(i, term, field, at) for (field, term), at in found.items()]
            rows = pa.array([r[0] for r in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[1] for r in out], pa.string()), batch.column(0).take(rows), pa.array([names[r[2]] for r in out], pa.string()), pa.array([weights[r[2]] for r in out], pa.float64()), pa.array([r[3] for r in out], pa.list_(pa.int32()))],
                ["term", key, "field", "weight", "positions"],
            )

    return docs.select(key, *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in names]).mapInArrow(run, f"term string, {key} {kind}, field string, weight double, positions array<int>")


def placed_terms(texts: tuple[str, ...], wanted: Wanted | None = None) -> list[tuple[int, int, str]]:
    """(position, field, stem) of the lexemes of a document's fields, in order; each field goes on after the last lexeme of those before."""
    out, offset = [], 0
    for field, text in enumerate(texts):
        own, last = wanted.lexemes(text) if wanted is not None else ((every := lexemes(text)), every[-1][0] if every else 0)
        out += [(offset + n, field, term) for n, term in own]
        offset += last
    return out


Condition = tuple[bool, list[tuple[int, str]]]


def parse_query(text: str) -> list[list[Condition]]:
    """Web-style queries as alternatives of conditions (negated, lexemes by place): words and -words, "phrases", or."""
    found: list[list[Condition]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', text.lower()):
        if word == "or" and not minus:
            found.append([])
            continue
        placed = lexemes(phrase or word)
        if placed:
            found[-1].append((bool(minus), placed))
    return [a for a in found if a]


def _terms_of(parsed: list[list[Condition]], negated: bool) -> set[str]:
    return {t for a in parsed for minus, placed in a if minus <= negated for _, t in placed}


def _holds(placed: list[tuple[int, str]], at: dict[str, list[int]]) -> bool:
    """Whether the lexemes stand at their distances somewhere."""
    first, term = placed[0]
    if len(placed) == 1:
        return bool(at.get(term))
    return any(all(p + n - first in at.get(t, ()) for n, t in placed[1:]) for p in at.get(term, ()))


def _accepts(parsed: list[list[Condition]], at: dict[str, list[int]], negations: bool = True) -> bool:
    """Whether an alternative holds; without ``negations`` what is negated counts as held."""
    return any(all((not negations or not _holds(placed, at)) if minus else _holds(placed, at) for minus, placed in a) for a in parsed)


def cover_density(parsed: list[list[Condition]], places: list[tuple[int, float, str]]) -> float:
    """The rank of a document: over its shortest stretches that satisfy the query, words by their weights, less for the words between.

    places: (position, weight, lexeme) of the query's lexemes, in order. Each
    stretch of n lexemes counts n / sum(1 / weight) / (1 + other words inside);
    the next one begins after the first lexeme of the last. Negations don't count.
    """
    total, begin = 0.0, 0
    while begin < len(places):
        at: dict[str, list[int]] = {}
        end = begin
        while end < len(places):
            at.setdefault(places[end][2], []).append(places[end][0])
            if _accepts(parsed, at, False):
                break
            end += 1
        if end == len(places):
            break
        at, low = {}, end
        while True:
            at.setdefault(places[low][2], []).append(places[low][0])
            if _accepts(parsed, at, False):
                break
            low -= 1
        n = end - low + 1
        noise = places[end][0] - places[low][0] - (end - low)
        total += n / sum(1 / w for _, w, _ in places[low : end + 1]) / (1 + max(0, noise))
        begin = low + 1
    return total


def _possible(parsed: list[list[Condition]], fields: list[str]) -> Column:
    """Whether a document can match: of some alternative, words begin as each of its lexemes must. Null fields hold nothing."""
    out = F.lit(False)
    for conditions in parsed:
        one = F.lit(True)
        for minus, placed in conditions:
            for _, t in [] if minus else placed:
                begins = rf"(?iu)(?<![\p{{L}}\p{{N}}_]){re.escape(prefix(t))}"
                one = one & functools.reduce(lambda x, y: x | y, [F.coalesce(F.col(f).cast("string").rlike(begins), F.lit(False)) for f in fields])
        out = out | one
    return out


def match(docs: DataFrame, query: str, key: str = "id", fields: dict[str, float] = FIELD_WEIGHTS) -> DataFrame:
    """Matching documents, all their columns, with ``rank``, their cover density.

    A document matches if all conditions of an alternative hold; a phrase needs
    its words at their distances. One pass over the texts, map-side; for many
    queries, write ``index`` once and use ``search_index``. Null fields are
    empty; a query without lexemes matches nothing.
    """
    parsed = parse_query(query)
    if not parsed:
        return docs.limit(0).withColumn("rank", F.lit(0.0))
    names, weights = list(fields), list(fields.values())
    columns = [c for c in docs.columns if c != "rank"]
    source = docs.where(_possible(parsed, names)).select(*columns, *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"_text_{f}") for f in names])
    stems, positive = _terms_of(parsed, True), _terms_of(parsed, False)

    def run(batches):
        wanted = Wanted(stems)
        for batch in batches:
            ranks = []
            for texts in zip(*(batch.column(len(columns) + k).to_pylist() for k in range(len(names))), strict=True):
                placed = placed_terms(texts, wanted)
                at: dict[str, list[int]] = {}
                for pos, _, term in placed:
                    at.setdefault(term, []).append(pos)
                ranks.append(round(cover_density(parsed, [(p, weights[f], t) for p, f, t in placed if t in positive]), 6) if _accepts(parsed, at) else None)
            kept = pa.array(ranks, pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], kept], [*columns, "rank"]).filter(kept.is_valid())

    schema = StructType([*source.schema.fields[: len(columns)], StructField("rank", DoubleType())])
    return source.mapInArrow(run, schema)


def match_all(docs: DataFrame, queries: list[str], key: str = "id", fields: dict[str, float] = FIELD_WEIGHTS) -> DataFrame:
    """key, ranks: the documents that match any of the queries, with a rank for each that they match, else null. One pass over the texts."""
    parsed = [parse_query(q) for q in queries]
    names, weights = list(fields), list(fields.values())
    stems = set().union(*[_terms_of(p, True) for p in parsed])
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        wanted = Wanted(stems)
        for batch in batches:
            out = []
            for texts in zip(*(batch.column(1 + k).to_pylist() for k in range(len(names))), strict=True):
                placed = placed_terms(texts, wanted)
                at: dict[str, list[int]] = {}
                for pos, _, term in placed:
                    at.setdefault(term, []).append(pos)
                places = [(p, weights[f], t) for p, f, t in placed]
                ranks = [round(cover_density(p, [x for x in places if x[2] in _terms_of(p, False)]), 6) if p and _accepts(p, at) else None for p in parsed]
                out.append(ranks if any(r is not None for r in ranks) else None)
            found = pa.array(out, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], [key, "ranks"]).filter(found.is_valid())

    return docs.select(key, *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in names]).mapInArrow(run, f"{key} {kind}, ranks array<double>")


def search_index(indexed: DataFrame, query: str, key: str = "id") -> DataFrame:
    """key, rank of the documents that match, from an index: only the query's terms are read, a document's rows meet in one shuffle."""
    parsed = parse_query(query)
    kind = indexed.schema[key].dataType.simpleString()
    if not parsed:
        return indexed.limit(0).select(key, F.lit(0.0).alias("rank"))
    positive = _terms_of(parsed, False)
    rows = indexed.where(F.col("term").isin(*sorted(_terms_of(parsed, True)))).groupBy(key).agg(F.collect_list(F.struct("term", "weight", "positions")).alias("_rows"))

    def run(batches):
        for batch in batches:
            ranks = []
            for listed in batch.column(1).to_pylist():
                places = sorted((p, r["weight"], r["term"]) for r in listed for p in r["positions"])
                at: dict[str, list[int]] = {}
                for p, _, t in places:
                    at.setdefault(t, []).append(p)
                ranks.append(round(cover_density(parsed, [x for x in places if x[2] in positive]), 6) if _accepts(parsed, at) else None)
            kept = pa.array(ranks, pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), kept], [key, "rank"]).filter(kept.is_valid())

    return rows.select(key, "_rows").mapInArrow(run, f"{key} {kind}, rank double")


def hash_embedding(df: DataFrame, key: str, text: str, size: int = EMBEDDING_SIZE) -> DataFrame:
    """Sparse, L2-normalised hash embeddings: key, dim, value."""
    each = df.select(F.col(key), F.explode(embedding_terms(F.col(text), size)).alias("t")).groupBy(key, F.col("t.dim").alias("dim")).agg(F.sum("t.sign").alias("v")).where("v <> 0")
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))
    return each.select(key, "dim", (F.col("v") / norm).alias("value"))


def dense(embedding: DataFrame, key: str, size: int = EMBEDDING_SIZE) -> DataFrame:
    """Sparse rows as one array of floats a key."""
    entries = F.map_from_entries(F.collect_list(F.struct("dim", "value")))
    whole = embedding.groupBy(key).agg(entries.alias("m"))
    return whole.select(key, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("int")), F.lit(0.0)).cast("float")).alias("embedding"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "id", vector: str = "embedding") -> DataFrame:
    """The k nearest by cosine, exact, with similarity and distance. Each task keeps k rows; k of each reach the last."""
    q = F.array(*[F.lit(float(x)) for x in query])
    similarity = F.greatest(F.lit(0.0), F.coalesce(cosine(F.col(vector), q), F.lit(0.0)))
    scored = vectors.withColumn("similarity", F.round(similarity, 9)).withColumn("distance", 1.0 - F.col("similarity"))
    return scored.orderBy(F.desc("similarity"), key).limit(k)


def nearest_typed(vectors: DataFrame, query: list[float], k: int, types: list, key: str = "id", kind: str = "collection", vector: str = "embedding") -> DataFrame:
    """The k nearest of each asked partition, merged by distance, k in all. A partition that doesn't exist gives none."""
    part = vectors.where(F.col(kind).isin(*types)) if types else vectors
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = part.withColumn("similarity", F.round(F.greatest(F.lit(0.0), F.coalesce(cosine(F.col(vector), q), F.lit(0.0))), 9)).withColumn("distance", 1.0 - F.col("similarity"))
    w = Window.partitionBy(kind).orderBy(F.desc("similarity"), key)
    return scored.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n").orderBy(F.desc("similarity"), key).limit(k)


def packed(rows: DataFrame, key: str, vector: str, block: str) -> DataFrame:
    """block, keys, matrix: up to 4096 unit vectors a row, map-side."""
    kind = dict(rows.dtypes)[key]

    def run(batches):
        for batch in batches:
            of = batch.column(2).to_numpy()
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            for k in np.unique(of):
                own = np.flatnonzero(of == k)
                for i in range(0, len(own), 4096):
                    part = own[i : i + 4096]
                    keys = batch.column(0).take(pa.array(part))
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), keys), pa.array([x[part].tobytes()], pa.binary())], ["block", "keys", "matrix"])

    return rows.select(key, vector, F.col(block).cast("int")).mapInArrow(run, f"block int, keys array<{kind}>, matrix binary")


def batch_nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "id", query_key: str = "query_id", vector: str = "embedding", block: int = 1024) -> DataFrame:
    """The k nearest vectors of each query, exact: query_key, key, similarity; ties by key.

    Queries, a stated set, are dealt into blocks of about ``block`` and packed as
    matrices, vectors likewise map-side. Each packed row of vectors meets each
    block in an equi-join on the block's number, which the planner broadcasts if
    the queries are few, and leaves k rows a query. Nothing reaches the driver but
    the number of queries. Null vectors and keys take no part.
    """
    known = queries.where(F.col(query_key).isNotNull() & F.col(vector).isNotNull())
    blocks = max(1, -(-known.count() // block))
    asked = packed(known.withColumn("_b", F.pmod(F.xxhash64(query_key), F.lit(blocks))).repartition("_b"), query_key, vector, "_b").withColumnsRenamed({"keys": "asked", "matrix": "q"})
    held = packed(vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).withColumn("_b", F.lit(0)), key, vector, "_b")
    pairs = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(asked, "block").select("keys", "matrix", "asked", "q")
    return top_of_blocks(pairs, k, key, query_key, (dict(vectors.dtypes)[key], dict(queries.dtypes)[query_key]))


def top_of_blocks(pairs: DataFrame, k: int, key: str, query_key: str, kinds: tuple[str, str]) -> DataFrame:
    """The k nearest of each query over packed rows of vectors (keys, matrix), each with a packed row of queries (asked, q)."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                keys, names = batch.column(0)[r].values, batch.column(2)[r].values
                x, q = (np.frombuffer(batch.column(c)[r].as_buffer(), np.float64).reshape(n, -1) for c, n in ((1, len(keys)), (3, len(names))))
                s = np.round(np.maximum(0, x @ q.T), 9)
                # Equal similarities by key, as in the end: sorted by key first, then stably.
                order = np.argsort(keys.to_numpy(zero_copy_only=False), kind="stable")
                top = order[np.argsort(-s[order], axis=0, kind="stable")[:k]]
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(np.repeat(np.arange(len(names)), len(top)))), keys.take(pa.array(top.T.reshape(-1))), pa.array(np.take_along_axis(s, top, 0).T.reshape(-1))], [query_key, key, "similarity"]
                )

    found = pairs.mapInArrow(run, f"{query_key} {kinds[1]}, {key} {kinds[0]}, similarity double")
    w = Window.partitionBy(query_key).orderBy(F.desc("similarity"), key)
    return found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def quantise(vector: Column, bits: int = 4) -> Column:
    """Components as whole numbers of 2 to 4 bits between -1 and 1."""
    if not 2 <= bits <= 4:
        raise ValueError("2 to 4 bits")
    top = (1 << bits) - 1
    return F.transform(vector, lambda x: F.round((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double"))) + 1) / 2 * top).cast("tinyint"))


def nearest_quantised(vectors: DataFrame, query: list[float], k: int, bits: int = 4, key: str = "id", vector: str = "embedding") -> DataFrame:
    """The k nearest by the cosine of quantised components, taken back to -1 to 1."""
    top = (1 << bits) - 1
    back = lambda x: F.transform(x, lambda c: c / F.lit(top / 2) - 1)
    q = quantise(F.array(*[F.lit(float(x)) for x in query]), bits)
    similarity = F.greatest(F.lit(0.0), F.coalesce(cosine(back(quantise(F.col(vector), bits)), back(q)), F.lit(0.0)))
    return vectors.withColumn("similarity", F.round(similarity, 9)).withColumn("distance", 1.0 - F.col("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def collection_name(kind: Column) -> Column:
    """A partition's name of a type: lower case with _ for each character that is unsafe, short names of two types, all for none."""
    name = F.regexp_replace(F.translate(F.coalesce(kind, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9_]", "_")
    return F.when(name == "", "all").when(name == "implementation_detail", "impl_detail").when(name == "open_question", "open_q").otherwise(name)


def safe_component(x: str) -> str:
    """A name part in lower case with _ for unsafe characters; a changed one ends in the first bytes of its SHA-256."""
    plain = x.strip().translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    bare = re.sub("[^a-z0-9_-]", "_", plain).strip("_") or "value"
    return bare if bare == plain else f"{bare}_{hashlib.sha256(x.encode()).hexdigest()[:8]}"


def scope_suffix(project: str | None = None, user: str | None = None, namespace: str | None = None) -> str:
    """project_, user_ and namespace_ of those that are given, ids without dashes; global without any."""
    short = lambda x: x.replace("-", "").lower() if re.fullmatch("[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", x) else safe_component(x)
    parts = [f"{k}_{short(v)}" for k, v in (("project", project), ("user", user)) if v] + ([f"namespace_{safe_component(namespace)}"] if namespace else [])
    return "_".join(parts) or "global"


def fan_out(items: DataFrame, scope: str = "") -> DataFrame:
    """Each item in the partitions all, its type, the scope's all, and scope and type."""
    kind = collection_name(F.col("memory_type"))
    parts = [F.lit("all"), kind] + ([F.lit(f"{scope}_all"), F.concat(F.lit(f"{scope}_"), kind)] if scope else [])
    return items.withColumn("collection", F.explode(F.array_distinct(F.array(*parts))))


# Cues of an objective's intent, and of continuation.
MEMORY_CUES = ("continue", "continuation", "previous", "prior", "last session", "what did we decide", "open task", "open loop", "recent decision")
HISTORY_CUES = ("session history", "debugging history", "what happened in prior sessions", "past sessions", "session graph")
REPOSITORY_CUES = ("codebase", "repository", "repo", "file", "symbol", "module", "import", "architecture", "api", "doc", "section", "heading", "class", "function", "struct")
REWRITE_CUES = ("rewrite", "rephrase", "summarize", "translate", "format", "fix grammar", "clean up wording")
CONTINUATION = (
    "continue", "continuation", "resume", "pick up where", "where we left off", "what were we", "what was i", "prior work", "previous session", "last session", "open task",
    "open loop", "unfinished", "follow up", "what's next", "what is next", "next step",
)


def intent_of(objective: str, has_files: bool = False) -> str:
    """none, memory_only, repository_only, session_graph_only or hybrid, by the objective's cues and whether files are named."""
    low = objective.lower()
    mem, past, repo, only = (any(c in low for c in cues) for cues in (MEMORY_CUES, HISTORY_CUES, REPOSITORY_CUES, REWRITE_CUES))
    repo = repo or has_files
    if past and not repo and not mem:
        return "session_graph_only"
    if repo:
        return "hybrid" if mem else "repository_only"
    if mem:
        return "memory_only"
    return "none" if only and not past else "hybrid"


def is_continuation(query: str) -> bool:
    low = query.lower()
    return any(c in low for c in CONTINUATION)


def goal_share(goals: Column, text: Column) -> Column:
    """The share of goals that a text holds."""
    return F.when(F.size(goals) > 0, F.size(F.filter(goals, lambda g: text.contains(g))) / F.size(goals)).otherwise(0.0)


def bag_cosine(left: DataFrame, right: DataFrame, key: str, text: str) -> DataFrame:
    """key, cosine, overlap: bag-of-words cosine and distinct shared tokens of two texts of one key."""
    words = lambda df: df.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), F.lit(1))).alias("w")).groupBy(key, "w").agg(F.count("*").alias("n"))
    a, b = words(left), words(right)
    dots = a.join(b.withColumnRenamed("n", "m"), [key, "w"]).groupBy(key).agg(F.sum(F.col("n") * F.col("m")).alias("dot"), F.count("*").alias("overlap"))
    norm = lambda df, name: df.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias(name))
    both = norm(a, "_x").join(norm(b, "_y"), key, "full").join(dots, key, "left")
    cosine_ = F.when(F.col("_x") * F.col("_y") > 0, F.col("dot") / (F.col("_x") * F.col("_y")))
    return both.select(key, F.round(F.coalesce(cosine_, F.lit(0.0)), 6).alias("cosine"), F.coalesce("overlap", F.lit(0)).alias("overlap"))
