"""Property graphs: extraction from events and memories, merging, statistics, communities' figures."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loomspan.functions.text import basename, capitalised, contains_any, distinctive, error_signature, similarity_tokens
from loomspan.llm.kernel import mapped
from loomspan.operators.events import event_text
from loomspan.operators.overlap import Index
from loomspan.plans.lineage import cut
from loomspan.schemas import EVIDENCE_RANK, lookup

NODE_COLUMNS = ("id", "label", "node_type", "source_type", "source_id")
EDGE_COLUMNS = ("source", "target", "relation", "evidence", "weight")
# Fixed values.
MEMORY_NODE_TYPES = {"risk": "error"}
PERSISTED_RELATIONS = ("caused_by", "depends_on", "supersedes", "contradicts", "confirms", "derived_from", "related_to", "from_same_session")
NOISY_PARTS = ("node_modules/", "dist/", "build/", ".next/", "coverage/", "target/", "vendor/")


def evidence_rank(x: Column) -> Column:
    return lookup(x, EVIDENCE_RANK, 0)


def command_label(x: Column) -> Column:
    words = F.filter(F.split(F.trim(x), r"\s+"), lambda w: w != "")
    return F.left(F.lower(F.array_join(F.slice(words, 1, 3), " ")), F.lit(60))


def graph_error_signature(x: Column) -> Column:
    return error_signature(x, "_", 80)


def _edge(df: DataFrame, source: Column, target: Column, relation: Column | str, weight: float = 1.0, evidence: str = "extracted") -> DataFrame:
    r = F.lit(relation) if isinstance(relation, str) else relation
    return df.select(source.alias("source"), target.alias("target"), r.alias("relation"), F.lit(evidence).alias("evidence"), F.lit(weight).alias("weight"), F.col("created_at"), F.col("ordinal"))


def structural_graph(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of files, tests, tools, commands and errors of sessions' events.

    File changes and test results give their own nodes only; every other event
    may give a tool, a command and an error at once. Nodes keep the first event
    that names them.
    """
    session = F.concat(F.lit("session:"), F.col("session_id"))
    text = event_text()
    file, tool = F.concat(F.lit("file:"), F.col("file_path")), F.concat(F.lit("tool:"), F.col("tool_name"))
    command, error = F.concat(F.lit("cmd:"), command_label(F.col("command"))), F.concat(F.lit("error:"), graph_error_signature(text))
    test = F.concat(F.lit("test:"), F.col("event_id"))
    changes = events.where("event_type = 'file_change' and file_path is not null")
    tests = events.where("event_type = 'test_result'")
    rest = events.where("event_type not in ('file_change', 'test_result')")
    tools, commands, errors = rest.where("tool_name is not null"), rest.where("command is not null"), rest.where("event_type = 'error'")

    def nodes(df: DataFrame, id_: Column, label: Column, kind: str) -> DataFrame:
        return df.select(id_.alias("id"), label.alias("label"), F.lit(kind).alias("node_type"), F.lit("session_event").alias("source_type"), F.col("event_id").alias("source_id"), "created_at", "ordinal")

    found = (
        nodes(changes, file, basename(F.col("file_path")), "file")
        .union(nodes(tests, test, F.coalesce("tool_name", F.concat(F.lit("Test "), F.left("event_id", F.lit(8)))), "test"))
        .union(nodes(tools, tool, F.col("tool_name"), "tool"))
        .union(nodes(commands, command, command_label(F.col("command")), "command"))
        .union(nodes(errors, error, F.left(text, F.lit(80)), "error"))
    )
    edges = (
        _edge(changes, session, file, "modifies")
        .union(_edge(changes, file, session, "touched_by"))
        .union(_edge(tests, session, test, "produces"))
        .union(_edge(tools, session, tool, F.when(F.col("event_type") == "tool_call", "calls").otherwise("produces")))
        .union(_edge(tools.where("file_path is not null"), tool, file, "modifies"))
        .union(_edge(commands, session, command, "calls"))
        .union(_edge(errors, error, session, "caused_by"))
        .union(_edge(errors.where("file_path is not null"), error, file, "references"))
    )
    return first_nodes(found, ("created_at", "ordinal")).select(*NODE_COLUMNS), edges.select(*EDGE_COLUMNS)


def co_occurrence(events: DataFrame, key: str = "session_id", item: str = "file_path", order: tuple[str, ...] = ("created_at", "ordinal")) -> DataFrame:
    """Pairs of items of one session, the one seen first as source.

    Items are made distinct first, and positions are ranks of first sights, so
    the pairs are those of distinct items of a session only.
    """
    seen = events.where(F.col(item).isNotNull()).groupBy(key, item).agg(F.min(F.struct(*order)).alias("at"))
    ranked = seen.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy("at", item)))
    a, b = ranked.select(key, F.col(item).alias("source"), F.col("pos").alias("a")), ranked.select(key, F.col(item).alias("target"), F.col("pos").alias("b"))
    return a.join(b, key).where("a < b").select(key, "source", "target")


def episode_graph(episodes: DataFrame, key: str = "session_id") -> tuple[DataFrame, DataFrame]:
    """Episode nodes; contains, sequential related_to (0.9), and caused_by where work and debugging alternate."""
    session, own = F.concat(F.lit("session:"), F.col(key)), lambda e: F.concat(F.lit("episode:"), F.col(key), F.lit(":"), e.cast("string"))
    nodes = episodes.select(own(F.col("episode")).alias("id"), F.col("title").alias("label"), F.lit("episode").alias("node_type"), F.lit("episode").alias("source_type"), F.col(key).alias("source_id"))
    w = Window.partitionBy(key).orderBy("episode")
    after = episodes.withColumns({"next": F.lead("episode").over(w), "next_type": F.lead("episode_type").over(w)}).where("next is not null")
    edge = lambda df, a, b, r, wt, ev: df.select(a.alias("source"), b.alias("target"), F.lit(r).alias("relation"), F.lit(ev).alias("evidence"), F.lit(wt).alias("weight"))
    turns = after.where("(episode_type = 'implementation' and next_type = 'debugging') or (episode_type = 'debugging' and next_type = 'implementation')")
    edges = (
        edge(episodes, session, own(F.col("episode")), "contains", 1.0, "extracted")
        .union(edge(after, own(F.col("episode")), own(F.col("next")), "related_to", 0.9, "extracted"))
        .union(edge(turns, own(F.col("next")), own(F.col("episode")), "caused_by", 0.7, "inferred"))
    )
    return nodes, edges


def memory_graph(memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memory nodes, and produces edges from their sessions. memories: memory_id, session_id, memory_type, title."""
    id_ = F.concat(F.lit("memory:"), F.col("memory_id").cast("string"))
    kind = lookup(F.col("memory_type"), MEMORY_NODE_TYPES, None)
    nodes = memories.select(id_.alias("id"), F.col("title").alias("label"), F.coalesce(kind, "memory_type").alias("node_type"), F.lit("memory").alias("source_type"), F.col("memory_id").cast("string").alias("source_id"))
    linked = memories.where("session_id is not null")
    edges = linked.select(F.concat(F.lit("session:"), F.col("session_id")).alias("source"), id_.alias("target"), F.lit("produces").alias("relation"), F.lit("extracted").alias("evidence"), F.lit(1.0).alias("weight"))
    return nodes, edges


#: Targets of an episode that go together as one row.
TOGETHER = 4096
#: Parts that an episode's summaries are dealt to, each of which meets all of its targets.
DEALT = 8


def companion_edges(memories: DataFrame) -> DataFrame:
    """related_to (0.92) between a summary and the bugs and implementation details of its episode.

    All of both meet, so an episode gives as many edges as the product of the
    two. Targets are gathered to arrays of at most TOGETHER, which a summary
    meets and then takes apart row by row, and an episode's summaries are dealt
    to DEALT parts, so neither a task nor a row holds an episode's edges.
    """
    m = memories.where("session_id is not null and episode is not null")
    name = F.concat(F.lit("memory:"), F.col("memory_id").cast("string"))
    left = m.where("memory_type = 'summary'").select("session_id", "episode", name.alias("source"), F.pmod(F.xxhash64("memory_id"), F.lit(DEALT)).cast("int").alias("_part"))
    right = m.where("memory_type in ('bug', 'implementation_detail')").select("session_id", "episode", name.alias("target"), F.monotonically_increasing_id().alias("_row"))
    many = right.groupBy("session_id", "episode", F.floor(F.col("_row") / TOGETHER).alias("_row")).agg(F.collect_list("target").alias("_targets"))
    many = many.select("session_id", "episode", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("_part"), "_targets")
    return left.join(many, ["session_id", "episode", "_part"]).select("source", F.explode("_targets").alias("target")).select(
        "source", "target", F.lit("related_to").alias("relation"), F.lit("inferred").alias("evidence"), F.lit(0.92).alias("weight")
    )


#: Tokens of the sets that one task holds at once; a block with more is taken apart.
PART = 1 << 23
#: Tokens from which on the sets of small blocks are not held together.
FEW = 1 << 20


def similar_pairs(items: DataFrame, id_: str, tokens: str, block: list[str], least: float = 0.5, shared: int = 4) -> DataFrame:
    """Pairs of a block whose token sets have Jaccard similarity ``least`` and ``shared`` tokens in common, or more.

    Each row is a set of its own, whatever its id. Sets go as 64-bit hashes to
    the tasks that hold their block, and pairs are found and counted there
    (``overlap.Index``), so sets that meet are never rows. A block of more than
    PART tokens is taken apart by the sets' sizes, and sets of one size by hash.
    A set is held in one part and goes also to those parts whose sets may be
    close and are smaller, or come before it. Only the bounds of such parts are
    broadcast, some 40 bytes for each PART tokens of the corpus at most.
    """
    known = [F.col(c).isNotNull() for c in [*block, id_]]
    # A token's hash holds its block, so blocks that are held together don't meet.
    hashes = F.transform(F.array_distinct(tokens), lambda w: F.xxhash64(w, *block))
    # As what a generator makes, they are made once a row, however often they are asked for.
    hashed = items.where(reduce(and_, known)).select(*block, F.col(id_).alias("_id"), F.explode(F.array(hashes)).alias("_w"))
    sets = hashed.where(F.size("_w") >= shared)
    sizes = sets.groupBy(*block, F.size("_w").alias("_n")).agg(F.sum(F.size("_w")).alias("_sum"))
    w = Window.partitionBy(*block)
    placed = sizes.withColumns({"_all": F.sum("_sum").over(w), "_chunk": F.floor((F.sum("_sum").over(w.orderBy("_n")) - F.col("_sum")) / PART)})
    chunks = placed.where(F.col("_all") > PART).groupBy(*block, "_chunk").agg(F.min("_n").alias("_low"), F.max("_n").alias("_high"), F.ceil(F.sum("_sum") / PART).alias("_parts"))
    n = F.size("_w")
    near = reduce(and_, [sets[c] == F.col("_k." + c) for c in block]) & (F.col("_k._low") <= n) & (F.col("_k._high") >= n * least - 1e-6)
    meets = sets.join(F.broadcast(cut(chunks)).alias("_k"), near, "left").select(*[sets[c] for c in block], "_id", "_w", *[F.col("_k." + c) for c in ("_chunk", "_high", "_parts")])
    own, part = F.pmod(F.xxhash64("_id", "_w"), F.col("_parts")), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))
    parts = meets.select("*", part.alias("_part"), (F.col("_high") >= n).alias("_home"), own.alias("_own")).where("_home is null or not _home or _part <= _own")
    asks = F.coalesce(~F.col("_home") | (F.col("_part") < F.col("_own")), F.lit(False))
    dealt = parts.select(*block, F.xxhash64(*block, "_chunk", "_part").alias("_key"), asks.alias("_asks"), F.when(F.col("_parts") > 1, 2).when(F.col("_parts") == 1, 1).otherwise(0).alias("_kind"), "_id", "_w")
    dealt = dealt.repartition("_key").sortWithinPartitions("_key", "_asks")
    pairs = mapped(dealt, _close(len(block), least, shared), StructType([*[dealt.schema[c] for c in block], *[StructField(c, dealt.schema["_id"].dataType) for c in ("_x", "_y")], *[StructField(c, LongType()) for c in ("_na", "_nb", "_both", "_apart")]]))
    # Two sets differ in at least as many tokens as parity bits: a count that says otherwise was not made of these sets.
    differ = F.col("_na") + F.col("_nb") - 2 * F.col("_both")
    sure = F.when(F.bit_count("_apart") <= differ, F.col("_both")).otherwise(F.raise_error(F.lit("shared tokens and parity bits of a pair disagree")))
    counted = pairs.select(*block, F.least("_x", "_y").alias("left"), F.greatest("_x", "_y").alias("right"), sure.cast("int").alias("shared"), (F.col("_both") / (F.col("_na") + F.col("_nb") - F.col("_both"))).alias("similarity"))
    return counted.where((F.col("left") < F.col("right")) & (F.col("shared") >= shared) & (F.col("similarity") >= least))


def _close(keys: int, least: float, shared: int):
    """Close pairs of sorted batches: block, key, asks, kind, id, set. Sets of a key that are held come before those that ask for them.

    Kind: 0 for a whole block, 1 for a part of one, 2 for one of several parts that hold the same sizes.
    """

    def arrays(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        n = pc.list_value_length(part.column(keys + 4)).to_numpy(zero_copy_only=False).astype(np.int64)
        return np.concatenate([[0], np.cumsum(n)]), part.column(keys + 4).flatten().to_numpy(zero_copy_only=False)

    def out(a, b, own: pa.RecordBatch, held: pa.RecordBatch, na, nb, both, apart) -> pa.RecordBatch:
        x, y = pa.array(a), pa.array(b)
        numbers = [pa.array(v.astype(np.int64)) for v in (na[a], nb[b], both, apart.view(np.int64))]
        columns = [*[held.column(k).take(y) for k in range(keys)], own.column(keys + 3).take(x), held.column(keys + 3).take(y), *numbers]
        return pa.RecordBatch.from_arrays(columns, [*own.schema.names[:keys], "_x", "_y", "_na", "_nb", "_both", "_apart"])

    def run(batches):
        parts, tokens, last, alone, index, held, size = [], 0, None, False, None, None, None

        def ready():
            nonlocal index, held, size
            held = pa.concat_batches(parts)
            offsets, every = arrays(held)
            index, size = Index(offsets, every, least, shared, pc.max(held.column(keys + 2)).as_py() == 2), np.diff(offsets)
            parts.clear()
            for a, b, both, apart in index.own():
                yield out(a, b, held, held, size, size, both, apart)

        for batch in batches:
            key, asks, kind = (batch.column(k).to_numpy(zero_copy_only=False) for k in (keys, keys + 1, keys + 2))
            begins = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (asks[1:] != asks[:-1])])) if len(key) else []
            for x, y in zip(begins, [*begins[1:], len(key)]):
                part = batch.slice(x, y - x)
                if not asks[x]:
                    # Whole blocks may be held together, parts of a block may not: their sets meet elsewhere.
                    if parts and key[x] != last and (tokens >= FEW or alone or kind[x]):
                        yield from ready()
                    if not parts:
                        tokens = 0
                    index, last, alone = None, key[x], kind[x] > 0
                    parts.append(part)
                    tokens += len(part.column(keys + 4).flatten())
                elif key[x] == last:
                    if index is None:
                        yield from ready()
                    offsets, every = arrays(part)
                    for a, b, both, apart in index.asked(offsets, every):
                        yield out(a, b, part, held, np.diff(offsets), size, both, apart)
        if parts:
            yield from ready()

    return run


def matched(pairs: DataFrame, degree: int = 2) -> DataFrame:
    """Greedy matching of pairs (left, right, similarity), the closest first, ties by left and right, each end in ``degree`` at most.

    In rounds: a pair that is, among the open pairs of each of its ends, within
    what that end may still take, is taken, as going through all pairs in order
    would; ends that are full lose their open pairs. The closest open pair is
    always taken, so rounds end.
    """
    open_, taken = cut(pairs.select("left", "right", "similarity").distinct()), None
    full = None
    while not open_.isEmpty():
        order = (F.desc("similarity"), F.asc("left"), F.asc("right"))
        ends = open_.select(F.explode(F.array("left", "right")).alias("end"), "left", "right", "similarity")
        ranked = ends.withColumn("nth", F.row_number().over(Window.partitionBy("end").orderBy(*order)))
        if full is not None:
            ranked = ranked.join(full, "end", "left")
        room = F.lit(degree) - (F.coalesce("used", F.lit(0)) if full is not None else F.lit(0))
        both = ranked.groupBy("left", "right", "similarity").agg(F.bool_and(F.col("nth") <= room).alias("ok"))
        now = cut(both.where("ok").drop("ok"))
        taken = now if taken is None else cut(taken.unionByName(now))
        full = cut(taken.select(F.explode(F.array("left", "right")).alias("end")).groupBy("end").agg(F.count("*").cast("int").alias("used")))
        done = full.where(F.col("used") >= degree)
        left = open_.join(now.select("left", "right"), ["left", "right"], "left_anti")
        for side in ("left", "right"):
            left = left.join(done.select(F.col("end").alias(side)), side, "left_anti")
        open_ = cut(left.select("left", "right", "similarity"))
    return open_ if taken is None else taken


def relationship_policy(a: str, b: str) -> Column:
    """How two memories may be related: a and b are structs of session_id, episode and memory_type.

    same_episode_only for those of one episode, skip for those of two, strong_only if one is a bug, else allow_ambiguous.
    """
    x, y = (F.struct(f"{c}.session_id", f"{c}.episode") for c in (a, b))
    placed = F.col(f"{a}.session_id").isNotNull() & F.col(f"{b}.session_id").isNotNull()
    return F.when(placed & x.eqNullSafe(y), "same_episode_only").when(placed, "skip").when((F.col(f"{a}.memory_type") == "bug") | (F.col(f"{b}.memory_type") == "bug"), "strong_only").otherwise("allow_ambiguous")


def similarity_edges(memories: DataFrame, block: list[str], degree: int = 2) -> DataFrame:
    """related_to between memories of a block with similar contents, the closest first, each memory in ``degree`` at most.

    Memories of two episodes of sessions are not related; of one episode they
    need two distinctive shared tokens.
    """
    items = memories.withColumn("_tokens", similarity_tokens(F.col("content")))
    pairs = similar_pairs(items, "memory_id", "_tokens", block)
    kind = F.col("memory_type") if "memory_type" in memories.columns else F.lit(None).cast("string")
    side = items.select(*block, "memory_id", F.struct("session_id", "episode", kind.alias("memory_type")).alias("place"), "_tokens")
    both = pairs.join(side.withColumnsRenamed({"memory_id": "left", "place": "_p", "_tokens": "_wa"}), [*block, "left"]).join(side.withColumnsRenamed({"memory_id": "right", "place": "_q", "_tokens": "_wb"}), [*block, "right"])
    policy = relationship_policy("_p", "_q")
    # Pairs of less than half are dropped under every policy, so strong_only and allow_ambiguous come to the same.
    allowed = both.where((policy != "skip") & ((policy != "same_episode_only") | (distinctive(F.array_intersect("_wa", "_wb")) >= 2)))
    picked = matched(allowed, degree)
    return picked.select(
        F.concat(F.lit("memory:"), F.col("left").cast("string")).alias("source"), F.concat(F.lit("memory:"), F.col("right").cast("string")).alias("target"), F.lit("related_to").alias("relation"),
        F.lit("inferred").alias("evidence"), F.round(F.least(F.lit(1.0), 0.6 + F.col("similarity") * 0.8), 3).alias("weight"),
    )


#: Characters of the runs that names are looked up by; shorter names are looked up as they are.
RUN = 8


def _runs(texts: DataFrame, keys: list[str], text: str, lengths: list[int] | None = None, bits: np.ndarray | None = None, size: int = 0) -> DataFrame:
    """keys, _h: hashes of a text's distinct runs, of ``lengths`` and in the filter, or of the one length that a name is looked up by."""
    from loomspan.llm.filters import is_set
    from loomspan.llm.kernel import mix

    def run(batches):
        for batch in batches:
            # Some thousand characters at least and a text at most beyond a million are hashed at once.
            column, first = batch.column(len(keys)), 0
            while first < batch.num_rows:
                part, chars = [], 0
                while first + len(part) < batch.num_rows and chars < 1_000_000:
                    part.append(column[first + len(part)].as_py() or "")
                    chars += len(part[-1])
                n = np.array([len(x) for x in part], np.int64)
                code = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
                row, left = np.repeat(np.arange(len(part)), n), np.repeat(np.cumsum(n), n) - np.arange(chars)
                own = np.repeat(np.minimum(n, RUN), n) if lengths is None else None
                h, rows, found = np.zeros(chars, np.uint64), [], []
                for length in range(1, RUN + 1):
                    h = h[: max(0, chars - length + 1)] * np.uint64(0x9E3779B97F4A7C15) + code[length - 1 :] + np.uint64(1)
                    if lengths is not None and length not in lengths:
                        continue
                    m = len(h)
                    keep = (left[:m] >= length) if own is None else (left[:m] >= length) & (own[:m] == length)
                    at = mix(h + np.uint64(length)).view(np.int64)
                    if bits is not None:
                        keep &= is_set(bits, at & ((1 << size) - 1))
                    rows.append(row[:m][keep])
                    found.append(at[keep])
                both = pd.DataFrame({"row": np.concatenate(rows), "h": np.concatenate(found)}).drop_duplicates() if rows else pd.DataFrame({"row": [], "h": []})
                take = pa.array(both["row"].to_numpy(np.int64) + first, pa.int64())
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(take) for k in range(len(keys))], pa.array(both["h"].to_numpy(np.int64), pa.int64())], [*keys, "_h"])
                first += len(part)

    asked = texts.select(*keys, F.col(text).alias("_t")).where("_t is not null")
    return mapped(asked, run, StructType([*[StructField(k, asked.schema[k].dataType) for k in keys], StructField("_h", LongType())]))


def mentions(texts: DataFrame, names: DataFrame, id_: str, text: str, name: str, block: tuple[str, ...] = ()) -> DataFrame:
    """block, id_, name: which texts contain which names, anywhere; names are distinct and not empty.

    Each name is looked up by its run of RUN characters that the fewest texts
    hold (a shorter name by itself), so texts meet only names whose rarest run
    they have; containment is then checked. Texts give only the runs that pass a
    filter of fixed size, which the names' runs set. Null texts and names match
    nothing.
    """
    from loomspan.llm.filters import flags

    wanted = cut(names.where(F.length(name) > 0).select(*block, name).distinct())
    lengths = [r[0] for r in wanted.select(F.least(F.lit(RUN), F.length(name))).distinct().collect()]
    if not lengths:
        return texts.select(*block, id_, F.lit("").alias(name)).limit(0)
    of_name = cut(_runs(wanted, [*block, name], name))
    bits, size = flags(of_name, bit=lambda size: F.pmod("_h", F.lit(1 << size)))
    of_text = cut(_runs(texts, [*block, id_], text, lengths, bits, size))
    often = of_text.groupBy(*block, "_h").agg(F.count("*").alias("_n"))
    rarest = of_name.join(often, [*block, "_h"]).groupBy(*block, name).agg(F.count("*").alias("_k"), F.min(F.struct("_n", "_h")).alias("_r"))
    # A name of which no text has some run is in none.
    all_ = rarest.join(of_name.groupBy(*block, name).agg(F.count("*").alias("_k")), [*block, name, "_k"], "left_semi")
    found = of_text.join(all_.select(*block, name, F.col("_r._h").alias("_h")), [*block, "_h"]).select(*block, id_, name)
    return found.join(texts.select(*block, id_, text), [*block, id_]).where(F.contains(text, F.col(name))).select(*block, id_, name).distinct()


def mention_edges(memories: DataFrame, files: DataFrame, block: tuple[str, ...] = ()) -> DataFrame:
    """references (0.7) from memories to the files whose base name, and so perhaps whose path, their title and content contain.

    With ``block`` (as session_id) only files of the same block count. A path
    that ends in / names no file.
    """
    own = files.where(F.trim("path") != "").select(*block, "path", basename(F.col("path")).alias("_name"))
    said = memories.select(*block, "memory_id", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))).alias("_text"))
    found = mentions(said, own, "memory_id", "_text", "_name", block).join(own, [*block, "_name"])
    return found.select("memory_id", "path").distinct().select(
        F.concat(F.lit("memory:"), F.col("memory_id").cast("string")).alias("source"), F.concat(F.lit("file:"), "path").alias("target"),
        F.lit("references").alias("relation"), F.lit("inferred").alias("evidence"), F.lit(0.7).alias("weight"),
    )


def continuity_edges(sessions: DataFrame, most: int = 20, key: str = "session_id", block: str = "project_id") -> DataFrame:
    """continuity (0.8) from each of the ``most`` sessions before one of a project to it, if it touched files; shared_files is how many.

    sessions: key, block, ended_at, files (array of paths; blank ones don't count).
    """
    n = F.size(F.array_distinct(F.filter("files", lambda x: F.trim(x) != "")))
    before = Window.partitionBy(block).orderBy("ended_at", key).rowsBetween(-most, -1)
    prior = sessions.withColumn("_prior", F.collect_list(key).over(before)).withColumn("shared_files", n).where("shared_files > 0")
    name = lambda c: F.concat(F.lit("session:"), c)
    return prior.select(F.explode("_prior").alias("_from"), key, "shared_files").select(
        name(F.col("_from")).alias("source"), name(F.col(key)).alias("target"), F.lit("continuity").alias("relation"), F.lit("inferred").alias("evidence"), F.lit(0.8).alias("weight"), "shared_files"
    )


def first_nodes(nodes: DataFrame, order: tuple[str, ...]) -> DataFrame:
    return nodes.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where("_n = 1").drop("_n")


def last_nodes(nodes: DataFrame, order: tuple[str, ...]) -> DataFrame:
    return nodes.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(*[F.desc(c) for c in order]))).where("_n = 1").drop("_n")


def merge_edges(edges: DataFrame, order: str = "position") -> DataFrame:
    """One edge for each (source, target, relation): the first of the best evidence, with the largest weight."""
    best = F.struct(evidence_rank(F.col("evidence")).alias("r"), (-F.col(order)).alias("p"))
    return edges.groupBy("source", "target", "relation").agg(F.max_by("evidence", best).alias("evidence"), F.max("weight").alias("weight"))


def merge_edges_with_metadata(edges: DataFrame, order: str = "position") -> DataFrame:
    """As ``merge_edges``, with metadata folded in order.

    A newcomer of better evidence, or of the same and a larger weight, adds its
    keys over the edge's; any other newcomer is dropped with its metadata.
    """
    listed = F.collect_list(F.struct(F.col(order).alias("p"), evidence_rank(F.col("evidence")).alias("r"), "evidence", "weight", "metadata"))
    seq = F.array_sort(listed, lambda a, b: F.when(a["p"] < b["p"], -1).when(a["p"] > b["p"], 1).otherwise(0))
    grouped = edges.groupBy("source", "target", "relation").agg(seq.alias("s"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).cast("map<string,string>")
    join = lambda a, b: F.map_from_entries(F.array_distinct(F.concat(F.filter(F.map_entries(a), lambda e: ~F.map_contains_key(b, e["key"])), F.map_entries(b)))).cast("map<string,string>")

    kind = "struct<r:int,evidence:string,weight:double,metadata:map<string,string>>"

    def step(s, x):
        m = F.coalesce(x["metadata"], empty)
        better, heavier = x["r"] > s["r"], x["weight"] > s["weight"]
        return F.struct(
            F.when(better, x["r"]).otherwise(s["r"]).alias("r"), F.when(better, x["evidence"]).otherwise(s["evidence"]).alias("evidence"),
            F.greatest(s["weight"], x["weight"]).alias("weight"), F.when(better | heavier, join(s["metadata"], m)).otherwise(s["metadata"]).alias("metadata"),
        ).cast(kind)

    start = F.struct(F.lit(-1).alias("r"), F.lit("").alias("evidence"), F.lit(-1e308).alias("weight"), empty.alias("metadata")).cast(kind)
    folded = grouped.withColumn("x", F.aggregate("s", start, step))
    return folded.select("source", "target", "relation", "x.evidence", "x.weight", "x.metadata")


def both_ways(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """Each edge in both directions, as a, b and w."""
    w = F.col(weight) if weight else F.lit(1.0)
    return edges.select(F.col("source").alias("a"), F.col("target").alias("b"), w.alias("w")).unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("b"), w.alias("w")))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree, degree, zero for isolated nodes."""
    ends = edges.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    sums = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    out = nodes.select("id").join(sums, "id", "left").na.fill(0, ["in_degree", "out_degree"])
    return out.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def statistics(nodes: DataFrame, edges: DataFrame, communities: int = 0) -> DataFrame:
    """One row: counts, evidence histogram, average degree (2 places), density (4), isolated nodes."""
    d = degrees(nodes, edges).agg(F.count("*").alias("node_count"), F.sum("degree").alias("total"), F.count_if(F.col("degree") == 0).alias("isolated_nodes"))
    e = edges.agg(
        F.count("*").alias("edge_count"), F.count_if(F.col("evidence") == "extracted").alias("extracted"), F.count_if(F.col("evidence") == "inferred").alias("inferred"),
        F.count_if(~F.col("evidence").isin("extracted", "inferred")).alias("ambiguous"),
    )
    n = F.col("node_count")
    density = F.when(n > 1, F.round(F.col("edge_count") / (n * (n - 1) / 2.0), 4)).otherwise(0.0)
    # One row each, folded into one.
    both = d.unionByName(e, allowMissingColumns=True)
    both = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return both.select("node_count", "edge_count", F.lit(communities).alias("community_count"), "extracted", "inferred", "ambiguous", F.when(n > 0, F.round(F.col("total") / n, 2)).otherwise(0.0).alias("avg_degree"), density.alias("density"), "isolated_nodes")


# Categories of node types in displays; other types are claims.
CATEGORIES = {
    "file": "files", "module": "files", "document": "docs", "section": "docs", "rationale": "docs", "summary": "docs", "change_log": "docs", "session": "sessions",
    "episode": "episodes", "error": "errors", "bug": "errors", "risk": "errors", "command": "commands", "tool": "commands", "test": "commands",
}


def category(kind: Column) -> Column:
    return lookup(kind, CATEGORIES, "claims")


def hub_type(kind: Column, degree: Column) -> Column:
    return F.when(kind == "session", "session_hub").when(kind == "module", "import_hub").when(kind.isin("file", "document") & (degree > 50), "central_file").otherwise("domain_hub")


def hubs(nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    """The n nodes of the largest degree, sessions and modules apart, with their class of hub."""
    ranked = nodes.join(degrees(nodes, edges).select("id", "degree"), "id").withColumn("hub_type", hub_type(F.col("node_type"), F.col("degree")))
    return ranked.where("hub_type not in ('session_hub', 'import_hub')").orderBy(F.desc("degree"), "id").limit(n)


def p95_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The degree at index floor(0.95 n) of the sorted degrees, from a histogram: no sort of all nodes in one task."""
    return _p95(degrees(nodes, edges))


def _p95(degree: DataFrame) -> DataFrame:
    histogram = degree.groupBy("degree").agg(F.count("*").alias("n"))
    # As many rows as there are distinct degrees.
    w = Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0)
    running = histogram.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1))))
    return running.where(F.col("upto") > F.floor(F.col("total") * 0.95)).agg(F.min("degree").alias("p95_degree"))


def damped(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Both-way edges with weights damped at hubs beyond the 95th percentile of degree by 1 / ln(degree)."""
    d = cut(degrees(nodes, edges).select("id", "degree"))
    limit = _p95(d).scalar()
    factor = F.when((F.col("p95_degree") >= 5) & (F.col("degree") > F.col("p95_degree")), 1.0 / F.greatest(F.lit(1.0), F.log(F.greatest(F.lit(2), "degree")))).otherwise(1.0)
    f = d.withColumn("p95_degree", limit).select("id", factor.alias("f"))
    out = both_ways(edges, "weight").join(f.withColumnsRenamed({"id": "a", "f": "_fa"}), "a").join(f.withColumnsRenamed({"id": "b", "f": "_fb"}), "b")
    return out.select("a", "b", (F.col("w") * F.least("_fa", "_fb")).alias("w"))


def community_figures(members: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Size, inner edges, cohesion (4 places), label, five representatives and three bridges of each community.

    members: id, community. Ties in degree go to the smaller id, ties of types to the first name.
    """
    src, dst = members.withColumnsRenamed({"id": "source", "community": "_cs"}), members.withColumnsRenamed({"id": "target", "community": "_ct"})
    e = edges.select("source", "target").join(src, "source", "left").join(dst, "target", "left")
    inner = e.where("_cs = _ct")
    crossing = e.where("not (_cs <=> _ct)")
    ends = inner.select(F.col("_cs").alias("community"), F.col("source").alias("id")).union(inner.select("_ct", "target"))
    outs = crossing.where("_cs is not null").select(F.col("_cs").alias("community"), F.col("source").alias("id")).union(crossing.where("_ct is not null").select("_ct", "target"))

    def top(df: DataFrame, n: int, name: str) -> DataFrame:
        counted = df.groupBy("community", "id").agg(F.count("*").alias("n"))
        ranked = counted.withColumn("_r", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "id"))).where(F.col("_r") <= n)
        return ranked.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "id"))), lambda x: x["id"]).alias(name))

    size = members.groupBy("community").agg(F.count("*").alias("node_count"))
    kinds = members.join(nodes.select("id", "node_type"), "id", "left").groupBy("community", capitalised(F.coalesce("node_type", F.lit("mixed"))).alias("kind")).agg(F.count("*").alias("n"))
    main = kinds.groupBy("community").agg(F.min_by("kind", F.struct((-F.col("n")).alias("n"), "kind")).alias("kind"))
    out = size.join(inner.groupBy(F.col("_cs").alias("community")).agg(F.count("*").alias("intra_edges")), "community", "left").na.fill(0, ["intra_edges"])
    possible = F.col("node_count") * (F.col("node_count") - 1) / 2.0
    out = out.withColumn("cohesion_score", F.when(possible > 0, F.round(F.least(F.lit(1.0), F.col("intra_edges") / possible), 4)).otherwise(0.0))
    out = out.join(main, "community").withColumn("label", F.format_string("%s cluster (%d nodes)", "kind", "node_count")).drop("kind")
    return out.join(top(ends, 5, "representative_nodes"), "community", "left").join(top(outs, 3, "bridge_nodes"), "community", "left")


def persistable(edges: DataFrame) -> DataFrame:
    """Edges between memories of uuid ids whose relation is one that is kept."""
    uuid = "^memory:[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
    kept = edges.where(F.col("source").rlike(uuid) & F.col("target").rlike(uuid) & F.col("relation").isin(*PERSISTED_RELATIONS))
    return kept.withColumn("from_id", F.substring("source", 8, 36)).withColumn("to_id", F.substring("target", 8, 36))


def is_noisy_path(x: Column) -> Column:
    return contains_any(F.lower(x), NOISY_PARTS)


def inject(nodes: DataFrame, edges: DataFrame, extra: DataFrame, budget: int = 15_000) -> DataFrame:
    """``edges`` with the heaviest of ``extra`` whose two ends are nodes."""
    ids = nodes.select("id")
    inside = extra.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return edges.unionByName(inside.orderBy(F.desc("weight"), "source", "target").limit(budget).select(*edges.columns))


def incremental_sync(nodes: DataFrame, edges: DataFrame, fresh_nodes: DataFrame, fresh_edges: DataFrame, touched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace what stems from the touched files (column path; changed or removed) by freshly parsed parts.

    nodes and edges have source_file. Edges whose ends are gone go as well.
    """
    gone = touched.select(F.col("path").alias("source_file")).distinct()
    kept = nodes.join(gone, "source_file", "left_anti").unionByName(fresh_nodes)
    kept = kept.dropDuplicates(["id"])
    ids = kept.select("id")
    links = edges.join(gone, "source_file", "left_anti").unionByName(fresh_edges)
    links = links.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return kept, links.select(*edges.columns)


# Buckets of node types that share a display; other types are symbols.
BUCKETS = {"file": "files", "module": "files", "document": "docs", "section": "docs", "rationale": "docs"}


def project_for_display(nodes: DataFrame, edges: DataFrame, most_nodes: int = 1200, most_edges: int = 3000) -> tuple[DataFrame, DataFrame]:
    """A graph for a display of so many nodes and edges; one within both bounds as it is.

    A third of the nodes at most are the first files, documents and symbols each,
    then come neighbours of these in the order of their edges, then the rest in
    order. Of the edges among them the first stay. Nodes come in order of
    ``position`` or id, edges of ``position`` or their ends and relation.
    """
    if nodes.limit(most_nodes + 1).count() <= most_nodes and edges.limit(most_edges + 1).count() <= most_edges:
        return nodes, edges
    n_order = F.col("position") if "position" in nodes.columns else F.col("id")
    e_order = F.struct("position") if "position" in edges.columns else F.struct("source", "target", "relation")
    ranked = nodes.select("id", n_order.alias("_a"), lookup(F.col("node_type"), BUCKETS, "symbols").alias("_bucket"))
    first = F.row_number().over(Window.partitionBy("_bucket").orderBy("_a"))
    seeds = cut(ranked.withColumn("_n", first).where(F.col("_n") <= max(1, most_nodes // 3)).select("id", "_a"))
    numbered = edges.select("source", "target", e_order.alias("_e"))
    ends = numbered.select(F.col("source").alias("id"), F.col("target").alias("to"), "_e").unionByName(numbered.select(F.col("target").alias("id"), F.col("source").alias("to"), "_e"))
    near = ends.join(seeds, "id").groupBy(F.col("to").alias("id")).agg(F.min(F.struct("_a", "_e")).alias("_k"))
    places = ranked.select("id", "_a").join(seeds.select("id", F.lit(0).alias("_seed")), "id", "left").join(near, "id", "left")
    tier = F.when(F.col("_seed").isNotNull(), 0).when(F.col("_k").isNotNull(), 1).otherwise(2)
    chosen = places.withColumn("_t", tier).orderBy("_t", F.when(F.col("_t") == 1, F.col("_k._a")).otherwise(F.col("_a")), F.when(F.col("_t") == 1, F.col("_k._e"))).limit(most_nodes)
    ids = cut(chosen.select("id"))
    kept = nodes.join(ids, "id", "left_semi").select(*nodes.columns)
    inside = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)
    return kept, inside.orderBy(e_order).limit(most_edges)


def merged(left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Two graphs as one: of a node that both have the right one's, edges by ``merge_edges``."""
    (n, e), (m, f) = left, right
    nodes = n.join(m.select("id"), "id", "left_anti").select(*n.columns).unionByName(m.select(*n.columns))
    columns = ("source", "target", "relation", "evidence", "weight")
    both = e.select(*columns, F.lit(1).alias("position")).unionByName(f.select(*columns, F.lit(2).alias("position")))
    return nodes, merge_edges(both)


def merged_projects(graphs: list[tuple[DataFrame, DataFrame]], most_nodes: int, most_edges: int) -> tuple[DataFrame, DataFrame] | None:
    """Graphs of several projects as one for a display: each is projected to what the ones before left over, one node and edge at least, until both bounds are reached."""
    out = None
    for nodes, edges in graphs:
        have = (0, 0) if out is None else (out[0].count(), out[1].count())
        if have[0] >= most_nodes and have[1] >= most_edges:
            break
        part = tuple(cut(x) for x in project_for_display(nodes, edges, max(1, most_nodes - have[0]), max(1, most_edges - have[1])))
        out = part if out is None else tuple(cut(x) for x in merged(out, part))
    return out


def layered(repository: list[tuple[DataFrame, DataFrame]], session: list[tuple[DataFrame, DataFrame]], most_nodes: int, most_edges: int) -> tuple[DataFrame, DataFrame] | None:
    """Both layers of all projects as one graph for a display, half of the bounds for the repository's, the rest for the sessions'."""
    half = max(1, most_nodes // 2), max(1, most_edges // 2)
    parts = [g for g in (merged_projects(repository, *half), merged_projects(session, max(1, most_nodes - half[0]), max(1, most_edges - half[1]))) if g is not None]
    return merged(*parts) if len(parts) == 2 else parts[0] if parts else None


def memory_communities(members: DataFrame) -> DataFrame:
    """memory_id, community of the members (id, community) that are memories of uuid ids and have a community."""
    uuid = "^memory:[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
    return members.where(F.col("id").rlike(uuid) & F.col("community").isNotNull()).select(F.substring("id", 8, 36).alias("memory_id"), "community")


def interleave(nodes: DataFrame, category: str = "node_type") -> DataFrame:
    """``place``: the best-linked of each category by turns."""
    nth = F.row_number().over(Window.partitionBy(category).orderBy(F.desc("degree"), "id"))
    return nodes.withColumn("turn", nth)
