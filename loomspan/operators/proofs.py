"""Provenance and proofs of memories: rows, handles, previews, and the arrays and details made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.text import clip
from loomspan.operators.events import event_text
from loomspan.operators.relational import either_end_counts

#: Characters of an excerpt.
EXCERPT = 500


def provenance_rows(memories: DataFrame, events: DataFrame) -> DataFrame:
    """memory_id, place, session_id, session_event_id, excerpt: a row for each stored event that a memory names, in order.

    memories: memory_id, provenance_event_ids (array). Names of events that are
    not stored give nothing, repeated names one row, the first.
    """
    named = memories.select("memory_id", F.posexplode("provenance_event_ids").alias("place", "session_event_id"))
    once = named.groupBy("memory_id", "session_event_id").agg(F.min("place").alias("place"))
    known = events.select("session_id", F.col("event_id").alias("session_event_id"), clip(event_text(), EXCERPT).alias("excerpt"))
    return once.join(known, "session_event_id").select("memory_id", "place", "session_id", "session_event_id", "excerpt")


def append_provenance(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored rows and those fresh ones whose (memory_id, session_event_id) is not stored yet, one each."""
    keys = ["memory_id", "session_event_id"]
    return stored.unionByName(fresh.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti").select(*stored.columns))


def provenance_preview(provenance: DataFrame, most: int = 1) -> DataFrame:
    """The first rows of each memory, with its number of rows."""
    w = Window.partitionBy("memory_id")
    out = provenance.withColumn("events", F.count("*").over(w)).withColumn("_n", F.row_number().over(w.orderBy("place", "session_event_id")))
    return out.where(F.col("_n") <= most).drop("_n")


def _value(key: str, default: str | None = None) -> Column:
    found = F.col("metadata")[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def proof_rows(claims: DataFrame, events: DataFrame) -> DataFrame:
    """Proofs to store of claims: claim_id, memory_id, session_event_id, proof_type, source_ref, excerpt, authority, verification, proof_time.

    claims: claim_id, memory_id, metadata (map), provenance_event_ids. One row
    for each named event, stored or not (then without excerpt and time); a claim that names none has one row whose
    reference is its key, else ``memory``.
    """
    own = claims.select(
        "claim_id", "memory_id", _value("proofType", "session_event").alias("proof_type"), _value("authorityClass").alias("authority"), _value("verificationStatus").alias("verification"),
        _value("claimKey", "memory").alias("_key"), F.explode_outer("provenance_event_ids").alias("session_event_id"),
    )
    known = events.select(F.col("event_id").alias("session_event_id"), clip(event_text(), EXCERPT).alias("excerpt"), F.col("created_at").alias("proof_time"))
    ref = F.coalesce(F.concat(F.lit("session_event:"), "session_event_id"), F.col("_key"))
    return own.join(known, "session_event_id", "left").select("claim_id", "memory_id", "session_event_id", "proof_type", ref.alias("source_ref"), "excerpt", "authority", "verification", "proof_time")


def proof_handles(memories: DataFrame, provenance: DataFrame) -> DataFrame:
    """memory_id, handles: proofs made from a memory's metadata and provenance, where no proofs are stored.

    Without provenance there is one handle, which refers to the claim's key,
    else to its derivation, else to ``memory``.
    """
    listed = F.array_sort(F.collect_list(F.struct("place", "session_id", "session_event_id", "excerpt")))
    both = memories.join(provenance.groupBy("memory_id").agg(listed.alias("_p")), "memory_id", "left")
    kind, who, how = _value("proofType", "session_event"), _value("authorityClass"), _value("verificationStatus")
    nothing = F.lit(None).cast("string")

    def handle(ref: Column, excerpt: Column, session: Column, event: Column) -> Column:
        return F.struct(kind.alias("proof_type"), ref.alias("source_ref"), excerpt.alias("excerpt"), session.alias("session_id"), event.alias("session_event_id"), who.alias("authority"), how.alias("verification"))

    bare = F.array(handle(F.coalesce(F.col("metadata")["claimKey"], F.col("metadata")["derivation"], F.lit("memory")), nothing, nothing, nothing))
    full = F.transform("_p", lambda x: handle(F.concat(F.lit("session_event:"), x["session_event_id"]), x["excerpt"], x["session_id"], x["session_event_id"]))
    return both.select("memory_id", F.when(F.col("_p").isNull(), bare).otherwise(full).alias("handles"))


def claim_projection(memories: DataFrame) -> DataFrame:
    """Claim columns of memories' metadata, with their defaults. memories: memory_id, session_id, memory_type, metadata (map)."""
    key = F.coalesce(F.col("metadata")["claimKey"], F.concat_ws(":", "memory_type", F.col("memory_id").cast("string")))
    subject = F.coalesce(F.nullif(F.split_part(key, F.lit(":"), F.lit(2)), F.lit("")), F.col("metadata")["sessionId"], F.lit("global"))
    return memories.select(
        "memory_id", "session_id", key.alias("claim_key"), F.col("memory_type").alias("claim_type"), subject.alias("subject"), F.coalesce(F.col("metadata")["rankingRole"], "memory_type").alias("predicate"),
        F.coalesce(F.col("metadata")["claimObject"], key).alias("object"), _value("claimPolarity", "positive").alias("polarity"), _value("authorityClass", "session_derived").alias("authority"),
        _value("verificationStatus", "unverified").alias("verification"), belief_admitted(F.col("metadata")).alias("admitted"),
    )


def backfill(memories: DataFrame, claims: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims, with ids made from their memories', and proofs of the memories that have no claim yet; running it again gives none.

    memories: memory_id, session_id, memory_type, metadata, provenance_event_ids; claims: memory_id.
    """
    missing = memories.join(claims.select("memory_id").distinct(), "memory_id", "left_anti")
    claim_id = F.left(F.sha2(F.concat_ws(":", F.lit("claim"), F.col("memory_id").cast("string")), 256), F.lit(32))
    made = claim_projection(missing).withColumn("claim_id", claim_id)
    return made, proof_rows(missing.withColumn("claim_id", claim_id), events)


def persist(drafts: DataFrame, events: DataFrame, claims: DataFrame, sessions: DataFrame) -> dict[str, DataFrame]:
    """What a session's memory drafts leave in the store: memories, embeddings, provenance, claims, proofs and jobs.

    drafts: memory_id, session_id, memory_type, title, content, metadata,
    provenance_event_ids. Drafts that the belief gate did not let in leave
    nothing; of drafts of one session, type, claim key and title the least
    memory_id stays. Memories that have a claim already keep it. sessions:
    session_id of those whose claims are to be reconciled and vectors synced.
    """
    from loomspan.operators.retrieval import hash_embedding
    from loomspan.streaming.jobs import plan

    same = Window.partitionBy("session_id", "memory_type", F.coalesce(F.col("metadata")["claimKey"], F.lit("")), "title").orderBy("memory_id")
    kept = drafts.where(belief_admitted(F.col("metadata"))).withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")
    made, rows = backfill(kept, claims, events)
    text = kept.select("memory_id", F.concat_ws(" ", "title", "content").alias("text"))
    return {
        "memories": kept, "embeddings": hash_embedding(text, "memory_id", "text"), "provenance": provenance_rows(kept, events), "claims": made, "proofs": rows,
        "jobs": plan(sessions).where(F.col("job_type").isin("reconcile_claims", "sync_vectors")),
    }


def belief_admitted(metadata: Column) -> Column:
    """Whether a draft's belief gate let it in; where it says nothing, it did."""
    return F.coalesce(metadata["belief.admit"].try_cast("boolean"), F.lit(True))


def hit_projection(hits: DataFrame) -> DataFrame:
    """``hits`` whose claim_key, authority and verification are filled from metadata, and with proof_type, source_class and ranking_role of it."""
    names = {"claim_key": "claimKey", "authority": "authorityClass", "verification": "verificationStatus"}
    filled = {c: F.coalesce(F.col(c), F.col("metadata")[k]) for c, k in names.items()}
    return hits.withColumns(filled | {c: F.col("metadata")[k] for c, k in (("proof_type", "proofType"), ("source_class", "sourceClass"), ("ranking_role", "rankingRole"))})


def relations(claims: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """memory_id, relations: the claims that a memory's claim is linked to, from either end, in order of relation and claim.

    claims: claim_id, memory_id, title; edges: source, target (claim ids), relation; ids: memory_id.
    """
    out = edges.select(F.col("source").alias("claim_id"), F.col("target").alias("other"), "relation", F.lit("outgoing").alias("direction"))
    back = edges.where("source <> target").select(F.col("target").alias("claim_id"), F.col("source").alias("other"), "relation", F.lit("incoming").alias("direction"))
    mine = claims.join(ids, "memory_id", "left_semi").select("memory_id", "claim_id")
    far = claims.select(F.col("claim_id").alias("other"), F.col("memory_id").alias("related_memory_id"), "title")
    both = out.unionByName(back).join(mine, "claim_id").join(far, "other")
    return both.groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct("relation", "direction", F.col("other").alias("claim_id"), "related_memory_id", "title"))).alias("relations"))


def memory_details(memories: DataFrame, claims: DataFrame, conflicts: DataFrame, provenance: DataFrame, proofs: DataFrame, ids: list, most: int = 20) -> DataFrame:
    """Memories by id with their claim, number of active conflicts, provenance and proofs as arrays.

    conflicts: source, target of open contradictions between claims. Of several claims of a memory the least id counts.
    """
    asked = memories.where(F.col("memory_id").isin(*ids[:most]))
    claim = claims.groupBy("memory_id").agg(F.min("claim_id").alias("claim_id"))
    open_ = either_end_counts(conflicts, "source", "target").withColumnsRenamed({"id": "claim_id", "n": "active_conflicts"})
    seen = provenance.groupBy("memory_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "session_event_id"))), lambda x: x["session_event_id"]).alias("provenance"))
    kept = proofs.groupBy("memory_id").agg(F.array_sort(F.collect_set("source_ref")).alias("proofs"))
    out = asked.join(claim, "memory_id", "left").join(open_, "claim_id", "left").join(seen, "memory_id", "left").join(kept, "memory_id", "left")
    none = F.array().cast("array<string>")
    return out.withColumns({"active_conflicts": F.coalesce("active_conflicts", F.lit(0)), "provenance": F.coalesce("provenance", none), "proofs": F.coalesce("proofs", none)})
