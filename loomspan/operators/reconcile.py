"""Claim reconciliation: strength, supersession, contradiction and confirmation of prior claims."""

from __future__ import annotations

from bisect import insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.plans.lineage import fresh
from loomspan.schemas import lookup

# Fixed values.
AUTHORITY_SCORE = {"repository": 50, "test_verified": 45, "tool_verified": 40, "user_confirmed": 35, "session_derived": 20, "model_derived": 0}
VERIFICATION_SCORE = {"verified": 4, "user_confirmed": 3, "inferred": 2, "unverified": 1, "contradicted": 0}
#: (newer, prior) types of which the newer may supersede the prior.
SUPERSEDES = (("fix", "bug"), ("decision", "decision"), ("constraint", "constraint"), ("constraint", "decision"), ("fact", "fact"), ("task", "task"))
WEIGHTS = {"supersedes": 0.9, "contradicts": 0.86, "confirms": 0.62}
CANDIDATES = 12


def strength(authority: Column, verification: Column) -> Column:
    return lookup(authority, AUTHORITY_SCORE, 10) + lookup(verification, VERIFICATION_SCORE, 1)


def may_supersede(newer: Column, prior: Column) -> Column:
    out = F.lit(False)
    for a, b in SUPERSEDES:
        out = out | ((newer == a) & (prior == b))
    return out


def prior_candidates(current: DataFrame, claims: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """For each current claim the newest admitted others of its key or subject, ``most`` of them, as columns prior_*.

    The two keys are two equi-joins, so neither is a nested loop. Only the
    newest most + 1 claims of a key or subject can be among the newest ``most``
    others, and only they are joined.
    """
    columns = ("claim_id", "claim_type", "polarity", "authority", "verification", "valid_from", "created_at")
    newest = [F.desc("valid_from"), F.desc("created_at"), F.desc("claim_id")]
    found = None
    for k in ("claim_key", "subject"):
        nth = F.row_number().over(Window.partitionBy("project_id", k).orderBy(*newest))
        priors = claims.where("admitted").withColumn("_n", nth).where(F.col("_n") <= most + 1)
        priors = priors.select(F.col("project_id"), F.col(k), *[F.col(c).alias(f"prior_{c}") for c in columns])
        part = current.join(priors, ["project_id", k]).where("prior_claim_id <> claim_id").select(*current.columns, *[f"prior_{c}" for c in columns])
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("claim_id").orderBy(F.desc("prior_valid_from"), F.desc("prior_created_at"), F.desc("prior_claim_id"))
    return found.dropDuplicates(["claim_id", "prior_claim_id"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def reconcile_edges(candidates: DataFrame) -> DataFrame:
    """claim_id, prior_claim_id, relation, weight, loser: all edges of one set-based pass.

    Opposite polarities contradict, and the weaker side, if any, is the loser;
    other pairs confirm, also where the newer supersedes as well.
    """
    newer, prior = strength(F.col("authority"), F.col("verification")), strength(F.col("prior_authority"), F.col("prior_verification"))
    opposite = F.coalesce(F.col("polarity") != F.col("prior_polarity"), F.lit(False))
    supersedes = may_supersede(F.col("claim_type"), F.col("prior_claim_type")) & (newer >= prior)
    loser = F.when(opposite & (newer > prior), F.col("prior_claim_id")).when(opposite & (newer < prior), F.col("claim_id"))
    kinds = F.array_compact(F.array(F.when(supersedes, "supersedes"), F.when(opposite, "contradicts").otherwise("confirms")))
    return candidates.withColumn("loser", loser).select("claim_id", "prior_claim_id", F.explode(kinds).alias("relation"), "loser").select(
        "claim_id", "prior_claim_id", "relation", lookup(F.col("relation"), WEIGHTS, None).alias("weight"), F.when(F.col("relation") == "contradicts", F.col("loser")).alias("loser")
    )


def apply_edges(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """Claims after reconciliation: superseded_by once set stays, losers are contradicted."""
    by = edges.where("relation = 'supersedes'").groupBy(F.col("prior_claim_id").alias("claim_id")).agg(F.min("claim_id").alias("_by"))
    lost = edges.where("loser is not null").select(F.col("loser").alias("claim_id")).distinct().withColumn("_lost", F.lit(True))
    out = claims.join(by, "claim_id", "left").join(lost, "claim_id", "left")
    return out.withColumn("superseded_by", F.coalesce("superseded_by", "_by")).withColumn("verification", F.when(F.col("_lost"), "contradicted").otherwise(F.col("verification"))).drop("_by", "_lost")


def _earlier(admitted: DataFrame, column: str, order: tuple[str, ...]) -> DataFrame:
    """claim_id, prior_claim_id: for each claim the newest CANDIDATES of those before it with its key or subject.

    Claims of one are sorted, where Spark's sort spills, and streamed; what a
    task holds are the ids and times of the newest ones.
    """
    times = ("valid_from", "created_at", "claim_id")
    rows = admitted.select("project_id", F.col(column).alias("_k"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], *times)

    def run(batches):
        at, held = None, []
        for batch in batches:
            claims, priors = [], []
            columns = [batch.column(c).to_pylist() for c in ("project_id", "_k", *times)]
            for project, key, *own in zip(*columns, strict=True):
                if (project, key) != at:
                    at, held = (project, key), []
                claims += [own[2]] * len(held)
                priors += [x[-1][1] for x in held]
                insort(held, tuple((v is not None, v if v is not None else 0) for v in own))
                del held[:-CANDIDATES]
            yield pa.RecordBatch.from_arrays([pa.array(claims, pa.string()), pa.array(priors, pa.string())], ["claim_id", "prior_claim_id"])

    dealt = rows.repartition("project_id", "_k").sortWithinPartitions("project_id", "_k", *[f"_o{k}" for k in range(len(order))])
    return dealt.mapInArrow(run, "claim_id string, prior_claim_id string")


def _meetings(pairs: DataFrame, lost: DataFrame) -> DataFrame:
    """claim_id, at, lost and met, its meetings in order, if claims are contradicted at the times in ``lost``.

    A claim that loses a meeting goes into its next ones with what that leaves it.
    """
    both = pairs.join(lost.select(F.col("claim_id").alias("prior_claim_id"), F.col("at").alias("_lost")), "prior_claim_id", "left")
    power = F.col("prior_authority") + F.when(F.col("_lost") < F.col("at"), VERIFICATION_SCORE["contradicted"]).otherwise(F.col("prior_verification"))
    meeting = F.struct("nth", "prior_claim_id", "may", "opposite", power.alias("power"))
    each = both.groupBy("claim_id").agg(F.first("at").alias("at"), F.first("authority").alias("authority"), F.first("verification").alias("verification"), F.array_sort(F.collect_list(meeting)).alias("m"))
    edge = "array<struct<prior_claim_id: string, supersedes: boolean, opposite: boolean, wins: boolean>>"

    def step(acc, m):
        mine = F.col("authority") + F.when(acc["lost"], VERIFICATION_SCORE["contradicted"]).otherwise(F.col("verification"))
        one = F.struct(m["prior_claim_id"].alias("prior_claim_id"), (m["may"] & (mine >= m["power"])).alias("supersedes"), m["opposite"].alias("opposite"), (m["opposite"] & (mine > m["power"])).alias("wins"))
        return F.struct((acc["lost"] | (m["opposite"] & (mine < m["power"]))).alias("lost"), F.concat(acc["met"], F.array(one)).alias("met"))

    folded = F.aggregate("m", F.struct(F.lit(False).alias("lost"), F.array().cast(edge).alias("met")), step)
    return each.select("claim_id", "at", folded.alias("_f")).select("claim_id", "at", "_f.lost", "_f.met")


def reconcile_in_order(claims: DataFrame, order: tuple[str, ...] = ("valid_from", "claim_id"), max_rounds: int = 1000) -> DataFrame:
    """Exact sequential reconciliation: each claim sees what the ones before it changed.

    Whom a claim meets hangs on the order alone: the newest CANDIDATES of the
    claims before it with its key or subject. What changes on the way is when a
    claim is contradicted. Those times are a fixpoint, found in rounds: all
    meetings are judged at once with the times known so far, a claim's own few
    in order, which gives new times; once they stay, each claim has met the
    others as they were. A time is right as soon as all earlier ones that bear
    on it are, so rounds are as many as contradictions follow from one another,
    not as claims. A round shuffles the meetings, at most CANDIDATES a claim, by
    prior claim and by claim; a claim is met by some CANDIDATES later ones a key,
    so no group of claims comes together in one task but to be sorted.

    ``claim_id`` is unique; null keys and subjects are equal; only admitted
    claims count. No claims give no edges.
    """
    admitted = claims.where("admitted")
    score = lambda c: (lookup(F.col(f"{c}authority"), AUTHORITY_SCORE, 10).alias(f"{c}authority"), lookup(F.col(f"{c}verification"), VERIFICATION_SCORE, 1).alias(f"{c}verification"))
    found = _earlier(admitted, "claim_key", order).unionByName(_earlier(admitted, "subject", order)).distinct()
    prior = admitted.select(*[F.col(c).alias(f"prior_{c}") for c in ("claim_id", "claim_type", "polarity", "authority", "verification", "valid_from", "created_at")])
    both = found.join(prior, "prior_claim_id").join(admitted.select("claim_id", "claim_type", "polarity", "authority", "verification", F.struct(*order).alias("at")), "claim_id")
    nth = F.row_number().over(Window.partitionBy("claim_id").orderBy(F.desc("prior_valid_from"), F.desc("prior_created_at"), F.desc("prior_claim_id")))
    said = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    opposite = said("polarity") & said("prior_polarity") & (F.col("polarity") != F.col("prior_polarity"))
    may = F.coalesce(may_supersede(F.col("claim_type"), F.col("prior_claim_type")), F.lit(False))
    pairs = fresh(both.withColumn("nth", nth).where(F.col("nth") <= CANDIDATES).select("claim_id", "at", "nth", "prior_claim_id", may.alias("may"), F.coalesce(opposite, F.lit(False)).alias("opposite"), *score(""), *score("prior_")))
    # A pair that agrees changes nothing: rounds go over claims with an opposite one.
    opposed = fresh(pairs.join(pairs.where("opposite").select("claim_id").distinct(), "claim_id", "left_semi"))
    lost = fresh(opposed.select("claim_id", "at").limit(0))
    for _ in range(max_rounds):
        met = _meetings(opposed, lost)
        events = met.select(F.when(F.col("lost"), F.col("claim_id")).alias("claim_id"), "at").where("claim_id is not null")
        events = events.unionByName(met.select(F.explode(F.filter("met", lambda m: m["wins"])).alias("m"), "at").select(F.col("m.prior_claim_id").alias("claim_id"), "at"))
        now = fresh(events.groupBy("claim_id").agg(F.min("at").alias("at")))
        same = now.join(lost.withColumnRenamed("at", "_was"), "claim_id", "full").where("not (at <=> _was)").isEmpty()
        lost = now
        if same:
            break
    else:
        raise RuntimeError(f"contradictions still move after {max_rounds} rounds")
    each = _meetings(pairs, lost).select("claim_id", F.explode("met").alias("m"))
    kinds = F.array_compact(F.array(F.when(F.col("m.supersedes"), "supersedes"), F.when(F.col("m.opposite"), "contradicts").otherwise("confirms")))
    return each.select("claim_id", F.col("m.prior_claim_id").alias("prior_claim_id"), F.explode(kinds).alias("relation")).withColumn("weight", lookup(F.col("relation"), WEIGHTS, None))


def outcome(edges: DataFrame) -> DataFrame:
    """Counters of a pass."""
    return edges.agg(*[F.count_if(F.col("relation") == r).alias(r) for r in WEIGHTS], F.count("loser").alias("contradicted"))
