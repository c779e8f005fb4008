"""Work queues as tables: active-deduped enqueue, claiming, back-off, collapse of redundant jobs, replays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ACTIVE = ("pending", "running")
# Jobs of a completed session and their priorities, lower first.
PLAN = (("session_replay", 20), ("reconcile_claims", 40), ("derive_session", 50), ("build_graph", 60), ("sync_vectors", 70))
HEAVY = ("build_graph",)
BASE_SECONDS, MOST_SECONDS, MAX_ATTEMPTS = 5, 60, 5


def plan(sessions: DataFrame) -> DataFrame:
    """The jobs of completed sessions; where ``unresolved_risk`` is told, only sessions that have one are replayed."""
    jobs = F.array(*[F.struct(F.lit(k).alias("job_type"), F.lit(p).alias("priority")) for k, p in PLAN])
    risky = F.coalesce("unresolved_risk", F.lit(False)) if "unresolved_risk" in sessions.columns else F.lit(True)
    each = sessions.select("session_id", risky.alias("_risk"), F.explode(jobs).alias("j")).where((F.col("j.job_type") != "session_replay") | F.col("_risk"))
    return each.select("session_id", "j.job_type", "j.priority", F.concat_ws(":", "j.job_type", "session_id").alias("dedupe_key"))


def enqueue(queue: DataFrame, fresh: DataFrame) -> DataFrame:
    """The queue with fresh jobs: an active job of the same dedupe key takes the least priority and time instead."""
    new = fresh.groupBy("dedupe_key").agg(F.min("priority").alias("_p"), F.min("available_at").alias("_a"), F.min_by("job_type", "priority").alias("_t"), F.min("created_at").alias("_c"))
    active = queue.where(F.col("status").isin(*ACTIVE))
    raised = queue.join(new, "dedupe_key", "left").withColumns({
        "priority": F.when(F.col("status").isin(*ACTIVE), F.least("priority", "_p")).otherwise(F.col("priority")),
        "available_at": F.when(F.col("status").isin(*ACTIVE), F.least("available_at", "_a")).otherwise(F.col("available_at")),
    }).select(*queue.columns)
    added = new.join(active.select("dedupe_key").distinct(), "dedupe_key", "left_anti")
    values = {"job_type": F.col("_t"), "priority": F.col("_p"), "available_at": F.col("_a"), "created_at": F.col("_c"), "status": F.lit("pending"), "attempts": F.lit(0), "job_id": F.sha2(F.concat_ws(":", "dedupe_key", F.col("_c").cast("string")), 256)}
    return raised.unionByName(added.select(*[values.get(c, F.col(c) if c == "dedupe_key" else F.lit(None)).cast(dict(queue.dtypes)[c]).alias(c) for c in queue.columns]))


def claim(queue: DataFrame, now: Column, n: int = 1, heavy: int = 1) -> DataFrame:
    """The next n available jobs by priority and age, of heavy kinds at most ``heavy``."""
    ready = queue.where((F.col("status") == "pending") & (F.col("available_at") <= now))
    order = [F.asc("priority"), F.asc("created_at"), F.asc("job_id")]
    few = ready.where(~F.col("job_type").isin(*HEAVY)).orderBy(*order).limit(n).unionByName(ready.where(F.col("job_type").isin(*HEAVY)).orderBy(*order).limit(heavy))
    return few.orderBy(*order).limit(n)


def backoff(attempts: Column) -> Column:
    """Seconds until the next try: 5 doubled each time, 60 at most."""
    return F.least(F.lit(MOST_SECONDS), F.lit(BASE_SECONDS) * F.pow(F.lit(2), F.least(F.lit(10), F.greatest(F.lit(0), attempts - 1)))).cast("int")


def finish(queue: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """The queue after results (job_id, ok): completed, or pending again after a back-off, or poisoned at the last try."""
    r = results.groupBy("job_id").agg(F.bool_or("ok").alias("_ok"))
    tries = F.col("attempts") + 1
    failed = F.col("_ok") == F.lit(False)
    out = queue.join(r, "job_id", "left")
    return out.withColumns({
        "status": F.when(F.col("_ok"), "completed").when(failed & (tries >= MAX_ATTEMPTS), "poisoned").when(failed, "pending").otherwise(F.col("status")),
        "attempts": F.when(F.col("_ok").isNotNull(), tries).otherwise(F.col("attempts")),
        "available_at": F.when(failed, F.timestamp_seconds(F.unix_timestamp(now) + backoff(tries))).otherwise(F.col("available_at")),
    }).select(*queue.columns)


def collapse(queue: DataFrame, key: str = "project_id") -> DataFrame:
    """Pending graph builds of a project: the newest stays, the others are completed."""
    w = Window.partitionBy(key, "job_type", "status").orderBy(F.desc("created_at"), F.desc("job_id"))
    old = (F.col("job_type") == "build_graph") & (F.col("status") == "pending") & (F.row_number().over(w) > 1)
    return queue.withColumn("status", F.when(old, "completed").otherwise(F.col("status")))


def replay_states(replays: DataFrame, done: DataFrame) -> DataFrame:
    """Replays whose sessions are done go from queued to ready."""
    d = done.select("session_id").distinct().withColumn("_done", F.lit(True))
    ready = (F.col("status") == "queued") & F.col("_done")
    return replays.join(d, "session_id", "left").withColumn("status", F.when(ready, "ready").otherwise(F.col("status"))).drop("_done")


def empty_queue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "job_id string, dedupe_key string, job_type string, project_id string, status string, priority int, attempts int, available_at timestamp, created_at timestamp")
