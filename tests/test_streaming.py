from datetime import datetime, timedelta

from pyspark.sql import functions as F

import pytest

from loomspan.operators.events import episodes_of, turn_ids
from loomspan.streaming import jobs, sessions

T0 = datetime(2025, 1, 1)
SCHEMA = "session_id string, event_id string, idempotency_key string, ordinal long, event_type string, message string, command string, tool_name string, file_path string, exit_code int, created_at timestamp"


def rows(n=20):
    kinds = ("prompt", "prompt", "command", "error")
    return [(f"s{i % 2}", f"e{i}", f"k{i}", i, kinds[i // 3 % 4], "text of it", None, None, None, None, T0 + timedelta(minutes=i * (20 if i % 7 == 0 else 1))) for i in range(n)]


def stream(spark, tmp_path, data, files=2):
    df = spark.createDataFrame(data, SCHEMA)
    for k in range(files):
        df.where((F.col("ordinal") >= len(data) * k // files) & (F.col("ordinal") < len(data) * (k + 1) // files)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def drain(df, spark, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_stateful_episodes_match_batch(spark, tmp_path):
    data = sorted(rows(24), key=lambda r: r[-1])
    data = [(*r[:3], i, *r[4:]) for i, r in enumerate(data)]
    df, live = stream(spark, tmp_path, data)
    got = drain(sessions.streaming_episodes(live, cap=3), spark, "episodes_out")
    want = {r.event_id: r.episode for r in episodes_of(df, cap=3).collect()}
    assert {r.event_id: r.episode for r in got.collect()} == want


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def test_sessions_as_state_match_batch(spark, tmp_path, rocks):
    data = sorted(rows(24), key=lambda r: r[-1])
    data = [(*r[:3], i, *r[4:]) for i, r in enumerate(data)]
    # The same key again in the other batch, the same event id under a new key, and what follows a duplicate only.
    late = T0 + timedelta(hours=8)
    more = [("s0", "other", data[0][2], 24), ("s0", data[2][1], "fresh", 25), ("s0", "third", "fresh", 26), ("s1", None, None, 27), ("s1", None, None, 28)]
    df, live = stream(spark, tmp_path, data + [(*m, "prompt", "more", None, None, None, None, late) for m in more])
    q = sessions.ingest(live, str(tmp_path / "out"), str(tmp_path / "check"), cap=3).start()
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert set(df.columns) < set(got.columns) and "duplicate" not in got.columns
    fresh = df.where("ordinal not in (24, 25)")
    want = turn_ids(episodes_of(fresh, cap=3))
    pick = lambda d: sorted((r.ordinal, r.session_id, r.episode_type, r.episode, r.turn) for r in d.collect())
    assert pick(got) == pick(want)


def test_idle_sessions_lose_their_state(spark, tmp_path, rocks):
    at = lambda k, days, key="k": ("s0", f"e{k}", key, k, "prompt", "text", None, None, None, None, T0 + timedelta(days=days))
    # The watermark of a batch is that of the batches before it, and an empty batch follows it.
    data = [at(0, 0), ("s1", "x", "x", 1, "prompt", "", None, None, None, None, T0 + timedelta(days=9)), at(2, 9.5)]
    _, live = stream(spark, tmp_path, data, files=3)
    q = sessions.ingest(live, str(tmp_path / "out"), str(tmp_path / "check"), idle_seconds=86400).start()
    q.processAllAvailable()
    q.stop()
    kept = {r.event_id: r.episode for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert kept == {"e0": 1, "x": 1, "e2": 1}


def test_dedupe_and_active(spark, tmp_path):
    df, live = stream(spark, tmp_path, rows() + rows()[:4], 1)
    assert drain(sessions.deduplicated(live), spark, "dedupe_out").count() == 20
    known = spark.createDataFrame([("s0", "active"), ("s1", "completed")], "session_id string, status string")
    yes, no = sessions.admitted(df, known)
    assert {r.session_id for r in yes.collect()} == {"s0"} and {r.session_id for r in no.collect()} == {"s1"}


def test_ingest_is_idempotent(spark, tmp_path):
    put = sessions.ingest_batch(str(tmp_path / "out"))
    a, b = spark.createDataFrame(rows(10), SCHEMA), spark.createDataFrame(rows(15), SCHEMA)
    for number, batch in ((0, a), (1, b), (1, b)):
        put(batch, number)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 15


def test_job_queue(spark):
    s = spark.createDataFrame([("x", T0)], "session_id string, created_at timestamp")
    fresh = jobs.plan(s).withColumns({"available_at": F.lit(T0), "created_at": F.lit(T0)})
    queue = jobs.enqueue(jobs.empty_queue(spark), fresh)
    assert queue.count() == 5 and jobs.enqueue(queue, fresh).count() == 5
    now = F.lit(T0 + timedelta(minutes=1))
    assert [r.job_type for r in jobs.claim(queue, now, 2).collect()] == ["session_replay", "reconcile_claims"]
    first = jobs.claim(queue, now).select("job_id").withColumn("ok", F.lit(False))
    after = jobs.finish(queue, first, now).where("attempts = 1").first()
    assert after.status == "pending" and after.available_at == T0 + timedelta(minutes=1, seconds=5)
    waits = spark.createDataFrame([(n,) for n in range(1, 7)], "n int").select(jobs.backoff(F.col("n")).alias("w"))
    assert [r.w for r in waits.collect()] == [5, 10, 20, 40, 60, 60]


def test_session_windows(spark, tmp_path):
    df, live = stream(spark, tmp_path, rows(12), 1)
    got = drain(sessions.session_windows(live, delay="0 seconds"), spark, "windows_out", "append")
    assert got.columns == ["session_id", "started_at", "ended_at", "events"]
