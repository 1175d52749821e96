"""Streams give what their batch twins give, over several triggers and restarts; state expires."""

import time

import pytest
from compare import spark_rows
from pyspark.sql import Row
from pyspark.sql import functions as F

from vocalith.operators import journal as J
from vocalith.plans import fixtures as X
from vocalith.streaming import jobs, state


def events(spark, sf_dir, stream):
    return jobs.read_events(spark, f"{sf_dir}/events.parquet", stream)


@pytest.mark.parametrize("job", [jobs.stream_sliding, jobs.stream_tumbling, jobs.stream_sessions])
def test_windows(spark, sf_dir, tmp_path, job):
    jobs.run_complete(job(events(spark, sf_dir, True)), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert spark_rows(spark.read.parquet(f"{tmp_path}/out")) == spark_rows(job(events(spark, sf_dir, False)))


def test_label_join(spark, sf_dir, tmp_path):
    labels = X.load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    join = lambda df: jobs.stream_label_join(df, labels, "user_id", "c_custkey").select("event_id", "c_mktsegment")
    jobs.run_to_end(join(events(spark, sf_dir, True)), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert spark_rows(spark.read.parquet(f"{tmp_path}/out")) == spark_rows(join(events(spark, sf_dir, False)))


def test_running_best(spark, sf_dir, tmp_path):
    jobs.run_to_end(jobs.stream_running_best(events(spark, sf_dir, True)), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    stream = spark.read.parquet(f"{tmp_path}/out").groupBy("run").agg({"saved": "count_if", "metric": "count"})
    batch = J.running_best(X.journal(spark, sf_dir)).groupBy("run").agg({"saved": "count_if", "metric": "count"})
    assert spark_rows(stream) == spark_rows(batch)


EVENTS = "user_id long, ts timestamp, event_id long, value double, event_type string"


def send(spark, path, rows):
    """rows (user_id, second, event_id, value, event_type) as a further file."""
    df = spark.createDataFrame([(u, s, e, v, k) for u, s, e, v, k in rows], "user_id long, s long, event_id long, value double, event_type string")
    df.select("user_id", F.timestamp_seconds("s").alias("ts"), "event_id", "value", "event_type").coalesce(1).write.mode("append").parquet(path)


def decide(spark, path, **settings):
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    jobs.run_to_end(jobs.stream_running_best(stream, **settings), f"{path}/out", f"{path}/checkpoint", empty_batches=False)
    return sorted((r.run, r.event_id if r.event_id is not None else -1, r.metric, r.saved, r.waited, r.stopped, r.closed) for r in spark.read.parquet(f"{path}/out").collect())


SCORES = [0.5, 0.4, 0.7, 0.7, 0.1, None, 0.9, 0.95]


def judged(scores, patience):
    best, waited, stopped, out = None, 0, False, []
    for k, x in enumerate(scores):
        saved = False
        if not stopped:
            saved = x is not None and (best is None or x > best)
            best, waited = (x, 0) if saved else (best, waited + 1)
            stopped = waited >= patience
        out.append((1, k, x, saved, waited, stopped, False))
    return out


def test_patience_over_triggers_and_restarts(spark, tmp_path):
    """Two files in one run (two triggers), a third one after a restart from the checkpoint; the rows of a file come out of order."""
    rows = [(1, 10 + k, k, x, "run") for k, x in enumerate(SCORES)]
    send(spark, f"{tmp_path}/in", rows[:3][::-1])
    time.sleep(0.1)
    send(spark, f"{tmp_path}/in", rows[3:5][::-1])
    assert decide(spark, tmp_path, patience=3) == judged(SCORES[:5], 3)
    send(spark, f"{tmp_path}/in", rows[5:][::-1])
    got = decide(spark, tmp_path, patience=3)
    assert got == judged(SCORES, 3) and got[-1][5] and not got[-1][3]


def test_another_key(spark, tmp_path):
    send(spark, f"{tmp_path}/in", [(1, 1, 1, 0.5, "run"), (2, 2, 2, 0.4, "run")])
    stream = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in").withColumn("fold", F.lit(7))
    jobs.run_to_end(jobs.stream_running_best(stream, key="fold"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert sorted((r.run, r.event_id, r.saved) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(7, 1, True), (7, 2, False)]


def test_state_expires(spark, tmp_path):
    """After its time to live a run's best is forgotten; with a long one it is not."""
    for name, ttl, saved in (("short", 1, True), ("long", 3_600_000, False)):
        path = tmp_path / name
        send(spark, f"{path}/in", [(1, 1, 1, 0.9, "run")])
        decide(spark, path, ttl_ms=ttl)
        time.sleep(0.2)
        send(spark, f"{path}/in", [(1, 2, 2, 0.3, "run")])
        assert decide(spark, path, ttl_ms=ttl)[-1][3] is saved


def test_idle_runs_are_closed(spark, tmp_path):
    """A timer closes a run from which nothing comes; its last row has the best score, and the run then begins anew."""
    send(spark, f"{tmp_path}/in", [(1, 1, 1, 0.9, "run"), (1, 2, 2, 0.3, "run")])
    decide(spark, tmp_path, idle_ms=1)
    time.sleep(0.2)
    send(spark, f"{tmp_path}/in", [(2, 3, 3, 0.1, "run")])
    got = decide(spark, tmp_path, idle_ms=1)
    assert (1, -1, 0.9, False, 1, True, True) in got
    send(spark, f"{tmp_path}/in", [(1, 4, 4, 0.2, "run")])
    assert (1, 4, 0.2, True, 0, False, False) in decide(spark, tmp_path, idle_ms=1)


def test_quarantine_over_restarts(spark, tmp_path):
    def run(ttl_ms=None):
        stream = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in")
        jobs.stream_quarantine(stream, f"{tmp_path}/good", f"{tmp_path}/late", f"{tmp_path}/checkpoint", ttl_ms=ttl_ms).awaitTermination()
        return [sorted(r.event_id for r in spark.read.schema(EVENTS).parquet(f"{tmp_path}/{x}").collect()) for x in ("good", "late")]

    send(spark, f"{tmp_path}/in", [(1, 10, 1, 0.0, "a"), (1, 9, 2, 0.0, "a"), (1, 10, 3, 0.0, "a"), (2, 5, 4, 0.0, "a")])
    assert run() == [[1, 3, 4], [2]]
    send(spark, f"{tmp_path}/in", [(1, 8, 5, 0.0, "a"), (2, 6, 6, 0.0, "a"), (2, 5, 7, 0.0, "a"), (3, None, 8, 0.0, "a")])
    assert run() == [[1, 3, 4, 6, 8], [2, 5, 7]]


def test_published_contents_expire(spark, tmp_path):
    def run(rows, ttl_ms):
        path = tmp_path / str(ttl_ms)
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema("doc_id long, text string").parquet(f"{path}/in")
        jobs.stream_publish_once(stream, f"{path}/out", f"{path}/conflicts", f"{path}/checkpoint", ttl_ms=ttl_ms).awaitTermination()
        return [sorted((r.doc_id, r.text) for r in spark.read.schema("doc_id long, text string").parquet(f"{path}/{x}").collect()) for x in ("out", "conflicts")]

    first, second = [(1, "a"), (1, "a"), (2, None)], [(1, "b"), (2, None), (3, "c")]
    run(first, None)
    assert run(second, None) == [[(1, "a"), (2, None), (3, "c")], [(1, "b")]]
    run(first, 1)
    time.sleep(0.2)
    assert run(second, 1) == [[(1, "a"), (1, "b"), (2, None), (2, None), (3, "c")], []]


def test_published_once_by_rows():
    """The processor takes rows, whose order does not matter, and asks for its key's state once."""

    class Hash:
        value, asked = None, 0

        def get(self):
            self.asked += 1
            return self.value

        def exists(self):
            raise AssertionError("a second question")

        def update(self, value):
            self.value = value

    processor = state.PublishOnce(None)
    processor.hash = Hash()
    judge = lambda *hashes: [(r.hash__, r.text, r.outcome__) for r in processor.handleInputRows((1,), (Row(doc_id=1, text=f"text {h}", hash__=h) for h in hashes), None)]
    assert judge("c", "a", "c", "b") == [("a", "text a", "new"), ("b", "text b", "conflict"), ("c", "text c", "conflict")]
    assert judge("a") == [("a", "text a", "same")]
    assert judge("b", "a") == [("a", "text a", "same"), ("b", "text b", "conflict")]
    assert processor.hash.asked == 3 and processor.hash.value == ("a",)


def test_a_second_run_adds_nothing(spark, sf_dir, tmp_path):
    for _ in range(2):
        jobs.run_to_end(jobs.stream_dedup(events(spark, sf_dir, True), watermark="400 days"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == out.select("event_id").distinct().count() == events(spark, sf_dir, False).count()
