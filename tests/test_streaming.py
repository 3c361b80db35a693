import os

import pytest
from pyspark.sql import functions as F

from aphora.operators import health, series
from aphora.streaming import breaker, generations, jobs, late, once
from tests.helpers import ntz, tuples

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string"


@pytest.fixture
def feed(spark, tmp_path):
    """Event files that arrive one after the other, and folders for the output."""
    class Feed:
        folder = str(tmp_path / "in")
        out = str(tmp_path / "out")
        checkpoint = str(tmp_path / "checkpoint")
        rows: list = []

        def add(self, rows):
            n = len(os.listdir(self.folder)) if os.path.isdir(self.folder) else 0
            os.makedirs(self.folder, exist_ok=True)
            spark.createDataFrame(rows, SCHEMA).toPandas().to_parquet(f"{self.folder}/{n:03d}.parquet", coerce_timestamps="us", index=False)
            self.rows = self.rows + rows

        def stream(self):
            return jobs.event_stream(spark, self.folder, SCHEMA, files_per_batch=1)

        def run(self, job):
            jobs.run_append(job(self.stream()), self.out, self.checkpoint)
            return spark.read.parquet(self.out)

        def batch(self):
            return spark.createDataFrame(self.rows, SCHEMA)

    return Feed()


def events(start, end, step=20, users=3, day=1):
    return [(i, ntz(i * step, day), i % users, "error" if i % 3 else "view") for i in range(start, end)]


def test_restart_and_late_file(spark, feed):
    """Three files, a restart after two, and a late file: windows equal the batch up to the watermark."""
    job = lambda s: jobs.rate_windows(s, "user_id", width="5 minutes", delay="10 minutes")
    feed.add(events(0, 100))
    feed.add(events(100, 200))
    first = tuples(feed.run(job).withColumn("window_start", F.col("window_start").cast("timestamp_ntz")), "user_id", "window_start", "n")
    on_time = series.tumbling_counts(feed.batch(), "user_id", "ts", "5 minutes")
    done = F.lit(ntz(199 * 20 - 600)).cast("timestamp_ntz")
    assert first == tuples(on_time.where(F.col("window_end") <= done), "user_id", "window_start", "n")
    feed.add([(900, ntz(1), 0, "view")])
    feed.add(events(200, 300))
    second = tuples(feed.run(job).withColumn("window_start", F.col("window_start").cast("timestamp_ntz")), "user_id", "window_start", "n")
    without_late = series.tumbling_counts(feed.batch().where("event_id <> 900"), "user_id", "ts", "5 minutes")
    done = F.lit(ntz(299 * 20 - 600)).cast("timestamp_ntz")
    assert second == tuples(without_late.where(F.col("window_end") <= done), "user_id", "window_start", "n")


def test_copies_are_consumed_once(spark, feed):
    job = lambda s: jobs.consume_once(s, ["event_id", "event_type"])
    feed.add(events(0, 40))
    feed.add(events(20, 60))
    assert feed.run(job).count() == 60
    feed.add(events(0, 60))
    assert feed.run(job).count() == 60


def test_sessions_equal_batch(spark, feed):
    feed.add(events(0, 30, step=400))
    feed.add(events(30, 60, step=400))
    feed.add([(999, ntz(0, 3), 0, "view")])
    got = feed.run(lambda s: jobs.session_windows(s, "user_id", gap="10 minutes"))
    want = series.activity_sessions(feed.batch().where("event_id < 999"), "user_id", "ts", 600)
    assert tuples(got.withColumn("last_event", F.col("last_event").cast("timestamp_ntz")), "user_id", "last_event", "events") == \
        tuples(want, "user_id", "last_event", "events")


def test_counters_follow(spark, feed):
    for part in ((0, 30), (30, 50), (50, 90)):
        feed.add(events(*part))
    jobs.run_counters(feed.stream(), ["user_id"], feed.out, feed.checkpoint)
    got = jobs.current_counters(spark, feed.out, ["user_id"], "user_id bigint")
    assert tuples(got, "user_id", "n") == tuples(feed.batch().groupBy("user_id").agg(F.count("*").alias("n")))
    assert generations.live_spans(spark, feed.out) == [(0, 0), (1, 1), (2, 2)]


def test_counters_are_compacted(spark, feed, monkeypatch):
    """Ten batches with a fanout of three; one merge fails in its middle, and the stream starts again."""
    for i in range(10):
        feed.add(events(i * 7, i * 7 + 7))
    real, calls = jobs._newest, []

    def failing(rows, keys):
        calls.append(1)
        if len(calls) == 2:
            broken = F.raise_error(F.lit("lost")).cast("bigint")
            return real(rows, keys).withColumn("n", F.when(F.col("user_id") >= 0, broken))
        return real(rows, keys)

    monkeypatch.setattr(jobs, "_newest", failing)
    with pytest.raises(Exception, match="lost"):
        jobs.run_counters(feed.stream(), ["user_id"], feed.out, feed.checkpoint, fanout=3)
    folders = set(os.listdir(feed.out))
    assert len(folders) > len(generations.live_spans(spark, feed.out))  # the merge that failed is there and overlooked
    monkeypatch.setattr(jobs, "_newest", real)
    jobs.run_counters(feed.stream(), ["user_id"], feed.out, feed.checkpoint, fanout=3)
    got = jobs.current_counters(spark, feed.out, ["user_id"], "user_id bigint")
    assert tuples(got, "user_id", "n") == tuples(feed.batch().groupBy("user_id").agg(F.count("*").alias("n")))
    live = generations.live_spans(spark, feed.out)
    assert live[0][0] == 0 and live[0][1] > 0 and len(live) <= 4
    assert len([f for f in os.listdir(feed.out) if f.startswith("span=")]) <= 2 * 4 + 1


def test_tiers_of_merged_folders():
    spans, rewritten = [], 0
    for batch in range(300):
        spans.append((batch, batch))
        due = generations._due([s for s in spans if s[1] < batch], 4, whole=False)
        if due:
            inside = [s for s in spans if due[0] <= s[0] and s[1] <= due[1]]
            assert inside[0][0] == due[0] and inside[-1][1] == due[1]
            rewritten += due[1] - due[0] + 1
            spans = sorted([s for s in spans if s not in inside] + [due])
        assert [s[0] for s in spans[1:]] == [s[1] + 1 for s in spans[:-1]]
        assert len(spans) <= 4 * 5 + 1
    assert rewritten <= 300 * 5


def test_events_once_whatever_the_delay(spark, feed, tmp_path):
    """Copies within a batch, in the next one, and days later; also after merges, a restart and a repeated batch."""
    parts = [events(0, 30) + events(0, 5), events(20, 50), events(50, 60, day=9), events(0, 60), [(1, ntz(5, 20), 0, "view"), (99, None, 0, "view")], [(99, None, 0, "view")], events(60, 70)]
    for part in parts:
        feed.add(part)
        for _ in range(2):
            once.consume_ever_once(feed.stream(), ["event_id"], feed.out, str(tmp_path / "history"), feed.checkpoint, bitmaps=8, fanout=3)
    got = once.consumed(spark, feed.out, SCHEMA.replace("timestamp_ntz", "timestamp"))
    assert sorted(r.event_id for r in got.collect()) == sorted({r[0] for r in feed.rows})
    assert got.where("event_id = 1").first().ts.day == 1


def test_a_filter_that_always_says_yes_loses_nothing(spark, feed, tmp_path, monkeypatch):
    monkeypatch.setattr(once, "_places", lambda: F.array(F.lit(3).cast("bigint")))
    for part in (events(0, 20), events(10, 40), events(100, 120)):
        feed.add(part)
    once.consume_ever_once(feed.stream(), ["event_id"], feed.out, str(tmp_path / "history"), feed.checkpoint, bitmaps=1)
    assert once.consumed(spark, feed.out, SCHEMA.replace("timestamp_ntz", "timestamp")).count() == 60


def test_filters_tell_ids_apart(spark):
    ids = spark.range(3000).select(F.to_date(F.lit("2024-01-01")).alias("day"), F.col("id").cast("string").alias("id"))
    filters = once.day_filters(ids, bitmaps=4)
    assert once.maybe_seen(ids.select("id"), filters, bitmaps=4).count() == 3000
    others = spark.range(10_000, 13_000).select(F.col("id").cast("string").alias("id"))
    assert once.maybe_seen(others, filters, bitmaps=4).count() < 150


def test_late_events_are_kept(spark, feed, tmp_path):
    """Batches are dealt by the watermark the one before left; a run again changes nothing."""
    parts = [events(0, 100), [(900, ntz(1), 0, "view"), (901, ntz(99 * 20 - 599), 0, "view"), (902, None, 0, "view")], events(100, 130), [(903, ntz(99 * 20), 1, "view")]]
    for part in parts:
        feed.add(part)
        for _ in range(2):
            late.split_late(feed.stream(), feed.out, str(tmp_path / "late"), str(tmp_path / "marks"), feed.checkpoint)
    schema = SCHEMA.replace("timestamp_ntz", "timestamp")
    good = late.events_in(spark, feed.out, schema)
    bad = late.events_in(spark, str(tmp_path / "late"), f"{schema}, watermark timestamp")
    assert sorted(r.event_id for r in bad.collect()) == [900, 902]
    assert sorted(r.event_id for r in good.collect()) == [*range(130), 901, 903]
    assert {r.watermark.hour * 3600 + r.watermark.minute * 60 + r.watermark.second for r in bad.collect()} == {99 * 20 - 600}


def test_late_windows(spark, feed, tmp_path):
    """An event whose window is still open is in time, however far it is behind."""
    for part in (events(0, 100), [(900, ntz(1), 0, "view"), (901, ntz(1300), 0, "view")]):
        feed.add(part)
    closes = F.window("ts", "30 minutes").getField("end")
    late.split_late(feed.stream(), feed.out, str(tmp_path / "late"), str(tmp_path / "marks"), feed.checkpoint, delay="1 minute", closes=closes)
    bad = late.events_in(spark, str(tmp_path / "late"), f"{SCHEMA.replace('timestamp_ntz', 'timestamp')}, watermark timestamp")
    assert sorted(r.event_id for r in bad.collect()) == [900, 901]


def test_ingest_by_day(spark, feed):
    feed.add(events(0, 10))
    feed.add(events(10, 20, day=2))
    jobs.ingest_events(feed.stream(), feed.out, feed.checkpoint)
    jobs.ingest_events(feed.stream(), feed.out, feed.checkpoint)
    stored = spark.read.parquet(feed.out)
    assert stored.count() == 20 and stored.select("dt").distinct().count() == 2


def test_attempts(spark, feed):
    feed.add([(i, ntz(i * 60), 1, "error") for i in range(6)] + [(50, ntz(0, 2), 1, "error")])
    got = feed.run(lambda s: jobs.attempt_windows(s, "user_id", threshold=5, width="15 minutes", slide="5 minutes"))
    assert sorted(r.attempts for r in got.collect()) == [5, 6, 6]


def test_metrics(spark, feed):
    feed.add(events(0, 10, step=600) + [(99, ntz(0, 2), 1, "view")])
    got = feed.run(lambda s: jobs.metric_rollup(s, "event_type", "user_id"))
    assert sum(r.n for r in got.collect()) == 10
    assert all(float(r.min_value) <= r.avg_value <= float(r.max_value) for r in got.collect())


def test_breaker_batches_continue(spark, feed, tmp_path):
    """Three batches, the last one partly older than the one before: the states are those of one run in that order."""
    from tests.test_health import step_by_step

    rows = [(i, ntz(i * 9), i % 2, "error" if i % 5 else "view") for i in range(120)]
    parts = [rows[:50], rows[70:], rows[50:70]]
    want = []
    for user in (0, 1):
        ordered = [r for part in parts for r in part if r[2] == user]
        want += step_by_step([(i, ts, kind == "error") for i, ts, _, kind in ordered], health.Breaker())[0]

    def calls(df):
        return df.select(F.concat(F.lit("e"), F.col("user_id").cast("string")).alias("endpoint"), F.col("event_id").alias("call_id"), "ts",
                         F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("outcome"))

    for part in parts:
        feed.add(part)
        breaker.run_breaker(calls(feed.stream()), feed.out, str(tmp_path / "state"), feed.checkpoint, chunk_ms=60_000)
    assert tuples(breaker.breaker_calls(spark, feed.out), "call_id", "allowed", "state", "failures") == sorted(want)


def test_breaker_equals_batch_and_stays_small(spark, feed, tmp_path):
    """Twelve batches: the states are those of one run, two states are kept and old batches are merged."""
    rows = [(i, ntz(i * 9), i % 2, "error" if i % 5 else "view") for i in range(120)]
    for i in range(12):
        feed.add(rows[i * 10 : i * 10 + 10])

    def calls(df):
        return df.select(F.concat(F.lit("e"), F.col("user_id").cast("string")).alias("endpoint"), F.col("event_id").alias("call_id"), "ts",
                         F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("outcome"))

    state = str(tmp_path / "state")
    breaker.run_breaker(calls(feed.stream()), feed.out, state, feed.checkpoint, fanout=3, trigger={"availableNow": True}).awaitTermination()
    columns = ["endpoint", "call_id", "allowed", "state", "failures"]
    assert tuples(breaker.breaker_calls(spark, feed.out), *columns) == tuples(health.breaker_states(calls(feed.batch())), *columns)
    assert len(generations.live_spans(spark, state)) == 2 and len(generations.live_spans(spark, feed.out)) <= 8


def test_logs(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text("[2024-01-31T10:00:00.000Z] [INFO] one\nnot a log line\n")
    (folder / "b.log").write_text('[2024-01-31T10:00:01.000Z] [WARN] [r] two {"n":1}\n')
    out, bad, checkpoint = (str(tmp_path / n) for n in ("good", "bad", "cp"))
    for _ in range(2):
        jobs.ingest_logs(jobs.log_stream(spark, str(folder), 1), out, bad, checkpoint)
    assert tuples(spark.read.parquet(out), "level", "message") == [("INFO", "one"), ("WARN", "two")]
    assert [r.line for r in spark.read.parquet(bad).collect()] == ["not a log line"]


def test_over_rate(spark, feed):
    feed.add([(i, ntz(i), 7, "view") for i in range(70)] + [(99, ntz(0, 2), 7, "view")])
    got = feed.run(lambda s: jobs.over_rate(s, "user_id", limit=50))
    assert [r.n for r in got.collect()] == [60]
