import random

import pytest
from pyspark.sql import functions as F

from aphora.operators import health
from tests.helpers import ntz, tuples

CALLS = "endpoint string, call_id bigint, ts timestamp_ntz, outcome string"


def step_by_step(calls, breaker):
    """The rule, one call after the other."""
    state, failures, last, out = "closed", 0, None, []
    for call_id, ts, failed in calls:
        if state == "open":
            if (ts - last).total_seconds() * 1000 > breaker.reset_ms:
                state, failures = "half-open", 0
            else:
                out.append((call_id, False, state, failures))
                continue
        if failed:
            failures, last = failures + 1, ts
            if failures >= breaker.threshold:
                state = "open"
        elif state == "half-open":
            state, failures = "closed", 0
        out.append((call_id, True, state, failures))
    return out, (state, failures, last)


def frame(spark, calls, endpoint="e"):
    return spark.createDataFrame([(endpoint, i, t, "failure" if f else "success") for i, t, f in calls], CALLS)


def run(spark, outcomes, step=1.0):
    calls = [(i, ntz(i * step), o == "F") for i, o in enumerate(outcomes)]
    rows = health.breaker_states(frame(spark, calls)).orderBy("call_id").collect()
    return [(r.state, r.failures, r.allowed) for r in rows]


def test_five_failures_open(spark):
    assert run(spark, "FSFFF")[-1] == ("closed", 4, True)
    got = run(spark, "FSFFSFFS")
    assert got[6] == ("open", 5, True) and got[7] == ("open", 5, False)


def test_half_open(spark):
    # The 31st second after the last failure is the first one that is more than the reset time away.
    got = run(spark, "FFFFF" + "S" * 32)
    assert [s for s, _, _ in got[4:35]] == ["open"] * 31 and not any(a for _, _, a in got[5:35])
    assert got[35] == ("closed", 0, True)
    got = run(spark, "FFFFF" + "S" * 30 + "FFFFF")
    assert [g[0] for g in got[35:]] == ["half-open"] * 4 + ["open"]
    assert got[36][1] == 2


@pytest.mark.parametrize("seed", range(6))
def test_chunks_do_not_matter(spark, seed):
    rng = random.Random(seed)
    breaker = health.Breaker(rng.choice([1, 2, 5]), rng.choice([2000, 30000]))
    rate, calls, at = rng.choice([0.3, 0.7, 0.95]), [], 0.0
    for i in range(700):
        at += rng.choice([0, 0.4, 1, 1, 5, 31])
        calls.append((i, ntz(at), rng.random() < rate))
    quiet = [(1000 + i, ntz(i * 40), i % 3 == 0) for i in range(20)]
    df = frame(spark, calls).unionByName(frame(spark, quiet, "quiet"))
    want, end = step_by_step(calls, breaker)
    others, _ = step_by_step(quiet, breaker)
    for chunk_ms, max_calls in ((30_000, 10**6), (60_000, 10**6), (86_400_000, 10**6), (1_000_000, 20)):
        got = health.breaker_states(df, breaker, chunk_ms, max_calls)
        assert tuples(got, "call_id", "allowed", "state", "failures") == sorted(want + others)
    status = health.breaker_status(df, F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"), breaker, 60_000).where("endpoint = 'e'").first()
    assert (status.state, status.failures, status.last_failure) == end
    if end[2] is not None:
        assert status.ms_since_last_failure == int((ntz(0, 5) - end[2]).total_seconds() * 1000)


def test_status_without_failures(spark):
    status = health.breaker_status(frame(spark, [(1, ntz(1), False)]), F.lit("2024-01-05").cast("timestamp_ntz")).first()
    assert (status.state, status.failures, status.last_failure, status.ms_since_last_failure) == ("closed", 0, None, None)


def test_chunks_cover_the_reset_time(spark):
    with pytest.raises(ValueError):
        health.breaker_states(frame(spark, [(1, ntz(1), False)]), chunk_ms=1000)


def test_chunks_survive_batch_boundaries(spark):
    calls = [(i, ntz(i * 0.01), i % 7 == 0) for i in range(5000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "333")
    try:
        got = tuples(health.breaker_states(frame(spark, calls), chunk_ms=30_000), "call_id", "allowed", "state", "failures")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(step_by_step(calls, health.Breaker())[0])


def test_workers_need_no_copy_of_the_package(tmp_path):
    """What runs in Python workers can be loaded where the package is not installed."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    (tmp_path / "run.pkl").write_bytes(cloudpickle.dumps((health.CallRun, health.Breaker(), health._chunks)))
    code = ("import numpy as np, pandas; from pyspark import cloudpickle; run, breaker, _ = cloudpickle.loads(open('run.pkl', 'rb').read());"
            "print(run(np.arange(6) * 1000, np.ones(6, dtype=bool), breaker).trace(0, 0, -1)[3])")
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, check=True)
    assert done.stdout.strip() == "(2, 5, 4000)"


def test_a_burst_of_one_endpoint_is_cut_by_count(spark):
    """200,000 calls within 50 s: no chunk is held whole beyond the limit and a millisecond's calls."""
    calls = spark.range(0, 200_000, 1, 8).select(
        F.lit("e").alias("endpoint"), F.col("id").alias("call_id"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("id") / 4000).cast("decimal(18,6)"))).alias("ts"),
        F.when(F.col("id") % 9 < 6, "failure").otherwise("success").alias("outcome"))
    chunked = health._chunked(calls, health.Breaker(), 3_600_000, 1000)
    assert chunked.groupBy("chunk").count().agg(F.max("count")).first()[0] <= 1004
    whole = health.breaker_states(calls, max_calls=10**9)
    cut = health.breaker_states(calls, max_calls=1000)
    digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    assert digest(whole) == digest(cut)
