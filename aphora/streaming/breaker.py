"""The circuit-breaker state as a stream: three numbers per endpoint.

Every micro-batch is worked on with the batch operator, so a hot endpoint is spread over time chunks. A call that arrives
in a later batch counts as later, as it would for a live breaker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from aphora.operators.health import STATE_SCHEMA, Breaker, breaker_step
from aphora.streaming import generations
from aphora.streaming.jobs import run_batches

CALL_STATES = "endpoint string, call_id bigint, ts timestamp_ntz, allowed boolean, state string, failures int"


def run_breaker(calls: DataFrame, out: str, state: str, checkpoint: str, breaker: Breaker = Breaker(),
                chunk_ms: int = 3_600_000, trigger: dict | None = None, fanout: int = generations.FANOUT) -> StreamingQuery:
    """Write the states after every call, batch by batch.

    Batch n starts from the states batch n - 1 left behind; both folders of a batch are overwritten when it is
    repeated, so the result is the same after a failure. Older states are removed, and the folders of earlier batches of calls
    merged, so that the number of folders grows as the logarithm of the number of batches.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = generations.read(spark, state, STATE_SCHEMA, before=batch_id, after=batch_id - 2).drop("_last")
        # The entries are what both results come from.
        states, after, entries = breaker_step(batch, before, breaker, chunk_ms)
        generations.write_batch(states, out, batch_id)
        generations.write_batch(after, state, batch_id)
        entries.unpersist()
        generations.forget(spark, state, batch_id - 1)
        generations.compact(spark, out, CALL_STATES, batch_id, lambda rows: rows.drop("_last"), fanout, whole=False)

    return run_batches(calls, write, checkpoint, trigger=trigger)


def breaker_calls(spark: SparkSession, out: str) -> DataFrame:
    """The states after every call, as ``run_breaker`` wrote them."""
    return generations.read(spark, out, CALL_STATES).drop("_last")
