"""Endpoint health from call logs: the circuit-breaker state after every call.

The rule of one endpoint is sequential: five failures open the breaker, calls are rejected while it is open,
the first call more than the reset time after the last failure is let through half-open with its count at zero,
a success then closes it, and five failures open it again. Failures count up while closed; successes do not
reset them.

An endpoint may have most of all calls, so its calls are never gathered in one task. They are cut into
time chunks, and the work is done in three steps:

1. per chunk, in parallel: how the chunk maps every possible state before it to the state after it;
2. per endpoint: these maps applied one after the other, one short row per chunk;
3. per chunk, in parallel: the states of its calls, now that the state before it is known.

The map of a chunk is small. Closed and half-open have as many variants as the threshold; open depends on when
the breaker lets calls through, and only the calls of the chunk's first reset interval can differ in that.

Steps 1 and 3 hold one chunk at a time, so chunks in which an endpoint is busy are made shorter. Step 2 passes
through an endpoint's maps in order and remembers three numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CLOSED, HALF_OPEN, OPEN = 0, 1, 2
STATE_NAMES = ["closed", "half-open", "open"]
NEVER = -1


@dataclass(frozen=True)
class Breaker:
    """Five failures open the breaker, thirty seconds after the last one calls are tried again."""

    threshold: int = 5
    reset_ms: int = 30_000

    @property
    def reset(self) -> int:
        return self.reset_ms * 1000


class CallRun:
    """Calls of one endpoint in time order, with the lookups the rule needs. Times are in microseconds."""

    def __init__(self, times: np.ndarray, failed: np.ndarray, breaker: Breaker):
        self.times, self.breaker, self.n = times, breaker, len(times)
        self.fail_at = np.append(np.flatnonzero(failed), self.n)
        ok_at = np.append(np.flatnonzero(~failed), self.n)
        self.failures_before = np.concatenate([[0], np.cumsum(failed)])
        self.next_ok = ok_at[np.searchsorted(ok_at, np.arange(self.n + 1))]

    def released(self, at):
        """The first call that is let through after failures at the given times."""
        return np.searchsorted(self.times, at + self.breaker.reset, side="right")

    def opens_closed(self, i, failures):
        """The call that opens a breaker that is closed before call i, or n."""
        place = self.failures_before[i] + self.breaker.threshold - failures - 1
        return self.fail_at[np.minimum(place, len(self.fail_at) - 1)]

    def opens_half(self, i, failures):
        """The call that opens a breaker that is half-open before call i, or n."""
        ok = self.next_ok[i]
        in_run = failures + (ok - i) >= self.breaker.threshold
        later = self.opens_closed(np.minimum(ok + 1, self.n), 0)
        return np.where(in_run, i + self.breaker.threshold - failures - 1, np.where(ok < self.n, later, self.n))

    def rest_half(self, i, failures):
        """State and failures at the end, for a breaker half-open before call i that does not open again."""
        ok = self.next_ok[i]
        closes = ok < self.n
        since = self.failures_before[self.n] - self.failures_before[np.minimum(ok + 1, self.n)]
        return np.where(closes, CLOSED, HALF_OPEN), np.where(closes, since, failures + (self.n - i))

    def last_failure(self, i):
        """The time of the last failure from call i on, or never."""
        if len(self.fail_at) == 1:
            return np.full(np.shape(i), NEVER, dtype=np.int64)
        last = self.fail_at[-2]
        return np.where(last >= i, self.times[last], NEVER)

    def exits(self) -> np.ndarray:
        """For every call i: state, failures and last failure at the end if call i is let through half-open.

        Each opening leads to the next call that is let through. Following these steps for all calls at once, by
        repeatedly doubling them, ends at the call after which the breaker does not open again.
        """
        n, starts = self.n, np.arange(self.n)
        opening = self.opens_half(starts, 0)
        opens = opening < n
        opened_at = self.times[np.minimum(opening, n - 1)]
        following = np.where(opens, self.released(opened_at), n)
        stays_open = opens & (following >= n)
        code, failures = self.rest_half(starts, 0)
        code = np.where(stays_open, OPEN, code)
        failures = np.where(stays_open, self.breaker.threshold, failures)
        last = np.where(stays_open, opened_at, self.last_failure(starts))

        moves = opens & ~stays_open
        step = np.where(moves, following, starts)
        carried = np.where(moves, opened_at, NEVER)
        while True:
            further = step[step]
            carried = np.where(carried[step] != NEVER, carried[step], carried)
            if np.array_equal(further, step):
                break
            step = further
        end_last = np.where(last[step] != NEVER, last[step], carried)
        return np.stack([code[step], failures[step], end_last], axis=1).astype(np.int64)

    def exit_of(self, exits: np.ndarray, code: int, failures: int) -> tuple[int, int, int]:
        """State, failures and last failure at the end for a breaker closed or half-open before the first call."""
        zero = np.int64(0)
        opening = int(self.opens_closed(zero, failures) if code == CLOSED else self.opens_half(zero, failures))
        if opening >= self.n:
            if code == CLOSED:
                code, failures = CLOSED, failures + int(self.failures_before[self.n])
            else:
                code, failures = (int(x) for x in self.rest_half(zero, failures))
            return code, failures, int(self.last_failure(zero))
        opened_at = int(self.times[opening])
        start = int(self.released(opened_at))
        if start >= self.n:
            return OPEN, self.breaker.threshold, opened_at
        code, failures, last = (int(x) for x in exits[start])
        return code, failures, last if last != NEVER else opened_at

    def trace(self, code: int, failures: int, last: int):
        """Whether each call is let through, and state and failures after it; and the state at the end."""
        n, limit = self.n, self.breaker.threshold
        allowed = np.ones(n, dtype=bool)
        states = np.full(n, CLOSED, dtype=np.int64)
        counts = np.zeros(n, dtype=np.int64)

        def closed_until(begin: int, end: int, base: int) -> None:
            counts[begin:end] = base + self.failures_before[begin + 1:end + 1] - self.failures_before[begin]

        i, opening = 0, None
        if code == OPEN:
            opening = -1
        while True:
            if opening is not None:
                start = int(self.released(last))
                allowed[opening + 1:start], states[opening + 1:start], counts[opening + 1:start] = False, OPEN, limit
                if start >= n:
                    return allowed, states, counts, (OPEN, limit, last)
                i, code, failures = start, HALF_OPEN, 0
            at = np.int64(i)
            first = int(self.opens_closed(at, failures) if code == CLOSED else self.opens_half(at, failures))
            end = min(first + 1, n)
            if code == CLOSED:
                closed_until(i, end, failures)
            else:
                ok = min(int(self.next_ok[i]), end)
                states[i:ok] = HALF_OPEN
                counts[i:ok] = failures + np.arange(1, ok - i + 1)
                closed_until(min(ok + 1, n), end, 0)
            seen = int(self.last_failure(at)) if first >= n else int(self.times[first])
            last = seen if seen != NEVER else last
            if first >= n:
                return allowed, states, counts, (int(states[n - 1]), int(counts[n - 1]), last)
            states[first], counts[first] = OPEN, limit
            opening = first


Piece = dict[str, np.ndarray]


def _joined(pieces: list[Piece]) -> Piece:
    return pieces[0] if len(pieces) == 1 else {c: np.concatenate([p[c] for p in pieces]) for c in pieces[0]}


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[list[Piece]]:
    """Whole chunks, as column arrays, out of batches of rows sorted by endpoint, chunk and time.

    There is one list per batch; a chunk that goes on in the next batch is held back until it is complete.
    """
    pending: list[Piece] = []
    for batch in batches:
        columns = {c: batch[c].to_numpy() for c in batch.columns}
        endpoint, chunk = columns["endpoint"], columns["chunk"]
        cuts = np.flatnonzero((endpoint[1:] != endpoint[:-1]) | (chunk[1:] != chunk[:-1])) + 1
        done: list[Piece] = []
        for i, j in zip([0, *cuts], [*cuts, len(batch)]):
            if i == j:
                continue
            if pending and (pending[0]["endpoint"][0] != endpoint[i] or pending[0]["chunk"][0] != chunk[i]):
                done.append(_joined(pending))
                pending = []
            pending.append({c: v[i:j] for c, v in columns.items()})
        if done:
            yield done
    if pending:
        yield [_joined(pending)]


def _run_of(piece: Piece, breaker: Breaker) -> CallRun:
    return CallRun(piece["t"].astype(np.int64), piece["failed"].astype(bool), breaker)


_MAP_SCHEMA = (
    "endpoint string, chunk bigint, entry_code array<bigint>, entry_failures array<bigint>, entry_last array<bigint>, "
    "open_until array<bigint>, open_code array<bigint>, open_failures array<bigint>, open_last array<bigint>"
)
_ENTRY_SCHEMA = (
    "endpoint string, chunk bigint, code bigint, failures bigint, last bigint, "
    "exit_code bigint, exit_failures bigint, exit_last bigint"
)
_CALL_SCHEMA = "endpoint string, call_id bigint, t bigint, allowed boolean, code bigint, failures bigint"


def _chunked(calls: DataFrame, breaker: Breaker, chunk_ms: int, max_calls: int) -> DataFrame:
    """Calls with the start of their chunk.

    A chunk has the given length. Where an endpoint has too many calls for one, its calls are counted by millisecond and the
    chunk is cut wherever the running count passes the limit, so no chunk holds more than the limit and the calls of
    one millisecond. Any cut is right, as a chunk is summarised for every state it may begin in.
    """
    t, width = F.unix_micros(F.col("ts").cast("timestamp")), chunk_ms * 1000
    failed = F.col("outcome") == "failure"
    timed = calls.select("endpoint", "call_id", t.alias("t"), failed.alias("failed"))
    timed = timed.withColumn("block", F.floor(F.col("t") / width) * width).withColumn("ms", F.floor(F.col("t") / 1000))
    busy = timed.groupBy("endpoint", "block").agg(F.count("*").alias("n")).where(F.col("n") > max_calls).select("endpoint", "block")
    bins = timed.join(busy, ["endpoint", "block"]).groupBy("endpoint", "block", "ms").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("endpoint", "block").orderBy("ms").rowsBetween(W.unboundedPreceding, -1)
    parts = bins.withColumn("part", F.floor(F.coalesce(F.sum("n").over(earlier), F.lit(0)) / max_calls))
    first = F.min("ms").over(W.partitionBy("endpoint", "block", "part"))
    cuts = parts.select("endpoint", "ms", (first * 1000).alias("start"))
    chunk = F.greatest(F.col("block"), F.coalesce("start", "block"))
    return timed.join(cuts, ["endpoint", "ms"], "left").withColumn("chunk", chunk).drop("block", "ms", "start")


def _in_order(rows: DataFrame) -> DataFrame:
    """Every chunk in one place and in time order; Spark sorts (and spills), Python only walks through.

    The number of partitions is that of the session, as the work is in Python and AQE would judge it by the bytes alone.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartition(partitions, "endpoint", "chunk")
    return placed.sortWithinPartitions("endpoint", "chunk", "t", "call_id")


def chunk_maps(chunked: DataFrame, breaker: Breaker, any_start: bool = False) -> DataFrame:
    """Step 1: the state map of every chunk.

    With ``any_start`` the breaker may have opened after the chunk began, as when older calls arrive late.
    """
    limit = breaker.threshold
    variants = [(CLOSED, f) for f in range(limit)] + [(HALF_OPEN, f) for f in range(1, limit)]

    def summary(piece: Piece) -> tuple:
        run = _run_of(piece, breaker)
        exits = run.exits()
        known = np.array([run.exit_of(exits, code, failures) for code, failures in variants], dtype=np.int64)
        chunk = int(piece["chunk"][0])
        # Before this chunk the breaker opened at the latest at its beginning, so it lets calls through at the
        # latest one reset interval into it: only that many calls can be the first.
        reachable = run.n if any_start else np.searchsorted(run.times, chunk + breaker.reset, side="left") + 1
        until, ends = run.times[:reachable], exits[:reachable]
        last_of_its_kind = np.append(np.any(ends[1:] != ends[:-1], axis=1), True)
        until, ends = until[last_of_its_kind], ends[last_of_its_kind]
        return (piece["endpoint"][0], chunk, known[:, 0], known[:, 1], known[:, 2], until,
                ends[:, 0], ends[:, 1], ends[:, 2])

    columns = ["endpoint", "chunk", "entry_code", "entry_failures", "entry_last", "open_until", "open_code",
               "open_failures", "open_last"]

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunks in _chunks(batches):
            yield pd.DataFrame([summary(c) for c in chunks], columns=columns)

    return _in_order(chunked).mapInPandas(summarise, _MAP_SCHEMA)


def chunk_entries(maps: DataFrame, breaker: Breaker, before: DataFrame | None = None) -> DataFrame:
    """Step 2: the state before and after every chunk. An endpoint's maps pass by in order; none is kept.

    ``before`` holds the state of endpoints that were seen earlier; the others start closed.
    """
    limit = breaker.threshold
    columns = ["endpoint", "chunk", "code", "failures", "last", "exit_code", "exit_failures", "exit_last"]

    def after(m, code: int, failures: int, last: int) -> tuple[int, int, int]:
        if code == OPEN:
            place = int(np.searchsorted(m.open_until, last + breaker.reset, side="right"))
            if place == len(m.open_until):
                return code, failures, last
            found = m.open_code[place], m.open_failures[place], m.open_last[place]
        else:
            place = failures if code == CLOSED else limit + failures - 1
            found = m.entry_code[place], m.entry_failures[place], m.entry_last[place]
        code, failures, seen = (int(x) for x in found)
        return code, failures, seen if seen != NEVER else last

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        endpoint, state = None, (CLOSED, 0, NEVER)
        for batch in batches:
            rows = []
            for m in batch.itertuples(index=False):
                before = state if m.endpoint == endpoint else (int(m.first_code), int(m.first_failures), int(m.first_last))
                endpoint, state = m.endpoint, after(m, *before)
                rows.append((m.endpoint, m.chunk, *before, *state))
            yield pd.DataFrame(rows, columns=columns)

    initial = {"first_code": F.lit(CLOSED), "first_failures": F.lit(0), "first_last": F.lit(NEVER)}
    if before is not None:
        known = before.select("endpoint", *[F.col(c).alias(f"_{c}") for c in ("code", "failures", "last")])
        maps = maps.join(known, "endpoint", "left")
        initial = {name: F.coalesce(F.col(name.replace("first", "")), value) for name, value in initial.items()}
    maps = maps.withColumns({name: value.cast("bigint") for name, value in initial.items()})
    placed = maps.repartition("endpoint").sortWithinPartitions("endpoint", "chunk")
    return placed.mapInPandas(follow, _ENTRY_SCHEMA)


def replay(chunked: DataFrame, entries: DataFrame, breaker: Breaker) -> DataFrame:
    """Step 3: the state after every call."""
    def traced(piece: Piece) -> Piece:
        entry = (int(piece[c][0]) for c in ("entry_code", "entry_failures", "entry_last"))
        allowed, states, counts, _ = _run_of(piece, breaker).trace(*entry)
        return {**{c: piece[c] for c in ("endpoint", "call_id", "t")}, "allowed": allowed, "code": states, "failures": counts}

    def run_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunks in _chunks(batches):
            yield pd.DataFrame(_joined([traced(c) for c in chunks]))

    before = entries.select("endpoint", "chunk", F.col("code").alias("entry_code"),
                            F.col("failures").alias("entry_failures"), F.col("last").alias("entry_last"))
    return _in_order(chunked.join(before, ["endpoint", "chunk"])).mapInPandas(run_chunks, _CALL_SCHEMA)


def _state_name(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STATE_NAMES]), (code + 1).cast("int"))


def _moment(micros: Column) -> Column:
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def named_states(rows: DataFrame) -> DataFrame:
    return rows.select(
        "endpoint", "call_id", _moment(F.col("t")).alias("ts"), "allowed", _state_name(F.col("code")).alias("state"),
        F.col("failures").cast("int").alias("failures"),
    )


# A chunk of this many calls takes some ten megabytes in a Python worker.
MAX_CALLS = 200_000


def _prepared(calls: DataFrame, breaker: Breaker, chunk_ms: int, max_calls: int) -> tuple[DataFrame, DataFrame]:
    if chunk_ms < breaker.reset_ms:
        raise ValueError("a chunk must be at least as long as the reset time")
    chunked = _chunked(calls, breaker, chunk_ms, max_calls)
    return chunked, chunk_entries(chunk_maps(chunked, breaker), breaker)


def breaker_states(calls: DataFrame, breaker: Breaker = Breaker(), chunk_ms: int = 3_600_000,
                   max_calls: int = MAX_CALLS) -> DataFrame:
    """State and failure count after every call; ``allowed`` is false for rejected calls."""
    chunked, entries = _prepared(calls, breaker, chunk_ms, max_calls)
    return named_states(replay(chunked, entries, breaker))


STATE_SCHEMA = "endpoint string, code bigint, failures bigint, last bigint"


def _last_states(entries: DataFrame) -> DataFrame:
    exits = F.struct(F.col("exit_code").alias("code"), F.col("exit_failures").alias("failures"), F.col("exit_last").alias("last"))
    return entries.groupBy("endpoint").agg(F.max_by(exits, "chunk").alias("s")).select("endpoint", "s.*")


def breaker_step(calls: DataFrame, before: DataFrame, breaker: Breaker = Breaker(), chunk_ms: int = 3_600_000,
                 max_calls: int = MAX_CALLS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The states after every call of a batch that follows earlier ones, and the state of every endpoint after it.

    Both come from the third, the states at the borders of the chunks. It is kept when it was first worked out; the caller
    releases it.
    """
    chunked = _chunked(calls, breaker, chunk_ms, max_calls)
    entries = chunk_entries(chunk_maps(chunked, breaker, any_start=True), breaker, before).persist()
    after = _last_states(entries)
    states = named_states(replay(chunked, entries, breaker))
    return states, after.unionByName(before.join(after, "endpoint", "left_anti")), entries


def breaker_status(calls: DataFrame, as_of: Column, breaker: Breaker = Breaker(), chunk_ms: int = 3_600_000,
                   max_calls: int = MAX_CALLS) -> DataFrame:
    """The last state of every endpoint; the age of the last failure is null if there never was one."""
    _, entries = _prepared(calls, breaker, chunk_ms, max_calls)
    latest = _last_states(entries)
    failed_at = F.when(F.col("last") != NEVER, _moment(F.col("last")))
    age = F.unix_millis(as_of.cast("timestamp")) - F.unix_millis(failed_at.cast("timestamp"))
    return latest.select(
        "endpoint", _state_name(F.col("code")).alias("state"), F.col("failures").cast("int").alias("failures"),
        failed_at.alias("last_failure"), age.alias("ms_since_last_failure"),
    )
