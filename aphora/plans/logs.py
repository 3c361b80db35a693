"""Log lines as data: parsing, formatting, latency and error reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aphora.functions.masking import mask_json_text
from aphora.functions.text import is_json
from aphora.operators import filters
from aphora.sources.sinks import staged

# Fixed value: how a log line begins: [time] [LEVEL] [request], the request being optional. The message follows,
# and a JSON object may end the line.
HEADER = r"^\[([^\]]+)\] \[(\w+)\] (?:\[([^\]]+)\] )?"

PERCENTILES = (0.5, 0.95)
#: Longer times (thirty thousand years) are no times.
MAX_MS = 1e15
#: Buckets for every factor of e, from coarse to fine.
STEPS = (32, 1 << 16)


# Reversed text: a string from its closing to its opening quote. A quote before an odd number of backslashes is escaped.
_REVERSED_TEXT = r'"[^"]*+(?:"(?=\\(?:\\\\)*+(?!\\))[^"]*+)*+"'
_REVERSED_TOKENS = rf'{_REVERSED_TEXT}|[{{}}]|[^"{{}}]++|"'


def json_tail(text: Column) -> Column:
    """The JSON object that ends the text and follows a blank; null if there is none.

    Read from its end, a quote is inside a string if an odd number of quotes stands behind it, wherever the object begins. So
    the brace that belongs to the last one is found in one pass over the tokens of the reversed text, and only from
    there the rest is parsed. Most lines have one place to begin only and need no search.
    """
    def step(state: Column, token: Column) -> Column:
        depth = state["depth"] + (token == "}").cast("int") - (token == "{").cast("int")
        read = state["read"] + F.length(token)
        found = state["found"].isNull() & (token == "{") & (depth == 0)
        return F.struct(depth.alias("depth"), read.alias("read"), F.when(found, read).otherwise(state["found"]).alias("found"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("read"), F.lit(None).cast("int").alias("found"))
    tokens = F.regexp_extract_all(F.reverse(text), F.lit(_REVERSED_TOKENS), F.lit(0))
    first = F.locate(" {", text)
    only = F.position(F.lit(" {"), text, first + 1) == 0
    size = F.when(only, F.length(text) - first).otherwise(F.aggregate(tokens, start, step, lambda s: s["found"]))
    rest = F.right(text, size)
    after_blank = F.substring(text, F.length(text) - size, F.lit(1)) == " "
    return F.when(F.endswith(text, F.lit("}")) & (first > 0) & after_blank, F.when(is_json(rest), rest))


def parse_logs(lines: DataFrame, column: str = "value") -> DataFrame:
    """The parts of each line; ``malformed`` marks lines that are not log lines.

    Only the beginning is matched by a pattern. A JSON object that ends the line is its metadata; what stands between is the
    message. There is at most one place from which the rest is one JSON object.
    """
    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(column, HEADER, i), F.lit(""))

    header = F.length(F.regexp_extract(column, HEADER, 0))
    cut = lines.select(F.col(column), F.substring(F.col(column), header + 1, F.length(column)).alias("_rest"))
    cut = cut.withColumn("_meta", json_tail(F.col("_rest")))
    cut = cut.withColumn("_brace", F.length("_rest") - F.length("_meta"))
    has_meta = F.col("_meta").isNotNull()
    message = F.when(has_meta, F.substring(F.col("_rest"), F.lit(1), F.col("_brace") - 1)).otherwise(F.col("_rest"))
    return cut.select(
        part(1).try_cast("timestamp_ntz").alias("logged_at"), part(2).alias("level"), part(3).alias("request_id"),
        F.nullif(message, F.lit("")).alias("message"),
        F.col("_meta").alias("meta"),
        (F.length(F.regexp_extract(column, HEADER, 0)) == 0).alias("malformed"),
        F.col(column).alias("line"),
    )


def split_malformed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    return parsed.where(~F.col("malformed")).drop("malformed", "line"), parsed.where("malformed").select("line")


def iso_time(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def format_line(at: Column, level: Column, request_id: Column, message: Column, meta: Column) -> Column:
    """A log line; missing parts leave no gap, and sensitive values of the JSON are hidden."""
    def bracketed(c: Column) -> Column:
        return F.concat(F.lit("["), c, F.lit("]"))

    shown = F.when(meta != "{}", mask_json_text(meta))
    return F.concat_ws(" ", bracketed(iso_time(at)), bracketed(F.upper(level)),
                       bracketed(F.nullif(request_id, F.lit(""))), message, shown)


def logged_number(meta: Column, key: str) -> Column:
    return F.get_json_object(meta, f"$.{key}").try_cast("double")


def _bucket(t: Column, per_e: int) -> Column:
    """A whole number that grows with t: so many steps for every factor of e. Any finite double has one."""
    size = F.floor((F.ln(F.abs(t)) + 746) * per_e).cast("bigint") + 1
    return F.when(t == 0, F.lit(0).cast("bigint")).when(t > 0, size).otherwise(-size)


def latency(requests: DataFrame, keys: list[str], response_ms: str = "response_ms") -> DataFrame:
    """Count, mean, median, 95th percentile and maximum of the response time per route, all exact.

    The requests are read once: how often each route took each time is written to the shared folder when this is called.
    The ranks that the percentiles lie between are then found in a histogram of at most some thousand logarithmic
    buckets, next in finer ones inside those that hold a rank, and last among the times of the finest. Values that are
    no numbers, infinite, or beyond ``MAX_MS`` are no times and are left out of every figure.
    """
    t = F.col(response_ms).cast("double")
    timed = requests.where(F.abs(t) <= MAX_MS).select(*keys, t.alias("_t"))
    steps = [F.lit(0).cast("bigint").alias("_level0"), *[_bucket(F.col("_t"), per_e).alias(f"_level{i + 1}") for i, per_e in enumerate(STEPS)], F.col("_t").alias(f"_level{len(STEPS) + 1}")]
    counts = staged(timed.groupBy(*keys, "_t").agg(F.count("*").alias("_n")).select(*keys, "_t", "_n", *steps), "route-times")
    exact = F.sum(F.col("_t").cast("decimal(22,6)") * F.col("_n").cast("decimal(15,0)")).alias("_sum")
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("requests"), exact, F.max("_t").alias("max_ms"))

    def joined(rows: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
        """Equal keys, null ones too."""
        named = few.select(*[F.col(c).alias(f"_of_{c}") if c in on else F.col(c) for c in few.columns])
        return rows.join(named, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in on]).drop(*[f"_of_{c}" for c in on])

    ranks = {f"_{name}{round(p * 100)}": f(F.lit(p) * (F.col("_total") - 1)) for p in PERCENTILES for name, f in (("lo", F.floor), ("hi", F.ceil))}
    hits = lambda rank: (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n"))
    wanted = totals.select(*keys, F.lit(0).cast("bigint").alias("_level0"), F.lit(0).cast("bigint").alias("_before"), F.col("requests").alias("_total"))
    for level in range(1, len(STEPS) + 2):
        above, here = f"_level{level - 1}", f"_level{level}"
        part = joined(counts.groupBy(*keys, above, here).agg(F.sum("_n").alias("_n")), wanted, [*keys, above])
        earlier = Window.partitionBy(*keys, above).orderBy(here).rowsBetween(Window.unboundedPreceding, -1)
        part = part.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        found = part.where(reduce(lambda a, b: a | b, [hits(rank) for rank in ranks.values()]))
        wanted = found.select(*keys, here, "_before", "_total")
    values = found.groupBy(*keys).agg(*[F.max(F.when(hits(rank), F.col(here))).alias(name) for name, rank in ranks.items()])

    def percentile(p: float) -> Column:
        at, low = F.lit(p) * (F.col("requests") - 1), F.col(f"_lo{round(p * 100)}")
        return low + (F.col(f"_hi{round(p * 100)}") - low) * (at - F.floor(at))

    return joined(totals, values, keys).select(
        *keys, "requests", (F.col("_sum").cast("double") / F.col("requests")).alias("mean_ms"),
        percentile(0.5).alias("p50_ms"), percentile(0.95).alias("p95_ms"), "max_ms")


def route_latency(parsed: DataFrame) -> DataFrame:
    """Latency by method, URL and status from the lines that report a finished request."""
    done = parsed.select(
        F.regexp_extract("message", r"^(\S+) (\S+)", 1).alias("method"),
        F.regexp_extract("message", r"^(\S+) (\S+)", 2).alias("url"),
        F.get_json_object("meta", "$.statusCode").try_cast("int").alias("status"),
        logged_number(F.col("meta"), "responseTime").alias("response_ms"),
    )
    return latency(done, ["method", "url", "status"])


def pair_requests(events: DataFrame) -> DataFrame:
    """Response time of each request from its start and end rows; a request without an end has none.

    Both rows carry method and URL, so these are keys: as aggregates of text they would force a sort.
    """
    start, end = F.col("phase") == "start", F.col("phase") == "end"
    paired = events.groupBy("request_id", "method", "url").agg(
        F.min(F.when(start, F.col("ts"))).alias("started_at"), F.max(F.when(end, F.col("ts"))).alias("ended_at"),
        F.max("status_code").alias("status_code"),
    )
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    took = (micros("ended_at") - micros("started_at")) / 1000
    return paired.withColumn("response_ms", took)


def level_counts(parsed: DataFrame, minimum: str = "debug") -> DataFrame:
    return filters.at_least_level(parsed, minimum).groupBy("level").agg(F.count("*").alias("lines"))


def error_actions(audit: DataFrame) -> DataFrame:
    """Audit rows per action that reports an error."""
    return audit.where(F.col("action").endswith("error")).groupBy("action").agg(F.count("*").alias("rows"))

