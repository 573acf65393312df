"""Per-request latency metrics. An unavailable metric is null and carries its reason, never zero.

The three contract versions use different formulas and stay separate columns:
``tpot_v1`` (last token), ``tpot_v2`` (terminal) and ``tpot_v3`` (generation terminal).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUCCESS = "SUCCESS"


def _succeeded(outcome: str) -> Column:
    return F.col(outcome) == SUCCESS


def ttft(outcome: str = "terminal_class") -> Column:
    """First output token minus dispatch; the first byte is never used."""
    return F.when(_succeeded(outcome), F.col("first_token_ns") - F.col("dispatch_ns"))


def ttft_reason(outcome: str = "terminal_class") -> Column:
    return F.when(~_succeeded(outcome), "REQUEST_FAILED").when(
        F.col("first_token_ns").isNull(), "FIRST_OUTPUT_TOKEN_NOT_OBSERVED"
    )


def end_to_end(outcome: str = "terminal_class") -> Column:
    return F.when(_succeeded(outcome), F.col("terminal_ns") - F.col("dispatch_ns"))


def _per_interval(until: Column, count: Column) -> Column:
    return F.try_divide((until - F.col("first_token_ns")).cast("double"), count - 1)


def tpot_v1(count: str = "output_value", outcome: str = "outcome") -> Column:
    return F.when(tpot_v1_reason(count, outcome).isNull(),
                  _per_interval(F.col("last_token_ns"), F.col(count)))


def tpot_v1_reason(count: str = "output_value", outcome: str = "outcome") -> Column:
    stamps = F.col("first_token_ns").isNull() | F.col("last_token_ns").isNull()
    return (
        F.when(~_succeeded(outcome), "REQUEST_FAILED")
        .when(F.col(count).isNull(), "MISSING_TOKEN_COUNT")
        .when(F.col(count) < 2, "INSUFFICIENT_OUTPUT_TOKENS")
        .when(stamps, "MISSING_TOKEN_TIMESTAMPS")
    )


def tpot_v2(count: str = "output_tokens") -> Column:
    usable = _succeeded("terminal_class") & (F.col(count) >= 2) & F.col("first_token_ns").isNotNull()
    return F.when(usable, _per_interval(F.col("terminal_ns"), F.col(count)))


def observed_span(count: str = "output_tokens") -> Column:
    """Last minus first token per interval; not a TPOT."""
    usable = _succeeded("terminal_class") & (F.col(count) >= 2)
    return F.when(usable, _per_interval(F.col("last_token_ns"), F.col(count)))


def tpot_v3(
    generation_terminal: str = "terminal_ns",
    count: str = "output_tokens",
    largest: str = "max_event_tokens",
) -> Column:
    return F.when(tpot_v3_reason(count, largest).isNull(),
                  _per_interval(F.col(generation_terminal), F.col(count)))


def tpot_v3_reason(count: str = "output_tokens", largest: str = "max_event_tokens") -> Column:
    """One event with several tokens hides the token clock of the whole request."""
    return F.when(F.col(largest) > 1, "GROUPED_TOKEN_EVENT").when(
        F.coalesce(F.col(count), F.lit(0)) < 2, "INSUFFICIENT_OUTPUT_TOKENS"
    )


def with_stream_events(requests: DataFrame, token_events: DataFrame) -> DataFrame:
    """Nest a flat token-event table into its requests as the array ``stream_events``.

    The events of one request are bounded by its output limit, so they fit one row.
    """
    nested = token_events.groupBy("run_id", "request_id").agg(
        F.sort_array(
            F.collect_list(F.struct("chunk_index", "event_offset_ns", "tokens_in_chunk",
                                    "per_token_offsets_ns"))
        ).alias("stream_events")
    )
    return requests.join(nested, ["run_id", "request_id"], "left")


def token_observations(requests: DataFrame, count: str = "output_value") -> DataFrame:
    """Per request: its token clock readings (``observations_ns``) or why there are none.

    Row-wise over the nested ``stream_events``; no shuffle.
    """
    own = "coalesce(e.per_token_offsets_ns, array(e.event_offset_ns))"
    spread = requests.selectExpr(
        "*",
        f"flatten(transform(coalesce(stream_events, array()), e -> {own})) AS stamps",
        """exists(coalesce(stream_events, array()),
             e -> e.per_token_offsets_ns IS NULL AND e.tokens_in_chunk <> 1) AS hidden""",
    )
    ordered = (
        "forall(sequence(1, greatest(size(stamps) - 1, 1)), "
        "i -> size(stamps) < 2 OR get(stamps, i) > get(stamps, i - 1))"
    )
    reason = (
        F.when(~_succeeded("outcome"), "REQUEST_FAILED")
        .when(F.col(count).isNull(), "MISSING_TOKEN_COUNT")
        .when(F.col("hidden"), "MULTI_TOKEN_CHUNK_WITHOUT_TOKEN_TIMESTAMPS")
        .when(F.size("stamps") == 0, "MISSING_TOKEN_TIMESTAMPS")
        .when(F.size("stamps") != F.col(count), "TOKEN_TIMESTAMP_COUNT_MISMATCH")
        .when(~F.expr(ordered), "MISSING_TOKEN_TIMESTAMPS")
    )
    return (
        spread.withColumn("observation_reason", reason)
        .withColumn(
            "observations_ns",
            F.when(F.col("observation_reason").isNull(), F.col("stamps")),
        )
        .drop("stamps", "hidden")
    )


def with_gaps(observed: DataFrame, stamps: str = "observations_ns") -> DataFrame:
    """Adjacent differences of an array of clock readings, as ``gaps_ns``."""
    gaps = (
        f"CASE WHEN size({stamps}) >= 2 THEN "
        f"transform(sequence(1, size({stamps}) - 1), "
        f"i -> get({stamps}, i) - get({stamps}, i - 1)) END"
    )
    return observed.withColumn("gaps_ns", F.expr(gaps))


def itl_gaps_v1(requests: DataFrame) -> DataFrame:
    observed = with_gaps(token_observations(requests))
    reason = F.coalesce(
        F.col("observation_reason"),
        F.when(F.size("observations_ns") < 2, "INSUFFICIENT_OUTPUT_TOKENS"),
    )
    return observed.withColumn("itl_reason", reason)


def gaps_v2(requests: DataFrame) -> DataFrame:
    """``gaps_ns`` where every event carried one token and the counts agree, else null."""
    eligible = (
        (F.col("terminal_class") == SUCCESS)
        & (F.col("output_tokens") >= 2)
        & (F.size("stream_events") == F.col("output_tokens"))
        & F.forall("stream_events", lambda e: e["tokens_in_chunk"] == 1)
    )
    clocks = F.when(eligible, F.transform("stream_events", lambda e: e["event_offset_ns"]))
    return with_gaps(requests.withColumn("__clocks", clocks), "__clocks").drop("__clocks")


def itl_gaps_v2(requests: DataFrame) -> DataFrame:
    """One row per gap, named by the event that closes it."""
    return gaps_v2(requests).where("gaps_ns IS NOT NULL").select(
        "run_id", "request_id",
        F.explode(
            F.arrays_zip(
                F.expr("slice(stream_events.chunk_index, 2, size(gaps_ns))").alias("chunk_index"),
                F.col("gaps_ns").alias("gap_ns"),
            )
        ).alias("g"),
    ).select("run_id", "request_id", "g.chunk_index", "g.gap_ns")


def output_gaps_v3(requests: DataFrame) -> DataFrame:
    """Mean gap, or why there is none; the event gaps themselves are always kept."""
    clocked = requests.where(F.size("stream_events") > 0).withColumn(
        "__clocks", F.transform("stream_events", lambda e: e["event_offset_ns"])
    )
    stepped = with_gaps(clocked, "__clocks").withColumnRenamed("gaps_ns", "stream_output_gap_ns")
    largest = F.array_max(F.transform("stream_events", lambda e: e["tokens_in_chunk"]))
    reason = F.when(largest > 1, "GROUPED_TOKEN_EVENT").when(
        F.col("stream_output_gap_ns").isNull(), "INSUFFICIENT_OUTPUT_TOKENS"
    )
    total = F.aggregate("stream_output_gap_ns", F.lit(0).cast("long"), lambda a, g: a + g)
    return (
        stepped.withColumn("itl_reason", reason)
        .withColumn(
            "itl_mean_ns",
            F.when(reason.isNull(),
                   F.try_divide(total.cast("double"), F.size("stream_output_gap_ns"))),
        )
        .drop("__clocks")
    )


def slo_v1(thresholds: Mapping[str, int | None], outcome: str = "outcome") -> Column:
    """Undeclared thresholds are ignored; a declared one with an unavailable metric fails."""
    satisfied = _succeeded(outcome)
    for metric, limit in thresholds.items():
        if limit is not None:
            satisfied = satisfied & F.coalesce(F.col(metric) <= limit, F.lit(False))
    return satisfied


def slo_v2(threshold_ns: int) -> Column:
    return F.coalesce(end_to_end() <= threshold_ns, F.lit(False))


# Terminal class, failure kind, origin and error code by cause, first match wins.
TERMINAL_LADDER = (
    ("http_status NOT BETWEEN 200 AND 299", "FAILED", "HTTP_STATUS", "HTTP_STATUS", None),
    ("timed_out", "TIMEOUT", "TIMEOUT", "HTTP_CLIENT", "httpx-timeout"),
    ("malformed", "FAILED", "PROTOCOL_MALFORMED_STREAM", "SSE_PARSER", "malformed-sse-stream"),
    ("token_mismatch", "FAILED", "TOKEN_ACCOUNTING", "TOKEN_ACCOUNTING",
     "fixture-token-accounting"),
    ("transport_failed", "FAILED", "TRANSPORT", "HTTP_CLIENT", "httpx-transport"),
    ("cancelled", "CANCELLED", "CANCELLED", "LOAD_GENERATOR", "request-cancelled"),
    ("unexpected", "FAILED", "UNEXPECTED", "HARNESS", "unexpected-request-failure"),
)


def classify_terminal(observed: DataFrame) -> DataFrame:
    """Terminal class, failure kind, origin and error code from the observed causes."""

    def pick(position: int, otherwise: str | None) -> Column:
        chain = F
        for condition, *labels in TERMINAL_LADDER:
            value = labels[position]
            code = (
                F.concat(F.lit("http-status-"), F.col("http_status").cast("string"))
                if value is None
                else F.lit(value)
            )
            chain = chain.when(F.expr(condition), code)
        return chain.otherwise(F.lit(otherwise))

    return (
        observed.withColumn("terminal_class", pick(0, SUCCESS))
        .withColumn("failure_kind", pick(1, None))
        .withColumn("failure_origin", pick(2, None))
        .withColumn("error_code", pick(3, None))
    )


def with_metrics(requests: DataFrame) -> DataFrame:
    """All row-wise metrics of the three versions beside the request."""
    return (
        requests.withColumn("ttft_ns", ttft())
        .withColumn("end_to_end_ns", end_to_end())
        .withColumn("tpot_v1_ns", tpot_v1())
        .withColumn("tpot_v2_ns", tpot_v2())
        .withColumn("tpot_v3_ns", tpot_v3())
        .withColumn("observed_span_ns", observed_span())
    )
