"""Run-level counts, rates, distributions and the one-row summary, in both contract versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from servescope.operators import request_metrics as rm
from servescope.operators.order_statistics import exact_percentiles
from servescope.operators.timeline import concurrency_by_interval, concurrency_by_sequence

V1_METRICS = ("TTFT_NS", "END_TO_END_SUCCESS_NS", "TPOT_NS", "ITL_NS")
V2_METRICS = (*V1_METRICS, "OBSERVED_TOKEN_SPAN_PER_INTERVAL_NS")

# What each distribution is taken over.
DENOMINATORS_V2 = {
    "END_TO_END_SUCCESS_NS": "successful measured requests",
    "TTFT_NS": "successful measured requests with first output token",
    "TPOT_NS": "successful measured requests with at least two exact output tokens",
    "ITL_NS": "adjacent distinct per-token observations from successful measured requests",
    "OBSERVED_TOKEN_SPAN_PER_INTERVAL_NS":
        "successful measured requests with at least two exact output tokens",
}
DENOMINATORS_V1 = {
    "TTFT_NS": "successful measured requests with first-output-token observation",
    "END_TO_END_SUCCESS_NS": "successful measured requests",
    "TPOT_NS": "successful measured requests with at least two counted output tokens",
    "ITL_NS": "adjacent per-token observations from successful measured requests",
}


def measured(requests: DataFrame) -> DataFrame:
    """Warmup records are kept in the tables but stay out of every measured number."""
    return requests.where(F.col("phase") == "MEASURED")


def _count(condition: str) -> Column:
    return F.count_if(F.expr(condition))


def _counts(column: str, named: dict[str, str]) -> list[Column]:
    m = "phase = 'MEASURED'"
    return [
        _count(m).alias("attempted"),
        *[_count(f"{m} AND {column} {test}").alias(name) for name, test in named.items()],
        _count("phase = 'WARMUP'").alias("warmup"),
    ]


def _counts_v1() -> list[Column]:
    return _counts(
        "outcome",
        {
            "successful": "= 'SUCCESS'",
            "failed": "<> 'SUCCESS'",
            "timed_out": "= 'TIMEOUT'",
            "cancelled": "= 'CANCELLED'",
            "protocol_errors": "IN ('PROTOCOL_ERROR', 'MALFORMED_STREAM')",
        },
    )


def _counts_v2() -> list[Column]:
    return _counts(
        "terminal_class",
        {
            "successful": "= 'SUCCESS'",
            "failed": "= 'FAILED'",
            "timed_out": "= 'TIMEOUT'",
            "cancelled": "= 'CANCELLED'",
        },
    )


def counts_v1(requests: DataFrame) -> DataFrame:
    """Failed means every non-success; timeouts and cancellations are subsets of it."""
    return requests.groupBy("run_id").agg(*_counts_v1())


def counts_v2(requests: DataFrame) -> DataFrame:
    """Failed, timed out and cancelled are disjoint."""
    return requests.groupBy("run_id").agg(*_counts_v2())


def _window() -> list[Column]:
    m = F.col("phase") == "MEASURED"
    start, end = F.min(F.when(m, F.col("dispatch_ns"))), F.max(F.when(m, F.col("terminal_ns")))
    return [
        start.alias("window_start_ns"),
        end.alias("window_end_ns"),
        F.when(end - start > 0, end - start).alias("window_ns"),
    ]


def measurement_window(requests: DataFrame) -> DataFrame:
    """Last terminal minus first dispatch of the measured requests; null unless positive."""
    return measured(requests).groupBy("run_id").agg(*_window())


def _seconds() -> Column:
    return F.col("window_ns") / F.lit(1e9)


def per_second(count: str | Column) -> Column:
    count = F.col(count) if isinstance(count, str) else count
    return F.try_divide(count.cast("double"), _seconds())


def request_rates(requests: DataFrame) -> DataFrame:
    return (
        requests.groupBy("run_id")
        .agg(*_counts_v2(), *_window())
        .select(
            "run_id",
            F.round(per_second("attempted"), 9).alias("offered_request_rate"),
            F.round(per_second("attempted"), 9).alias("terminal_request_rate"),
            F.round(per_second("successful"), 9).alias("successful_request_throughput"),
        )
    )


def _tokens() -> list[Column]:
    """Token sums of the measured successes; the v1 sums are null once one count is unknown."""
    ok = "phase = 'MEASURED' AND outcome = 'SUCCESS'"

    def total(tokens: str) -> Column:
        return F.coalesce(F.sum(F.expr(f"CASE WHEN {ok} THEN {tokens} END")), F.lit(0))

    return [
        F.when(_count(f"{ok} AND output_value IS NULL") == 0, total("output_value")).alias("output_v1"),
        F.when(
            _count(f"{ok} AND (output_value IS NULL OR input_value IS NULL)") == 0,
            total("output_value + input_value"),
        ).alias("total_v1"),
        total("output_tokens").alias("output_v2"),
        total("output_tokens + input_tokens").alias("total_v2"),
    ]


def token_throughput(requests: DataFrame) -> DataFrame:
    return (
        requests.groupBy("run_id")
        .agg(*_tokens(), *_window())
        .select(
            "run_id",
            *[
                F.round(per_second(c), 9).alias(f"{c}_tokens_per_second")
                for c in ("output_v1", "total_v1", "output_v2", "total_v2")
            ],
        )
    )


def _good(satisfied: Column) -> Column:
    return F.count_if((F.col("phase") == "MEASURED") & satisfied).alias("slo_satisfying")


def goodput(requests: DataFrame, satisfied: Column) -> DataFrame:
    grouped = requests.groupBy("run_id").agg(_good(satisfied), *_window())
    return grouped.select(
        "run_id", "slo_satisfying", F.round(per_second("slo_satisfying"), 9).alias("goodput")
    )


def rate_value(numerator: str, denominator: str) -> Column:
    """Numerator, denominator and value; the value is null on a zero denominator."""
    n, d = F.col(numerator), F.col(denominator)
    return F.struct(
        n.alias("numerator"),
        d.alias("denominator"),
        F.try_divide(n.cast("double"), d).alias("value"),
    )


def failure_rates(requests: DataFrame) -> DataFrame:
    """Version 1 counts every non-success and gives 0.0 for no attempts; version 2 keeps both parts."""
    m = "phase = 'MEASURED'"
    counted = requests.groupBy("run_id").agg(
        *_counts_v2(), _count(f"{m} AND outcome <> 'SUCCESS'").alias("__failed_v1")
    )
    return counted.select(
        "run_id",
        F.coalesce(F.try_divide(F.col("__failed_v1").cast("double"), F.col("attempted")), F.lit(0.0))
        .alias("failure_rate_v1"),
        F.coalesce(F.try_divide(F.col("timed_out").cast("double"), F.col("attempted")), F.lit(0.0))
        .alias("timeout_rate_v1"),
        rate_value("failed", "attempted").alias("failure_rate"),
        rate_value("timed_out", "attempted").alias("timeout_rate"),
    )


def _samples(rows: DataFrame, single: dict[str, Column], gaps: str) -> DataFrame:
    """Row metrics and gaps of each request as long (run, metric, value) samples; no shuffle."""
    entries = [
        F.struct(F.lit(name).alias("metric"), F.array(column.cast("double")).alias("values"))
        for name, column in single.items()
    ]
    entries.append(
        F.struct(
            F.lit("ITL_NS").alias("metric"), F.col(gaps).cast("array<double>").alias("values")
        )
    )
    spread = rows.select("run_id", F.explode(F.array(*entries)).alias("s"))
    return spread.select("run_id", "s.metric", F.explode("s.values").alias("value")).where(
        "value IS NOT NULL"
    )


def samples_v2(requests: DataFrame) -> DataFrame:
    """Samples of the measured successes; the metrics are null on every other request."""
    return _samples(
        rm.gaps_v2(measured(requests)),
        {
            "END_TO_END_SUCCESS_NS": rm.end_to_end(),
            "TTFT_NS": rm.ttft(),
            "TPOT_NS": rm.tpot_v2(),
            "OBSERVED_TOKEN_SPAN_PER_INTERVAL_NS": rm.observed_span(),
        },
        "gaps_ns",
    )


def samples_v1(requests: DataFrame) -> DataFrame:
    return _samples(
        rm.itl_gaps_v1(measured(requests)),
        {
            "TTFT_NS": rm.ttft("outcome"),
            "END_TO_END_SUCCESS_NS": rm.end_to_end("outcome"),
            "TPOT_NS": rm.tpot_v1(),
        },
        "gaps_ns",
    )


def distributions(
    runs: DataFrame | None,
    samples: DataFrame,
    denominators: dict[str, str],
    digits: int | None = None,
) -> DataFrame:
    """One row per run and metric; a metric without samples keeps its row and says why.

    ``runs`` lists the runs that must appear; without it only metrics with samples come out.
    """
    found = exact_percentiles(samples, ["run_id", "metric"], "value")
    if digits is not None:
        for name in ("p50", "p95", "p99"):
            found = found.withColumn(name, F.round(name, digits))
    if runs is None:
        return found
    names = F.map_from_arrays(
        F.array(*[F.lit(k) for k in denominators]),
        F.array(*[F.lit(v) for v in denominators.values()]),
    )
    grid = runs.select("run_id", F.explode(names).alias("metric", "denominator"))
    return (
        grid.join(found, ["run_id", "metric"], "left")
        .withColumn("sample_count", F.coalesce("sample_count", F.lit(0)))
        .withColumn("unavailable_reason", F.expr("CASE WHEN sample_count = 0 THEN 'NO_SAMPLES' END"))
    )


def _wide(found: DataFrame, names: dict[str, str]) -> DataFrame:
    columns = []
    for metric, prefix in names.items():
        here = F.col("metric") == metric
        columns.append(F.max(F.when(here, F.col("sample_count"))).alias(f"{prefix}_count"))
        for p in ("p50", "p95", "p99"):
            columns.append(F.max(F.when(here, F.col(p))).alias(f"{prefix}_{p}"))
    return found.groupBy("run_id").agg(*columns)


def run_summary_v2(
    requests: DataFrame,
    *,
    requested_concurrency: int = 2,
    digits: int | None = 6,
    satisfied: Column | None = None,
    lifecycle: DataFrame | None = None,
) -> DataFrame:
    """Counts, window, totals and goodput in one aggregate; percentiles and peak beside it.

    The peak follows the ordered start and end events of ``lifecycle`` (run_id, sequence, request_id,
    kind), as version 2 has it; only without an event log it is taken from the requests' intervals.
    """
    base = requests.groupBy("run_id").agg(
        *_counts_v2(), *_window(), *_tokens(),
        _good(F.col("slo_satisfied") if satisfied is None else satisfied),
    )
    wide = _wide(
        distributions(None, samples_v2(requests), DENOMINATORS_V2, digits),
        {
            "END_TO_END_SUCCESS_NS": "end_to_end",
            "TTFT_NS": "ttft",
            "TPOT_NS": "tpot",
            "ITL_NS": "itl",
            "OBSERVED_TOKEN_SPAN_PER_INTERVAL_NS": "token_span",
        },
    )
    peaks = concurrency_by_interval(requests) if lifecycle is None else concurrency_by_sequence(lifecycle)
    peak = peaks.select("run_id", "max_concurrency")
    summary = (
        base.join(peak, "run_id", "left")
        .join(wide, "run_id", "left")
        .withColumn("requested_concurrency", F.lit(requested_concurrency).cast("long"))
        .withColumn("offered_request_rate", F.round(per_second("attempted"), 9))
        .withColumn("terminal_request_rate", F.round(per_second("attempted"), 9))
        .withColumn("successful_request_throughput", F.round(per_second("successful"), 9))
        .withColumn("output_token_throughput", F.round(per_second("output_v2"), 9))
        .withColumn("total_token_throughput", F.round(per_second("total_v2"), 9))
        .withColumn("goodput", F.round(per_second("slo_satisfying"), 9))
        .withColumn("failure_rate", F.expr("try_divide(CAST(failed AS DOUBLE), attempted)"))
        .withColumn("timeout_rate", F.expr("try_divide(CAST(timed_out AS DOUBLE), attempted)"))
        .drop("output_v1", "total_v1", "output_v2", "total_v2", "window_start_ns", "window_end_ns")
    )
    return _zero_counts(summary)


def _zero_counts(summary: DataFrame) -> DataFrame:
    """A metric without samples counts zero; its percentiles stay null."""
    counts = [f"{m}_count" for m in ("ttft", "end_to_end", "tpot", "itl", "token_span")]
    return summary.fillna(0, [c for c in counts if c in summary.columns])


def run_summary_v1(requests: DataFrame, satisfied: Column | None = None) -> DataFrame:
    """Version 1 does not round; ``satisfied`` defaults to the stored flag."""
    base = requests.groupBy("run_id").agg(
        *_counts_v1(), *_window(), *_tokens(),
        _good(F.col("slo_satisfied") if satisfied is None else satisfied),
    )
    wide = _wide(
        distributions(None, samples_v1(requests), DENOMINATORS_V1),
        {"TTFT_NS": "ttft", "END_TO_END_SUCCESS_NS": "end_to_end", "TPOT_NS": "tpot",
         "ITL_NS": "itl"},
    )
    summary = (
        base.join(wide, "run_id", "left")
        .withColumn("offered_request_rate", per_second("attempted"))
        .withColumn("successful_request_throughput", per_second("successful"))
        .withColumn("output_token_throughput", per_second("output_v1"))
        .withColumn("total_token_throughput", per_second("total_v1"))
        .withColumn("goodput", per_second("slo_satisfying"))
        .withColumn(
            "failure_rate",
            F.expr("coalesce(try_divide(CAST(failed AS DOUBLE), attempted), 0D)"),
        )
        .withColumn(
            "timeout_rate",
            F.expr("coalesce(try_divide(CAST(timed_out AS DOUBLE), attempted), 0D)"),
        )
        .drop("output_v1", "total_v1", "output_v2", "total_v2", "window_start_ns", "window_end_ns")
    )
    return _zero_counts(summary)
