"""Queries over per-request metrics and run summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from servescope.operators import request_metrics as rm
from servescope.operators import run_summary as rs
from servescope.plans import tables as t
from servescope.plans.oracle import percentile_sql, sql
from servescope.session import cut

OK = "terminal_class = 'SUCCESS'"


def _req(column, *names):
    def run(spark, sf):
        return t.requests(spark, sf).select("request_id", *[c.alias(n) for n, c in column().items()])

    return run


def token_observations(spark, sf):
    observed = rm.token_observations(t.requests(spark, sf))
    return observed.select(
        "request_id",
        F.array_join(F.col("observations_ns").cast("array<string>"), ",").alias("observations"),
        F.col("observation_reason").alias("reason"),
    )


def unavailable_reasons(spark, sf):
    gaps = rm.itl_gaps_v1(t.requests(spark, sf))
    return (
        gaps.select(
            "run_id",
            F.explode(
                F.array(
                    F.struct(F.lit("ttft").alias("metric"), rm.ttft_reason("outcome").alias("reason")),
                    F.struct(F.lit("tpot").alias("metric"), rm.tpot_v1_reason().alias("reason")),
                    F.struct(F.lit("itl").alias("metric"), F.col("itl_reason").alias("reason")),
                )
            ).alias("r"),
        )
        .select("run_id", "r.metric", F.coalesce("r.reason", F.lit("AVAILABLE")).alias("reason"))
        .groupBy("run_id", "metric", "reason")
        .agg(F.count(F.lit(1)).alias("requests"))
    )


SLO_V1 = {
    "ttft_ns": t.TTFT_SLO_NS,
    "tpot_v1_ns": t.TPOT_SLO_NS,
    "end_to_end_ns": t.E2E_SLO_NS,
    "max_gap_ns": None,
}


def slo_v1(spark, sf):
    gaps = rm.itl_gaps_v1(t.requests(spark, sf))
    ready = rm.with_metrics(gaps).withColumn("max_gap_ns", F.array_max("gaps_ns"))
    return ready.select(
        "request_id",
        rm.slo_v1({k: v for k, v in SLO_V1.items()}).alias("satisfied"),
        rm.slo_v1({"ttft_ns": None, "max_gap_ns": t.ITL_SLO_NS}).alias("itl_satisfied"),
    )


def slo_v2(spark, sf):
    return t.requests(spark, sf).select(
        "request_id",
        rm.slo_v2(t.E2E_SLO_NS).alias("satisfied"),
        (rm.slo_v2(t.E2E_SLO_NS) != F.col("slo_satisfied")).alias("stored_differs"),
    )


def terminal_class(spark, sf):
    causes = t.requests(spark, sf).selectExpr(
        "request_id",
        "http_status",
        "last_type = 'signup' AND blk % 5 <> 0 AS timed_out",
        "last_type = 'error' AND blk % 6 = 1 AS malformed",
        "output_tokens <> token_events AND blk % 4 = 1 AS token_mismatch",
        "last_type = 'error' AND blk % 6 = 3 AS transport_failed",
        "last_type = 'signup' AND blk % 5 = 0 AS cancelled",
        "last_type = 'error' AS unexpected",
    )
    return rm.classify_terminal(causes).select(
        "request_id", "terminal_class", "failure_kind", "failure_origin", "error_code"
    )


def latency_percentiles(spark, sf):
    from servescope.operators.order_statistics import exact_percentiles

    ready = rs.measured(t.requests(spark, sf)).select("run_id", rm.ttft().alias("ttft_ns"))
    return exact_percentiles(cut(ready), ["run_id"], "ttft_ns")


def distributions(spark, sf):
    requests = cut(t.requests(spark, sf))
    found = rs.distributions(
        requests.select("run_id").distinct(), rs.samples_v2(requests), rs.DENOMINATORS_V2
    )
    return found.select(
        "run_id", "metric", "denominator", "sample_count", "p50", "p95", "p99", "unavailable_reason"
    )


def run_summary_v1(spark, sf):
    return rs.run_summary_v1(cut(t.requests(spark, sf)))


def run_summary_v2(spark, sf):
    log = cut(t.sequenced(t.stream_events(spark, sf)).select("run_id", "sequence", "request_id", "kind"))
    return rs.run_summary_v2(cut(t.requests(spark, sf)), digits=None, lifecycle=log)


def failure_rates(spark, sf):
    return rs.failure_rates(t.requests(spark, sf)).select(
        "run_id", "failure_rate_v1", "timeout_rate_v1",
        F.col("failure_rate.numerator").alias("failure_numerator"),
        F.col("failure_rate.denominator").alias("failure_denominator"),
        F.col("failure_rate.value").alias("failure_rate_v2"),
        F.col("timeout_rate.numerator").alias("timeout_numerator"),
        F.col("timeout_rate.value").alias("timeout_rate_v2"),
    )


QUERIES = {
    "latency_percentiles": latency_percentiles,
    "ttft": _req(lambda: {"ttft_ns": rm.ttft(), "reason": rm.ttft_reason()}),
    "e2e": _req(lambda: {"end_to_end_ns": rm.end_to_end()}),
    "tpot_v1": _req(lambda: {"tpot_ns": rm.tpot_v1(), "reason": rm.tpot_v1_reason()}),
    "tpot_v2": _req(lambda: {"tpot_ns": rm.tpot_v2()}),
    "token_span": _req(lambda: {"span_ns": rm.observed_span()}),
    "tpot_v3": _req(lambda: {"tpot_ns": rm.tpot_v3(), "reason": rm.tpot_v3_reason()}),
    "token_observations": token_observations,
    "itl_gaps": lambda s, d: rm.itl_gaps_v2(t.requests(s, d)),
    "itl_mean_v3": lambda s, d: rm.output_gaps_v3(t.requests(s, d)).select(
        "request_id", "itl_mean_ns", "itl_reason",
        F.array_join(F.coalesce(F.col("stream_output_gap_ns"), F.array()).cast("array<string>"), ",").alias("gaps"),
    ),
    "unavailable_reasons": unavailable_reasons,
    "slo_v1": slo_v1,
    "slo_v2": slo_v2,
    "terminal_class": terminal_class,
    "run_counts_v1": lambda s, d: rs.counts_v1(t.requests(s, d)),
    "run_counts_v2": lambda s, d: rs.counts_v2(t.requests(s, d)),
    "measurement_window": lambda s, d: rs.measurement_window(t.requests(s, d)),
    "request_rates": lambda s, d: rs.request_rates(t.requests(s, d)),
    "token_throughput": lambda s, d: rs.token_throughput(t.requests(s, d)),
    "goodput": lambda s, d: rs.goodput(t.requests(s, d), rm.slo_v2(t.E2E_SLO_NS)),
    "failure_rates": failure_rates,
    "distributions": distributions,
    "run_summary_v1": run_summary_v1,
    "run_summary_v2": run_summary_v2,
}

_OBS = """obs AS (
  SELECT r.*, reason, stamps FROM (
    SELECT r.*, coalesce(s.stamps, []) AS stamps,
      CASE WHEN outcome <> 'SUCCESS' THEN 'REQUEST_FAILED'
           WHEN output_value IS NULL THEN 'MISSING_TOKEN_COUNT'
           WHEN hidden THEN 'MULTI_TOKEN_CHUNK_WITHOUT_TOKEN_TIMESTAMPS'
           WHEN s.request_id IS NULL THEN 'MISSING_TOKEN_TIMESTAMPS'
           WHEN len(stamps) <> output_value THEN 'TOKEN_TIMESTAMP_COUNT_MISMATCH'
           WHEN NOT strictly THEN 'MISSING_TOKEN_TIMESTAMPS' END AS reason
    FROM req r LEFT JOIN (
      SELECT request_id, list(stamp ORDER BY chunk_index, k) AS stamps, bool_or(bad) AS hidden,
             bool_and(stamp > coalesce(before, -1)) AS strictly
      FROM (SELECT *, lag(stamp) OVER (PARTITION BY request_id ORDER BY chunk_index, k) AS before
            FROM (SELECT request_id, chunk_index, per_token_offsets_ns IS NULL AND tokens_in_chunk <> 1 AS bad,
                         unnest(coalesce(per_token_offsets_ns, [event_offset_ns])) AS stamp,
                         generate_subscripts(coalesce(per_token_offsets_ns, [event_offset_ns]), 1) AS k
                  FROM tev))
      GROUP BY request_id) s ON s.request_id = r.request_id) r)"""

_GAPS2 = """gaps AS (
  SELECT run_id, request_id, phase, chunk_index, gap_ns FROM (
    SELECT t.run_id, t.request_id, r.phase, chunk_index,
           event_offset_ns - lag(event_offset_ns)
             OVER (PARTITION BY t.request_id ORDER BY event_offset_ns, chunk_index) AS gap_ns
    FROM tev t JOIN req r ON r.request_id = t.request_id
    WHERE terminal_class = 'SUCCESS' AND output_tokens >= 2 AND max_event_tokens = 1
      AND token_events = output_tokens) WHERE gap_ns IS NOT NULL)"""

_SAMPLES2 = f"""{_GAPS2}, samples AS (
  SELECT run_id, 'END_TO_END_SUCCESS_NS' AS metric, CAST(terminal_ns - dispatch_ns AS DOUBLE) AS value
    FROM req WHERE {OK} AND phase = 'MEASURED'
  UNION ALL SELECT run_id, 'TTFT_NS', first_token_ns - dispatch_ns FROM req
    WHERE {OK} AND phase = 'MEASURED' AND first_token_ns IS NOT NULL
  UNION ALL SELECT run_id, 'TPOT_NS', (terminal_ns - first_token_ns) / (output_tokens - 1) FROM req
    WHERE {OK} AND phase = 'MEASURED' AND output_tokens >= 2
  UNION ALL SELECT run_id, 'OBSERVED_TOKEN_SPAN_PER_INTERVAL_NS',
      (last_token_ns - first_token_ns) / (output_tokens - 1) FROM req
    WHERE {OK} AND phase = 'MEASURED' AND output_tokens >= 2
  UNION ALL SELECT run_id, 'ITL_NS', gap_ns FROM gaps WHERE phase = 'MEASURED'),
 dist AS ({percentile_sql('samples', 'run_id, metric', 'value')})"""

_SAMPLES1 = f"""{_OBS}, samples AS (
  SELECT run_id, 'END_TO_END_SUCCESS_NS' AS metric, CAST(terminal_ns - dispatch_ns AS DOUBLE) AS value
    FROM req WHERE {OK} AND phase = 'MEASURED'
  UNION ALL SELECT run_id, 'TTFT_NS', first_token_ns - dispatch_ns FROM req
    WHERE {OK} AND phase = 'MEASURED' AND first_token_ns IS NOT NULL
  UNION ALL SELECT run_id, 'TPOT_NS', (last_token_ns - first_token_ns) / (output_value - 1) FROM req
    WHERE {OK} AND phase = 'MEASURED' AND output_value >= 2
  UNION ALL SELECT run_id, 'ITL_NS', gap FROM (
    SELECT run_id, stamp - lag(stamp) OVER (PARTITION BY request_id ORDER BY k) AS gap
    FROM (SELECT run_id, request_id, unnest(stamps) AS stamp, generate_subscripts(stamps, 1) AS k
          FROM obs WHERE reason IS NULL AND phase = 'MEASURED')) WHERE gap IS NOT NULL),
 dist AS ({percentile_sql('samples', 'run_id, metric', 'value')})"""

_M = "FILTER (WHERE phase = 'MEASURED'"


def _wide(metric: str, prefix: str) -> str:
    here = f"FILTER (WHERE metric = '{metric}')"
    return (f"coalesce(max(sample_count) {here}, 0) AS {prefix}_count, "
            + ", ".join(f"max({p}) {here} AS {prefix}_{p}" for p in ("p50", "p95", "p99")))


_COUNTS1 = f"""count(*) {_M}) AS attempted,
    count(*) {_M} AND outcome = 'SUCCESS') AS successful,
    count(*) {_M} AND outcome <> 'SUCCESS') AS failed,
    count(*) {_M} AND outcome = 'TIMEOUT') AS timed_out,
    count(*) {_M} AND outcome = 'CANCELLED') AS cancelled,
    count(*) {_M} AND outcome IN ('PROTOCOL_ERROR', 'MALFORMED_STREAM')) AS protocol_errors,
    count(*) FILTER (WHERE phase = 'WARMUP') AS warmup"""
_COUNTS2 = f"""count(*) {_M}) AS attempted,
    count(*) {_M} AND terminal_class = 'SUCCESS') AS successful,
    count(*) {_M} AND terminal_class = 'FAILED') AS failed,
    count(*) {_M} AND terminal_class = 'TIMEOUT') AS timed_out,
    count(*) {_M} AND terminal_class = 'CANCELLED') AS cancelled,
    count(*) FILTER (WHERE phase = 'WARMUP') AS warmup"""
_WINDOW = f"(max(terminal_ns) {_M}) - min(dispatch_ns) {_M}))"
_SEC = f"({_WINDOW} / 1e9)"

_PEAK = """conc AS (SELECT run_id, CAST(max(a) AS BIGINT) AS max_concurrency FROM (
    SELECT run_id, sum(CASE kind WHEN 'CLIENT_REQUEST_STARTED' THEN 1 WHEN 'CLIENT_REQUEST_ENDED' THEN -1 ELSE 0 END)
      OVER (PARTITION BY run_id ORDER BY sequence ROWS UNBOUNDED PRECEDING) AS a FROM seq) GROUP BY run_id)"""

ORACLES = {
    "latency_percentiles": sql(
        "req",
        percentile_sql(
            f"(SELECT run_id, first_token_ns - dispatch_ns AS x FROM req WHERE {OK} AND phase = 'MEASURED')",
            "run_id", "x"),
    ),
    "ttft": sql("req", f"""SELECT request_id,
        CASE WHEN {OK} THEN first_token_ns - dispatch_ns END AS ttft_ns,
        CASE WHEN NOT {OK} THEN 'REQUEST_FAILED'
             WHEN first_token_ns IS NULL THEN 'FIRST_OUTPUT_TOKEN_NOT_OBSERVED' END AS reason FROM req"""),
    "e2e": sql("req", f"""SELECT request_id,
        CASE WHEN {OK} THEN terminal_ns - dispatch_ns END AS end_to_end_ns FROM req"""),
    "tpot_v1": sql("req", f"""SELECT request_id,
        CASE WHEN {OK} AND output_value >= 2
             THEN (last_token_ns - first_token_ns) / (output_value - 1) END AS tpot_ns,
        CASE WHEN NOT {OK} THEN 'REQUEST_FAILED' WHEN output_value IS NULL THEN 'MISSING_TOKEN_COUNT'
             WHEN output_value < 2 THEN 'INSUFFICIENT_OUTPUT_TOKENS'
             WHEN first_token_ns IS NULL THEN 'MISSING_TOKEN_TIMESTAMPS' END AS reason FROM req"""),
    "tpot_v2": sql("req", f"""SELECT request_id, CASE WHEN {OK} AND output_tokens >= 2
        THEN (terminal_ns - first_token_ns) / (output_tokens - 1) END AS tpot_ns FROM req"""),
    "token_span": sql("req", f"""SELECT request_id, CASE WHEN {OK} AND output_tokens >= 2
        THEN (last_token_ns - first_token_ns) / (output_tokens - 1) END AS span_ns FROM req"""),
    "tpot_v3": sql("req", """SELECT request_id, CASE WHEN max_event_tokens <= 1 AND output_tokens >= 2
        THEN (terminal_ns - first_token_ns) / (output_tokens - 1) END AS tpot_ns,
        CASE WHEN max_event_tokens > 1 THEN 'GROUPED_TOKEN_EVENT'
             WHEN output_tokens < 2 THEN 'INSUFFICIENT_OUTPUT_TOKENS' END AS reason FROM req"""),
    "token_observations": sql("req tev", f"""WITH {_OBS}
        SELECT request_id, reason,
          CASE WHEN reason IS NULL THEN array_to_string(stamps, ',') END AS observations FROM obs"""),
    "itl_gaps": sql("req tev", f"WITH {_GAPS2} SELECT run_id, request_id, chunk_index, gap_ns FROM gaps"),
    "itl_mean_v3": sql("tev", """SELECT request_id,
          CASE WHEN max(toks) = 1 AND count(gap) > 0 THEN sum(gap) / count(gap) END AS itl_mean_ns,
          CASE WHEN max(toks) > 1 THEN 'GROUPED_TOKEN_EVENT'
               WHEN count(gap) = 0 THEN 'INSUFFICIENT_OUTPUT_TOKENS' END AS itl_reason,
          coalesce(string_agg(CAST(gap AS VARCHAR), ',' ORDER BY chunk_index), '') AS gaps
        FROM (SELECT request_id, chunk_index, tokens_in_chunk AS toks, event_offset_ns
                - lag(event_offset_ns) OVER (PARTITION BY request_id ORDER BY chunk_index) AS gap FROM tev)
        GROUP BY request_id"""),
    "unavailable_reasons": sql("req tev", f"""WITH {_OBS}, long AS (
        SELECT run_id, 'ttft' AS metric, CASE WHEN NOT {OK} THEN 'REQUEST_FAILED'
          WHEN first_token_ns IS NULL THEN 'FIRST_OUTPUT_TOKEN_NOT_OBSERVED' ELSE 'AVAILABLE' END AS reason FROM obs
        UNION ALL SELECT run_id, 'tpot', CASE WHEN NOT {OK} THEN 'REQUEST_FAILED'
          WHEN output_value IS NULL THEN 'MISSING_TOKEN_COUNT'
          WHEN output_value < 2 THEN 'INSUFFICIENT_OUTPUT_TOKENS'
          WHEN first_token_ns IS NULL THEN 'MISSING_TOKEN_TIMESTAMPS' ELSE 'AVAILABLE' END FROM obs
        UNION ALL SELECT run_id, 'itl', coalesce(reason,
          CASE WHEN len(stamps) < 2 THEN 'INSUFFICIENT_OUTPUT_TOKENS' ELSE 'AVAILABLE' END) FROM obs)
        SELECT run_id, metric, reason, count(*) AS requests FROM long GROUP BY ALL"""),
    "slo_v1": sql("req tev", f"""WITH {_OBS}, worst AS (
        SELECT request_id, max(gap) AS gap FROM (
          SELECT request_id, stamp - lag(stamp) OVER (PARTITION BY request_id ORDER BY k) AS gap
          FROM (SELECT request_id, unnest(stamps) AS stamp, generate_subscripts(stamps, 1) AS k
                FROM obs WHERE reason IS NULL)) GROUP BY request_id)
        SELECT o.request_id,
          {OK} AND coalesce(first_token_ns - dispatch_ns <= {t.TTFT_SLO_NS}, false)
            AND coalesce(output_value >= 2, false)
            AND coalesce((last_token_ns - first_token_ns) / nullif(output_value - 1, 0) <= {t.TPOT_SLO_NS}, false)
            AND terminal_ns - dispatch_ns <= {t.E2E_SLO_NS} AS satisfied,
          {OK} AND coalesce(gap <= {t.ITL_SLO_NS}, false) AS itl_satisfied
        FROM obs o LEFT JOIN worst w ON w.request_id = o.request_id"""),
    "slo_v2": sql("req", f"""SELECT request_id,
        {OK} AND terminal_ns - dispatch_ns <= {t.E2E_SLO_NS} AS satisfied,
        ({OK} AND terminal_ns - dispatch_ns <= {t.E2E_SLO_NS}) <> slo_satisfied AS stored_differs FROM req"""),
    "terminal_class": sql("req", """SELECT request_id,
        c.cls AS terminal_class, c.kind AS failure_kind, c.origin AS failure_origin, c.code AS error_code
        FROM (SELECT request_id, CASE
          WHEN http_status >= 300 THEN {'cls': 'FAILED', 'kind': 'HTTP_STATUS', 'origin': 'HTTP_STATUS',
                                        'code': 'http-status-' || http_status}
          WHEN last_type = 'signup' AND blk % 5 <> 0 THEN {'cls': 'TIMEOUT', 'kind': 'TIMEOUT',
                                        'origin': 'HTTP_CLIENT', 'code': 'httpx-timeout'}
          WHEN last_type = 'error' AND blk % 6 = 1 THEN {'cls': 'FAILED', 'kind': 'PROTOCOL_MALFORMED_STREAM',
                                        'origin': 'SSE_PARSER', 'code': 'malformed-sse-stream'}
          WHEN output_tokens <> token_events AND blk % 4 = 1 THEN {'cls': 'FAILED', 'kind': 'TOKEN_ACCOUNTING',
                                        'origin': 'TOKEN_ACCOUNTING', 'code': 'fixture-token-accounting'}
          WHEN last_type = 'error' AND blk % 6 = 3 THEN {'cls': 'FAILED', 'kind': 'TRANSPORT',
                                        'origin': 'HTTP_CLIENT', 'code': 'httpx-transport'}
          WHEN last_type = 'signup' THEN {'cls': 'CANCELLED', 'kind': 'CANCELLED',
                                        'origin': 'LOAD_GENERATOR', 'code': 'request-cancelled'}
          WHEN last_type = 'error' THEN {'cls': 'FAILED', 'kind': 'UNEXPECTED',
                                        'origin': 'HARNESS', 'code': 'unexpected-request-failure'}
          ELSE {'cls': 'SUCCESS', 'kind': NULL, 'origin': NULL, 'code': NULL} END AS c FROM req)"""),
    "run_counts_v1": sql("req", f"SELECT run_id, {_COUNTS1} FROM req GROUP BY run_id"),
    "run_counts_v2": sql("req", f"SELECT run_id, {_COUNTS2} FROM req GROUP BY run_id"),
    "measurement_window": sql("req", f"""SELECT run_id, min(dispatch_ns) {_M}) AS window_start_ns,
        max(terminal_ns) {_M}) AS window_end_ns, {_WINDOW} AS window_ns FROM req GROUP BY run_id"""),
    "request_rates": sql("req", f"""SELECT run_id,
        round(count(*) {_M}) / {_SEC}, 9) AS offered_request_rate,
        round(count(*) {_M}) / {_SEC}, 9) AS terminal_request_rate,
        round(count(*) {_M} AND {OK}) / {_SEC}, 9) AS successful_request_throughput
        FROM req GROUP BY run_id"""),
    "token_throughput": sql("req", f"""SELECT run_id,
        round(CASE WHEN count(*) {_M} AND {OK} AND output_value IS NULL) = 0
          THEN sum(output_value) {_M} AND {OK}) END / {_SEC}, 9) AS output_v1_tokens_per_second,
        round(CASE WHEN count(*) {_M} AND {OK} AND (output_value IS NULL OR input_value IS NULL)) = 0
          THEN sum(output_value + input_value) {_M} AND {OK}) END / {_SEC}, 9) AS total_v1_tokens_per_second,
        round(sum(output_tokens) {_M} AND {OK}) / {_SEC}, 9) AS output_v2_tokens_per_second,
        round(sum(output_tokens + input_tokens) {_M} AND {OK}) / {_SEC}, 9) AS total_v2_tokens_per_second
        FROM req GROUP BY run_id"""),
    "goodput": sql("req", f"""SELECT run_id,
        count(*) {_M} AND {OK} AND terminal_ns - dispatch_ns <= {t.E2E_SLO_NS}) AS slo_satisfying,
        round(count(*) {_M} AND {OK} AND terminal_ns - dispatch_ns <= {t.E2E_SLO_NS}) / {_SEC}, 9) AS goodput
        FROM req GROUP BY run_id"""),
    "failure_rates": sql("req", f"""SELECT run_id,
        count(*) {_M} AND outcome <> 'SUCCESS') / count(*) {_M}) AS failure_rate_v1,
        count(*) {_M} AND outcome = 'TIMEOUT') / count(*) {_M}) AS timeout_rate_v1,
        count(*) {_M} AND terminal_class = 'FAILED') AS failure_numerator,
        count(*) {_M}) AS failure_denominator,
        count(*) {_M} AND terminal_class = 'FAILED') / count(*) {_M}) AS failure_rate_v2,
        count(*) {_M} AND terminal_class = 'TIMEOUT') AS timeout_numerator,
        count(*) {_M} AND terminal_class = 'TIMEOUT') / count(*) {_M}) AS timeout_rate_v2
        FROM req GROUP BY run_id"""),
    "distributions": sql("req tev", f"""WITH {_SAMPLES2},
        names(metric, denominator) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in rs.DENOMINATORS_V2.items())})
        SELECT g.run_id, g.metric, g.denominator, coalesce(d.sample_count, 0) AS sample_count, p50, p95, p99,
          CASE WHEN d.sample_count IS NULL THEN 'NO_SAMPLES' END AS unavailable_reason
        FROM (SELECT * FROM (SELECT DISTINCT run_id FROM req) CROSS JOIN names) g
        LEFT JOIN dist d ON d.run_id = g.run_id AND d.metric = g.metric"""),
    "run_summary_v1": sql("req tev", f"""WITH {_SAMPLES1},
        wide AS (SELECT run_id, {_wide('TTFT_NS', 'ttft')}, {_wide('END_TO_END_SUCCESS_NS', 'end_to_end')},
          {_wide('TPOT_NS', 'tpot')}, {_wide('ITL_NS', 'itl')} FROM dist GROUP BY run_id),
        base AS (SELECT run_id, {_COUNTS1}, {_WINDOW} AS window_ns,
          count(*) {_M} AND slo_satisfied) AS slo_satisfying,
          count(*) {_M}) / {_SEC} AS offered_request_rate,
          count(*) {_M} AND {OK}) / {_SEC} AS successful_request_throughput,
          CASE WHEN count(*) {_M} AND {OK} AND output_value IS NULL) = 0
            THEN sum(output_value) {_M} AND {OK}) END / {_SEC} AS output_token_throughput,
          CASE WHEN count(*) {_M} AND {OK} AND (output_value IS NULL OR input_value IS NULL)) = 0
            THEN sum(output_value + input_value) {_M} AND {OK}) END / {_SEC} AS total_token_throughput,
          count(*) {_M} AND slo_satisfied) / {_SEC} AS goodput,
          count(*) {_M} AND outcome <> 'SUCCESS') / count(*) {_M}) AS failure_rate,
          count(*) {_M} AND outcome = 'TIMEOUT') / count(*) {_M}) AS timeout_rate
          FROM req GROUP BY run_id)
        SELECT * FROM base JOIN wide USING (run_id)"""),
    "run_summary_v2": sql("req tev seq", f"""WITH {_SAMPLES2}, {_PEAK},
        wide AS (SELECT run_id, {_wide('END_TO_END_SUCCESS_NS', 'end_to_end')}, {_wide('TTFT_NS', 'ttft')},
          {_wide('TPOT_NS', 'tpot')}, {_wide('ITL_NS', 'itl')},
          {_wide('OBSERVED_TOKEN_SPAN_PER_INTERVAL_NS', 'token_span')} FROM dist GROUP BY run_id),
        base AS (SELECT run_id, {_COUNTS2}, {_WINDOW} AS window_ns,
          count(*) {_M} AND slo_satisfied) AS slo_satisfying,
          CAST(2 AS BIGINT) AS requested_concurrency,
          round(count(*) {_M}) / {_SEC}, 9) AS offered_request_rate,
          round(count(*) {_M}) / {_SEC}, 9) AS terminal_request_rate,
          round(count(*) {_M} AND {OK}) / {_SEC}, 9) AS successful_request_throughput,
          round(sum(output_tokens) {_M} AND {OK}) / {_SEC}, 9) AS output_token_throughput,
          round(sum(output_tokens + input_tokens) {_M} AND {OK}) / {_SEC}, 9) AS total_token_throughput,
          round(count(*) {_M} AND slo_satisfied) / {_SEC}, 9) AS goodput,
          count(*) {_M} AND terminal_class = 'FAILED') / count(*) {_M}) AS failure_rate,
          count(*) {_M} AND terminal_class = 'TIMEOUT') / count(*) {_M}) AS timeout_rate
          FROM req GROUP BY run_id)
        SELECT * FROM base JOIN wide USING (run_id) JOIN conc USING (run_id)"""),
}
