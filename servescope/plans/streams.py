"""Streaming jobs run over the given tables: written as files, streamed, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from servescope.operators.request_metrics import end_to_end
from servescope.plans import tables as t
from servescope.plans.oracle import sql
from servescope.plans.replay import _FR, conversation_chunks
from servescope.plans.telemetry import _S, _samples, scrapes
from servescope.session import cut
from servescope.sources.scrapes import label_text
from servescope.streaming import jobs

SEEN = "timestamp_micros(1704067200000000 + off_ns div 1000) AS seen_at"


def windowed_summary(s, d):
    terminals = t.requests(s, d).withColumn("end_to_end_ns", end_to_end()).selectExpr(
        "run_id", "timestamp_micros(1704067200000000 + terminal_ns div 1000) AS terminal_at",
        "terminal_class", "phase", "end_to_end_ns", "slo_satisfied")
    rows = cut(terminals)
    counted = jobs.run_to_table(jobs.window_histogram(jobs.as_stream(rows, closing="terminal_at")))
    return jobs.windowed_summary(counted, rows).selectExpr("run_id", "unix_micros(window_start) AS window_start_us", "attempted", "successful",
                           "timed_out", "slo_satisfying", "e2e_p50", "e2e_p95")


def quiet_spans(s, d):
    events = t.clocked_events(s, d).selectExpr("user_id", SEEN)
    spans = jobs.run_to_table(jobs.activity_spans(jobs.as_stream(events, closing="seen_at"), "user_id", gap="12 hours"))
    return spans.selectExpr("user_id", "unix_micros(span_start) AS start_us", "unix_micros(span_end) AS end_us", "events")


def _starts(s, d):
    return t.stream_events(s, d).where("kind = 'CLIENT_REQUEST_STARTED'").selectExpr("run_id", "request_id", SEEN)


def _groups(s, d):
    return jobs.groups_for(t.table(s, d, "events").count())


def stream_duplicates(s, d):
    """Every start of a request; some requests start twice."""
    told = jobs.duplicate_report(jobs.as_stream(_starts(s, d), by="request_id", closing="seen_at"), groups=_groups(s, d))
    return jobs.run_to_table(told).selectExpr("run_id", "request_id", "status", "unix_micros(seen_at) AS seen_us", "copy")


def stream_dedup(s, d):
    starts = _starts(s, d)
    return jobs.run_to_table(jobs.dedup_requests(jobs.as_stream(starts, by="request_id"))).selectExpr(
        "run_id", "request_id", "unix_micros(seen_at) AS seen_us")


def stream_frames(s, d):
    chunks = conversation_chunks(s, d).selectExpr(
        "request_id", "ordinal", "bytes", "timestamp_micros(1704067200000000 + ordinal * 1000) AS seen_at")
    return jobs.run_to_table(jobs.stream_frames(jobs.as_stream(chunks, by="request_id", closing="seen_at")))


def stream_lifecycle(s, d):
    """Some requests never end (user % 43), of some a token comes after the terminal (user % 47)."""
    user = "CAST(split(request_id, '-')[0] AS BIGINT)"
    columns = ["run_id", "request_id", "kind", "kind_rank", "off_ns", "token_delta_count", "terminal_class"]
    events = t.stream_events(s, d).where(
        f"NOT ({user} % 43 = 0 AND kind IN ('REQUEST_TERMINAL', 'CLIENT_REQUEST_ENDED'))").select(*columns)
    again = events.where(f"{user} % 47 = 0 AND kind = 'REQUEST_TERMINAL'").selectExpr(
        "run_id", "request_id", "'SSE_TOKEN_EVENT' AS kind", "2 AS kind_rank", "off_ns + 1000000 AS off_ns", "1L AS token_delta_count",
        "CAST(NULL AS STRING) AS terminal_class")
    rows = events.unionByName(again).selectExpr("*", SEEN)
    told = jobs.stream_requests(jobs.as_stream(rows, by="request_id", closing="seen_at"), groups=_groups(s, d))
    return jobs.run_to_table(told)


def stream_counter_deltas(s, d):
    samples = _samples(s, d).where("violation IS NULL AND metric = 'ev_total'").join(
        scrapes(s, d).select("scrape_id", "slot", "process_start_id", "scrape_offset_ns"), "scrape_id").select(
        "slot", "metric", label_text().alias("label_set"), "process_start_id", "scrape_offset_ns", "value",
        F.expr("timestamp_micros(1704067200000000 + scrape_offset_ns div 1000)").alias("seen_at"))
    return jobs.run_to_table(jobs.live_counter_deltas(jobs.as_stream(samples, by="slot", closing="seen_at")))


QUERIES = {
    "windowed_summary": windowed_summary,
    "quiet_spans": quiet_spans,
    "stream_dedup": stream_dedup,
    "stream_duplicates": stream_duplicates,
    "stream_frames": stream_frames,
    "stream_lifecycle": stream_lifecycle,
    "stream_counter_deltas": stream_counter_deltas,
}

_DAY = "86400000000"

ORACLES = {
    "windowed_summary": sql("req", f"""WITH m AS (SELECT *, (terminal_ns // 1000 + 1704067200000000) AS us FROM req WHERE phase = 'MEASURED'),
        w AS (SELECT run_id, us // {_DAY} * {_DAY} AS window_start_us, count(*) AS attempted,
          count(*) FILTER (WHERE terminal_class = 'SUCCESS') AS successful, count(*) FILTER (WHERE terminal_class = 'TIMEOUT') AS timed_out,
          count(*) FILTER (WHERE slo_satisfied) AS slo_satisfying,
          list(terminal_ns - dispatch_ns ORDER BY terminal_ns - dispatch_ns) FILTER (WHERE terminal_class = 'SUCCESS') AS v
          FROM m GROUP BY ALL)
        SELECT run_id, window_start_us, attempted, successful, timed_out, slo_satisfying, """ + ", ".join(
        f"""CAST(CASE WHEN len(v) > 0 THEN v[CAST(floor((len(v) - 1) * {p}::DOUBLE) AS BIGINT) + 1]::DOUBLE
            + ((len(v) - 1) * {p}::DOUBLE - floor((len(v) - 1) * {p}::DOUBLE))
            * (v[CAST(ceil((len(v) - 1) * {p}::DOUBLE) AS BIGINT) + 1] - v[CAST(floor((len(v) - 1) * {p}::DOUBLE) AS BIGINT) + 1]) END AS DOUBLE) AS {n}"""
        for n, p in (("e2e_p50", "0.5"), ("e2e_p95", "0.95"))) + f"""
        FROM w"""),
    "quiet_spans": sql("ev", """WITH e AS (SELECT user_id, off_ns // 1000 + 1704067200000000 AS us FROM ev),
        g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) <= 43200000000 THEN 0 ELSE 1 END AS fresh FROM e),
        n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS span FROM g)
        SELECT user_id, min(us) AS start_us, max(us) + 43200000000 AS end_us, count(*) AS events FROM n GROUP BY user_id, span"""),
    "stream_dedup": sql("req", "SELECT run_id, request_id, dispatch_ns // 1000 + 1704067200000000 AS seen_us FROM req"),
    "stream_frames": f"""WITH {_FR} SELECT request_id, frame_index, kind, data, completing_chunk, error FROM fx WHERE kind <> 'tail'
        UNION ALL SELECT request_id, count(*) FILTER (WHERE kind <> 'tail'), 'tail', NULL, NULL, 'INCOMPLETE' FROM fx GROUP BY request_id
        HAVING bool_or(kind = 'tail') OR NOT bool_or(kind = 'done')""",
    "stream_duplicates": sql("sev", """SELECT run_id, request_id, CASE WHEN copy = 0 THEN 'FIRST' ELSE 'DUPLICATE' END AS status,
          off_ns // 1000 + 1704067200000000 AS seen_us, copy FROM (SELECT *, row_number() OVER (PARTITION BY run_id, request_id ORDER BY off_ns) - 1 AS copy
            FROM sev WHERE kind = 'CLIENT_REQUEST_STARTED')"""),
    "stream_lifecycle": sql("sev", """WITH e AS (SELECT *, CAST(split_part(request_id, '-', 1) AS BIGINT) AS u FROM sev),
        g AS (SELECT run_id, request_id, u, min(off_ns) FILTER (WHERE kind = 'CLIENT_REQUEST_STARTED') AS dispatch_ns,
          min(off_ns) FILTER (WHERE kind = 'SSE_TOKEN_EVENT') AS first_token_ns, max(off_ns) FILTER (WHERE kind = 'SSE_TOKEN_EVENT') AS last_token_ns,
          max(off_ns) FILTER (WHERE kind = 'REQUEST_TERMINAL') AS terminal_ns,
          CAST(coalesce(sum(token_delta_count), 0) AS BIGINT) AS output_tokens, max(terminal_class) AS terminal_class FROM e GROUP BY ALL)
        SELECT run_id, request_id, CASE WHEN u % 43 = 0 THEN 'TIMEOUT' ELSE 'CLOSED' END AS status, dispatch_ns, first_token_ns, last_token_ns,
          CASE WHEN u % 43 <> 0 THEN terminal_ns END AS terminal_ns, output_tokens,
          CASE WHEN u % 43 = 0 THEN 'TIMEOUT' ELSE terminal_class END AS terminal_class, 0::BIGINT AS late_events FROM g
        UNION ALL SELECT run_id, request_id, 'LATE', NULL, NULL, NULL, NULL, NULL, NULL, 1::BIGINT FROM g WHERE u % 47 = 0 AND u % 43 <> 0"""),
    "stream_counter_deltas": sql("ev", f"""WITH {_S}, p AS (SELECT slot, metric, labels AS label_set, day * 86400000000000 + 86399999999999 AS scrape_offset_ns,
            value, lag(value) OVER w AS bv, day // 10 AS proc, lag(day // 10) OVER w AS bproc FROM smp WHERE metric = 'ev_total'
          WINDOW w AS (PARTITION BY slot, labels ORDER BY day))
        SELECT slot, metric, label_set, scrape_offset_ns, CASE WHEN proc <> bproc THEN 'RESTART' WHEN value < bv THEN 'RESET' ELSE 'OK' END AS status,
          CASE WHEN proc = bproc AND value >= bv THEN value - bv END AS delta FROM p WHERE bproc IS NOT NULL"""),
}
