"""Rule-set queries. The adapters break fields on purpose, so that every set reports something."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from servescope.functions.rules import check_rules, violation_report
from servescope.operators import quality as q
from servescope.operators import run_summary as rs
from servescope.plans import tables as t
from servescope.plans.oracle import rules_sql, sql


def _report(df, rules, *keys):
    return violation_report(check_rules(df, rules), list(keys))


# Column expressions that read the same in both engines.
TIMING_V1 = [
    "request_id", "dispatch_ns",
    "first_body_ns + CASE WHEN user_id % 17 = 0 THEN 1000000000000000 ELSE 0 END AS first_byte_ns",
    "CASE WHEN user_id % 19 = 0 THEN NULL ELSE first_token_ns END AS first_token_ns",
    "CASE WHEN user_id % 23 = 0 THEN first_token_ns - 1000 ELSE last_token_ns END AS last_token_ns",
    "CASE WHEN user_id % 31 = 0 THEN dispatch_ns - 1 ELSE terminal_ns END AS terminal_ns",
]
REQUEST_V1 = [
    "r.*",
    """CASE WHEN outcome = 'SUCCESS' AND user_id % 17 <> 0 THEN NULL
         WHEN user_id % 13 = 0 THEN 'TIMEOUT' ELSE outcome END AS failure_kind""",
    "CASE WHEN outcome <> 'SUCCESS' THEN terminal_ns + CASE WHEN user_id % 7 = 0 THEN 1 ELSE 0 END END AS failure_ns",
]
TOKEN_COUNT = [
    "request_id",
    "CASE WHEN blk % 4 = 3 AND user_id % 5 <> 0 OR user_id % 43 = 0 THEN NULL ELSE output_tokens END AS value",
    """CASE blk % 4 WHEN 0 THEN 'FIXTURE_EXACT' WHEN 1 THEN 'TOKENIZER_DERIVED'
         WHEN 2 THEN 'SERVER_REPORTED' ELSE 'UNKNOWN' END AS source""",
    """CASE WHEN user_id % 11 = 0 THEN 'DERIVED' WHEN blk % 4 = 3 THEN 'UNAVAILABLE'
         WHEN blk % 4 = 1 THEN 'DERIVED' ELSE 'EXACT' END AS quality""",
    "CASE WHEN blk % 4 = 1 OR user_id % 19 = 0 THEN 'tok' END AS tokenizer_id",
    "CASE WHEN blk % 4 = 1 AND user_id % 23 <> 0 THEN 'rev' END AS tokenizer_revision",
    "CASE WHEN blk % 4 = 2 AND user_id % 29 <> 0 OR user_id % 31 = 0 THEN 'usage' END AS provider_field",
]
CONFIG_FACTS = """SELECT user_id, count(*) AS requests, min(terminal_ns - dispatch_ns) AS connect_timeout_ns,
    max(first_token_ns - dispatch_ns) AS first_token_timeout_ns,
    max(CASE WHEN user_id % 5 = 0 THEN 1000 ELSE terminal_ns - dispatch_ns END) AS request_timeout_ns
    FROM req GROUP BY user_id"""
CONFIG = [
    "user_id", "connect_timeout_ns", "first_token_timeout_ns", "request_timeout_ns",
    "CASE WHEN user_id % 7 <> 0 THEN 1000 END AS ttft_threshold_ns",
    "CASE WHEN user_id % 14 = 7 THEN 1000 END AS tpot_threshold_ns",
    "CAST(NULL AS BIGINT) AS end_to_end_threshold_ns", "CAST(NULL AS BIGINT) AS itl_threshold_ns",
    "concat(CASE WHEN user_id % 13 = 0 THEN '/' WHEN user_id % 17 = 0 THEN 'a/../' ELSE 'workloads/' END, user_id) AS workload_path",
    "CASE WHEN user_id % 2 = 0 THEN requests END AS batch_size",
    "CASE WHEN user_id % 6 = 0 THEN 'DIRECTLY_OBSERVED' WHEN user_id % 6 = 2 THEN 'CONFIGURED' END AS batch_source",
]
SUMMARY = [
    "run_id", "attempted", "attempted + CASE WHEN run_id % 11 = 0 THEN 1 ELSE 0 END AS terminal",
    "successful", "failed", "timed_out", "cancelled",
    "protocol_errors + CASE WHEN run_id % 13 = 0 THEN 100 ELSE 0 END AS protocol_errors",
    "failed - timed_out - cancelled AS failed_only",
    "warmup AS warmup_records", "warmup - CASE WHEN run_id % 17 = 0 THEN 1 ELSE 0 END AS warmup_excluded",
    "attempted % 4 AS observed_concurrency", "2 AS requested_concurrency",
    "CASE WHEN run_id % 2 = 0 THEN 8 END AS batch_size",
    "CASE WHEN run_id % 6 = 0 THEN 'DIRECTLY_OBSERVED' WHEN run_id % 6 = 2 THEN 'CONFIGURED' END AS batch_source",
    "CASE WHEN run_id % 3 = 0 THEN 4 END AS observed_batch",
    "CASE WHEN run_id % 9 = 0 THEN 'CONFIGURED' WHEN run_id % 9 = 3 THEN 'DIRECTLY_OBSERVED' END AS observed_batch_source",
    "successful AS sample_count",
    "CASE WHEN successful > 0 OR run_id % 5 = 0 THEN 1.5 END AS p50",
    "CASE WHEN successful > 0 AND run_id % 7 <> 0 THEN 2.5 END AS p95",
    "CASE WHEN successful > 0 THEN 3.5 END AS p99",
    "CASE WHEN successful = 0 AND run_id % 3 <> 0 THEN 'NO_SAMPLES' END AS unavailable_reason",
]
RUN = [
    "f.*",
    "CASE WHEN f.run_id % 19 = 0 THEN '2024-01-01T00:00:00+02:00' ELSE '2024-01-01T00:00:00Z' END AS created_at",
    "found_measured + CASE WHEN f.run_id % 7 = 0 THEN 1 ELSE 0 END AS attempted",
    "found_warmup AS warmup_records", "CASE WHEN found_requests > 8 THEN found_measured ELSE 7 END AS configured_measured",
    "1 AS configured_warmup", "found_successful AS successful",
    "found_failed - CASE WHEN f.run_id % 23 = 0 THEN 1 ELSE 0 END AS failed",
    "found_timed_out AS timed_out", "found_cancelled AS cancelled", "found_protocol_errors AS protocol_errors",
    "2 AS requested_concurrency", "CASE WHEN f.run_id % 29 = 0 THEN 3 ELSE 2 END AS configured_concurrency",
    "f.run_id % 2 AS workload_sha256", "CASE WHEN f.run_id % 31 = 0 THEN 5 ELSE f.run_id % 2 END AS configured_workload_sha256",
    "'m' AS model_id", "CASE WHEN f.run_id % 37 = 0 THEN 'n' ELSE 'm' END AS configured_model_id",
    "CASE WHEN f.run_id % 41 = 0 THEN 'T4' END AS gpu_model",
]
REQUEST_V2 = [
    "request_id", "terminal_class", "dispatch_ns", "output_tokens", "slo_satisfied",
    "CASE WHEN user_id % 61 = 0 THEN dispatch_ns - 1 ELSE terminal_ns END AS terminal_ns",
    "CASE WHEN user_id % 17 = 0 THEN terminal_ns ELSE dispatch_ns END AS headers_ns",
    "CASE WHEN user_id % 19 = 0 THEN dispatch_ns - 5 ELSE first_body_ns END AS first_body_ns",
    "CASE WHEN user_id % 23 = 0 THEN NULL ELSE first_token_ns END AS first_token_ns",
    "CASE WHEN user_id % 29 = 0 THEN last_token_ns + 1 ELSE last_token_ns END AS last_token_ns",
    """CASE WHEN user_id % 31 = 0 THEN 'TIMEOUT' WHEN terminal_class = 'SUCCESS' THEN NULL
         WHEN user_id % 37 = 0 THEN NULL WHEN terminal_class = 'FAILED' THEN 'HTTP_STATUS'
         ELSE terminal_class END AS failure_kind""",
    "CASE WHEN user_id % 41 = 0 THEN 404 ELSE http_status END AS http_status",
    "CASE WHEN terminal_class <> 'SUCCESS' THEN terminal_ns + CASE WHEN user_id % 43 = 0 THEN 1 ELSE 0 END END AS failure_ns",
    "CASE WHEN terminal_class = 'TIMEOUT' AND user_id % 47 <> 0 THEN 'policy' END AS timeout_policy",
    "max_event_tokens <= 1 OR user_id % 53 = 0 AS per_token_complete",
]
EVENT = [
    "*",
    "CASE WHEN event_id % 71 = 0 OR kind = 'RAW_BODY_CHUNK' THEN 0 END AS raw_chunk_sequence",
    "CAST(NULL AS VARCHAR(10)) AS raw_bytes_base64", "CAST(NULL AS BIGINT) AS raw_byte_count",
    "CAST(NULL AS VARCHAR(10)) AS raw_bytes_sha256",
]
TIMING_V3 = [
    "request_id", "dispatch_ns", "first_body_ns AS headers_ns",
    "CASE WHEN user_id % 17 = 0 THEN dispatch_ns ELSE first_body_ns END AS first_body_ns", "first_token_ns",
    "last_token_ns AS generation_terminal_ns",
    "last_token_ns + CASE WHEN user_id % 19 = 0 THEN 0 ELSE 1 END AS usage_terminal_ns",
    "last_token_ns + CASE WHEN user_id % 23 = 0 THEN -1 ELSE 2 END AS protocol_terminal_ns",
    "last_token_ns + 3 AS transport_terminal_ns",
]


def _req(s, d):
    return t.requests(s, d)


CHUNK_ARRAY = """CASE WHEN event_id % 11 = 0 THEN array(off_ns - 1, off_ns + 5)
    WHEN event_id % 7 = 0 THEN array(off_ns - 1) WHEN event_id % 5 = 0 THEN array(off_ns, off_ns - 1000)
    WHEN toks = 2 AND event_id % 2 = 0 THEN array(off_ns - 1000, off_ns) END"""


def rules_chunk(s, d):
    chunks = t.block_events(s, d).where("token_bearing").selectExpr(
        "event_id", "off_ns AS event_offset_ns", "toks AS tokens_in_chunk",
        f"{CHUNK_ARRAY} AS per_token_offsets_ns")
    return _report(chunks, q.CHUNK, "event_id")


def _chunks_v1(s, d):
    order = Window.partitionBy("run_id", "request_id").orderBy("pos")
    return (
        t.block_events(s, d)
        .where("token_bearing")
        .withColumn("dense", F.row_number().over(order))
        .selectExpr(
            "run_id", "request_id",
            "CAST(dense - 1 + CASE WHEN event_id % 29 = 0 THEN 1 ELSE 0 END AS BIGINT) AS chunk_index",
            "off_ns - CASE WHEN event_id % 31 = 0 THEN 400000000000000 ELSE 0 END AS event_offset_ns",
            "toks AS tokens_in_chunk",
            "CASE WHEN toks = 2 AND event_id % 2 = 0 THEN array(off_ns - 1000, off_ns) END AS per_token_offsets_ns")
    )


def rules_request_v1(s, d):
    requests = _req(s, d).alias("r").selectExpr(*REQUEST_V1)
    return _report(q.with_stream_facts(requests, _chunks_v1(s, d)), q.REQUEST_V1, "request_id")


def rules_config(s, d):
    facts = _req(s, d).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("requests"),
        F.min(F.expr("terminal_ns - dispatch_ns")).alias("connect_timeout_ns"),
        F.max(F.expr("first_token_ns - dispatch_ns")).alias("first_token_timeout_ns"),
        F.max(F.expr("CASE WHEN user_id % 5 = 0 THEN 1000 ELSE terminal_ns - dispatch_ns END")).alias(
            "request_timeout_ns"))
    return _report(facts.selectExpr(*CONFIG), q.CONFIGURATION, "user_id")


def _by_user(s, d):
    return _req(s, d).withColumn("run_id", F.col("user_id"))


def rules_summary(s, d):
    return _report(rs.counts_v1(_by_user(s, d)).selectExpr(*SUMMARY), q.SUMMARY, "run_id")


def rules_run(s, d):
    requests = _by_user(s, d)
    declared = requests.where("NOT (user_id % 3 = 0 AND blk % 16 = 2)").select("run_id", "case_id")
    facts = q.run_facts(requests, declared).alias("f").selectExpr(*RUN)
    return _report(facts, q.RUN, "run_id")


def rules_request_v2(s, d):
    arrays = (
        t.block_events(s, d).where("token_bearing").groupBy("run_id", "request_id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "off_ns", "toks", "event_id"))).alias("e"))
        .selectExpr("run_id", "request_id",
                    "transform(filter(e, x -> x.event_id % 59 <> 0), x -> x.toks) AS deltas",
                    "transform(e, x -> x.off_ns) AS token_offsets_ns"))
    base = _req(s, d).select("run_id", "request_id").join(arrays, ["run_id", "request_id"], "left")
    requests = _req(s, d).selectExpr(*REQUEST_V2).join(base.drop("run_id"), "request_id")
    filled = requests.withColumn("deltas", F.expr("coalesce(deltas, CAST(array() AS ARRAY<BIGINT>))")).withColumn(
        "token_offsets_ns", F.expr("coalesce(token_offsets_ns, CAST(array() AS ARRAY<BIGINT>))"))
    return _report(filled, q.REQUEST_V2, "request_id")


def rules_evidence_kind(s, d):
    return _report(t.stream_events(s, d).selectExpr(*EVENT), q.EVIDENCE_EVENT, "event_id", "kind")


def rules_timing_v3(s, d):
    return _report(_req(s, d).selectExpr(*TIMING_V3), q.TIMING_V3, "request_id")


def rules_request_v3(s, d):
    events = (
        t.block_events(s, d).where("pos > 0 AND pos < n - 1 OR pos = n - 1").groupBy("run_id", "request_id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "off_ns", "toks", "event_type", "event_id", "n"))).alias("e"),
             F.max("off_ns").alias("generation_terminal_ns"))
        .selectExpr("request_id", "generation_terminal_ns", """transform(e, x -> named_struct(
            'at', x.off_ns - CASE WHEN x.event_id % 43 = 0 THEN 900000000000000 ELSE 0 END,
            'ids', CASE WHEN x.pos < x.n - 1 AND x.toks > 0 THEN transform(sequence(1L, x.toks), i -> x.event_id + i)
                        ELSE CAST(array() AS ARRAY<BIGINT>) END,
            'text', x.event_type,
            'finish', CASE WHEN x.pos = x.n - 1 AND x.event_id % 47 <> 0 THEN 'length' END,
            'prompt', CASE WHEN x.pos = 1 OR x.event_id % 53 = 0 THEN array(1L, 2L) END)) AS token_events"""))
    stored = (
        events.join(_req(s, d).drop("run_id", "token_events"), "request_id")
        .selectExpr(
            "request_id", "token_events", "generation_terminal_ns", "first_token_ns", "user_id AS u",
            "concat('cmpl-', CASE WHEN user_id % 17 = 0 THEN 'x' ELSE '' END, request_id) AS response_id",
            "request_id AS external_id", "concat('cmpl-', request_id, '-0') AS item_id",
            "concat('cmpl-', request_id, '-0-', CASE WHEN user_id % 19 = 0 THEN 'XYZ' ELSE substring(md5(request_id), 1, 8) END) AS internal_id",
            "array(1L, 2L) AS sent_prompt",
            "CASE WHEN user_id % 23 = 0 THEN array(1L, 3L) ELSE array(1L, 2L) END AS returned_prompt",
            "flatten(transform(token_events, e -> e.ids)) AS output_ids",
            "user_id % 29 = 0 AS terminal_carried_tokens",
            "array_join(transform(token_events, e -> e.text), CASE WHEN user_id % 31 = 0 THEN ' ' ELSE '' END) AS output_text",
            "max_event_tokens", "output_tokens")
        .withColumn("output_text_sha256", F.sha2("output_text", 256))
        .withColumn("tpot_ns", F.expr("""CASE WHEN max_event_tokens = 1 AND output_tokens >= 2 OR u % 37 = 0
            THEN try_divide(CAST(generation_terminal_ns - first_token_ns AS DOUBLE), output_tokens - 1) END"""))
        .withColumn("tpot_reason", F.expr("CASE WHEN max_event_tokens > 1 AND u % 41 <> 0 THEN 'GROUPED_TOKEN_EVENT' END")))
    bearing = "filter(token_events, e -> size(e.ids) > 0)"
    stored = stored.withColumn("output_gaps_ns", F.expr(
        f"""CASE WHEN size({bearing}) < 2 THEN CAST(array() AS ARRAY<BIGINT>) ELSE transform(sequence(1, size({bearing}) - 1),
              i -> get({bearing}, i).at - get({bearing}, i - 1).at + CASE WHEN u % 13 = 0 THEN 1 ELSE 0 END) END""")).withColumn(
        "itl_ns", F.expr("""CASE WHEN size(output_gaps_ns) > 0 AND max_event_tokens = 1
              THEN CAST(aggregate(output_gaps_ns, 0L, (a, g) -> a + g) AS DOUBLE) / size(output_gaps_ns) + u % 11 div 10 END"""))
    return _report(stored, q.REQUEST_V3, "request_id")


EXCHANGE = [
    "request_id AS exchange_id", "blk % 5 <> 0 AS completion",
    "CASE WHEN blk % 5 = 0 THEN 'PROMETHEUS_BASELINE' WHEN blk % 5 = 1 THEN 'CANCELLATION' ELSE 'MEASURED_COMPLETION' END AS purpose",
    "CASE WHEN blk % 5 = 0 OR user_id % 17 = 0 THEN 'GET' ELSE 'POST' END AS method",
    "CASE WHEN blk % 5 = 0 THEN '/metrics' ELSE '/v1/completions' END AS target",
    "CASE WHEN blk % 5 <> 0 OR user_id % 19 = 0 THEN request_id END AS request_id",
    "request_id AS sent_request_id", "CASE WHEN user_id % 23 = 0 THEN NULL ELSE request_id END AS received_request_id",
    "dispatch_ns AS headers_sent_ns", "dispatch_ns + CASE WHEN user_id % 29 = 0 THEN -1 ELSE 0 END AS body_sent_ns",
    "first_body_ns AS headers_received_ns", "terminal_ns AS body_done_ns", "terminal_ns AS transport_done_ns",
    "CASE WHEN user_id % 31 = 0 THEN 'text/html' WHEN blk % 5 = 0 THEN 'text/plain' ELSE 'text/event-stream' END AS media_type",
    "CASE WHEN blk % 5 = 0 THEN 'text/plain; version=0.0.4' ELSE 'text/event-stream; charset=utf-8' END AS content_type",
    "'127.0.0.1' AS host", "8000 AS port",
    "CASE WHEN user_id % 37 = 0 THEN 'example:1' ELSE '127.0.0.1:8000' END AS request_host",
    "CASE WHEN blk % 5 = 0 THEN 0 ELSE 100 + n END AS request_bytes",
    "CASE WHEN blk % 5 <> 0 THEN CAST(100 + n - CASE WHEN user_id % 41 = 0 THEN 1 ELSE 0 END AS VARCHAR(10)) END AS request_length",
    "10 * n AS response_bytes",
    "CASE WHEN blk % 5 = 0 THEN CAST(10 * n AS VARCHAR(10)) END AS response_length",
    "CASE WHEN blk % 5 <> 0 THEN CASE WHEN user_id % 43 = 0 THEN 'gzip' ELSE 'Chunked' END END AS transfer_encoding",
    "'application/json' AS request_media",
    """CASE WHEN blk % 5 = 0 THEN 'CLEAN_RESPONSE_CLOSE' WHEN terminal_class = 'SUCCESS' AND blk % 5 <> 1 THEN 'CLEAN_EOF'
         ELSE 'INTENTIONAL_CLIENT_CLOSE_AFTER_FIRST_GENERATION_DELIVERY' END AS terminal""",
    "CASE WHEN user_id % 47 = 0 THEN 3 ELSE 5 END + CASE WHEN blk % 5 <> 0 THEN 3 ELSE 0 END AS request_header_count",
    "CASE WHEN blk % 5 <> 0 THEN 5 ELSE 4 END AS response_header_count",
]


def _names(names):
    return "array(" + ", ".join(f"'{n}'" for n in names) + ")"


def _duck_names(names):
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _exchange_arrays(fmt):
    cq, cr = fmt(q.COMPLETION_REQUEST_HEADERS), fmt(q.COMPLETION_RESPONSE_HEADERS)
    mq, mr = fmt(q.METRICS_REQUEST_HEADERS), fmt(q.METRICS_RESPONSE_HEADERS)
    broken = fmt(("host", "host", *q.COMPLETION_REQUEST_HEADERS[2:]))
    twice = fmt((*q.METRICS_RESPONSE_HEADERS[1:], "content-type"))
    return [
        f"CASE WHEN blk % 5 = 0 THEN {mq} WHEN user_id % 53 = 0 THEN {broken} ELSE {cq} END AS request_names",
        f"CASE WHEN blk % 5 <> 0 THEN {cr} WHEN user_id % 59 = 0 THEN {twice} ELSE {mr} END AS response_names",
        f"CASE WHEN blk % 5 = 0 THEN {mq} ELSE {cq} END AS required_request_names",
        f"CASE WHEN blk % 5 = 0 THEN {mr} ELSE {cr} END AS required_response_names",
    ]


def rules_exchange(s, d):
    return _report(_req(s, d).selectExpr(*EXCHANGE, *_exchange_arrays(_names)), q.EXCHANGE, "exchange_id")


def headers(s, d):
    """Header fields: the query string of a page's URL, with a few framing and secret names mixed in."""
    fields = t.table(s, d, "pages").selectExpr(
        "page_id AS message_id",
        """posexplode(concat(
             array(named_struct('k', 'Content-Type', 'v', concat(' text/', element_at(split(url, '/'), 4), ' ')),
                   named_struct('k', 'Content-Length', 'v', CAST(length(html) AS STRING))),
             CASE WHEN page_id % 7 = 0 THEN array(named_struct('k', 'transfer-encoding', 'v', 'chunked'))
                  ELSE array() END,
             CASE WHEN page_id % 11 = 0 THEN array(named_struct('k', 'X-Api-Key', 'v', 'zzz')) ELSE array() END,
             CASE WHEN page_id % 13 = 0 THEN array(named_struct('k', 'content-type', 'v', 'a/b\\t')) ELSE array() END,
             CASE WHEN page_id % 17 = 0 THEN array(named_struct('k', 'bad name', 'v', 'é')) ELSE array() END,
             transform(regexp_extract_all(url, '[?&]([^=&#]+)=([^&#]*)', 0),
               p -> named_struct('k', regexp_extract(p, '[?&]([^=&#]+)=([^&#]*)', 1),
                                 'v', regexp_extract(p, '[?&]([^=&#]+)=([^&#]*)', 2))))) AS (ordinal, f)""")
    return fields.selectExpr(
        "message_id", "CAST(ordinal AS BIGINT) AS ordinal",
        "encode(f.k, 'UTF-8') AS name_bytes", "encode(f.v, 'UTF-8') AS value_bytes",
        "lower(f.k) AS normalized_name",
        "CASE WHEN message_id % 19 = 0 THEN f.v ELSE trim(BOTH ' \\t' FROM f.v) END AS normalized_value",
        "CAST(octet_length(f.k) AS BIGINT) AS name_size",
        "CAST(octet_length(f.v) + CASE WHEN message_id % 23 = 0 THEN 1 ELSE 0 END AS BIGINT) AS value_size",
        "sha2(f.k, 256) AS name_sha256",
        "sha2(CASE WHEN message_id % 29 = 0 THEN 'other' ELSE f.v END, 256) AS value_sha256")


HEADERS_CTE = """hf AS (SELECT page_id AS message_id, ordinal - 1 AS ordinal, f.k AS k, f.v AS v FROM (
    SELECT page_id, unnest(fs) AS f, generate_subscripts(fs, 1) AS ordinal FROM (
      SELECT page_id, [{'k': 'Content-Type', 'v': ' text/' || string_split(url, '/')[4] || ' '},
          {'k': 'Content-Length', 'v': CAST(length(html) AS VARCHAR)}]
        || CASE WHEN page_id % 7 = 0 THEN [{'k': 'transfer-encoding', 'v': 'chunked'}] ELSE [] END
        || CASE WHEN page_id % 11 = 0 THEN [{'k': 'X-Api-Key', 'v': 'zzz'}] ELSE [] END
        || CASE WHEN page_id % 13 = 0 THEN [{'k': 'content-type', 'v': 'a/b' || chr(9)}] ELSE [] END
        || CASE WHEN page_id % 17 = 0 THEN [{'k': 'bad name', 'v': 'é'}] ELSE [] END
        || [{'k': regexp_extract(p, '[?&]([^=&#]+)=([^&#]*)', 1), 'v': regexp_extract(p, '[?&]([^=&#]+)=([^&#]*)', 2)}
            FOR p IN regexp_extract_all(url, '[?&]([^=&#]+)=([^&#]*)', 0)] AS fs FROM pages))),
  hd AS (SELECT *, lower(k) AS normalized_name,
      CASE WHEN message_id % 19 = 0 THEN v ELSE trim(v, ' ' || chr(9)) END AS normalized_value,
      count(*) OVER (PARTITION BY message_id, lower(k)) AS copies,
      bool_or(lower(k) = 'content-length') OVER (PARTITION BY message_id)
        AND bool_or(lower(k) = 'transfer-encoding') OVER (PARTITION BY message_id) AS both_framings FROM hf)"""


def rules_header(s, d):
    return _report(q.header_repeats(headers(s, d)), q.HEADER, "message_id", "ordinal")


POLICY_FIELDS = ("workload", "model", "tokenizer", "sampling")


def rules_policy(s, d):
    """One policy per source of documents: its languages and the number of its files shape the lists."""
    policies = t.table(s, d, "documents").groupBy(F.expr("doc_id div 10").alias("policy_id")).agg(
        F.count(F.lit(1)).alias("files"),
        F.sort_array(F.collect_list("lang")).alias("langs")).selectExpr(
        "policy_id",
        """concat(array('workload', 'model', 'tokenizer'), CASE WHEN policy_id % 7 <> 0 THEN array('sampling') ELSE array() END,
             CASE WHEN policy_id % 3 <> 0 THEN array('runtime_identity') ELSE array() END,
             CASE WHEN policy_id % 5 <> 0 THEN array('hardware_identity') ELSE array() END, langs) AS required_fields""",
        """concat(CASE WHEN policy_id % 3 = 0 THEN array('runtime_identity') ELSE array() END,
             CASE WHEN policy_id % 11 = 0 THEN array('model', 'x', 'x') ELSE array() END) AS allowed_fields""",
        f"{_names(POLICY_FIELDS)} AS essential_fields",
        "CASE WHEN policy_id % 3 = 0 THEN 'CROSS_RUNTIME' WHEN policy_id % 4 = 0 THEN 'CROSS_HARDWARE' ELSE 'SAME_RUNTIME_AND_HARDWARE' END AS comparison_kind",
        "policy_id % 13 AS minimum_successful_requests", "files AS minimum_metric_samples")
    return _report(policies, q.POLICY, "policy_id")


CONTROL = [
    "run_id", "requests AS id_uses", "distinct_ids", "CASE WHEN run_id % 7 = 0 THEN 1 ELSE 0 END AS shared_ids",
    "1 + run_id % 2 AS client_slots_used",
    "CASE WHEN run_id % 11 = 0 THEN 'TERMINAL_UNKNOWN' ELSE 'SERVER_ABORT_ACKNOWLEDGED_AND_DRAINED' END AS cancellation_class",
    "run_id % 13 AS cancellation_process", "run_id % 26 AS server_process", "1 AS steady_processes",
    "100000000 - run_id % 2 AS steady_smallest_gap_ns", "run_id % 3 AS steady_peak_running",
    "run_id % 5 AS prefix_query_delta", "0 AS prefix_hit_delta", "run_id % 17 AS late_compilations",
    "first_ns AS first_memory_ns", "first_ns AS memory_start_ns", "first_ns + 10 AS last_memory_ns",
    "first_ns + run_id % 19 AS memory_end_ns", "first_ns AS steady_start_ns", "first_ns + 1 AS first_steady_ns",
    "first_ns + 50 AS last_steady_ns", "first_ns + 60 AS quiet_start_ns",
    "first_ns + 60 + 1999999990 + run_id % 23 AS quiet_end_ns", "last_ns AS steady_end_ns",
    "first_ns + 40 AS cancellation_end_ns", "last_ns - run_id % 2 * 3000000000000000 AS measured_start_ns",
    "last_ns AS drain_start_ns", "last_ns + 5 AS drain_done_ns", "last_ns + run_id % 29 AS final_scrape_ns",
    "last_ns + 20 AS drain_end_ns", "failed % 2 AS final_running", "last_ns + 30 AS shutdown_first_ns",
    "last_ns + 30 AS shutdown_start_ns", "last_ns + 40 AS shutdown_last_ns", "last_ns + 45 AS shutdown_end_ns",
    "1 + requests % 2 AS shutdown_processes", "last_ns + 50 AS residual_ns", "last_ns + 46 AS residual_start_ns",
    "last_ns + 49 + run_id % 31 AS residual_end_ns", "run_id % 37 AS residual_processes", "0 AS residual_requests",
]


def rules_restart_control(s, d):
    facts = _by_user(s, d).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("requests"), F.count_distinct("request_id").alias("distinct_ids"),
        F.min("dispatch_ns").alias("first_ns"), F.max("terminal_ns").alias("last_ns"),
        F.count_if(F.expr("terminal_class = 'FAILED'")).alias("failed"))
    return _report(facts.selectExpr(*CONTROL), q.RESTART_CONTROL, "run_id")


QUERIES = {
    "rules_timing_v1": lambda s, d: _report(_req(s, d).selectExpr(*TIMING_V1), q.TIMING_V1, "request_id"),
    "rules_chunk": rules_chunk,
    "rules_request_v1": rules_request_v1,
    "rules_token_count": lambda s, d: _report(_req(s, d).selectExpr(*TOKEN_COUNT), q.TOKEN_COUNT, "request_id"),
    "rules_config": rules_config,
    "rules_summary": rules_summary,
    "rules_run": rules_run,
    "rules_request_v2": rules_request_v2,
    "rules_evidence_kind": rules_evidence_kind,
    "rules_timing_v3": rules_timing_v3,
    "rules_request_v3": rules_request_v3,
    "rules_exchange": rules_exchange,
    "rules_header": rules_header,
    "rules_policy": rules_policy,
    "rules_restart_control": rules_restart_control,
}


def _from(columns, source):
    return f"(SELECT {', '.join(columns)} FROM {source})"


_LIST = {**q.CHUNK,
    "stamp-count": "len(per_token_offsets_ns) = tokens_in_chunk",
    "stamps-not-ordered": """per_token_offsets_ns = list_sort(per_token_offsets_ns)
        AND len(list_distinct(per_token_offsets_ns)) = len(per_token_offsets_ns)""",
    "stamp-after-event": "per_token_offsets_ns[-1] <= event_offset_ns"}

_REQUEST_V2_DUCK = {**q.REQUEST_V2,
    "deltas-not-aligned": "len(deltas) = len(token_offsets_ns)",
    "delta-sum-differs": "coalesce(list_sum(deltas), 0) = output_tokens",
    "first-token-differs": "output_tokens = 0 OR coalesce(first_token_ns = token_offsets_ns[1], false)",
    "last-token-differs": "output_tokens = 0 OR coalesce(last_token_ns = token_offsets_ns[-1], false)",
    "complete-with-grouped-event": "NOT per_token_complete OR coalesce(list_bool_and([x = 1 FOR x IN deltas]), true)"}

_REQUEST_V3_DUCK = {
    "response-id-differs": "response_id = 'cmpl-' || external_id",
    "serving-item-id-differs": "item_id = 'cmpl-' || external_id || '-0'",
    "internal-id-malformed": "regexp_full_match(internal_id, 'cmpl-' || external_id || '-0-[0-9a-f]{8}')",
    "prompt-ids-differ": "sent_prompt = returned_prompt",
    "prompt-not-on-first-event": "n_prompts = 1 AND first_prompt AND returned_prompt = [1, 2]",
    "output-ids-differ": "true",
    "events-not-monotonic": "NOT went_back",
    "not-one-final-terminal": "n_terminals = 1",
    "terminal-tokens-flag-differs": "NOT terminal_carried_tokens",
    "first-token-differs": "first_token_ns = first_bearing_ns",
    "generation-terminal-differs": "generation_terminal_ns = last_at",
    "text-does-not-rebuild": "output_text = expected_text",
    "grouped-needs-unavailable": "max_event_tokens <= 1 OR (tpot_ns IS NULL AND tpot_reason = 'GROUPED_TOKEN_EVENT')",
    "tpot-does-not-rebuild": """max_event_tokens > 1 OR coalesce(
        tpot_ns = (generation_terminal_ns - first_token_ns) / nullif(output_tokens - 1, 0), tpot_ns IS NULL AND output_tokens < 2)""",
    "gaps-do-not-rebuild": "NOT (user_id % 13 = 0 AND token_events >= 2)",
    "itl-does-not-rebuild": "max_event_tokens > 1 OR token_events < 2 OR user_id % 11 <> 10",
}

_EXCHANGE_DUCK = {**q.EXCHANGE,
    "request-header-count": "request_header_count = len(request_names)",
    "response-header-count": "response_header_count = len(response_names)",
    "content-type-missing-or-repeated": "len([x FOR x IN response_names IF x = 'content-type']) = 1",
    "media-type-differs": "media_type = lower(trim(string_split(content_type, ';')[1]))",
    "host-differs": "request_host = host || ':' || port",
    "request-length-differs": "request_length = CAST(request_bytes AS VARCHAR)",
    "response-length-differs": "response_length = CAST(response_bytes AS VARCHAR)",
    "request-header-not-once": "len([n FOR n IN required_request_names IF len([x FOR x IN request_names IF x = n]) <> 1]) = 0",
    "response-header-not-once": "len([n FOR n IN required_response_names IF len([x FOR x IN response_names IF x = n]) <> 1]) = 0",
}

_HEADER_DUCK = {
    "size-differs": "message_id % 23 <> 0",
    "hash-differs": "message_id % 29 <> 0 OR v = 'other'",
    "not-ascii": "NOT regexp_matches(k || v, '[^\\x00-\\x7F]')",
    "name-malformed": "regexp_full_match(k, '[A-Za-z0-9!#$%&''*+.^_`|~-]+')",
    "control-byte": "NOT regexp_matches(v, '[\\x00-\\x1F\\x7F]')",
    "name-not-normalized": "normalized_name = lower(k)",
    "value-not-normalized": "normalized_value = trim(v, ' ' || chr(9))",
    "secret-header": f"NOT regexp_matches(normalized_name, '{q.SECRET_HEADER}')",
    "singleton-repeated": f"copies = 1 OR normalized_name NOT IN {q.SINGLETON_HEADERS}",
    "ambiguous-framing": "NOT both_framings",
}

_POLICY_DUCK = {**q.POLICY,
    "required-fields-repeat": "len(list_distinct(required_fields)) = len(required_fields)",
    "allowed-fields-repeat": "len(list_distinct(allowed_fields)) = len(allowed_fields)",
    "field-in-both-lists": "NOT list_has_any(required_fields, allowed_fields)",
    "essential-field-missing": "list_has_all(required_fields, essential_fields)",
    "runtime-list-wrong": """CASE WHEN comparison_kind = 'CROSS_RUNTIME' THEN list_contains(allowed_fields, 'runtime_identity')
        ELSE list_contains(required_fields, 'runtime_identity') END""",
    "hardware-list-wrong": """CASE WHEN comparison_kind = 'CROSS_HARDWARE' THEN list_contains(allowed_fields, 'hardware_identity')
        ELSE list_contains(required_fields, 'hardware_identity') END""",
}

_FACTS1 = """facts AS (SELECT request_id, count(*) AS chunks, min(chunk_index) AS lowest_index, max(chunk_index) AS highest_index,
      count(DISTINCT chunk_index) AS distinct_index, count(*) FILTER (WHERE before >= at_ns) AS steps_back,
      min(at_ns) AS earliest_event_ns, max(at_ns) AS latest_event_ns,
      min(own[1]) FILTER (WHERE stamped) AS earliest_stamp_ns, max(own[-1]) FILTER (WHERE stamped) AS latest_stamp_ns,
      sum(toks) AS stream_tokens, arg_min(own[1], (chunk_index, at_ns)) AS first_observation_ns,
      arg_max(own[-1], (chunk_index, at_ns)) AS last_observation_ns
    FROM (SELECT *, lag(at_ns) OVER (PARTITION BY request_id ORDER BY chunk_index, at_ns) AS before FROM (
      SELECT request_id, toks, off_ns - CASE WHEN event_id % 31 = 0 THEN 400000000000000 ELSE 0 END AS at_ns,
        row_number() OVER (PARTITION BY request_id ORDER BY pos) - 1 + CASE WHEN event_id % 29 = 0 THEN 1 ELSE 0 END AS chunk_index,
        toks = 2 AND event_id % 2 = 0 AS stamped,
        CASE WHEN toks = 2 AND event_id % 2 = 0 THEN [off_ns - 1000, off_ns]
             ELSE [off_ns - CASE WHEN event_id % 31 = 0 THEN 400000000000000 ELSE 0 END] END AS own
      FROM be WHERE token_bearing)) GROUP BY request_id),
    joined AS (SELECT r.*, coalesce(chunks, 0) AS chunks, lowest_index, highest_index, distinct_index,
      coalesce(steps_back, 0) AS steps_back, earliest_event_ns, latest_event_ns, earliest_stamp_ns, latest_stamp_ns,
      coalesce(stream_tokens, 0) AS stream_tokens, first_observation_ns, last_observation_ns
      FROM (SELECT """ + ", ".join(REQUEST_V1) + """ FROM req r) r LEFT JOIN facts f ON f.request_id = r.request_id)"""

_COUNTS_BY_USER = """(SELECT user_id AS run_id, count(*) FILTER (WHERE phase = 'MEASURED') AS attempted,
    count(*) FILTER (WHERE phase = 'MEASURED' AND outcome = 'SUCCESS') AS successful,
    count(*) FILTER (WHERE phase = 'MEASURED' AND outcome <> 'SUCCESS') AS failed,
    count(*) FILTER (WHERE phase = 'MEASURED' AND outcome = 'TIMEOUT') AS timed_out,
    count(*) FILTER (WHERE phase = 'MEASURED' AND outcome = 'CANCELLED') AS cancelled,
    count(*) FILTER (WHERE phase = 'MEASURED' AND outcome IN ('PROTOCOL_ERROR', 'MALFORMED_STREAM')) AS protocol_errors,
    count(*) FILTER (WHERE phase = 'WARMUP') AS warmup FROM req GROUP BY user_id)"""

_RUN_FACTS = """(SELECT user_id AS run_id, count(*) AS found_requests, count(DISTINCT request_id) AS found_distinct,
    count(*) FILTER (WHERE phase = 'MEASURED') AS found_measured, count(*) FILTER (WHERE phase = 'WARMUP') AS found_warmup,
    count(*) FILTER (WHERE user_id % 3 = 0 AND case_id = 'case-2') AS undeclared_cases,
    count(*) FILTER (WHERE phase = 'MEASURED' AND outcome = 'SUCCESS') AS found_successful,
    count(*) FILTER (WHERE phase = 'MEASURED' AND outcome <> 'SUCCESS') AS found_failed,
    count(*) FILTER (WHERE phase = 'MEASURED' AND outcome = 'TIMEOUT') AS found_timed_out,
    count(*) FILTER (WHERE phase = 'MEASURED' AND outcome = 'CANCELLED') AS found_cancelled,
    count(*) FILTER (WHERE phase = 'MEASURED' AND outcome IN ('PROTOCOL_ERROR', 'MALFORMED_STREAM')) AS found_protocol_errors
    FROM req GROUP BY user_id) f"""

_ARRAYS2 = "(SELECT r.*, coalesce(deltas, []) AS deltas, coalesce(token_offsets_ns, []) AS token_offsets_ns FROM (SELECT " + \
    ", ".join(REQUEST_V2) + """ FROM req) r LEFT JOIN (SELECT request_id,
      coalesce(list(toks ORDER BY pos) FILTER (WHERE event_id % 59 <> 0), []) AS deltas,
      list(off_ns ORDER BY pos) AS token_offsets_ns FROM be WHERE token_bearing GROUP BY request_id) a
    ON a.request_id = r.request_id)"""

_V3 = """ev3 AS (SELECT request_id, pos, n, toks, event_type, token_bearing, event_id, off_ns,
      off_ns - CASE WHEN event_id % 43 = 0 THEN 900000000000000 ELSE 0 END AS at_ns,
      pos = n - 1 AND event_id % 47 <> 0 AS fin, pos = 1 OR event_id % 53 = 0 AS prompt FROM be WHERE pos > 0 OR n = 1),
    g3 AS (SELECT request_id, count(*) FILTER (WHERE prompt) AS n_prompts, bool_or(prompt AND (pos = 1 OR n = 1)) AS first_prompt,
      count(*) FILTER (WHERE fin) AS n_terminals, bool_or(before > at_ns) AS went_back,
      arg_min(at_ns, pos) FILTER (WHERE token_bearing) AS first_bearing_ns, arg_max(at_ns, pos) AS last_at,
      max(off_ns) AS generation_terminal_ns, string_agg(event_type, '' ORDER BY pos) AS expected_text,
      string_agg(event_type, ' ' ORDER BY pos) AS spaced_text
      FROM (SELECT *, lag(at_ns) OVER (PARTITION BY request_id ORDER BY pos) AS before FROM ev3) GROUP BY request_id),
    v3 AS (SELECT g3.*, user_id, token_events, first_token_ns, max_event_tokens, output_tokens, g3.request_id AS external_id,
      'cmpl-' || CASE WHEN user_id % 17 = 0 THEN 'x' ELSE '' END || g3.request_id AS response_id,
      'cmpl-' || g3.request_id || '-0' AS item_id,
      'cmpl-' || g3.request_id || '-0-' || CASE WHEN user_id % 19 = 0 THEN 'XYZ' ELSE md5(g3.request_id)[1:8] END AS internal_id,
      [1, 2] AS sent_prompt, CASE WHEN user_id % 23 = 0 THEN [1, 3] ELSE [1, 2] END AS returned_prompt,
      user_id % 29 = 0 AS terminal_carried_tokens,
      CASE WHEN user_id % 31 = 0 THEN spaced_text ELSE expected_text END AS output_text,
      CASE WHEN max_event_tokens = 1 AND output_tokens >= 2 OR user_id % 37 = 0
        THEN (generation_terminal_ns - first_token_ns) / nullif(output_tokens - 1, 0) END AS tpot_ns,
      CASE WHEN max_event_tokens > 1 AND user_id % 41 <> 0 THEN 'GROUPED_TOKEN_EVENT' END AS tpot_reason
      FROM g3 JOIN req ON req.request_id = g3.request_id)"""

_POLICIES = f"""(SELECT policy_id, ['workload', 'model', 'tokenizer']
      || CASE WHEN policy_id % 7 <> 0 THEN ['sampling'] ELSE [] END
      || CASE WHEN policy_id % 3 <> 0 THEN ['runtime_identity'] ELSE [] END
      || CASE WHEN policy_id % 5 <> 0 THEN ['hardware_identity'] ELSE [] END || langs AS required_fields,
    CASE WHEN policy_id % 3 = 0 THEN ['runtime_identity'] ELSE [] END
      || CASE WHEN policy_id % 11 = 0 THEN ['model', 'x', 'x'] ELSE [] END AS allowed_fields,
    {_duck_names(POLICY_FIELDS)} AS essential_fields,
    CASE WHEN policy_id % 3 = 0 THEN 'CROSS_RUNTIME' WHEN policy_id % 4 = 0 THEN 'CROSS_HARDWARE'
      ELSE 'SAME_RUNTIME_AND_HARDWARE' END AS comparison_kind,
    policy_id % 13 AS minimum_successful_requests, files AS minimum_metric_samples
    FROM (SELECT doc_id // 10 AS policy_id, count(*) AS files, list(lang) AS langs FROM documents GROUP BY doc_id // 10))"""

ORACLES = {
    "rules_timing_v1": sql("req", rules_sql(_from(TIMING_V1, "req"), "request_id", q.TIMING_V1)),
    "rules_chunk": sql("be", rules_sql(
        f"""(SELECT event_id, off_ns AS event_offset_ns, toks AS tokens_in_chunk,
            {CHUNK_ARRAY.replace('array(', 'list_value(')} AS per_token_offsets_ns FROM be WHERE token_bearing)""",
        "event_id", _LIST)),
    "rules_request_v1": sql("req", f"WITH {_FACTS1} " + rules_sql("joined", "request_id", q.REQUEST_V1)),
    "rules_token_count": sql("req", rules_sql(_from(TOKEN_COUNT, "req"), "request_id", q.TOKEN_COUNT)),
    "rules_config": sql("req", rules_sql(_from(CONFIG, f"({CONFIG_FACTS})"), "user_id", q.CONFIGURATION)),
    "rules_summary": sql("req", rules_sql(_from(SUMMARY, _COUNTS_BY_USER), "run_id", q.SUMMARY)),
    "rules_run": sql("req", rules_sql(_from(RUN, _RUN_FACTS), "run_id", {
        **q.RUN, "created-not-utc": "regexp_matches(created_at, '(Z|[+]00:00)$')"})),
    "rules_request_v2": sql("req be", rules_sql(_ARRAYS2, "request_id", _REQUEST_V2_DUCK)),
    "rules_evidence_kind": sql("sev", rules_sql(_from(EVENT, "sev"), "event_id, kind", q.EVIDENCE_EVENT)),
    "rules_timing_v3": sql("req", rules_sql(_from(TIMING_V3, "req"), "request_id", q.TIMING_V3)),
    "rules_request_v3": sql("be req", f"WITH {_V3} " + rules_sql("v3", "request_id", _REQUEST_V3_DUCK)),
    "rules_exchange": sql("req", rules_sql(_from([*EXCHANGE, *_exchange_arrays(_duck_names)], "req"), "exchange_id", _EXCHANGE_DUCK)),
    "rules_header": f"WITH {HEADERS_CTE} " + rules_sql("hd", "message_id, ordinal", _HEADER_DUCK),
    "rules_policy": rules_sql(_POLICIES, "policy_id", _POLICY_DUCK),
    "rules_restart_control": sql("req", rules_sql(_from(CONTROL, """(SELECT user_id AS run_id, count(*) AS requests,
        count(DISTINCT request_id) AS distinct_ids, min(dispatch_ns) AS first_ns, max(terminal_ns) AS last_ns,
        count(*) FILTER (WHERE terminal_class = 'FAILED') AS failed FROM req GROUP BY user_id)"""), "run_id", q.RESTART_CONTROL)),
}
