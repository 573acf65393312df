"""Explicit schemas of the retained records, and their shape as operator tables.

Records are read with these schemas, never with inferred ones. ``requests_v1`` and ``requests_v2``
flatten the nested request records of the two contract versions into the columns the metric jobs
read; both keep the token-bearing events nested, so no metric needs a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FAILURE = "kind STRING, origin STRING, error_code STRING, occurred_offset_ns BIGINT"
_POLICY = ("connect_timeout_seconds DOUBLE, write_timeout_seconds DOUBLE, pool_timeout_seconds DOUBLE, "
           "read_timeout_seconds DOUBLE")
_COUNT = ("value BIGINT, source STRING, quality STRING, tokenizer_id STRING, tokenizer_revision STRING, "
          "provider_field_name STRING")

# Field names and types of the retained records.
SCHEMAS: dict[str, str] = {
    "requests_v1": f"""run_id STRING, request_id STRING, case_id STRING, phase STRING, outcome STRING,
        timing STRUCT<dispatch_offset_ns BIGINT, first_response_byte_offset_ns BIGINT,
          first_output_token_offset_ns BIGINT, last_output_token_offset_ns BIGINT, terminal_offset_ns BIGINT>,
        stream_events ARRAY<STRUCT<chunk_index BIGINT, event_offset_ns BIGINT, output_tokens_in_chunk BIGINT,
          per_token_observation_offsets_ns ARRAY<BIGINT>>>,
        input_tokens STRUCT<{_COUNT}>, output_tokens STRUCT<{_COUNT}>,
        failure STRUCT<kind STRING, occurred_offset_ns BIGINT, error_code STRING>""",
    "requests_v2": f"""run_id STRING, request_id STRING, case_id STRING, phase STRING, terminal_class STRING,
        http_status BIGINT, timing STRUCT<dispatch_offset_ns BIGINT, response_headers_offset_ns BIGINT,
          first_response_body_bytes_offset_ns BIGINT, first_output_token_offset_ns BIGINT,
          last_output_token_offset_ns BIGINT, terminal_offset_ns BIGINT>,
        input_token_count BIGINT, output_token_count BIGINT, token_count_source STRING,
        token_event_delta_counts ARRAY<BIGINT>, token_event_observation_offsets_ns ARRAY<BIGINT>,
        per_token_observation_complete BOOLEAN, slo_satisfied BOOLEAN,
        failure STRUCT<{_FAILURE}, timeout_policy STRUCT<{_POLICY}>>""",
    "stream_events": """run_id STRING, sequence BIGINT, request_id STRING, case_id STRING, phase STRING, kind STRING,
        observation_offset_ns BIGINT, raw_chunk_sequence BIGINT, raw_bytes_base64 STRING, raw_byte_count BIGINT,
        raw_bytes_sha256 STRING, sse_event_sequence BIGINT, sse_data STRING, token_delta_count BIGINT,
        terminal_class STRING, failure_kind STRING""",
    "server_events": """run_id STRING, sequence BIGINT, request_id STRING, case_id STRING, kind STRING,
        observation_offset_ns BIGINT, action_index BIGINT, token_delta_count BIGINT, http_status BIGINT""",
    "headers": "message_id STRING, direction STRING, ordinal BIGINT, name_base64 STRING, value_base64 STRING",
    "log_records": """source_stream_id STRING, record_ordinal BIGINT, byte_start BIGINT, byte_end BIGINT,
        observation_offset_ns BIGINT, raw_record STRING, raw_record_sha256 STRING""",
    "scrapes": """slot STRING, scrape_id STRING, process_start_id STRING, scrape_offset_ns BIGINT, scrape_utc TIMESTAMP,
        exposition_text STRING, sha256 STRING""",
    "phases": "run_id STRING, phase STRING, started_ns BIGINT, ended_ns BIGINT, passed BOOLEAN",
    "memory_samples": "run_id STRING, observation_ns BIGINT, allocated_bytes BIGINT",
    "restart_records": """case_id STRING, repetition_index INT, sent_prompt ARRAY<BIGINT>, returned_prompt ARRAY<BIGINT>,
        output_ids ARRAY<BIGINT>, finish_reason STRING, prompt_tokens BIGINT, completion_tokens BIGINT,
        total_tokens BIGINT, output_text_sha256 STRING, replacement_run BOOLEAN""",
    "workload_cases": """workload STRING, case_id STRING, prompt STRING, expected_terminal_class STRING,
        expected_output_token_count BIGINT""",
    "files": "bundle_id STRING, path STRING, size BIGINT, sha256 STRING",
}


def read_records(spark: SparkSession, kind: str, paths: str | list[str]) -> DataFrame:
    """JSON lines of one record type; a line that does not fit has null fields (see ``evidence``)."""
    return spark.read.schema(SCHEMAS[kind]).json(paths)


def requests_v2(records: DataFrame) -> DataFrame:
    """Version-2 request records as the columns of the metric jobs and of ``quality.REQUEST_V2``."""
    return records.selectExpr(
        "run_id", "request_id", "case_id", "phase", "terminal_class", "terminal_class AS outcome", "http_status",
        "timing.dispatch_offset_ns AS dispatch_ns", "timing.response_headers_offset_ns AS headers_ns",
        "timing.first_response_body_bytes_offset_ns AS first_body_ns",
        "timing.first_output_token_offset_ns AS first_token_ns",
        "timing.last_output_token_offset_ns AS last_token_ns", "timing.terminal_offset_ns AS terminal_ns",
        "input_token_count AS input_tokens", "output_token_count AS output_tokens",
        "input_token_count AS input_value", "output_token_count AS output_value",
        "coalesce(array_max(token_event_delta_counts), 0L) AS max_event_tokens",
        "CAST(size(token_event_delta_counts) AS BIGINT) AS token_events",
        "per_token_observation_complete AS per_token_complete", "slo_satisfied",
        "token_event_delta_counts AS deltas", "token_event_observation_offsets_ns AS token_offsets_ns",
        "failure.kind AS failure_kind", "failure.occurred_offset_ns AS failure_ns",
        "to_json(failure.timeout_policy) AS timeout_policy",
        """transform(arrays_zip(token_event_delta_counts, token_event_observation_offsets_ns), (e, i) -> named_struct(
             'chunk_index', CAST(i AS BIGINT), 'event_offset_ns', e.token_event_observation_offsets_ns,
             'tokens_in_chunk', e.token_event_delta_counts,
             'per_token_offsets_ns', CAST(NULL AS ARRAY<BIGINT>))) AS stream_events""",
    )


def requests_v1(records: DataFrame) -> DataFrame:
    """Version-1 request records as the columns of the metric jobs; unknown counts stay null."""
    known = F.col("outcome").isin("SUCCESS", "TIMEOUT", "CANCELLED")
    return records.withColumn("terminal_class", F.when(known, F.col("outcome")).otherwise("FAILED")).selectExpr(
        "run_id", "request_id", "case_id", "phase", "outcome", "terminal_class",
        "timing.dispatch_offset_ns AS dispatch_ns", "timing.first_response_byte_offset_ns AS first_byte_ns",
        "timing.first_output_token_offset_ns AS first_token_ns",
        "timing.last_output_token_offset_ns AS last_token_ns", "timing.terminal_offset_ns AS terminal_ns",
        "input_tokens.value AS input_value", "output_tokens.value AS output_value",
        "coalesce(input_tokens.value, 0L) AS input_tokens", "coalesce(output_tokens.value, 0L) AS output_tokens",
        "coalesce(array_max(stream_events.output_tokens_in_chunk), 0L) AS max_event_tokens",
        "failure.kind AS failure_kind", "failure.occurred_offset_ns AS failure_ns",
        """transform(stream_events, e -> named_struct('chunk_index', e.chunk_index, 'event_offset_ns', e.event_offset_ns,
             'tokens_in_chunk', e.output_tokens_in_chunk,
             'per_token_offsets_ns', e.per_token_observation_offsets_ns)) AS stream_events""",
    )


def lifecycle_events(records: DataFrame) -> DataFrame:
    """Evidence events as the lifecycle, consistency, shape and streaming jobs read them."""
    return records.withColumnRenamed("observation_offset_ns", "off_ns")


def body_chunks(records: DataFrame) -> DataFrame:
    """The raw body reads among the evidence events, still encoded (see ``replay.decode_chunks``)."""
    return records.where("kind = 'RAW_BODY_CHUNK'").selectExpr(
        "run_id", "request_id", "raw_chunk_sequence AS ordinal", "observation_offset_ns",
        "raw_bytes_base64", "raw_byte_count", "raw_bytes_sha256",
    )
