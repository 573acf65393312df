"""Retained records from JSON lines through to summaries, rules and replay."""

from __future__ import annotations

import base64
import hashlib
import json

import pytest

from servescope.functions.rules import check_rules
from servescope.operators import quality as q
from servescope.operators import replay as rp
from servescope.operators import request_metrics as rm
from servescope.operators import run_summary as rs
from servescope.operators import timeline as tl
from servescope.sources import records as rc
from test_metrics import RUN_A


def v2_record(name, phase, cls, tokens_in, dispatch, end, events):
    return {
        "run_id": "a", "request_id": name, "case_id": name, "phase": phase, "terminal_class": cls, "http_status": 200,
        "timing": {
            "dispatch_offset_ns": dispatch, "first_output_token_offset_ns": events[0][0] if events else None,
            "last_output_token_offset_ns": events[-1][0] if events else None, "terminal_offset_ns": end},
        "input_token_count": tokens_in, "output_token_count": sum(n for _, n in events), "token_count_source": "FIXTURE_EXACT",
        "token_event_delta_counts": [n for _, n in events], "token_event_observation_offsets_ns": [at for at, _ in events],
        "per_token_observation_complete": bool(events) and all(n == 1 for _, n in events), "slo_satisfied": cls == "SUCCESS",
        "failure": None if cls == "SUCCESS" else {
            "kind": "TIMEOUT" if cls == "TIMEOUT" else "HTTP_STATUS", "occurred_offset_ns": end,
            "timeout_policy": {"read_timeout_seconds": 0.5} if cls == "TIMEOUT" else None}}


def test_version_two_records_give_the_golden_summary(spark, tmp_path):
    lines = [json.dumps(v2_record(*row)) for row in RUN_A]
    (tmp_path / "requests.jsonl").write_text("\n".join(lines) + "\n")
    requests = rc.requests_v2(rc.read_records(spark, "requests_v2", str(tmp_path / "requests.jsonl")))
    row = rs.run_summary_v2(requests).first()
    assert (row.run_id, row.attempted, row.window_ns, row.itl_count) == ("a", 8, 735159333, 5)
    assert row.tpot_p95 == pytest.approx(45238421.875) and row.goodput == pytest.approx(6.801246717)
    assert all(r.violations == [] for r in check_rules(requests, q.REQUEST_V2).collect())


def test_version_one_records(spark, tmp_path):
    record = {
        "run_id": "a", "request_id": "r", "case_id": "c", "phase": "MEASURED", "outcome": "SUCCESS",
        "timing": {"dispatch_offset_ns": 0, "first_response_byte_offset_ns": 10, "first_output_token_offset_ns": 20,
                   "last_output_token_offset_ns": 55, "terminal_offset_ns": 60},
        "stream_events": [{"chunk_index": 0, "event_offset_ns": 20, "output_tokens_in_chunk": 1},
                          {"chunk_index": 1, "event_offset_ns": 55, "output_tokens_in_chunk": 2,
                           "per_token_observation_offsets_ns": [30, 55]}],
        "input_tokens": {"value": None, "source": "UNKNOWN", "quality": "UNAVAILABLE"},
        "output_tokens": {"value": 3, "source": "FIXTURE_EXACT", "quality": "EXACT"}, "failure": None}
    (tmp_path / "r.jsonl").write_text(json.dumps(record) + "\n")
    requests = rc.requests_v1(rc.read_records(spark, "requests_v1", str(tmp_path / "r.jsonl")))
    assert rm.itl_gaps_v1(requests).first().gaps_ns == [10, 25]
    row = rs.token_throughput(requests).first()
    assert row.output_v1_tokens_per_second is not None and row.total_v1_tokens_per_second is None
    assert check_rules(requests, q.TIMING_V1).first().violations == []


def test_evidence_events_feed_concurrency_and_replay(spark, tmp_path):
    body = [b"data: a\r\n\r", b"\ndata: [DONE]\n\n"]
    kinds = ["CLIENT_REQUEST_STARTED", "RAW_BODY_CHUNK", "RAW_BODY_CHUNK", "CLIENT_REQUEST_ENDED"]
    lines = []
    for i, kind in enumerate(kinds):
        event = {"run_id": "a", "sequence": i, "request_id": "r", "kind": kind, "observation_offset_ns": 10 * i}
        if kind == "RAW_BODY_CHUNK":
            raw = body[i - 1]
            event |= {"raw_chunk_sequence": i - 1, "raw_bytes_base64": base64.b64encode(raw).decode(),
                      "raw_byte_count": len(raw), "raw_bytes_sha256": hashlib.sha256(raw).hexdigest()}
        lines.append(json.dumps(event))
    (tmp_path / "e.jsonl").write_text("\n".join(lines) + "\n")
    events = rc.read_records(spark, "stream_events", str(tmp_path / "e.jsonl"))
    assert tl.concurrency_by_sequence(rc.lifecycle_events(events)).first().max_concurrency == 1
    chunks = rp.decode_chunks(rc.body_chunks(events))
    assert [r.integrity for r in chunks.collect()] == [None, None]
    frames = rp.sse_frames(chunks).orderBy("frame_index").collect()
    assert [(r.kind, r.data, r.observation_offset_ns) for r in frames] == [("data", "a", 20), ("done", "[DONE]", 20)]


def test_every_schema_is_valid(spark):
    for kind, ddl in rc.SCHEMAS.items():
        assert spark.createDataFrame([], ddl).columns, kind
