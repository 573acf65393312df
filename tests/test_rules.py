"""Mutation: a sound record has no violation; one changed field names exactly its rule."""

from __future__ import annotations

import pytest

from servescope.functions.rules import check_rules
from servescope.operators import quality as q

TIMING = ({"dispatch_ns": 10, "first_byte_ns": 12, "first_token_ns": 13, "last_token_ns": 20, "terminal_ns": 30},
          "dispatch_ns long, first_byte_ns long, first_token_ns long, last_token_ns long, terminal_ns long", q.TIMING_V1)
TOKENS = ({"value": 3, "source": "FIXTURE_EXACT", "quality": "EXACT", "tokenizer_id": None, "tokenizer_revision": None, "provider_field": None},
          "value long, source string, quality string, tokenizer_id string, tokenizer_revision string, provider_field string", q.TOKEN_COUNT)
EVENT = ({"kind": "REQUEST_TERMINAL", "raw_chunk_sequence": None, "raw_bytes_base64": None, "raw_byte_count": None,
          "raw_bytes_sha256": None, "sse_event_sequence": None, "sse_data": None, "token_delta_count": None,
          "terminal_class": "SUCCESS", "failure_kind": None},
         "kind string, raw_chunk_sequence long, raw_bytes_base64 string, raw_byte_count long, raw_bytes_sha256 string, "
         "sse_event_sequence long, sse_data string, token_delta_count long, terminal_class string, failure_kind string", q.EVIDENCE_EVENT)
REQUEST = ({"dispatch_ns": 0, "headers_ns": 1, "first_body_ns": 2, "first_token_ns": 3, "last_token_ns": 5, "terminal_ns": 9,
            "terminal_class": "SUCCESS", "failure_kind": None, "failure_ns": None, "http_status": 200, "slo_satisfied": True,
            "output_tokens": 2, "deltas": [1, 1], "token_offsets_ns": [3, 5], "per_token_complete": True, "timeout_policy": None},
           "dispatch_ns long, headers_ns long, first_body_ns long, first_token_ns long, last_token_ns long, terminal_ns long, "
           "terminal_class string, failure_kind string, failure_ns long, http_status long, slo_satisfied boolean, output_tokens long, "
           "deltas array<long>, token_offsets_ns array<long>, per_token_complete boolean, timeout_policy string", q.REQUEST_V2)
POLICY = ({"required_fields": ["a", "b", "runtime_identity", "hardware_identity"], "allowed_fields": [], "essential_fields": ["a"],
           "comparison_kind": "SAME_RUNTIME_AND_HARDWARE", "minimum_successful_requests": 1, "minimum_metric_samples": 1},
          "required_fields array<string>, allowed_fields array<string>, essential_fields array<string>, comparison_kind string, "
          "minimum_successful_requests long, minimum_metric_samples long", q.POLICY)
V3 = ({n: i for i, n in enumerate(("dispatch_ns", "headers_ns", "first_body_ns", "first_token_ns", "generation_terminal_ns",
                                   "usage_terminal_ns", "protocol_terminal_ns", "transport_terminal_ns"))},
      "dispatch_ns long, headers_ns long, first_body_ns long, first_token_ns long, generation_terminal_ns long, "
      "usage_terminal_ns long, protocol_terminal_ns long, transport_terminal_ns long", q.TIMING_V3)

CASES = [
    (TIMING, {}, []),
    (TIMING, {"terminal_ns": 5, "first_byte_ns": None, "first_token_ns": None, "last_token_ns": None}, ["terminal-before-dispatch"]),
    (TIMING, {"first_byte_ns": 9}, ["observation-outside-interval"]),
    (TIMING, {"first_token_ns": None}, ["last-without-first"]),
    (TIMING, {"last_token_ns": 12, "first_byte_ns": None}, ["last-before-first"]),
    (TIMING, {"first_byte_ns": 14}, ["byte-after-token"]),
    (TOKENS, {}, []),
    (TOKENS, {"quality": "DERIVED"}, ["fixture-needs-exact"]),
    (TOKENS, {"tokenizer_id": "t"}, ["identity-only-for-tokenizer"]),
    (TOKENS, {"provider_field": "usage"}, ["provider-field-only-for-server"]),
    (TOKENS, {"source": "SERVER_REPORTED"}, ["server-needs-provider-field"]),
    (TOKENS, {"value": None}, ["unavailable-needs-unknown-source", "unavailable-needs-unavailable-quality"]),
    (EVENT, {}, []),
    (EVENT, {"terminal_class": None}, ["terminal-class-missing"]),
    (EVENT, {"failure_kind": "TIMEOUT"}, ["failure-kind-iff-failure"]),
    (EVENT, {"terminal_class": "FAILED", "failure_kind": "TIMEOUT"}, ["failure-kind-differs"]),
    (EVENT, {"token_delta_count": 1}, ["token-delta-unexpected"]),
    (EVENT, {"raw_byte_count": 1}, ["raw-fields-unexpected"]),
    (EVENT, {"sse_event_sequence": 1}, ["sse-sequence-presence"]),
    (REQUEST, {}, []),
    (REQUEST, {"http_status": 404}, ["success-without-2xx"]),
    (REQUEST, {"terminal_class": "FAILED", "slo_satisfied": False}, ["failure-missing"]),
    (REQUEST, {"deltas": [1, 2]}, ["delta-sum-differs", "complete-with-grouped-event"]),
    (REQUEST, {"headers_ns": 4}, ["observations-not-chronological"]),
    (REQUEST, {"first_token_ns": 4}, ["first-token-differs"]),
    (REQUEST, {"last_token_ns": 6}, ["last-token-differs"]),
    (REQUEST, {"timeout_policy": "p"}, ["timeout-policy-mismatch"]),
    (POLICY, {}, []),
    (POLICY, {"required_fields": ["a", "a", "runtime_identity", "hardware_identity"]}, ["required-fields-repeat"]),
    (POLICY, {"allowed_fields": ["b"]}, ["field-in-both-lists"]),
    (POLICY, {"essential_fields": ["z"]}, ["essential-field-missing"]),
    (POLICY, {"comparison_kind": "CROSS_RUNTIME"}, ["runtime-list-wrong"]),
    (V3, {}, []),
    (V3, {"usage_terminal_ns": 4}, ["terminals-not-strict"]),
    (V3, {"headers_ns": 3}, ["marks-not-monotonic"]),
]


@pytest.mark.parametrize(("record", "change", "expected"), CASES)
def test_mutations(spark, record, change, expected):
    base, ddl, rules = record
    row = {**base, **change}
    df = spark.createDataFrame([tuple(row[c.split()[0]] for c in ddl.split(", "))], ddl)
    assert check_rules(df, rules).first().violations == expected
