"""Unit values and the golden run, for the formulas of all contract versions."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from servescope.operators import request_metrics as rm
from servescope.operators import run_summary as rs
from servescope.operators.order_statistics import exact_percentiles

REQUEST = ("run_id long, request_id string, case_id string, phase string, outcome string, terminal_class string, "
           "dispatch_ns long, first_token_ns long, last_token_ns long, terminal_ns long, input_tokens long, "
           "output_tokens long, output_value long, input_value long, max_event_tokens long, slo_satisfied boolean, "
           "stream_events array<struct<chunk_index:long,event_offset_ns:long,tokens_in_chunk:long,per_token_offsets_ns:array<long>>>")


def request(spark, **given):
    base = {
        "run_id": 1, "request_id": "r", "case_id": "c", "phase": "MEASURED", "outcome": "SUCCESS",
        "terminal_class": "SUCCESS", "dispatch_ns": 0, "first_token_ns": 20, "last_token_ns": 50, "terminal_ns": 60,
        "input_tokens": 2, "output_tokens": 3, "output_value": 3, "input_value": 2, "max_event_tokens": 1,
        "slo_satisfied": True, "stream_events": [(0, 20, 1, None), (1, 30, 1, None), (2, 50, 1, None)],
    }
    rows = [{**base, **g} for g in given.get("rows", [given])]
    names = [c.split()[0] for c in REQUEST.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], REQUEST)


def one(df, column):
    return df.select(column.alias("v")).first().v


def test_percentiles_of_four(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (4, 1, 3, 2)], "g int, v double")
    row = exact_percentiles(df, ["g"], "v").first()
    assert (row.p50, row.sample_count) == (2.5, 4)
    assert row.p95 == pytest.approx(3.85) and row.p99 == pytest.approx(3.97)


@pytest.mark.parametrize("hot_samples", [0, 1000, 10**9])
def test_percentiles_match_sorted_order_with_a_hot_group(spark, hot_samples):
    rng = random.Random(5)
    rows = [(0, rng.lognormvariate(3, 2)) for _ in range(4000)] + [(0, 7.5)] * 900
    rows += [(g, rng.choice([-3.0, 0.0, 1e-9, 2.0, 1e15])) for g in (1, 2, 3) for _ in range(rng.randint(1, 40))]
    rows += [(4, -float(i)) for i in range(25)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: r for r in exact_percentiles(df, ["g"], "v", hot_samples=hot_samples).collect()}
    assert len(got) == 5
    for group in range(5):
        values = sorted(v for g, v in rows if g == group)
        for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
            h = (len(values) - 1) * p
            lo, hi = values[math.floor(h)], values[math.ceil(h)]
            assert got[group][name] == lo + (h - math.floor(h)) * (hi - lo)


def test_ttft_uses_the_first_token_not_the_first_byte(spark):
    assert one(request(spark, dispatch_ns=100, first_token_ns=150), rm.ttft()) == 50


def test_tpot_versions(spark):
    df = request(spark)
    assert one(df, rm.tpot_v1()) == 15.0
    assert one(df, rm.tpot_v2()) == 20.0
    assert one(df, rm.observed_span()) == 15.0
    assert one(df, rm.tpot_v3()) == 20.0
    assert one(request(spark, max_event_tokens=2), rm.tpot_v3_reason()) == "GROUPED_TOKEN_EVENT"


@pytest.mark.parametrize(("change", "reason"), [
    ({"outcome": "TIMEOUT"}, "REQUEST_FAILED"),
    ({"output_value": None}, "MISSING_TOKEN_COUNT"),
    ({"output_value": 1}, "INSUFFICIENT_OUTPUT_TOKENS"),
    ({"first_token_ns": None}, "MISSING_TOKEN_TIMESTAMPS"),
])
def test_tpot_v1_reasons(spark, change, reason):
    df = request(spark, **change)
    assert one(df, rm.tpot_v1_reason()) == reason
    assert one(df, rm.tpot_v1()) is None


def test_itl_gaps(spark):
    df = request(spark, stream_events=[(0, 20, 1, None), (1, 30, 1, None), (2, 55, 1, None)])
    assert rm.itl_gaps_v1(df).first().gaps_ns == [10, 25]
    assert [r.gap_ns for r in rm.itl_gaps_v2(df).orderBy("chunk_index").collect()] == [10, 25]
    assert rm.output_gaps_v3(df).first().itl_mean_ns == 17.5


@pytest.mark.parametrize(("events", "count", "reason"), [
    ([(0, 20, 2, None)], 2, "MULTI_TOKEN_CHUNK_WITHOUT_TOKEN_TIMESTAMPS"),
    ([], 0, "MISSING_TOKEN_TIMESTAMPS"),
    ([(0, 20, 1, None)], 2, "TOKEN_TIMESTAMP_COUNT_MISMATCH"),
    ([(0, 30, 1, None), (1, 30, 1, None)], 2, "MISSING_TOKEN_TIMESTAMPS"),
    ([(0, 30, 2, [20, 30])], 2, None),
])
def test_token_observation_reasons(spark, events, count, reason):
    row = rm.token_observations(request(spark, stream_events=events, output_value=count)).first()
    assert row.observation_reason == reason


def test_flat_token_events_nest_like_the_record(spark):
    flat = spark.createDataFrame(
        [(1, "r", 1, 30, 1, None), (1, "r", 0, 20, 1, None)],
        "run_id long, request_id string, chunk_index long, event_offset_ns long, tokens_in_chunk long, per_token_offsets_ns array<long>")
    nested = rm.with_stream_events(request(spark).drop("stream_events"), flat).first().stream_events
    assert [e.event_offset_ns for e in nested] == [20, 30]


def test_slo_v1_declared_threshold_without_metric_fails(spark):
    df = rm.with_metrics(request(spark, first_token_ns=None))
    assert one(df, rm.slo_v1({"ttft_ns": 100})) is False
    assert one(df, rm.slo_v1({"ttft_ns": None, "end_to_end_ns": 60})) is True


def test_unknown_tokens_make_throughput_unavailable(spark):
    df = request(spark, rows=[{"request_id": "a"}, {"request_id": "b", "input_value": None}])
    row = rs.token_throughput(df).first()
    assert row.output_v1_tokens_per_second is not None and row.total_v1_tokens_per_second is None


def test_failed_counts_differ_by_version(spark):
    df = request(spark, rows=[
        {"request_id": "a"}, {"request_id": "b", "outcome": "TIMEOUT", "terminal_class": "TIMEOUT"},
        {"request_id": "c", "outcome": "HTTP_ERROR", "terminal_class": "FAILED"},
        {"request_id": "w", "phase": "WARMUP"}])
    assert rs.counts_v1(df).first().failed == 2
    assert rs.counts_v2(df).first().failed == 1
    assert rs.counts_v2(df).first().attempted == 3


def test_empty_distribution_keeps_its_row(spark):
    df = request(spark, outcome="TIMEOUT", terminal_class="TIMEOUT")
    rows = rs.distributions(df.select("run_id"), rs.samples_v2(df), rs.DENOMINATORS_V2).collect()
    assert len(rows) == 5 and {r.unavailable_reason for r in rows} == {"NO_SAMPLES"}


RUN_A = [
    ("warmup-001", "WARMUP", "SUCCESS", 2, 35133708, 82986958, [(50521958, 1), (61427875, 1)]),
    ("measured-001", "MEASURED", "SUCCESS", 2, 83260375, 186808917, [(115416000, 1), (135895042, 1), (156248708, 1)]),
    ("measured-002", "MEASURED", "SUCCESS", 2, 83489917, 184845167, [(111061792, 1), (132170500, 1), (153334625, 1)]),
    ("measured-003", "MEASURED", "SUCCESS", 2, 185103500, 257005542, [(207774875, 1), (229101042, 2)]),
    ("measured-004", "MEASURED", "SUCCESS", 2, 187184000, 286801083, [(240089708, 1), (260550208, 1)]),
    ("measured-005", "MEASURED", "SUCCESS", 1, 257622167, 309017125, [(281754958, 1)]),
    ("measured-006", "MEASURED", "FAILED", 2, 287398417, 332795250, [(310958667, 1)]),
    ("measured-007", "MEASURED", "FAILED", 2, 309544750, 313089417, []),
    ("measured-008", "MEASURED", "TIMEOUT", 2, 313585417, 818419708, []),
]


def test_golden_run_summary(spark):
    rows = [
        {
            "request_id": name, "phase": phase, "terminal_class": cls, "outcome": cls, "dispatch_ns": dispatch,
            "terminal_ns": end, "input_tokens": tokens_in, "input_value": tokens_in,
            "first_token_ns": events[0][0] if events else None, "last_token_ns": events[-1][0] if events else None,
            "output_tokens": sum(n for _, n in events), "output_value": sum(n for _, n in events),
            "max_event_tokens": max((n for _, n in events), default=0),
            "slo_satisfied": cls == "SUCCESS" and end - dispatch <= 5_000_000_000,
            "stream_events": [(i, at, n, None) for i, (at, n) in enumerate(events)],
        }
        for name, phase, cls, tokens_in, dispatch, end, events in RUN_A
    ]
    got = rs.run_summary_v2(request(spark, rows=rows)).first().asDict()
    want = {
        "window_ns": 735159333, "attempted": 8, "successful": 5, "failed": 2, "timed_out": 1, "cancelled": 0, "warmup": 1,
        "max_concurrency": 2, "offered_request_rate": 10.881994747, "successful_request_throughput": 6.801246717,
        "goodput": 6.801246717, "output_token_throughput": 16.322992121, "total_token_throughput": 28.565236211,
        "failure_rate": 0.25, "timeout_rate": 0.125,
        "end_to_end_count": 5, "end_to_end_p50": 99617083.0, "end_to_end_p95": 103109883.6, "end_to_end_p99": 103460810.32,
        "ttft_p50": 27571875.0, "ttft_p95": 48755691.4, "ttft_p99": 52075704.68,
        "tpot_count": 4, "tpot_p50": 36294073.0, "tpot_p95": 45238421.875, "tpot_p99": 46416784.375,
        "itl_count": 5, "itl_p50": 20479042.0, "itl_p95": 21153041.6, "itl_p99": 21161908.32,
        "token_span_p50": 20438427.0, "token_span_p95": 21035029.025, "token_span_p99": 21116139.005,
    }
    for name, value in want.items():
        assert got[name] == pytest.approx(value, abs=1e-6), name


@pytest.mark.parametrize(("cause", "expected"), [
    ({"http_status": 503}, ("FAILED", "HTTP_STATUS", "HTTP_STATUS", "http-status-503")),
    ({"timed_out": True, "malformed": True}, ("TIMEOUT", "TIMEOUT", "HTTP_CLIENT", "httpx-timeout")),
    ({"malformed": True}, ("FAILED", "PROTOCOL_MALFORMED_STREAM", "SSE_PARSER", "malformed-sse-stream")),
    ({"token_mismatch": True}, ("FAILED", "TOKEN_ACCOUNTING", "TOKEN_ACCOUNTING", "fixture-token-accounting")),
    ({"cancelled": True}, ("CANCELLED", "CANCELLED", "LOAD_GENERATOR", "request-cancelled")),
    ({}, ("SUCCESS", None, None, None)),
])
def test_terminal_classes(spark, cause, expected):
    names = ("timed_out", "malformed", "token_mismatch", "transport_failed", "cancelled", "unexpected")
    row = {"http_status": 200, **dict.fromkeys(names, False), **cause}
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in row.items()])
    got = rm.classify_terminal(df).first()
    assert (got.terminal_class, got.failure_kind, got.failure_origin, got.error_code) == expected
