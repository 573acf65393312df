"""Framing against an incremental reader, and the recorded edge cases."""

from __future__ import annotations

import base64
import hashlib
import random

import pytest

from pyspark.sql import functions as F

from servescope.operators import replay as rp

CHUNK = "request_id int, ordinal long, observation_offset_ns long, bytes binary"


def chunks(spark, bodies):
    rows = [(i, o, o * 10, bytearray(c)) for i, body in enumerate(bodies) for o, c in enumerate(body)]
    return spark.createDataFrame(rows, CHUNK)


def incremental(body):
    buffer, frames = b"", []
    for o, c in enumerate(body):
        buffer = (buffer + c).replace(b"\r\n", b"\n")
        while b"\n\n" in buffer:
            frame, buffer = buffer.split(b"\n\n", 1)
            frames.append((frame.decode("latin1"), o))
    return frames, buffer.decode("latin1")


@pytest.mark.parametrize(("width", "size"), [(1, 1 << 20), (2, 1 << 20), (1024, 1 << 20), (1024, 9), (3, 1)])
def test_pieces_equal_an_incremental_reader(spark, width, size):
    rng = random.Random(3)
    parts = [b"\n", b"\r\n", b"data: a", b": c", b"data", b"data: [DONE]", b"x", " é".encode(), b"\n\n", b"\r\n\r\n"]
    bodies = []
    for _ in range(150):
        body = b"".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        cuts = sorted(rng.sample(range(1, len(body)), min(len(body) - 1, rng.randint(0, 8)))) if len(body) > 1 else []
        bodies.append([body[a:b] for a, b in zip([0, *cuts], [*cuts, len(body)])])
    got: dict[int, dict] = {}
    for r in rp.sse_pieces(chunks(spark, bodies), width=width, size=size).collect():
        got.setdefault(r.request_id, {})[r.frame_index] = r
    for i, body in enumerate(bodies):
        frames, tail = incremental(body)
        rows = [got[i][k] for k in sorted(got[i])]
        assert [(r.raw_frame, r.completing_chunk) for r in rows if r.frame_end is not None] == frames
        open_tail = "".join(r.raw_frame for r in rows if r.frame_end is None)
        assert open_tail.strip("\r\n") == tail.strip("\r\n")


CASES = [
    ([b"data: a\n\ndata: [DO", b"NE]\n\n"], [("data", "a"), ("done", "[DONE]")], "OK"),
    ([b"data: a\r\n\r", b"\ndata: [DONE]\r\n\r\n"], [("data", "a"), ("done", "[DONE]")], "OK"),
    ([b": hi\n\ndata: a\ndata:b\ndata\n\ndata: [DONE]\n\n"], [("comment", None), ("data", "a\nb\n"), ("done", "[DONE]")], "OK"),
    ([b"data: [DONE]\n\ndata: [DONE]\n\n"], [("done", "[DONE]"), ("done", "[DONE]")], "DUPLICATE_DONE"),
    ([b"data: [DONE]\n\ndata: x\n\n"], [("done", "[DONE]"), ("data", "x")], "DATA_AFTER_DONE"),
    ([b"data: x\n\n"], [("data", "x")], "MISSING_DONE"),
    ([b"data: [DONE]\n\ndata: x"], [("done", "[DONE]"), ("tail", None)], "INCOMPLETE_FINAL_FRAME"),
    ([b"data: \xff\n\n"], [("error", None)], "INVALID_UTF8"),
    ([b"event: x\n\n"], [("error", None)], "UNSUPPORTED_FIELD"),
    ([b"data: a\rb\n\n"], [("error", None)], "BARE_CARRIAGE_RETURN"),
    ([b"data: " + b"x" * 70000 + b"\n\n"], [("data", "x" * 70000)], "MISSING_DONE"),
]


def test_recorded_streams(spark):
    frames = rp.sse_frames(chunks(spark, [c[0] for c in CASES]))
    rows: dict[int, list] = {}
    for r in frames.orderBy("request_id", "frame_index").collect():
        rows.setdefault(r.request_id, []).append((r.kind, r.data))
    status = {r.request_id: r.status for r in rp.stream_status(frames).collect()}
    for i, (_, want, verdict) in enumerate(CASES):
        assert rows[i] == want
        assert status[i] == verdict


def test_body_hash(spark):
    bodies = [[b"a" * 50, b"b" * 60, b"c"], [b"tiny"]]
    df = chunks(spark, bodies)
    want = {i: hashlib.sha256(b"".join(b)).hexdigest() for i, b in enumerate(bodies)}
    assert {r.request_id: r.body_sha256 for r in rp.body_hash(df).collect()} == want
    broken = df.withColumn("bytes", F.when(F.col("ordinal") > 0, F.col("bytes")))
    assert {(r.body_sha256, r.status) for r in rp.body_hash(broken).collect()} == {(None, "UNSOUND_CHUNK")}


def test_two_runs_with_the_same_ids_stay_apart(spark):
    first, second = [b"data: a\n", b"\ndata: [DONE]\n\n"], [b"data: b\n\n"]
    df = chunks(spark, [first]).withColumn("run_id", F.lit("A")).union(chunks(spark, [second]).withColumn("run_id", F.lit("B")))
    want = {(r, 0): hashlib.sha256(b"".join(b)).hexdigest() for r, b in (("A", first), ("B", second))}
    assert {(r.run_id, r.request_id): r.body_sha256 for r in rp.body_hash(df).collect()} == want
    frames = rp.sse_frames(df)
    assert {(r.run_id, r.frame_index, r.data) for r in frames.collect()} == {("A", 0, "a"), ("A", 1, "[DONE]"), ("B", 0, "b")}
    assert {r.run_id: r.status for r in rp.stream_status(frames).collect()} == {"A": "OK", "B": "MISSING_DONE"}
    sent = spark.createDataFrame([("A", 0, [1], 1, 99), ("C", 0, [1], 1, 99)],
                                 "run_id string, request_id int, sent_prompt array<long>, expected_output_tokens long, transport_terminal_ns long")
    got = {r.run_id: r.violations for r in rp.completion_replay(sent, frames).collect()}
    assert got["A"].startswith("broken-frame") and "one-protocol-terminal" in got["C"] and len(got) == 2


def test_chunk_integrity(spark):
    good = base64.b64encode(b"hello!").decode()
    sha = hashlib.sha256(b"hello!").hexdigest()
    rows = [(good, 6, sha), ("*" + good, 6, sha), (good, 7, sha), (good, 6, "0" * 64), ("QR==", 1, sha), (good + "\n", 6, sha)]
    df = spark.createDataFrame(rows, "raw_bytes_base64 string, raw_byte_count long, raw_bytes_sha256 string")
    got = [r.integrity for r in rp.decode_chunks(df).collect()]
    assert got == [None, "NOT_BASE64", "SIZE_DIFFERS", "HASH_DIFFERS", "NOT_CANONICAL", "NOT_BASE64"]


def fingerprint(spark, body=(b"data: a\n", b"\ndata: [DONE]\n\n"), shape=2, klass="SUCCESS", failed=0, peak=2, source="w", at=0):
    request = [("r", i, "case", "MEASURED", klass, None, 3, 2, "stream", "1,1", True, True) for i in ("a", "b")]
    requests = spark.createDataFrame(request, "run_id string, request_id string, case_id string, phase string, terminal_class string, failure_kind string, "
                                     "input_tokens long, output_tokens long, token_count_source string, token_deltas string, per_token_complete boolean, slo_satisfied boolean")
    pieces = spark.createDataFrame([("r", "a", o, o + at, bytearray(c)) for o, c in enumerate(body)],
                                   "run_id string, request_id string, ordinal long, observation_offset_ns long, bytes binary")
    events = spark.createDataFrame([("r", "a", k, "SSE_TOKEN_EVENT", 1, at + k) for k in range(shape)],
                                   "run_id string, request_id string, sequence long, kind string, token_delta_count long, off_ns long")
    runs = spark.createDataFrame([("r", source, "c", "f", failed, 0, 2, peak, False)], "run_id string, workload_sha256 string, configuration_sha256 string, "
                                 "fixture_sha256 string, failed long, timed_out long, attempted long, max_concurrency long, batch_observed boolean")
    return rp.run_fingerprint(requests, pieces, events, runs).first().semantic_fingerprint


def test_fingerprint_repeats_under_other_chunks_and_clocks_only(spark):
    same = fingerprint(spark)
    assert fingerprint(spark, body=(b"data: a\n\nda", b"ta: [DONE]", b"\n\n"), at=500) == same
    changed = [{"body": (b"data: b\n", b"\ndata: [DONE]\n\n")}, {"shape": 3}, {"klass": "FAILED"}, {"failed": 1}, {"peak": 3}, {"source": "v"}]
    assert len({same, *[fingerprint(spark, **c) for c in changed]}) == len(changed) + 1


def test_record_drift_names_every_differing_scalar(spark):
    schema = "k int, a struct<b: double, c: struct<d: long, e: string>>, l array<int>, extra string"
    left = spark.createDataFrame([(1, (1.5, (2, "x")), [1, 2], None), (2, (None, None), [], "p"), (3, None, None, None), (5, (1.0, (1, "y")), [3], "q")], schema)
    right = spark.createDataFrame([(1, (1.5, (3, "x")), [2, 1], None), (2, (None, (None, None)), [], "p"), (3, None, None, None), (4, None, [7], None)], schema)
    got = {(r.k, r.field): (r.rebuilt, r.stored) for r in rp.record_drift(left, right, ["k"]).collect()}
    assert got == {(1, "a.c.d"): ("2", "3"), (1, "l"): ("[1,2]", "[2,1]"), (2, "a.c?"): (None, "present"), (4, "l"): (None, "[7]"),
                   (5, "a?"): ("present", None), (5, "a.b"): ("1.0", None), (5, "a.c?"): ("present", None), (5, "a.c.d"): ("1", None),
                   (5, "a.c.e"): ("y", None), (5, "l"): ("[3]", None), (5, "extra"): ("q", None)}


def test_sorted_bytes_of_a_task_do_not_grow_with_the_table(spark, monkeypatch):
    rows = chunks(spark, [[b"data: a\r\n\r", b"\n: c\n\ndata: b\n\n"], [b"data: [DONE]\n\ndata: late\n\n"], [b"data: open"]] * 20)
    want = rp.sse_frames(rows).collect()
    monkeypatch.setattr(rp, "TASK_BYTES", 1000)
    pieces = rp.sse_pieces(rows)
    assert rp.tasks_for(120) == 30 <= pieces.rdd.getNumPartitions()
    key = lambda r: (r.request_id, r.frame_index)
    assert sorted(rp.sse_frames(rows, tasks=20).collect(), key=key) == sorted(want, key=key)


def test_cancellation_of_requests_without_chunks_or_frames(spark):
    rows = chunks(spark, [[b'data: {"id":"x","choices":[{"index":0,"token_ids":[1]}]}\n\n', b"data: cut"], [b"dat", b"a: x"]])
    requests = spark.createDataFrame([(0, 10**9), (1, 10**9), (7, 10**9)], "request_id long, close_ns long")
    got = {r.request_id: r for r in rp.cancellation_replay(requests, rows, rp.sse_frames(rows), tasks=16).collect()}
    assert [(got[i].status, got[i].pending_bytes) for i in (0, 1, 7)] == [
        ("READ_AFTER_FIRST_DELIVERY", 9), ("NO_GENERATION_DELIVERED", 7), ("NO_GENERATION_DELIVERED", 0)]
    assert got[0].delivered_tokens == 1 and got[7].state_at_close == "AT_SSE_FRAME_BOUNDARY"
