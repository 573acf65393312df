"""A stream cut into several triggers says what the batch job says over the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from servescope.operators import replay as rp
from servescope.streaming import jobs

BODIES = [
    [b"data: a\r\n\r", b"\ndata: b\n\n", b": c\n\n", b"data: [DONE]\n\n"],
    [b"event: x\n\n", b"data: [DONE]\n\ndata: late\n\n"],
    [b"data: open"],
]


def test_frames_over_many_triggers_equal_the_batch(spark):
    rows = [(i, o, o * 10, bytearray(c)) for i, body in enumerate(BODIES) for o, c in enumerate(body)]
    chunks = spark.createDataFrame(rows, "request_id int, ordinal long, observation_offset_ns long, bytes binary")
    seen = chunks.withColumn("seen_at", F.expr("timestamp_micros(1704067200000000 + ordinal)"))
    streamed = jobs.run_to_table(jobs.stream_frames(jobs.as_stream(seen, 5, 1)))
    columns = ["request_id", "frame_index", "kind", "data", "completing_chunk", "error"]
    want = rp.sse_frames(chunks).where("kind <> 'tail'").select(*columns).collect()
    assert sorted(streamed.select(*columns).collect()) == sorted(want)


def test_open_body_is_reported_at_the_timeout(spark):
    rows = [(1, 0, bytearray(b"data: open"), 0), (2, 0, bytearray(b"data: [DONE]\n\n"), 9 * 3_600_000_000)]
    df = spark.createDataFrame(rows, "request_id int, ordinal long, bytes binary, us long").selectExpr(
        "request_id", "ordinal", "bytes", "timestamp_micros(1704067200000000 + us) AS seen_at")
    out = jobs.run_to_table(jobs.stream_frames(jobs.as_stream(df, 1)))
    assert [(r.request_id, r.kind, r.error) for r in out.where("kind = 'tail'").collect()] == [(1, "tail", "INCOMPLETE")]


def test_lifecycle_closes_times_out_and_counts_late_events(spark):
    hour = 3_600_000_000_000
    rows = [
        ("a", "CLIENT_REQUEST_STARTED", 0, 0, None, None), ("a", "SSE_TOKEN_EVENT", 2, 10, 2, None),
        ("a", "REQUEST_TERMINAL", 4, 20, None, "SUCCESS"), ("a", "SSE_TOKEN_EVENT", 2, 30, 1, None),
        ("b", "CLIENT_REQUEST_STARTED", 0, 5, None, None), ("c", "REQUEST_TERMINAL", 4, 9 * hour, None, "FAILED"),
    ]
    df = spark.createDataFrame(rows, "request_id string, kind string, kind_rank int, off_ns long, token_delta_count long, terminal_class string")
    df = df.withColumn("seen_at", F.expr("timestamp_micros(1704067200000000 + off_ns div 1000)"))
    got = {(r.request_id, r.status): r for r in jobs.run_to_table(jobs.stream_requests(jobs.as_stream(df, 1))).collect()}
    assert got[("a", "CLOSED")].output_tokens == 2 and got[("a", "CLOSED")].terminal_ns == 20
    assert got[("a", "LATE")].late_events == 1
    assert ("b", "TIMEOUT") in got and ("c", "CLOSED") in got


def test_live_counter_tells_restart_and_reset_apart(spark):
    rows = [(1, "m", "l", "p", i, v) for i, v in enumerate([1.0, 3.0, 2.0])] + [(1, "m", "l", "q", 3, 9.0)]
    df = spark.createDataFrame(rows, "slot long, metric string, label_set string, process_start_id string, scrape_offset_ns long, value double")
    df = df.withColumn("seen_at", F.expr("timestamp_micros(1704067200000000 + scrape_offset_ns)"))
    out = jobs.run_to_table(jobs.live_counter_deltas(jobs.as_stream(df, 1))).orderBy("scrape_offset_ns").collect()
    assert [(r.status, r.delta) for r in out] == [("OK", 2.0), ("RESET", None), ("RESTART", None)]


def at(df):
    return df.selectExpr("*", "timestamp_micros(1704067200000000 + us) AS seen_at").drop("us")


def test_a_closed_stream_leaves_nothing_open(spark):
    day = 86_400_000_000
    rows = [(1, i * day // 4, "SUCCESS", "MEASURED", 1 + (i * 7919) % 40, i % 3 > 0) for i in range(40)]
    rows += [(1, 5, "TIMEOUT", "MEASURED", None, False), (1, 6, "SUCCESS", "WARMUP", 9, True), (2, 7, "FAILED", "MEASURED", 3, False)]
    df = spark.createDataFrame(rows, "run_id long, us long, terminal_class string, phase string, end_to_end_ns long, slo_satisfied boolean")
    df = at(df).withColumnRenamed("seen_at", "terminal_at")
    counted = jobs.run_to_table(jobs.window_histogram(jobs.as_stream(df, closing="terminal_at")))
    got = {(r.run_id, r.window_start): r for r in jobs.windowed_summary(counted, df).collect()}
    want = {(r.run_id, r.w.start): r for r in df.where("phase = 'MEASURED'").groupBy("run_id", F.window("terminal_at", "1 day").alias("w")).agg(
        F.count("*").alias("attempted"), F.expr("count_if(terminal_class = 'TIMEOUT')").alias("timed_out"),
        F.expr("percentile(CASE WHEN terminal_class = 'SUCCESS' THEN end_to_end_ns END, array(0.5, 0.95))").alias("p")).collect()}
    assert got.keys() == want.keys() and len(want) == 11
    for k, r in want.items():
        assert (got[k].attempted, got[k].timed_out) == (r.attempted, r.timed_out)
        assert ([got[k].e2e_p50, got[k].e2e_p95] if r.p else None) == r.p


def test_window_state_does_not_grow_with_the_samples(spark):
    df = spark.range(60_000).selectExpr("1L AS run_id", "timestamp_micros(1704067200000000 + id) AS terminal_at", "'SUCCESS' AS terminal_class",
                                        "'MEASURED' AS phase", "1000 + (id * 7919) % 60000 AS end_to_end_ns", "true AS slo_satisfied")
    counted = jobs.run_to_table(jobs.window_histogram(jobs.as_stream(df, closing="terminal_at")))
    assert counted.count() < 7 * jobs.STEPS
    assert jobs.windowed_summary(counted, df).first().e2e_p50 == 1000 + 29_999.5


def test_duplicate_report_over_triggers(spark):
    rows = [("a", 0), ("a", 3), ("b", 1), ("a", 9 * 3_600_000_000), (None, 2), (None, 4)]
    df = at(spark.createDataFrame(rows, "request_id string, us long")).withColumn("run_id", F.lit(1))
    told = jobs.run_to_table(jobs.duplicate_report(jobs.as_stream(df.coalesce(1), closing="seen_at")))
    assert sorted((str(r.request_id), r.status, r["copy"]) for r in told.collect()) == [
        ("None", "DUPLICATE", 1), ("None", "FIRST", 0), ("a", "DUPLICATE", 1), ("a", "DUPLICATE", 2), ("a", "FIRST", 0), ("b", "FIRST", 0)]


def test_open_body_without_limit_ends_as_an_error(spark):
    rows = [(1, 0, bytearray(b"data: a\n\n"), 0), (1, 1, bytearray(b"data: " + b"x" * 2_000_000), 1), (1, 2, bytearray(b"\n\n"), 2)]
    df = at(spark.createDataFrame(rows, "request_id int, ordinal long, bytes binary, us long"))
    out = jobs.run_to_table(jobs.stream_frames(jobs.as_stream(df.where("ordinal < 2"), 1, closing="seen_at")))
    assert sorted((r.frame_index, r.kind, r.error) for r in out.collect()) == [(0, "data", None), (1, "error", "BUFFER_LIMIT")]


def test_duplicates_inside_the_watermark_are_dropped(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 2)], "request_id string, us long").selectExpr(
        "request_id", "timestamp_micros(1704067200000000 + us) AS seen_at")
    assert jobs.run_to_table(jobs.dedup_requests(jobs.as_stream(df, 1))).count() == 2
    two = df.withColumn("run_id", F.lit(1)).union(df.withColumn("run_id", F.lit(2)))
    assert jobs.run_to_table(jobs.dedup_requests(jobs.as_stream(two, 1))).count() == 4


def test_state_rows_are_groups_of_requests(spark, tmp_path):
    df = at(spark.range(300).selectExpr("id div 3 AS run_id", "concat('r\"', id % 3) AS request_id", "id AS us"))
    events = df.selectExpr("*", "'CLIENT_REQUEST_STARTED' AS kind", "0 AS kind_rank", "1L AS off_ns", "1L AS token_delta_count", "'' AS terminal_class")
    for name, told in (("copies", jobs.duplicate_report(jobs.as_stream(df, 1), groups=4)),
                       ("requests", jobs.stream_requests(jobs.as_stream(events, 1), groups=4))):
        query = told.writeStream.format("parquet").option("path", str(tmp_path / name)).option(
            "checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) == 4
    got = spark.read.parquet(str(tmp_path / "copies"))
    assert sorted(got.select("run_id", "request_id").collect()) == sorted(df.select("run_id", "request_id").collect())


def test_requests_of_one_group_keep_their_own_deadlines(spark, tmp_path):
    hour = 3_600_000_000
    # a trigger each; a and b are forgotten at the third, while c of the same group goes on
    triggers = [[("a", 0), ("b", 0), ("c", hour), ("b", hour // 2)], [("d", 4 * hour)], [("c", 4 * hour)], [("a", 5 * hour), ("c", 5 * hour)]]
    for rows in triggers:
        df = at(spark.createDataFrame(rows, "request_id string, us long")).withColumn("run_id", F.lit(1))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arrivals = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    told = jobs.run_to_table(jobs.duplicate_report(arrivals, groups=1)).collect()
    assert sorted((r.request_id, r["copy"]) for r in told) == [
        ("a", 0), ("a", 0), ("b", 0), ("b", 1), ("c", 0), ("c", 1), ("c", 2), ("d", 0)]
