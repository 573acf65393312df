"""The given tables read as serving-run records (see FIXTURES.md, part 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from servescope.operators.sliced import SlicedOrder
from servescope.session import use

BLOCK = 8
E2E_SLO_NS = 260_000_000_000_000
TTFT_SLO_NS = 40_000_000_000_000
TPOT_SLO_NS = 40_000_000_000_000
ITL_SLO_NS = 86_400_000_000_000


# One token-bearing event; a two-token event has own token stamps on even event ids only.
STREAM_EVENT = """named_struct('chunk_index', pos, 'event_offset_ns', off_ns, 'tokens_in_chunk', toks,
    'per_token_offsets_ns', CASE WHEN toks = 2 AND event_id % 2 = 0 THEN array(off_ns - 1000, off_ns) END)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def clocked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with a nanosecond offset from the origin."""
    off = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) * 1000
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value", off.alias("off_ns")
    )


def block_events(spark: SparkSession, sf_dir: str, run: str = "user_id % 4") -> DataFrame:
    """Each user's events in blocks of eight; every block is one request."""
    ranked = SlicedOrder(["user_id"], ["off_ns", "event_id"]).rank(
        clocked_events(spark, sf_dir), "rn"
    )
    block = Window.partitionBy("user_id", "blk")
    return (
        ranked.withColumn("rn0", F.col("rn") - 1)
        .withColumn("blk", F.expr(f"rn0 div {BLOCK}"))
        .withColumn("pos", F.expr(f"rn0 % {BLOCK}"))
        .withColumn("n", F.count(F.lit(1)).over(block))
        .withColumn(
            "toks",
            F.expr("CASE event_type WHEN 'purchase' THEN 2L WHEN 'error' THEN 0L ELSE 1L END"),
        )
        .withColumn("token_bearing", F.expr("pos > 0 AND pos < n - 1 AND toks > 0"))
        .withColumn("run_id", F.expr(run))
        .withColumn("request_id", F.concat_ws("-", "user_id", "blk"))
        .drop("rn", "rn0")
    )


def requests_from(blocks: DataFrame) -> DataFrame:
    grouped = blocks.groupBy("run_id", "request_id", "user_id", "blk").agg(
        F.max("n").alias("n"),
        F.min("off_ns").alias("dispatch_ns"),
        F.min(F.expr("CASE WHEN pos = 1 THEN off_ns END")).alias("first_body_ns"),
        F.min(F.expr("CASE WHEN token_bearing THEN off_ns END")).alias("first_token_ns"),
        F.max(F.expr("CASE WHEN token_bearing THEN off_ns END")).alias("last_token_ns"),
        F.max("off_ns").alias("terminal_ns"),
        F.sum(F.expr("CASE WHEN token_bearing THEN toks ELSE 0L END")).alias("output_tokens"),
        F.count_if(F.col("token_bearing")).alias("token_events"),
        F.coalesce(F.max(F.expr("CASE WHEN token_bearing THEN toks END")), F.lit(0)).alias(
            "max_event_tokens"
        ),
        F.max(F.expr("CASE WHEN pos = n - 1 THEN event_type END")).alias("last_type"),
        F.sort_array(F.collect_list(F.expr(f"CASE WHEN token_bearing THEN {STREAM_EVENT} END"))).alias(
            "stream_events"
        ),
    )
    return grouped.selectExpr(
        "*",
        "concat('case-', blk % 16) AS case_id",
        "user_id % 3 + 1 AS repetition",
        "CASE WHEN blk = 0 THEN 'WARMUP' ELSE 'MEASURED' END AS phase",
        """CASE last_type WHEN 'error' THEN 'FAILED'
             WHEN 'signup' THEN CASE WHEN blk % 5 = 0 THEN 'CANCELLED' ELSE 'TIMEOUT' END
             ELSE 'SUCCESS' END AS terminal_class""",
        """CASE last_type WHEN 'error' THEN
               CASE blk % 6 WHEN 0 THEN 'TRANSPORT_ERROR' WHEN 1 THEN 'HTTP_ERROR'
                 WHEN 2 THEN 'PROTOCOL_ERROR' WHEN 3 THEN 'MALFORMED_STREAM'
                 WHEN 4 THEN 'TOKEN_ACCOUNTING_ERROR' ELSE 'UNEXPECTED_ERROR' END
             WHEN 'signup' THEN CASE WHEN blk % 5 = 0 THEN 'CANCELLED' ELSE 'TIMEOUT' END
             ELSE 'SUCCESS' END AS outcome""",
        "CASE WHEN last_type = 'error' AND blk % 2 = 0 THEN 503L ELSE 200L END AS http_status",
        "2 + blk % 3 AS input_tokens",
        "CASE WHEN run_id = 3 AND user_id % 11 = 0 THEN NULL ELSE output_tokens END AS output_value",
        "CASE WHEN run_id = 2 AND user_id % 13 = 0 THEN NULL ELSE 2 + blk % 3 END AS input_value",
        f"""(last_type NOT IN ('error', 'signup') AND terminal_ns - dispatch_ns <= {E2E_SLO_NS})
              <> (user_id % 29 = 0 AND blk % 3 = 1) AS slo_satisfied""",
    )


def requests(spark: SparkSession, sf_dir: str, run: str = "user_id % 4") -> DataFrame:
    return requests_from(block_events(spark, sf_dir, run))


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client-side evidence events of every request; some payloads are broken on purpose.

    Broken: a terminal class that differs (event_id % 89), a lost token delta (% 97), a second
    start (user % 41, block 2), a lost end (user % 37, block 1).
    """
    blocks = block_events(spark, sf_dir)
    last = "pos = n - 1"
    kinds = f"""filter(array(
        CASE WHEN pos = 0 THEN struct(0 AS rank, 'CLIENT_REQUEST_STARTED' AS kind) END,
        CASE WHEN pos = 0 AND user_id % 41 = 0 AND blk = 2
             THEN struct(1 AS rank, 'CLIENT_REQUEST_STARTED' AS kind) END,
        CASE WHEN token_bearing THEN struct(2 AS rank, 'SSE_TOKEN_EVENT' AS kind) END,
        CASE WHEN pos > 0 AND pos < n - 1 AND toks = 0 THEN struct(2 AS rank, 'SSE_COMMENT' AS kind) END,
        CASE WHEN {last} AND event_type NOT IN ('error', 'signup')
             THEN struct(3 AS rank, 'SSE_DONE' AS kind) END,
        CASE WHEN {last} THEN struct(4 AS rank, 'REQUEST_TERMINAL' AS kind) END,
        CASE WHEN {last} AND NOT (user_id % 37 = 0 AND blk = 1)
             THEN struct(5 AS rank, 'CLIENT_REQUEST_ENDED' AS kind) END), k -> k IS NOT NULL)"""
    return blocks.selectExpr("*", f"explode({kinds}) AS k").selectExpr(
        "run_id", "request_id", "concat('case-', blk % 16) AS case_id",
        "CASE WHEN blk = 0 THEN 'WARMUP' ELSE 'MEASURED' END AS phase",
        "k.kind AS kind", "k.rank AS kind_rank", "event_id", "pos", "off_ns",
        "CASE WHEN k.kind IN ('SSE_TOKEN_EVENT', 'SSE_COMMENT', 'SSE_DONE') THEN pos - 1 END AS sse_event_sequence",
        "CASE WHEN k.kind = 'SSE_TOKEN_EVENT' THEN event_type END AS sse_data",
        "CASE WHEN k.kind = 'SSE_TOKEN_EVENT' AND event_id % 97 <> 0 THEN toks END AS token_delta_count",
        """CASE WHEN k.kind <> 'REQUEST_TERMINAL' THEN NULL WHEN event_id % 89 = 0 THEN 'FAILED'
             WHEN event_type = 'error' THEN 'FAILED' WHEN event_type <> 'signup' THEN 'SUCCESS'
             WHEN blk % 5 = 0 THEN 'CANCELLED' ELSE 'TIMEOUT' END AS terminal_class""",
        """CASE WHEN k.kind <> 'REQUEST_TERMINAL' THEN NULL WHEN event_type = 'error' THEN 'HTTP_STATUS'
             WHEN event_type <> 'signup' THEN NULL WHEN blk % 5 = 0 THEN 'CANCELLED'
             ELSE 'TIMEOUT' END AS failure_kind""",
    )


def sequenced(events: DataFrame) -> DataFrame:
    """Number a run's events from 0 in clock order."""
    order = SlicedOrder(["run_id"], ["off_ns", "kind_rank", "request_id", "pos"])
    return order.rank(events, "sequence").withColumn("sequence", F.col("sequence") - 1)


def server_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = """filter(array(
        CASE WHEN pos = 0 THEN 'REQUEST_ACCEPTED' END,
        CASE WHEN pos = 1 THEN 'RESPONSE_HEADERS_SENT' END,
        CASE WHEN token_bearing THEN 'SSE_TOKEN_EVENT_SENT' END,
        CASE WHEN pos > 0 AND pos < n - 1 AND toks = 0 THEN 'SSE_COMMENT_SENT' END,
        CASE WHEN pos = n - 1 THEN CASE event_type WHEN 'error' THEN 'HTTP_ERROR_SENT'
             WHEN 'signup' THEN 'STALL_STARTED' ELSE 'SSE_DONE_SENT' END END,
        CASE WHEN pos = n - 1 THEN 'REQUEST_HANDLER_ENDED' END), k -> k IS NOT NULL)"""
    return block_events(spark, sf_dir).selectExpr(
        "run_id", "request_id", "off_ns", "toks", "token_bearing", f"explode({kinds}) AS kind"
    ).selectExpr(
        "run_id", "request_id", "kind", "off_ns",
        "CASE WHEN kind = 'SSE_TOKEN_EVENT_SENT' THEN toks END AS token_delta_count",
    )
