"""Queries that replay recorded bodies and rebuild derived records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from servescope.operators import replay as rp
from servescope.operators import run_summary as rs
from servescope.operators import timeline as tl
from servescope.operators.sliced import SlicedOrder
from servescope.plans import tables as t
from servescope.plans.comparison import _SUMMARY1
from servescope.plans.metrics import _PEAK
from servescope.plans.oracle import by_user, sql
from servescope.session import cut


def conversation_chunks(s, d):
    """A conversation as a streamed body: one data frame per turn, cut into two reads.

    By conversation: CRLF line ends split inside the last one (% 7), comment frames (% 11), an
    unsupported field before the second turn (% 17), no end marker (% 5), an open tail (% 10),
    data after the end (% 19), a second end (% 23).
    """
    turns = t.table(s, d, "conversations").select("conv_id", "turn", "role", "text")
    ranked = SlicedOrder(["conv_id"], ["turn", "role"]).rank(turns, "rn")
    eol = "CASE WHEN conv_id % 7 = 0 THEN '\\r\\n' ELSE '\\n' END"
    parts = ranked.selectExpr(
        "conv_id", "rn - 1 AS k", f"{eol} AS eol",
        "concat('data: ', regexp_replace(text, '[\\\\r\\\\n]', ' ')) AS line").selectExpr(
        "conv_id", "k", """CASE WHEN conv_id % 11 = 0 THEN concat(': keep', eol, eol)
            WHEN conv_id % 17 = 0 AND k = 1 THEN concat('event: x', eol, eol) ELSE '' END AS prefix""",
        "concat(line, eol, eol) AS frame", "conv_id % 7 = 0 AS crlf").selectExpr(
        "conv_id", "k", "concat(prefix, frame) AS whole",
        "CASE WHEN prefix <> '' THEN length(prefix) WHEN crlf THEN length(frame) - 1 ELSE length(frame) div 2 END AS at")
    reads = parts.selectExpr("conv_id", "stack(2, 2 * k, substring(whole, 1, at), 2 * k + 1, substring(whole, at + 1)) AS (ordinal, body)")
    ends = ranked.groupBy("conv_id").agg(F.max("rn").alias("n")).selectExpr(
        "conv_id", "2 * n AS ordinal",
        """concat(CASE WHEN conv_id % 5 <> 0 THEN 'data: [DONE]\\n\\n' WHEN conv_id % 10 = 0 THEN 'data: cut' ELSE '' END,
             CASE WHEN conv_id % 19 = 0 THEN 'data: late\\n\\n' ELSE '' END,
             CASE WHEN conv_id % 23 = 0 THEN 'data: [DONE]\\n\\n' ELSE '' END) AS body""")
    return reads.unionByName(ends).selectExpr(
        "conv_id AS request_id", "ordinal", "ordinal * 1000 AS observation_offset_ns", "encode(body, 'UTF-8') AS bytes")


def completion_chunks(s, d):
    """A request's events as completion responses, each cut into two reads at character 20.

    By user: no finish reason (% 13), no usage (% 17), foreign id (% 19), no end (% 23), usage off
    by one (% 29), other prompt ids (% 31), a metric missing (% 37).
    """
    block = Window.partitionBy("user_id", "blk")
    total = F.sum(F.expr("CASE WHEN token_bearing THEN toks ELSE 0L END")).over(block)
    b = t.block_events(s, d).withColumn("output_tokens", total).where("pos > 0").withColumn(
        "id", F.expr("concat('cmpl-', CASE WHEN user_id % 19 = 0 THEN 'x' ELSE '' END, request_id)"))
    generation = """to_json(named_struct('id', id, 'choices', array(named_struct('index', 0, 'text', event_type,
        'token_ids', CASE WHEN token_bearing THEN transform(sequence(1L, toks), i -> event_id * 10 + i) ELSE array() END,
        'finish_reason', CASE WHEN pos = n - 1 AND user_id % 13 <> 0 THEN 'length' END,
        'prompt_token_ids', CASE WHEN pos = 1 THEN array(n + CASE WHEN user_id % 31 = 0 THEN 1 ELSE 0 END) END))))"""
    metrics = ", ".join(f"'{k}', 1.5D" for k in rp.SERVER_METRIC_KEYS)
    fewer = ", ".join(f"'{k}', 1.5D" for k in rp.SERVER_METRIC_KEYS[1:])
    usage = f"""to_json(named_struct('id', id, 'choices', array(), 'usage', named_struct('prompt_tokens', n,
        'completion_tokens', output_tokens,
        'total_tokens', n + output_tokens + CASE WHEN user_id % 29 = 0 THEN 1 ELSE 0 END),
        'metrics', CASE WHEN user_id % 37 = 0 THEN map({fewer}) ELSE map({metrics}) END))"""
    frames = f"""filter(array(struct(4 * pos AS o, off_ns AS at, {generation} AS v),
        CASE WHEN pos = n - 1 AND user_id % 17 <> 0 THEN struct(4 * n AS o, off_ns + 1000 AS at, {usage} AS v) END,
        CASE WHEN pos = n - 1 AND user_id % 23 <> 0 THEN struct(4 * n + 2 AS o, off_ns + 2000 AS at, '[DONE]' AS v) END),
        f -> f IS NOT NULL)"""
    bodies = b.selectExpr("run_id", "request_id", f"explode({frames}) AS f").selectExpr(
        "run_id", "request_id", "f.o AS ordinal", "f.at AS off_ns", "concat('data: ', f.v, '\\n\\n') AS body")
    return bodies.selectExpr(
        "run_id", "request_id", """stack(2, ordinal, off_ns - 500, substring(body, 1, 20), ordinal + 1, off_ns, substring(body, 21))
            AS (ordinal, observation_offset_ns, body)""").selectExpr(
        "run_id", "request_id", "ordinal", "observation_offset_ns", "encode(body, 'UTF-8') AS bytes").where("octet_length(bytes) > 0")


def chunk_integrity(s, d):
    chunks = t.table(s, d, "documents").selectExpr(
        "doc_id", "regexp_replace(base64(encode(text, 'UTF-8')), '[\\\\r\\\\n]', '') AS b64", "text").selectExpr(
        "doc_id", "CASE WHEN doc_id % 7 = 0 THEN concat(b64, '\\n') WHEN doc_id % 11 = 0 THEN concat('*', b64) "
        "WHEN doc_id % 19 = 0 AND b64 LIKE '%==' THEN concat(substring(b64, 1, length(b64) - 3), "
        "translate(substring(b64, length(b64) - 2, 1), 'AQgw', 'BRhx'), '==') ELSE b64 END AS raw_bytes_base64",
        "octet_length(text) + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS raw_byte_count",
        "sha2(CASE WHEN doc_id % 17 = 0 THEN 'other' ELSE text END, 256) AS raw_bytes_sha256")
    return rp.decode_chunks(chunks).selectExpr("doc_id", "coalesce(integrity, 'OK') AS integrity",
                                               "CAST(octet_length(bytes) AS BIGINT) AS decoded_bytes")


def sse_frames(s, d):
    return rp.sse_frames(conversation_chunks(s, d)).select(
        "request_id", "frame_index", "kind", "data", "completing_chunk", "error")


def stream_status(s, d):
    return rp.stream_status(rp.sse_frames(conversation_chunks(s, d)))


def _completion_tasks(s, d):
    """An event is about one frame of two chunks of some hundred bytes."""
    n = t.table(s, d, "events").count()
    return rp.tasks_for(3 * n, 300 * n)


def completion_replay(s, d):
    requests = t.requests(s, d).selectExpr(
        "run_id", "request_id", "array(n) AS sent_prompt", "output_tokens AS expected_output_tokens",
        "terminal_ns + 3000 AS transport_terminal_ns")
    return rp.completion_replay(requests, rp.sse_frames(completion_chunks(s, d), tasks=_completion_tasks(s, d)))


def cancellation_replay(s, d):
    requests = t.requests(s, d).selectExpr(
        "run_id", "request_id", """CASE WHEN user_id % 3 = 2 THEN terminal_ns + 5000 WHEN first_token_ns IS NULL THEN terminal_ns - 600
            WHEN token_events >= 2 AND user_id % 5 = 1 THEN last_token_ns - 500 ELSE first_token_ns END AS close_ns""")
    chunks, tasks = cut(completion_chunks(s, d)), _completion_tasks(s, d)
    return rp.cancellation_replay(requests, chunks, rp.sse_frames(chunks, tasks=tasks), tasks).drop("delivery_frame")


def event_chunks(s, d):
    """The body of a request, one frame an event, in reads that end inside a frame."""
    frames = t.block_events(s, d).where("pos > 0").selectExpr(
        "run_id", "request_id", "pos", "concat('data: ', event_type, ' ', toks, '\n\n') AS body")
    return frames.selectExpr("run_id", "request_id", "stack(2, 2 * pos, substring(body, 1, 8), 2 * pos + 1, substring(body, 9)) AS (ordinal, part)").selectExpr(
        "run_id", "request_id", "ordinal", "encode(part, 'UTF-8') AS bytes")


def semantic_fingerprint(s, d):
    events = cut(t.sequenced(t.stream_events(s, d)))
    blocks = t.block_events(s, d).where("token_bearing").groupBy("run_id", "request_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "toks"))), lambda x: x["toks"].cast("string")), ",").alias("token_deltas"))
    requests = cut(t.requests(s, d).drop("stream_events"))
    told = requests.join(blocks, ["run_id", "request_id"], "left").selectExpr(
        "*", "CASE WHEN terminal_class <> 'SUCCESS' THEN terminal_class END AS failure_kind",
        "CASE WHEN output_tokens > 0 THEN 'stream' ELSE 'none' END AS token_count_source", "max_event_tokens <= 1 AS per_token_complete")
    peaks = tl.concurrency_by_sequence(events).select("run_id", "max_concurrency")
    runs = rs.counts_v2(requests).join(peaks, "run_id").selectExpr(
        "*", "sha2(concat('workload-', run_id % 2), 256) AS workload_sha256", "sha2('configuration', 256) AS configuration_sha256",
        "sha2('fixture', 256) AS fixture_sha256", "false AS batch_observed")
    return rp.run_fingerprint(told, event_chunks(s, d), events, runs)


def summary_drift(s, d):
    """Whole version-1 summaries, rates and distributions included; of some users the stored one is off in
    a count or a percentile, or missing."""
    rebuilt = cut(rs.run_summary_v1(cut(t.requests(s, d, "user_id"))).selectExpr(
        "run_id", "named_struct('attempted', attempted, 'successful', successful, 'failed', failed) AS counts",
        "named_struct('goodput', goodput, 'failure_rate', failure_rate) AS rates",
        "named_struct('ttft', named_struct('count', ttft_count, 'p50', ttft_p50, 'p95', ttft_p95), "
        "'end_to_end', named_struct('count', end_to_end_count, 'p99', end_to_end_p99)) AS distributions"))
    stored = rebuilt.where("run_id % 13 <> 5").withColumn(
        "counts", F.col("counts").withField("failed", F.expr("counts.failed + CASE WHEN run_id % 7 = 0 THEN 1 ELSE 0 END"))).withColumn(
        "distributions", F.expr("CASE WHEN run_id % 11 = 0 THEN named_struct('ttft', named_struct('count', distributions.ttft.count, "
                                "'p50', distributions.ttft.p50 + 0.5D, 'p95', distributions.ttft.p95), 'end_to_end', distributions.end_to_end) ELSE distributions END"))
    number = "CASE WHEN {0} = 'present' THEN 1D ELSE CAST({0} AS DOUBLE) END AS {0}"
    return rp.record_drift(rebuilt, stored, ["run_id"]).selectExpr("run_id", "field", number.format("rebuilt"), number.format("stored"))


def derived_drift(s, d):
    """The derived record of each body, as stored text, against the one rebuilt from its bytes."""
    rebuilt = cut(rp.stream_status(rp.sse_frames(conversation_chunks(s, d)))).selectExpr(
        "concat('derived/', request_id, '.txt') AS path", "request_id",
        "concat_ws(' ', status, data_frames, comment_frames, done_frames) AS content")
    stored = rebuilt.where("request_id % 14 <> 3").withColumn(
        "content", F.expr("CASE WHEN request_id % 9 = 4 THEN concat(content, '!') ELSE content END"))
    return rp.drift(rebuilt, stored, ["path"], ["content"])


QUERIES = {
    "chunk_integrity": chunk_integrity,
    "sse_frames": sse_frames,
    "stream_status": stream_status,
    "body_hash": lambda s, d: rp.body_hash(cut(conversation_chunks(s, d))).drop("status"),
    "protocol_shape": lambda s, d: rp.protocol_shape(t.sequenced(t.stream_events(s, d))),
    "semantic_fingerprint": semantic_fingerprint,
    "completion_replay": completion_replay,
    "cancellation_replay": cancellation_replay,
    "summary_drift": summary_drift,
    "derived_drift": derived_drift,
}

_FR = """tn AS (SELECT conv_id, regexp_replace(text, '[\\r\\n]', ' ', 'g') AS data,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n
    FROM conversations),
  fr AS (SELECT conv_id, k * 10 AS o, 'comment' AS kind, NULL AS data, 2 * k AS c, NULL AS error FROM tn WHERE conv_id % 11 = 0
    UNION ALL SELECT conv_id, k * 10, 'error', NULL, 2 * k, 'UNSUPPORTED_FIELD' FROM tn WHERE conv_id % 17 = 0 AND conv_id % 11 <> 0 AND k = 1
    UNION ALL SELECT conv_id, k * 10 + 1, 'data', data, 2 * k + 1, NULL FROM tn
    UNION ALL SELECT conv_id, n * 10 + 2, 'done', '[DONE]', 2 * n, NULL FROM tn WHERE k = 0 AND conv_id % 5 <> 0
    UNION ALL SELECT conv_id, n * 10 + 3, 'data', CASE WHEN conv_id % 10 = 0 THEN 'cutdata: late' ELSE 'late' END, 2 * n,
        CASE WHEN conv_id % 5 <> 0 THEN 'DATA_AFTER_DONE' END FROM tn WHERE k = 0 AND conv_id % 19 = 0
    UNION ALL SELECT conv_id, n * 10 + 4,
        CASE WHEN conv_id % 10 = 0 AND conv_id % 19 <> 0 THEN 'data' ELSE 'done' END,
        CASE WHEN conv_id % 10 = 0 AND conv_id % 19 <> 0 THEN 'cutdata: [DONE]' ELSE '[DONE]' END, 2 * n,
        CASE WHEN conv_id % 5 <> 0 THEN 'DUPLICATE_DONE' END FROM tn WHERE k = 0 AND conv_id % 23 = 0
    UNION ALL SELECT conv_id, n * 10 + 5, 'tail', NULL, NULL, NULL FROM tn
      WHERE k = 0 AND conv_id % 10 = 0 AND conv_id % 19 <> 0 AND conv_id % 23 <> 0),
  fx AS (SELECT conv_id AS request_id, row_number() OVER (PARTITION BY conv_id ORDER BY o) - 1 AS frame_index,
    kind, data, c AS completing_chunk, error FROM fr),
  st AS (SELECT request_id, count(*) FILTER (WHERE kind = 'data') AS data_frames,
      count(*) FILTER (WHERE kind = 'comment') AS comment_frames, count(*) FILTER (WHERE kind = 'done') AS done_frames,
      CAST(CASE WHEN bool_or(kind = 'tail') THEN 9 ELSE 0 END AS BIGINT) AS tail_bytes,
      coalesce(arg_min(error, frame_index) FILTER (WHERE error IS NOT NULL),
        CASE WHEN bool_or(kind = 'tail') THEN 'INCOMPLETE_FINAL_FRAME'
             WHEN count(*) FILTER (WHERE kind = 'done') = 0 THEN 'MISSING_DONE' ELSE 'OK' END) AS status
    FROM fx GROUP BY request_id)"""

_SHAPE = """shp AS (SELECT run_id, request_id,
      string_agg(kind || ':' || coalesce(CAST(token_delta_count AS VARCHAR), '-'), ',' ORDER BY sequence) AS protocol_shape
    FROM seq WHERE kind IN ('SSE_COMMENT', 'SSE_TOKEN_EVENT', 'SSE_DONE') GROUP BY ALL)"""

_SHOWN = ", ".join(f"'{f}=' || coalesce(CAST({f} AS VARCHAR), 'null')" for f in sorted([*rp.REQUEST_FIELDS, "body_sha256", "protocol_shape"]))

_DRIFT = ", ".join(f"{{'f': '{f}', 'r': CAST({r} AS DOUBLE), 's': CAST(CASE WHEN run_id % 13 <> 5 THEN {x} END AS DOUBLE)}}" for f, r, x in (
    *[(f"{p}?", "1", "1") for p in ("counts", "rates", "distributions", "distributions.ttft", "distributions.end_to_end")],
    ("counts.attempted", "attempted", "attempted"), ("counts.successful", "successful", "successful"),
    ("counts.failed", "failed", "failed + CASE WHEN run_id % 7 = 0 THEN 1 ELSE 0 END"),
    ("rates.goodput", "goodput", "goodput"), ("rates.failure_rate", "failure_rate", "failure_rate"),
    ("distributions.ttft.count", "coalesce(ttft_count, 0)", "coalesce(ttft_count, 0)"),
    ("distributions.ttft.p50", "ttft_p50", "ttft_p50 + CASE WHEN run_id % 11 = 0 THEN 0.5 ELSE 0 END"),
    ("distributions.ttft.p95", "ttft_p95", "ttft_p95"),
    ("distributions.end_to_end.count", "coalesce(end_to_end_count, 0)", "coalesce(end_to_end_count, 0)"),
    ("distributions.end_to_end.p99", "end_to_end_p99", "end_to_end_p99")))

ORACLES = {
    "chunk_integrity": """SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN 'NOT_BASE64'
          WHEN doc_id % 19 = 0 AND strlen(text) % 3 = 1 THEN 'NOT_CANONICAL'
          WHEN doc_id % 13 = 0 THEN 'SIZE_DIFFERS' WHEN doc_id % 17 = 0 THEN 'HASH_DIFFERS' ELSE 'OK' END AS integrity,
        CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN NULL ELSE strlen(text) END AS decoded_bytes FROM documents""",
    "sse_frames": f"WITH {_FR} SELECT * FROM fx",
    "stream_status": f"WITH {_FR} SELECT * FROM st",
    "body_hash": """WITH tn AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS k,
            CASE WHEN conv_id % 7 = 0 THEN chr(13) || chr(10) ELSE chr(10) END AS eol,
            'data: ' || regexp_replace(text, '[\\r\\n]', ' ', 'g') AS line FROM conversations),
        bd AS (SELECT conv_id, string_agg(CASE WHEN conv_id % 11 = 0 THEN ': keep' || eol || eol
              WHEN conv_id % 17 = 0 AND k = 1 THEN 'event: x' || eol || eol ELSE '' END || line || eol || eol, '' ORDER BY k)
            || CASE WHEN conv_id % 5 <> 0 THEN 'data: [DONE]' || chr(10) || chr(10) WHEN conv_id % 10 = 0 THEN 'data: cut' ELSE '' END
            || CASE WHEN conv_id % 19 = 0 THEN 'data: late' || chr(10) || chr(10) ELSE '' END
            || CASE WHEN conv_id % 23 = 0 THEN 'data: [DONE]' || chr(10) || chr(10) ELSE '' END AS body
          FROM tn GROUP BY conv_id)
        SELECT conv_id AS request_id, strlen(body) AS body_bytes, sha256(body) AS body_sha256 FROM bd""",
    "protocol_shape": sql("seq", f"WITH {_SHAPE} SELECT * FROM shp"),
    "semantic_fingerprint": sql("req seq", f"""WITH {_SHAPE}, bod AS (SELECT request_id,
            sha256(string_agg('data: ' || event_type || ' ' || toks || chr(10) || chr(10), '' ORDER BY pos)) AS sha FROM be WHERE pos > 0 GROUP BY request_id),
        dl AS (SELECT request_id, string_agg(CAST(toks AS VARCHAR), ',' ORDER BY pos) AS token_deltas FROM be WHERE token_bearing GROUP BY request_id),
        q AS (SELECT req.*, coalesce(protocol_shape, '') AS protocol_shape, token_deltas, coalesce(sha, sha256('')) AS body_sha256,
            CASE WHEN terminal_class <> 'SUCCESS' THEN terminal_class END AS failure_kind,
            CASE WHEN output_tokens > 0 THEN 'stream' ELSE 'none' END AS token_count_source, max_event_tokens <= 1 AS per_token_complete
          FROM req LEFT JOIN shp ON shp.request_id = req.request_id LEFT JOIN bod ON bod.request_id = req.request_id
          LEFT JOIN dl ON dl.request_id = req.request_id),
        h AS (SELECT run_id, sha256(concat_ws('|', {_SHOWN})) AS h FROM q),
        l AS (SELECT run_id, h[1:4] AS b, sha256(string_agg(h, '' ORDER BY h)) AS bh FROM h GROUP BY ALL),
        r AS (SELECT run_id, sha256(string_agg(bh, '' ORDER BY b)) AS root FROM l GROUP BY run_id), {_PEAK},
        f AS (SELECT req.run_id, concat_ws('/', sha256('workload-' || (req.run_id % 2)), sha256('configuration'), sha256('fixture'),
            count(*) FILTER (WHERE phase = 'MEASURED' AND terminal_class = 'FAILED'), count(*) FILTER (WHERE phase = 'MEASURED' AND terminal_class = 'TIMEOUT'),
            count(*) FILTER (WHERE phase = 'MEASURED'), max(max_concurrency), 'false') AS facts FROM req JOIN conc ON conc.run_id = req.run_id GROUP BY req.run_id)
        SELECT r.run_id, sha256(root || '|' || facts) AS semantic_fingerprint FROM r JOIN f ON f.run_id = r.run_id"""),
    "completion_replay": sql("req be", """WITH x AS (SELECT request_id, string_agg(event_type, '' ORDER BY pos) AS txt FROM be
          WHERE pos > 0 GROUP BY request_id)
        SELECT r.run_id, r.request_id, CASE WHEN user_id % 13 <> 0 AND n > 1 THEN terminal_ns END AS generation_terminal_ns,
          CASE WHEN user_id % 17 <> 0 AND n > 1 THEN terminal_ns + 1000 END AS usage_terminal_ns,
          CASE WHEN user_id % 23 <> 0 AND n > 1 THEN terminal_ns + 1500 END AS protocol_terminal_ns,
          output_tokens, sha256(coalesce(txt, '')) AS output_text_sha256,
          CASE WHEN user_id % 13 <> 0 AND max_event_tokens = 1 AND output_tokens >= 2
               THEN (terminal_ns - first_token_ns) / (output_tokens - 1) END AS tpot_ns,
          array_to_string([v FOR v IN [
            CASE WHEN user_id % 19 = 0 AND n > 1 THEN 'body-id-differs' END,
            CASE WHEN user_id % 13 = 0 OR n = 1 THEN 'one-generation-terminal' END,
            CASE WHEN user_id % 17 = 0 OR n = 1 THEN 'one-usage-terminal' END,
            CASE WHEN user_id % 23 = 0 OR n = 1 THEN 'one-protocol-terminal' END,
            CASE WHEN user_id % 31 = 0 OR n = 1 THEN 'prompt-ids-differ' END,
            CASE WHEN user_id % 29 = 0 AND user_id % 17 <> 0 AND n > 1 THEN 'usage-does-not-add-up' END,
            CASE WHEN user_id % 37 = 0 OR user_id % 17 = 0 OR n = 1 THEN 'metrics-incomplete' END,
            CASE WHEN output_tokens = 0 THEN 'no-output-token' END] IF v IS NOT NULL], ',') AS violations
        FROM req r LEFT JOIN x ON x.request_id = r.request_id"""),
    "cancellation_replay": sql("req be", """WITH q AS (SELECT r.*, CASE WHEN user_id % 3 = 2 THEN terminal_ns + 5000
              WHEN first_token_ns IS NULL THEN terminal_ns - 600
              WHEN token_events >= 2 AND user_id % 5 = 1 THEN last_token_ns - 500 ELSE first_token_ns END AS close_ns,
            fp.pos AS fpos, fp.toks AS ftoks FROM req r
          LEFT JOIN (SELECT request_id, min(pos) AS pos, arg_min(toks, pos) AS toks FROM be WHERE token_bearing GROUP BY request_id) fp
            ON fp.request_id = r.request_id),
        z AS (SELECT *, user_id % 3 = 2 AS whole, token_events >= 2 AND user_id % 5 = 1 AS ahead FROM q)
        SELECT run_id, request_id, CASE WHEN fpos IS NULL THEN 'NO_GENERATION_DELIVERED'
            WHEN whole AND user_id % 13 <> 0 THEN 'GENERATION_TERMINAL_BEFORE_CLOSE'
            WHEN whole AND user_id % 17 <> 0 THEN 'USAGE_BEFORE_CLOSE'
            WHEN whole AND user_id % 23 <> 0 THEN 'DONE_BEFORE_CLOSE'
            WHEN whole OR ahead THEN 'READ_AFTER_FIRST_DELIVERY' ELSE 'OK' END AS status,
          4 * fpos + 1 AS delivery_chunk, first_token_ns AS delivery_ns, ftoks AS delivered_tokens,
          CAST(CASE WHEN NOT whole AND ahead THEN 20 ELSE 0 END AS BIGINT) AS pending_bytes,
          CASE WHEN NOT whole AND ahead THEN 'INCOMPLETE_TRAILING_SSE_BYTES' ELSE 'AT_SSE_FRAME_BOUNDARY' END AS state_at_close
        FROM z"""),
    "summary_drift": by_user(sql("req tev", f"""WITH {_SUMMARY1}, long AS (SELECT run_id, unnest([{_DRIFT}]) AS x FROM summ)
        SELECT run_id, x.f AS field, x.r AS rebuilt, x.s AS stored FROM long WHERE x.r IS DISTINCT FROM x.s""")),
    "derived_drift": f"""WITH {_FR} SELECT 'derived/' || request_id || '.txt' AS path, 'content' AS field,
          concat_ws(' ', status, data_frames, comment_frames, done_frames) AS rebuilt,
          CASE WHEN request_id % 14 <> 3 THEN concat_ws(' ', status, data_frames, comment_frames, done_frames) || '!' END AS stored
        FROM st WHERE request_id % 14 = 3 OR request_id % 9 = 4""",
}
