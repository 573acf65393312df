"""Replay of recorded response bodies: frames, completions, cancellations, hashes, fingerprints.

A body is never gathered whole. Its chunks are folded into segments of at most ``SEGMENT`` consecutive
chunks and about ``SEGMENT_BYTES``, which are written once; what one segment needs from those before it
(a split CRLF, an unmatched newline, how many frames came before) is a handful of small columns, carried
over the slim segment table and joined back. An ordinary response is one segment; an endless one is
many, spread over tasks.

Bodies are told apart by run and request id where a table has runs, else by request id.
Bytes are handled as ISO-8859-1 text, one character per byte, and decoded as UTF-8 per frame.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from servescope.functions.keys import request_key
from servescope.session import cut

#: A segment ends after so many chunks or bytes.
SEGMENT = 1024
SEGMENT_BYTES = 1 << 20
#: More parts than a span of chunks can have.
PARTS = 1 << 30
#: What a task sorts at a time, and what a row of it takes besides its text. Tables of fewer tasks than
#: ``OWN_TASKS`` are left to the session's partitions.
TASK_BYTES = 1 << 26
ROW_BYTES = 250
OWN_TASKS = 16
# Fixed value: the end-of-stream marker.
DONE = "[DONE]"


def decode_chunks(chunks: DataFrame) -> DataFrame:
    """Base64 to bytes with the integrity findings of each chunk (null when sound)."""
    given = F.col("raw_bytes_base64")
    raw = F.try_to_binary(given, F.lit("base64"))
    again = F.regexp_replace(F.base64(raw), "[\r\n]", "")
    alphabet = given.rlike("^[A-Za-z0-9+/]*={0,2}$") & ~F.contains(given, F.lit("\n"))
    reason = (
        F.when(raw.isNull() | ~alphabet, "NOT_BASE64")
        .when(again != given, "NOT_CANONICAL")
        .when(F.octet_length(raw) != F.col("raw_byte_count"), "SIZE_DIFFERS")
        .when(F.sha2(raw, 256) != F.col("raw_bytes_sha256"), "HASH_DIFFERS")
    )
    return chunks.withColumn("bytes", F.when(alphabet, raw)).withColumn("integrity", reason)


def tasks_for(rows: int, size: int = 0) -> int:
    """Tasks among which so many rows of so many bytes in all are sorted, so that none of them grows with the table."""
    return math.ceil((ROW_BYTES * rows + size) / TASK_BYTES)


def _dealt(df: DataFrame, tasks: int, *by: str) -> DataFrame:
    return df if tasks < OWN_TASKS else df.repartition(tasks, *by)


def _segments(chunks: DataFrame, key: Sequence[str], width: int, size: int, tasks: int = 0) -> DataFrame:
    text = F.decode("bytes", "ISO-8859-1")
    spans = (
        chunks.where(F.octet_length("bytes") > 0)
        .select(*key, "ordinal", "observation_offset_ns", "bytes")
        .withColumn("span", F.floor(F.col("ordinal") / width))
    )
    rows = _dealt(spans, tasks, *key, "span").withColumn("bytes", text).withColumnRenamed("bytes", "t")
    upto = (Window.unboundedPreceding, Window.currentRow)
    in_span = Window.partitionBy(*key, "span").orderBy("ordinal")
    # the bytes before a chunk decide its part of the span, so a part exceeds ``size`` by one chunk at most
    before = F.sum(F.length("t").cast("long")).over(in_span.rowsBetween(*upto)) - F.length("t")
    parted = rows.withColumn("seg", F.col("span") * PARTS + F.floor(before / size))
    inside = Window.partitionBy(*key, "span", "seg").orderBy("ordinal")
    crosses = F.coalesce(
        F.endswith(F.lag("t").over(inside), F.lit("\r")) & F.startswith("t", F.lit("\n")), F.lit(False)
    )
    crlf = (F.length("t") - F.length(F.replace("t", F.lit("\r\n"), F.lit("\n")))) + crosses.cast("int")
    dangling = F.endswith("t", F.lit("\r")).cast("int")
    # where the chunk ends in the normalized segment; a carriage return waits for its line feed
    ended = parted.withColumn("e", F.length("t") - crlf).withColumn(
        "e", (F.sum("e").over(inside.rowsBetween(*upto)) - dangling).cast("long")
    )
    return (
        ended.groupBy(*key, "span", "seg")
        .agg(F.sort_array(F.collect_list(F.struct("ordinal", "e", "observation_offset_ns", "t"))).alias("c"))
        .withColumn("raw", F.array_join(F.transform("c", lambda x: x["t"]), ""))
        .withColumn(
            "ends",
            F.transform("c", lambda x: F.struct(x["ordinal"].alias("ordinal"), x["e"].alias("e"),
                                                x["observation_offset_ns"].alias("at"))),
        )
        .withColumn("ends_cr", F.endswith("raw", F.lit("\r")))
        .withColumn("body", F.expr("CASE WHEN ends_cr THEN substring(raw, 1, length(raw) - 1) ELSE raw END"))
        .withColumn("r", F.replace("body", F.lit("\r\n"), F.lit("\n")))
        .withColumns({
            "starts_nl": F.startswith("r", F.lit("\n")),
            "only_nl": F.rtrim(F.col("r"), F.lit("\n")) == "",
            "trail": F.length("r") - F.length(F.rtrim(F.col("r"), F.lit("\n"))),
            "len": F.length("r"),
            "n0": _boundaries(F.col("r")),
            "n1": _boundaries(F.concat(F.lit("\n"), "r")),
        })
        .drop("c", "raw", "body", "span")
    )


def _boundaries(text: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit("\n\n"), F.lit("")))) / 2).cast("long")


def _carried(segments: DataFrame, key: Sequence[str]) -> DataFrame:
    """What the segments before leave behind. A segment is a function of the state before it (a waiting
    carriage return, an unmatched newline); scans over these few columns compose the functions."""
    slim = segments.drop("r", "ends")
    w = Window.partitionBy(*key).orderBy("seg")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return (
        slim.withColumn("stray", F.coalesce(F.lag("ends_cr").over(w), F.lit(False)) & ~F.col("starts_nl"))
        .withColumn("s", F.sum("trail").over(upto))
        .withColumn(
            "base", F.when(~F.col("only_nl") | F.col("stray"), F.col("s") - F.col("trail"))
        )
        .withColumn("leaves", (F.col("s") - F.coalesce(F.max("base").over(upto), F.lit(0))) % 2)
        .withColumn("takes", F.coalesce(F.lag("leaves").over(w), F.lit(0)))
        .withColumn("n", F.expr("CASE WHEN takes = 1 AND NOT stray THEN n1 ELSE n0 END"))
        .withColumn("frames_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("x_len", F.expr("len + takes + CAST(stray AS INT) - leaves"))
        .withColumn("x_before", F.coalesce(F.sum("x_len").over(before), F.lit(0)))
        .withColumn("earlier", F.lag("seg").over(w).isNotNull())
        .withColumn("later", F.lead("seg").over(w).isNotNull())
        .select(*key, "seg", "stray", "takes", "leaves", "frames_before", "x_before", "earlier", "later")
    )


def _stitched(segments: DataFrame, key: Sequence[str], tasks: int) -> DataFrame:
    whole = """concat(CASE WHEN takes = 1 THEN '\\n' ELSE '' END, CASE WHEN stray THEN '\\r' ELSE '' END, r)"""
    return (
        _dealt(segments.select(*key, "seg", "r", "ends"), tasks, *key, "seg")
        .join(_carried(segments, key), [*key, "seg"])
        .withColumn("x", F.expr(whole))
        .withColumn("x", F.expr("CASE WHEN leaves = 1 THEN substring(x, 1, length(x) - 1) ELSE x END"))
    )


def sse_pieces(
    chunks: DataFrame, key: Sequence[str] | None = None, width: int = SEGMENT, size: int = SEGMENT_BYTES, tasks: int = 0
) -> DataFrame:
    """All frames of all bodies, the unfinished tail included (``closed`` false).

    The frames of a segment and the ends of its chunks become rows first; running sums place the frames,
    and the chunk that completes a frame is the last chunk end seen on the way back to the frame's end.
    Only frames that reach over a segment's border are put together by a group. The tasks follow the size of
    the segments; those that fold the segments follow ``tasks``, as the chunks have not been counted yet.
    """
    key = key or request_key(chunks)
    segments = cut(_segments(chunks, key, width, size, tasks))
    tasks = tasks_for(*segments.select(
        F.coalesce(F.sum(F.size("ends") + F.col("n0") + 1), F.lit(0)), F.coalesce(F.sum("len"), F.lit(0))).first())
    items = """concat(
        transform(split(x, '\n\n'), (p, i) -> named_struct('chunk', false, 'i', CAST(i AS BIGINT), 'piece', p,
            'size', CAST(length(p) + 2 AS BIGINT), 'ordinal', CAST(NULL AS BIGINT), 'at', CAST(NULL AS BIGINT))),
        transform(ends, c -> named_struct('chunk', true, 'i', c.e + takes + CAST(stray AS INT), 'piece', CAST(NULL AS STRING),
            'size', 0L, 'ordinal', CAST(c.ordinal AS BIGINT), 'at', CAST(c.at AS BIGINT))))"""
    rows = _stitched(segments, key, tasks).select(
        *key, "seg", "frames_before", "x_before", "earlier", "later",
        F.expr(items).alias("items"), F.size(F.split("x", "\n\n")).alias("k"))
    # the segment's text and arrays stay behind; a row carries its own frame only
    rows = rows.select(*key, "seg", "frames_before", "x_before", "earlier", "later", "k", F.explode("items").alias("item")).select(
        *key, "seg", "frames_before", "x_before", "earlier", "later", "k", "item.*")
    within = Window.partitionBy(*key, "seg")
    upto = (Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("sum", F.sum("size").over(within.orderBy("chunk", "i").rowsBetween(*upto))).withColumn(
        "place", F.when(F.col("chunk"), F.col("i")).otherwise(F.col("sum")))
    back = within.orderBy(F.desc("place"), F.desc("chunk"), F.desc("ordinal")).rowsBetween(*upto)
    seen = F.last(F.when(F.col("chunk"), F.struct("ordinal", "at")), ignorenulls=True).over(back)
    last = F.col("i") == F.col("k") - 1
    frames = cut(placed.withColumn("by", seen).where("NOT chunk").select(
        *key, "seg",
        (F.col("frames_before") + F.col("i")).alias("frame_index"),
        F.col("piece").alias("raw_frame"),
        F.when(~last, F.col("by.ordinal")).alias("completing_chunk"),
        F.when(~last, F.col("by.at")).alias("observation_offset_ns"),
        F.when(~last, F.col("x_before") + F.col("place")).alias("frame_end"),
        ((F.col("i") == 0) & F.col("earlier") | last & F.col("later")).alias("over"),
    ))
    out = [*key, "frame_index", "raw_frame", "completing_chunk", "observation_offset_ns", "frame_end"]
    joined = frames.where("over").groupBy(*key, "frame_index").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("seg", "raw_frame"))), lambda s: s["raw_frame"]), ""
        ).alias("raw_frame"),
        F.max("completing_chunk").alias("completing_chunk"),
        F.max("observation_offset_ns").alias("observation_offset_ns"),
        F.max("frame_end").alias("frame_end"),
    )
    return _dealt(frames.where("NOT over").select(*out).unionByName(joined.select(*out)), tasks, *key)


def _shaped(pieces: DataFrame) -> DataFrame:
    """Frames with their lines read: ``kind``, ``data`` and ``error``."""
    raw_bytes = F.encode("raw_frame", "ISO-8859-1")
    utf8 = F.try_validate_utf8(raw_bytes.cast("string"))
    read = pieces.withColumn("text", utf8).withColumn("lines", F.split("text", "\n"))
    shaped = (
        read.withColumn(
            "bad_line",
            F.exists("lines", lambda x: ~(F.startswith(x, F.lit(":")) | (x == "data") | F.startswith(x, F.lit("data:")))),
        )
        .withColumn(
            "data_lines",
            F.transform(
                F.filter("lines", lambda x: (x == "data") | F.startswith(x, F.lit("data:"))),
                lambda x: F.regexp_replace(F.substr(x, F.lit(6)), "^ ", ""),
            ),
        )
        .withColumn("data", F.when(F.size("data_lines") > 0, F.array_join("data_lines", "\n")))
    )
    error = (
        F.when(F.col("text").isNull(), "INVALID_UTF8")
        .when(F.contains("text", F.lit("\r")), "BARE_CARRIAGE_RETURN")
        .when(F.col("bad_line"), "UNSUPPORTED_FIELD")
    )
    kind = (
        F.when(F.col("frame_end").isNull(), "tail")
        .when(error.isNotNull(), "error")
        .when(F.col("data").isNull(), "comment")
        .when(F.col("data") == DONE, "done")
        .otherwise("data")
    )
    return shaped.withColumn("kind", kind).withColumn(
        "error", F.when(F.col("frame_end").isNotNull(), error)
    )


def sse_frames(
    chunks: DataFrame, key: Sequence[str] | None = None, width: int = SEGMENT, limit: int | None = None,
    size: int = SEGMENT_BYTES, tasks: int = 0,
) -> DataFrame:
    """Frames with kind, data and error; empty frames are skipped, the open tail is ``kind='tail'``.

    A frame of more than ``limit`` bytes is flagged ``over_limit`` and keeps its data. ``tasks``: see ``sse_pieces``.
    """
    key = key or request_key(chunks)
    pieces = sse_pieces(chunks, key, width, size, tasks).where("raw_frame <> ''")
    framed = _shaped(pieces)
    # only frames that hold the marker can be the end, so few are read twice
    marked = _shaped(pieces.where(F.contains("raw_frame", F.lit(DONE))))
    first_done = marked.where("kind = 'done'").groupBy(*key).agg(F.min("frame_index").alias("__done"))
    raw_bytes = F.encode("raw_frame", "ISO-8859-1")
    late = (
        F.when((F.col("kind") == "done") & (F.col("frame_index") > F.col("__done")), "DUPLICATE_DONE")
        .when((F.col("kind") == "data") & (F.col("frame_index") > F.col("__done")), "DATA_AFTER_DONE")
    )
    return framed.join(first_done, key, "left").select(
        *key, "frame_index", "kind",
        F.when(F.col("kind").isin("data", "done"), F.col("data")).alias("data"),
        "completing_chunk", "observation_offset_ns", "frame_end",
        F.coalesce("error", late).alias("error"),
        F.octet_length(raw_bytes).cast("long").alias("frame_bytes"),
        (F.rtrim(F.ltrim(F.col("raw_frame"), F.lit("\n")), F.lit("\n")) != "").alias("has_content"),
        (F.lit(False) if limit is None else F.octet_length(raw_bytes) > limit).alias("over_limit"),
    )


def stream_status(frames: DataFrame, key: Sequence[str] | None = None) -> DataFrame:
    """Per body: frames by kind and the first thing that is wrong with it, or OK."""
    first_error = F.min_by("error", F.when(F.col("error").isNotNull(), F.col("frame_index")))
    grouped = frames.groupBy(*(key or request_key(frames))).agg(
        F.count_if(F.col("kind") == "data").alias("data_frames"),
        F.count_if(F.col("kind") == "comment").alias("comment_frames"),
        F.count_if(F.col("kind") == "done").alias("done_frames"),
        F.coalesce(F.max(F.when(F.col("kind") == "tail", F.col("frame_bytes"))), F.lit(0)).alias("tail_bytes"),
        first_error.alias("__error"),
        F.bool_or((F.col("kind") == "tail") & F.col("has_content")).alias("__open"),
    )
    status = (
        F.coalesce("__error", F.when(F.col("__open"), "INCOMPLETE_FINAL_FRAME"),
                   F.when(F.col("done_frames") == 0, "MISSING_DONE"), F.lit("OK"))
    )
    return grouped.withColumn("status", status).drop("__error", "__open")


# The shape of one completion response; anything the stream does not need is ignored.
COMPLETION = """STRUCT<id: STRING, choices: ARRAY<STRUCT<index: BIGINT, text: STRING, token_ids: ARRAY<BIGINT>,
    finish_reason: STRING, prompt_token_ids: ARRAY<BIGINT>>>,
    usage: STRUCT<prompt_tokens: BIGINT, completion_tokens: BIGINT, total_tokens: BIGINT>,
    metrics: MAP<STRING, DOUBLE>>"""
# The five metrics a usage frame has to carry.
SERVER_METRIC_KEYS = (
    "generation_time_ms", "mean_itl_ms", "queue_time_ms", "time_to_first_token_ms", "tokens_per_second",
)


def completion_events(frames: DataFrame) -> DataFrame:
    """Data frames as responses: ``event`` is GENERATION, USAGE, DONE or BROKEN."""
    parsed = frames.where("kind IN ('data', 'done', 'error')").withColumn(
        "v", F.when(F.col("kind") == "data", F.from_json("data", COMPLETION))
    )
    choices = F.size("v.choices")
    event = (
        F.when(F.col("kind") == "done", "DONE")
        .when(F.col("v.choices").isNull(), "BROKEN")
        .when(choices == 0, "USAGE")
        .when(choices == 1, "GENERATION")
        .otherwise("BROKEN")
    )
    choice = F.get("v.choices", F.lit(0))
    metrics = F.array_join(F.array_sort(F.map_keys("v.metrics")), ",")
    return parsed.select(
        *request_key(frames), "frame_index", "observation_offset_ns", "completing_chunk", "frame_end",
        event.alias("event"),
        F.col("v.id").alias("body_id"),
        choice["index"].alias("choice_index"),
        choice["text"].alias("text"),
        F.coalesce(choice["token_ids"], F.array().cast("array<bigint>")).alias("token_ids"),
        choice["finish_reason"].alias("finish_reason"),
        choice["prompt_token_ids"].alias("prompt_token_ids"),
        F.col("v.usage").alias("usage"),
        (metrics == ",".join(SERVER_METRIC_KEYS)).alias("metrics_complete"),
    )


# name: predicate over the folded events of one request
COMPLETION_RULES = {
    "broken-frame": "broken = 0",
    "body-id-differs": "wrong_ids = 0",
    "choice-index-differs": "wrong_choices = 0",
    "finish-reason-unknown": "odd_reasons = 0",
    "one-generation-terminal": "terminals = 1",
    "one-usage-terminal": "usages = 1",
    "one-protocol-terminal": "dones = 1",
    "generation-after-terminal": "last_generation <= first_terminal",
    "usage-before-terminal": "first_usage > first_terminal",
    "done-before-usage": "first_done > first_usage",
    "terminal-clocks-not-strict":
        "generation_terminal_ns < usage_terminal_ns AND usage_terminal_ns < protocol_terminal_ns"
        " AND protocol_terminal_ns < transport_terminal_ns",
    "clock-went-back": "went_back = 0",
    "prompt-ids-differ": "prompt_events = 1 AND returned_prompt = sent_prompt",
    "output-count-differs": "size(output_ids) = expected_output_tokens",
    "usage-does-not-add-up":
        "usage.prompt_tokens + usage.completion_tokens = usage.total_tokens"
        " AND usage.completion_tokens = size(output_ids)",
    "metrics-incomplete": "metrics_complete",
    "no-output-token": "size(output_ids) > 0",
}


def completion_replay(requests: DataFrame, frames: DataFrame) -> DataFrame:
    """Rebuild each completion from its frames and check it against what was sent.

    ``requests``: run_id, request_id, sent_prompt, expected_output_tokens, transport_terminal_ns. The
    generation events of a request are bounded by its output limit and fit one row.
    """
    from servescope.functions.rules import failed_rules

    key = request_key(requests)
    events = completion_events(frames)
    order = Window.partitionBy(*key).orderBy("frame_index")
    stepped = events.withColumn("before", F.lag("observation_offset_ns").over(order))
    kind, at, index = F.col("event"), F.col("observation_offset_ns"), F.col("frame_index")
    terminal = (kind == "GENERATION") & F.col("finish_reason").isNotNull()
    bearing = (kind == "GENERATION") & (F.size("token_ids") > 0)
    folded = stepped.groupBy(*key).agg(
        F.count_if(kind == "BROKEN").alias("broken"),
        F.count_if((kind != "DONE") & (kind != "BROKEN")
                   & ~F.col("body_id").eqNullSafe(F.concat(F.lit("cmpl-"), "request_id"))).alias("wrong_ids"),
        F.count_if((kind == "GENERATION") & ~F.col("choice_index").eqNullSafe(F.lit(0))).alias("wrong_choices"),
        F.count_if(F.col("finish_reason") != "length").alias("odd_reasons"),
        F.count_if(terminal).alias("terminals"),
        F.count_if(kind == "USAGE").alias("usages"),
        F.count_if(kind == "DONE").alias("dones"),
        F.max(F.when(kind == "GENERATION", index)).alias("last_generation"),
        F.min(F.when(terminal, index)).alias("first_terminal"),
        F.min(F.when(kind == "USAGE", index)).alias("first_usage"),
        F.min(F.when(kind == "DONE", index)).alias("first_done"),
        F.min(F.when(terminal, at)).alias("generation_terminal_ns"),
        F.min(F.when(kind == "USAGE", at)).alias("usage_terminal_ns"),
        F.min(F.when(kind == "DONE", at)).alias("protocol_terminal_ns"),
        F.count_if(F.col("before") > at).alias("went_back"),
        F.count_if(F.col("prompt_token_ids").isNotNull()).alias("prompt_events"),
        F.min_by("prompt_token_ids", F.when(F.col("prompt_token_ids").isNotNull(), index)).alias("returned_prompt"),
        F.max(F.when(kind == "USAGE", F.col("usage"))).alias("usage"),
        F.coalesce(F.bool_and(F.when(kind == "USAGE", F.col("metrics_complete"))), F.lit(False)).alias("metrics_complete"),
        F.min(F.when(bearing, at)).alias("first_token_ns"),
        F.max(F.when(bearing, F.size("token_ids"))).alias("largest_event"),
        F.sort_array(F.collect_list(F.when(kind == "GENERATION", F.struct("frame_index", "token_ids", "text")))).alias("g"),
    )
    # a request without any frame has none of anything
    counts = ["broken", "wrong_ids", "wrong_choices", "odd_reasons", "terminals", "usages", "dones", "went_back", "prompt_events"]
    joined = requests.join(folded, key, "left").fillna(0, counts).fillna(False, ["metrics_complete"])
    rebuilt = joined.withColumn("output_ids", F.expr("flatten(coalesce(g.token_ids, array()))")).withColumn(
        "output_text", F.array_join(F.coalesce(F.col("g.text"), F.array()), "")
    )
    tpot = F.when(
        F.col("largest_event") == 1,
        F.try_divide((F.col("generation_terminal_ns") - F.col("first_token_ns")).cast("double"),
                     F.size("output_ids") - 1),
    )
    return rebuilt.select(
        *key, "generation_terminal_ns", "usage_terminal_ns", "protocol_terminal_ns",
        F.size("output_ids").cast("long").alias("output_tokens"),
        F.sha2("output_text", 256).alias("output_text_sha256"),
        tpot.alias("tpot_ns"),
        F.array_join(failed_rules(COMPLETION_RULES), ",").alias("violations"),
    )


def cancellation_replay(requests: DataFrame, chunks: DataFrame, frames: DataFrame, tasks: int = 0) -> DataFrame:
    """Up to the client's close: the first generation delivery, the closing read, what was pending.

    ``requests``: run_id, request_id, close_ns. Chunks observed after the close are not the client's.
    ``tasks``: among how many the chunks are sorted, see ``sse_pieces``.
    """
    key = request_key(requests)
    # the bytes stay behind, only their number is sorted; one join each for chunks and frames, as every side of
    # a join is sorted in memory of its own
    slim = _dealt(chunks.select(*key, "ordinal", "observation_offset_ns", F.octet_length("bytes").alias("n_bytes")), tasks, *key)

    def joined_left(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
        named = right.withColumnsRenamed({k: f"__{k}" for k in key})
        same = reduce(and_, [F.col(k) == F.col(f"__{k}") for k in key])
        return left.join(named, same & condition, "left")

    last = joined_left(requests.select(*key, "close_ns"), slim, F.col("observation_offset_ns") <= F.col("close_ns")).groupBy(*key).agg(
        F.max("ordinal").alias("last_chunk"),
        F.sum("n_bytes").alias("received_bytes"),
    )
    within = joined_left(last, completion_events(frames), F.col("completing_chunk") <= F.col("last_chunk"))
    bearing = (F.col("event") == "GENERATION") & (F.size("token_ids") > 0)
    first = F.struct("frame_index", "completing_chunk", "observation_offset_ns", F.size("token_ids").alias("tokens"))
    joined = within.groupBy(*key).agg(
        F.max("last_chunk").alias("last_chunk"),
        F.max("received_bytes").alias("received_bytes"),
        F.min(F.when(bearing, first)).alias("d"),
        F.count_if(F.col("event") == "USAGE").alias("usages"),
        F.count_if(F.col("event") == "DONE").alias("dones"),
        F.count_if(F.col("finish_reason").isNotNull()).alias("terminals"),
        F.max("frame_end").alias("last_end"),
    )
    pending = F.coalesce("received_bytes", F.lit(0)) - F.coalesce("last_end", F.lit(0))
    status = (
        F.when(F.col("d").isNull(), "NO_GENERATION_DELIVERED")
        .when(F.col("terminals") > 0, "GENERATION_TERMINAL_BEFORE_CLOSE")
        .when(F.col("usages") > 0, "USAGE_BEFORE_CLOSE")
        .when(F.col("dones") > 0, "DONE_BEFORE_CLOSE")
        .when(F.col("last_chunk") > F.col("d.completing_chunk"), "READ_AFTER_FIRST_DELIVERY")
        .otherwise("OK")
    )
    return joined.select(
        *key, status.alias("status"),
        F.col("d.frame_index").alias("delivery_frame"),
        F.col("d.completing_chunk").alias("delivery_chunk"),
        F.col("d.observation_offset_ns").alias("delivery_ns"),
        F.col("d.tokens").cast("long").alias("delivered_tokens"),
        pending.alias("pending_bytes"),
        F.when(pending > 0, "INCOMPLETE_TRAILING_SSE_BYTES").otherwise("AT_SSE_FRAME_BOUNDARY").alias("state_at_close"),
    )


def _hash_sorted(keys: Sequence[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Running SHA-256 over rows sorted by (key, ordinal); holds one digest at a time."""
    columns = [*keys, "body_bytes", "body_sha256", "status"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, digest, size, sound = None, None, 0, True
        done: list[tuple] = []

        def closed() -> tuple:
            return (*current, size, digest.hexdigest(), "OK") if sound else (*current, size, None, "UNSOUND_CHUNK")

        for batch in batches:
            for *request, data in zip(*[batch[k] for k in keys], batch["bytes"]):
                if digest is None or request != current:
                    if digest is not None:
                        done.append(closed())
                    current, digest, size, sound = request, hashlib.sha256(), 0, True
                if data is None:
                    sound = False
                else:
                    digest.update(data)
                    size += len(data)
            yield pd.DataFrame(done, columns=columns)
            done = []
        if digest is not None:
            yield pd.DataFrame([closed()], columns=columns)

    return run


def body_hash(chunks: DataFrame) -> DataFrame:
    """SHA-256 of each body over its chunks in order; null with a status where a chunk has no bytes.

    Sorted chunks stream past a running digest, so no body of any size is held in memory.
    """
    key, types = request_key(chunks), dict(chunks.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in key)
    return (
        chunks.repartition(*key)
        .sortWithinPartitions(*key, "ordinal")
        .select(*key, "bytes")
        .mapInPandas(_hash_sorted(key), f"{schema}, body_bytes long, body_sha256 string, status string")
    )


def protocol_shape(events: DataFrame) -> DataFrame:
    """Ordered (kind, token delta) of the stream events of a request, as text."""
    part = F.concat_ws(":", "kind", F.coalesce(F.col("token_delta_count").cast("string"), F.lit("-")))
    shaped = events.where("kind IN ('SSE_COMMENT', 'SSE_TOKEN_EVENT', 'SSE_DONE')")
    return shaped.groupBy("run_id", "request_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("sequence", part.alias("part")))), lambda x: x["part"]),
            ",",
        ).alias("protocol_shape")
    )


def semantic_fingerprint(
    requests: DataFrame, run_facts: DataFrame, fields: Sequence[str], digits: int = 4
) -> DataFrame:
    """One hash per run over what has to repeat: never clocks, ports, run ids or chunk borders.

    Request hashes are combined as a tree (by the first ``digits`` hex digits of the request's
    own hash, then over these buckets), so a run of any size combines in parallel. ``fields`` are
    text columns; ``run_facts`` carries run_id and a text ``facts``.
    """
    shown = [F.concat(F.lit(f"{f}="), F.coalesce(F.col(f).cast("string"), F.lit("null"))) for f in sorted(fields)]
    hashed = requests.select("run_id", F.sha2(F.concat_ws("|", *shown), 256).alias("h"))
    leaves = hashed.groupBy("run_id", F.substr("h", F.lit(1), F.lit(digits)).alias("b")).agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("bh")
    )
    roots = leaves.groupBy("run_id").agg(
        F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "bh"))), lambda x: x["bh"]), ""), 256)
        .alias("root")
    )
    return roots.join(run_facts, "run_id").select(
        "run_id", F.sha2(F.concat_ws("|", "root", "facts"), 256).alias("semantic_fingerprint")
    )


#: What of a request has to repeat, besides its body and protocol shape.
REQUEST_FIELDS = (
    "request_id", "case_id", "phase", "terminal_class", "failure_kind", "input_tokens", "output_tokens", "token_count_source",
    "token_deltas", "per_token_complete", "slo_satisfied",
)
#: What of a run has to repeat: the identities of its inputs, its rates as counts, and its peak.
RUN_FIELDS = (
    "workload_sha256", "configuration_sha256", "fixture_sha256", "failed", "timed_out", "attempted", "max_concurrency", "batch_observed",
)


def run_fingerprint(
    requests: DataFrame, chunks: DataFrame, events: DataFrame, runs: DataFrame,
    request_fields: Sequence[str] = REQUEST_FIELDS, run_fields: Sequence[str] = RUN_FIELDS, digits: int = 4,
) -> DataFrame:
    """The semantic fingerprint of each run over everything that has to repeat.

    ``requests``: run_id and the request fields; ``chunks``: run_id, request_id, ordinal, bytes, of which
    only the whole body counts; ``events``: the stream events of ``protocol_shape``; ``runs``: run_id and the
    run fields. A request without chunks has the hash of an empty body. Rates are compared as
    counts, so no rounding decides.
    """
    key = ["run_id", "request_id"]
    bodies = body_hash(chunks.select(*key, "ordinal", "bytes")).select(*key, F.coalesce("body_sha256", F.lit("unsound")).alias("body_sha256"))
    whole = requests.join(bodies, key, "left").join(protocol_shape(events), key, "left").fillna(
        {"body_sha256": hashlib.sha256(b"").hexdigest(), "protocol_shape": ""})
    shown = [F.coalesce(F.col(f).cast("string"), F.lit("null")) for f in run_fields]
    facts = runs.select("run_id", F.concat_ws("/", *shown).alias("facts"))
    return semantic_fingerprint(whole, facts, [*request_fields, "body_sha256", "protocol_shape"], digits)


def flat_fields(schema: T.StructType, prefix: str = "") -> list[tuple[str, Column]]:
    """Path and text of every scalar in a record: structs are followed to any depth, lists and maps are
    written as JSON, so their elements and order count."""
    out: list[tuple[str, Column]] = []
    for field in schema.fields:
        path = f"{prefix}{field.name}"
        column = F.col(".".join(f"`{p}`" for p in path.split(".")))
        if isinstance(field.dataType, T.StructType):
            # a missing struct is told apart from one of nulls
            out += [(f"{path}?", F.when(column.isNotNull(), F.lit("present"))), *flat_fields(field.dataType, f"{path}.")]
        elif isinstance(field.dataType, (T.ArrayType, T.MapType)):
            out.append((path, F.to_json(column)))
        else:
            out.append((path, column.cast("string")))
    return out


def record_drift(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Every scalar of two tables of records, whatever their nesting: ``key, field, rebuilt, stored`` where
    they differ. A field that one schema lacks is null on that side, and so is a missing record."""

    def long(df: DataFrame, name: str) -> DataFrame:
        fields = [(p, c) for p, c in flat_fields(df.schema) if p not in key]
        pairs = F.array(*[F.struct(F.lit(p).alias("field"), c.alias("v")) for p, c in fields])
        return df.select(*key, F.explode(pairs).alias("x")).where("x.v IS NOT NULL").select(*key, "x.field", F.col("x.v").alias(name))

    both = long(left, "rebuilt").join(long(right, "stored"), [*key, "field"], "full_outer")
    return both.where(~F.col("rebuilt").eqNullSafe(F.col("stored")))


def drift(left: DataFrame, right: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Field by field: what was rebuilt against what was stored; one side missing counts too."""

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            *key,
            F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields])).alias("x"),
        ).select(*key, "x.field", F.col("x.v").alias(name))

    both = long(left, "rebuilt").join(long(right, "stored"), [*key, "field"], "full_outer")
    return both.where(~F.col("rebuilt").eqNullSafe(F.col("stored")))
