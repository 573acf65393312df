"""Structured Streaming versions of the incremental parts.

Order is by sequence and clock inside a key; watermarks bound how long a window, a half-read body
or an open request may wait. Results of closed windows equal the batch jobs over the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from servescope.functions.keys import REQUEST_KEY, request_key
from servescope.operators.order_statistics import bucket, percentiles_by_bucket
from servescope.operators.replay import DONE
from servescope.session import shared_folder


#: No row is from this time or later; a row of it ends a bounded stream.
CLOSING = "9000-01-01 00:00:00"


def watermarked(df: DataFrame, at: str, delay: str) -> DataFrame:
    """A watermark, past which the closing row of a bounded stream goes no further.

    The condition names the event time, so the optimizer leaves it behind the watermark, which the
    closing row has moved by then.
    """
    return df.withWatermark(at, delay).where(F.col(at) < F.lit(CLOSING).cast("timestamp"))


def as_stream(
    df: DataFrame, files: int | None = None, per_trigger: int | None = None, by: str | None = None,
    closing: str | None = None,
) -> DataFrame:
    """Write a table to the shared folder and read it back as a stream of files.

    With ``by`` all rows of a key land in one file, so a key is never split over triggers. With
    ``closing``, the name of the event time, the stream ends: a last file holds one row of the time
    ``CLOSING``, so every window, span and state is closed by the watermark when all has been read.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    if by is not None:
        df = df.repartition(by) if files is None else df.repartition(files, by)
    elif files is not None:
        df = df.repartition(files)
    df.write.parquet(path)
    if closing is not None:
        end = [F.lit(CLOSING).cast(t).alias(c) if c == closing else F.lit(None).cast(t).alias(c) for c, t in df.dtypes]
        spark.range(1).select(*end).write.mode("append").parquet(path)
    reader = spark.readStream.schema(df.schema)
    if per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", str(per_trigger))
    return reader.parquet(path)


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run over everything available, into a table in the shared folder, and read the table."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/stream-out-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", f"{folder}/data")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/data")


#: Buckets of an octave in the state of a window.
STEPS = 16


def _successful(terminals: DataFrame) -> DataFrame:
    value = F.when(F.col("terminal_class") == "SUCCESS", F.col("end_to_end_ns")).cast("double")
    sound = F.when(F.abs(value) < F.lit(float("inf")), value)
    return terminals.withColumn("__v", sound).withColumn("__b", bucket(F.col("__v"), STEPS))


def window_histogram(terminals: DataFrame, every: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts per run, tumbling window of terminal time and bucket of the end-to-end time.

    ``terminals``: run_id, terminal_at (timestamp), terminal_class, phase, end_to_end_ns, slo_satisfied. The
    state of a window has a row for each bucket (``STEPS`` an octave), however many samples it takes.
    """
    # ahead of the watermark, and passed by the closing row
    measured = terminals.where((F.col("phase") == "MEASURED") | (F.col("terminal_at") >= F.lit(CLOSING).cast("timestamp")))
    return (
        _successful(watermarked(measured, "terminal_at", delay))
        .groupBy("run_id", F.window("terminal_at", every).alias("w"), "__b")
        .agg(
            F.count(F.lit(1)).alias("attempted"),
            F.count_if(F.col("terminal_class") == "SUCCESS").alias("successful"),
            F.count_if(F.col("terminal_class") == "TIMEOUT").alias("timed_out"),
            F.count_if(F.col("slo_satisfied")).alias("slo_satisfying"),
        )
        .select("run_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                "__b", "attempted", "successful", "timed_out", "slo_satisfying")
    )


def windowed_summary(histogram: DataFrame, terminals: DataFrame, every: str = "1 day") -> DataFrame:
    """Counts and exact end-to-end percentiles of the closed windows of ``window_histogram``.

    ``terminals`` are the rows that the stream has taken, as they were written; of these only the buckets
    that hold a wanted rank are sorted. Rows that the watermark turned away must not be among them.
    """
    keys = ["run_id", "window_start"]
    counts = histogram.groupBy(*keys, "window_end").agg(
        *[F.sum(c).alias(c) for c in ("attempted", "successful", "timed_out", "slo_satisfying")])
    rows = _successful(terminals.where("phase = 'MEASURED'")).where("__b IS NOT NULL").select(
        "run_id", F.window("terminal_at", every).getField("start").alias("window_start"), "__b", "__v")
    buckets = histogram.where("__b IS NOT NULL").select(*keys, "__b", F.col("successful").alias("__c"))
    exact = percentiles_by_bucket(rows, buckets, keys, {"e2e_p50": 0.5, "e2e_p95": 0.95})
    return counts.join(exact, keys, "left")


def dedup_requests(arrivals: DataFrame, key: Sequence[str] | None = None, at: str = "seen_at", delay: str = "1 hour") -> DataFrame:
    """At-least-once input to once per run and id, as long as the copies fall inside the watermark."""
    return watermarked(arrivals, at, delay).dropDuplicatesWithinWatermark([*(key or request_key(arrivals))])


#: Groups of requests unless the caller knows the rate; the state of a group is a row.
GROUPS = 1024
GROUP_ROWS = 8192


def groups_for(rows: int) -> int:
    """Groups for a bounded stream of so many rows, about ``GROUP_ROWS`` each."""
    return max(32, -(-rows // GROUP_ROWS))


def _grouped(rows: DataFrame, delay: str, groups: int, *columns: str) -> DataFrame:
    """Rows with their request as one text, dealt to ``groups`` by its hash.

    A state function is called once for each group that has news, not once for each request: a call costs
    milliseconds whatever it holds. The group's state keeps a deadline for each of its requests.
    """
    dealt = watermarked(rows, "seen_at", delay).withColumn("request", F.to_json(F.struct(*request_key(rows))))
    return dealt.selectExpr(f"pmod(xxhash64(request), {groups}) AS dealt", "request", *columns, "seen_at")


def _named(told: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """The request's columns again, as the rows had them."""
    types = dict(rows.dtypes)
    key = F.from_json("request", ", ".join(f"{k} {types[k]}" for k in request_key(rows))).alias("request")
    return told.select(key, *columns).selectExpr(*[f"request.{k}" for k in request_key(rows)], *columns)


def _arrived(batches: Iterator[pd.DataFrame], state: GroupState, columns: Sequence[str]) -> list[tuple]:
    """The rows of a call in order; none if the deadline has come."""
    if state.hasTimedOut:
        return []
    return sorted(row for b in batches for row in zip(*[b[c].tolist() for c in columns]))


def _open(state: GroupState) -> dict[str, list]:
    """What is kept of each request, its deadline first."""
    return {request: kept for request, *kept in zip(*state.get)} if state.exists else {}


def _expired(kept: dict[str, list], state: GroupState) -> list[tuple[str, list]]:
    """Take out the requests whose deadline the watermark has passed, and store the others."""
    now = state.getCurrentWatermarkMs()
    gone = [(request, kept.pop(request)) for request in [r for r, values in kept.items() if values[0] < now]]
    if kept:
        state.update(tuple(list(column) for column in zip(*[(request, *values) for request, values in kept.items()])))
        state.setTimeoutTimestamp(max(min(values[0] for values in kept.values()), now + 1))
    elif state.exists:
        state.remove()
    return gone


COPIES = "request string, status string, seen_us long, copy long"
COPIES_STATE = "request array<string>, due_ms array<long>, arrived array<long>"


def _report_copies(wait_ms: int):
    def report(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Every arrival of an id, numbered in the order of arrival."""
        kept, now, rows = _open(state), state.getCurrentWatermarkMs(), []
        for request, at in _arrived(batches, state, ["request", "seen_us"]):
            values = kept.setdefault(request, [0, 0])
            rows.append((request, "DUPLICATE" if values[1] else "FIRST", at, values[1]))
            values[:] = max(values[0], max(at // 1000, now) + wait_ms), values[1] + 1
        _expired(kept, state)
        if rows:
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in COPIES.split(", ")])

    return report


def duplicate_report(arrivals: DataFrame, delay: str = "1 hour", wait_ms: int = 3_600_000, groups: int = GROUPS) -> DataFrame:
    """FIRST and DUPLICATE rows for every arrival of a run and id; an id is forgotten once the watermark
    is ``wait_ms`` past its last copy. Columns of ``arrivals``: run_id, request_id, seen_at."""
    told = _grouped(arrivals, delay, groups, "unix_micros(seen_at) AS seen_us").groupBy("dealt").applyInPandasWithState(
        _report_copies(wait_ms), COPIES, COPIES_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return _named(told.withColumn("seen_at", F.timestamp_micros("seen_us")), arrivals, "status", "seen_at", "copy")


def activity_spans(events: DataFrame, key: str, at: str = "seen_at", gap: str = "2 seconds", delay: str = "10 seconds") -> DataFrame:
    """Spans of activity per client; between two spans lies a quiet interval of at least ``gap``."""
    return (
        watermarked(events, at, delay)
        .groupBy(key, F.session_window(at, gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("events"))
        .select(key, F.col("w.start").alias("span_start"), F.col("w.end").alias("span_end"), "events")
    )


FRAMES = "frame_index long, kind string, data string, completing_chunk long, error string"
FRAME_STATE = "buffer binary, done boolean, next_ordinal long, frame_index long, held_ordinals array<long>, held array<binary>, broken boolean"
#: Bytes that a body may leave unread in the state: an unfinished frame, and chunks that came early.
STATE_BYTES = 1 << 20


def _with_key(df: DataFrame, columns: str) -> str:
    types = dict(df.dtypes)
    return ", ".join([*[f"{k} {types[k]}" for k in request_key(df)], columns])


def _read_frame(raw: bytes, done: bool) -> tuple[str, str | None, str | None]:
    """kind, data, error of one complete frame; the batch job expresses the same rules natively."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return "error", None, "INVALID_UTF8"
    if "\r" in text:
        return "error", None, "BARE_CARRIAGE_RETURN"
    lines = text.split("\n")
    if any(not (x == "data" or x.startswith((":", "data:"))) for x in lines):
        return "error", None, "UNSUPPORTED_FIELD"
    values = [x[5:].removeprefix(" ") for x in lines if x.startswith("data")]
    if not values:
        return "comment", None, None
    data = "\n".join(values)
    if data == DONE:
        return "done", data, "DUPLICATE_DONE" if done else None
    return "data", data, "DATA_AFTER_DONE" if done else None


def assemble_frames(
    key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    """Bytes in, completed frames out. Early chunks wait for their turn; what is open at the
    timeout becomes one INCOMPLETE row. A body that leaves more than ``STATE_BYTES`` unread ends with one
    BUFFER_LIMIT row."""
    columns = [*REQUEST_KEY[-len(key):], "frame_index", "kind", "data", "completing_chunk", "error"]
    buffer, done, turn, index, ordinals, held, broken = (
        state.get if state.exists else (b"", False, 0, 0, [], [], False)
    )
    if state.hasTimedOut:
        state.remove()
        if not broken and (bytes(buffer).strip(b"\n") or not done or held):
            yield pd.DataFrame([(*key, index, "tail", None, None, "INCOMPLETE")], columns=columns)
        return
    waiting = dict(zip([int(o) for o in ordinals], [bytes(h) for h in held]))
    latest = 0
    for batch in batches:
        for row in batch.itertuples(index=False):
            if row.ordinal >= turn and not broken:
                waiting[int(row.ordinal)] = bytes(row.bytes)
            latest = max(latest, int(row.seen_at.timestamp() * 1000))
    buffer, rows = bytes(buffer), []
    while turn in waiting:
        buffer = (buffer + waiting.pop(turn)).replace(b"\r\n", b"\n")
        while b"\n\n" in buffer:
            raw, buffer = buffer.split(b"\n\n", 1)
            if raw:
                kind, data, error = _read_frame(raw, done)
                done = done or kind == "done"
                rows.append((*key, index, kind, data, turn, error))
            index += 1
        turn += 1
    if not broken and len(buffer) + sum(map(len, waiting.values())) > STATE_BYTES:
        broken, buffer, waiting = True, b"", {}
        rows.append((*key, index, "error", None, None, "BUFFER_LIMIT"))
    state.update((buffer, done, turn, index, list(waiting), list(waiting.values()), broken))
    state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + 3_600_000)
    yield pd.DataFrame(rows, columns=columns)


def stream_frames(chunks: DataFrame, delay: str = "1 hour") -> DataFrame:
    """``chunks``: run_id, request_id, ordinal (dense from 0), bytes, seen_at."""
    key = request_key(chunks)
    return (
        watermarked(chunks, "seen_at", delay)
        .groupBy(*key)
        .applyInPandasWithState(
            assemble_frames, _with_key(chunks, FRAMES), FRAME_STATE, "append", GroupStateTimeout.EventTimeTimeout
        )
    )


LIFECYCLE = ("status string, dispatch_ns long, first_token_ns long, last_token_ns long, "
             "terminal_ns long, output_tokens long, terminal_class string, late_events long")
LIFECYCLE_STATE = ("request array<string>, due_ms array<long>, dispatch_ns array<long>, first_token_ns array<long>, "
                   "last_token_ns array<long>, output_tokens array<long>, closed array<boolean>")
REQUEST_WAIT_MS = 3_600_000


def assemble_requests(
    key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    """Events to one closed record at the terminal; a request without one closes at the timeout;
    events after the close are counted in a LATE row."""
    kept, now, rows, late = _open(state), state.getCurrentWatermarkMs(), [], {}
    columns = ["request", "off_ns", "kind_rank", "kind", "token_delta_count", "terminal_class", "seen_ms"]
    for request, off, _, kind, tokens, cls, seen in _arrived(batches, state, columns):
        values = kept.setdefault(request, [0, None, None, None, 0, False])
        due, dispatch, first, last, total, closed = values
        due = max(due, max(seen, now) + REQUEST_WAIT_MS)
        if closed:
            if kind != "CLIENT_REQUEST_ENDED":
                late[request] = late.get(request, 0) + 1
        elif kind == "CLIENT_REQUEST_STARTED" and dispatch is None:
            dispatch = off
        elif kind == "SSE_TOKEN_EVENT":
            first, last, total = off if first is None else first, off, total + tokens
        elif kind == "REQUEST_TERMINAL":
            closed = True
            rows.append((request, "CLOSED", dispatch, first, last, off, total, cls, 0))
        values[:] = due, dispatch, first, last, total, closed
    rows += [(request, "LATE", None, None, None, None, None, None, n) for request, n in late.items()]
    for request, (_, dispatch, first, last, total, closed) in _expired(kept, state):
        if not closed:
            rows.append((request, "TIMEOUT", dispatch, first, last, None, total, "TIMEOUT", 0))
    if rows:
        yield pd.DataFrame(rows, columns=["request", *[c.split()[0] for c in LIFECYCLE.split(", ")]], dtype="object")


def stream_requests(events: DataFrame, delay: str = "1 hour", groups: int = GROUPS) -> DataFrame:
    """``events``: run_id, request_id, kind, kind_rank, off_ns, token_delta_count, terminal_class, seen_at."""
    told = _grouped(
        events, delay, groups, "kind", "kind_rank", "off_ns", "coalesce(CAST(token_delta_count AS BIGINT), 0L) AS token_delta_count",
        "coalesce(terminal_class, '') AS terminal_class", "unix_millis(seen_at) AS seen_ms",
    ).groupBy("dealt").applyInPandasWithState(
        assemble_requests, f"request string, {LIFECYCLE}", LIFECYCLE_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return _named(told, events, *[c.split()[0] for c in LIFECYCLE.split(", ")])


DELTAS = ("slot long, metric string, label_set string, scrape_offset_ns long, status string, delta double")
SILENT_MS = 7 * 86_400_000
DELTA_STATE = "process string, offset_ns long, value double"


def follow_counter(
    key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    """Change of one series against its last scrape, with restart, reorder and reset told apart; a series
    that has been silent for a week of event time starts anew."""
    if state.hasTimedOut:
        state.remove()
        return
    process, offset, value = state.get if state.exists else (None, None, None)
    rows, latest = [], 0
    for s in pd.concat(list(batches)).sort_values("scrape_offset_ns").itertuples(index=False):
        latest = max(latest, int(s.seen_at.timestamp() * 1000))
        if process is not None:
            if s.process_start_id != process:
                status = "RESTART"
            elif s.scrape_offset_ns <= offset:
                status = "REORDERED"
            elif s.value < value:
                status = "RESET"
            else:
                status = "OK"
            delta = s.value - value if status == "OK" else None
            rows.append((*key, int(s.scrape_offset_ns), status, delta))
            if status == "REORDERED":
                continue
        process, offset, value = s.process_start_id, int(s.scrape_offset_ns), float(s.value)
    state.update((process, offset, value))
    state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + SILENT_MS)
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in DELTAS.split(", ")])
    frame["delta"] = frame["delta"].astype("float64")
    yield frame


def live_counter_deltas(samples: DataFrame, delay: str = "1 hour") -> DataFrame:
    """``samples``: slot, metric, label_set, process_start_id, scrape_offset_ns, value, seen_at."""
    return watermarked(samples, "seen_at", delay).groupBy("slot", "metric", "label_set").applyInPandasWithState(
        follow_counter, DELTAS, DELTA_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
