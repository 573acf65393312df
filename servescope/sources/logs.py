"""Server log lines with ordinals, byte offsets and hashes; identity correlation over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servescope.operators.sliced import HOT_ROWS, SLICE_ROWS, SlicedOrder

# Fixed patterns: the four log lines that tie the ids of one request together.
ITEM = r"cmpl-([A-Za-z0-9._-]+)-0"
RECEIVED = rf"\bReceived request {ITEM}:"
ADDED = rf"\bAdded request {ITEM}-([0-9a-f]{{8}})\."
EXTERNAL_ABORT = rf"\bRequest {ITEM} aborted\."
INTERNAL_ABORT = rf"\bAborted request\(s\) {ITEM}-([0-9a-f]{{8}})\."


def retain_records(
    lines: DataFrame, stream: str = "source_stream_id", hot_rows: int = HOT_ROWS, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Byte interval and hash of each line; lines are separated by one byte.

    The byte position is a running sum along the stream.
    """
    sized = lines.withColumn("__size", F.octet_length("raw_record").cast("long"))
    ended = SlicedOrder([stream], ["record_ordinal"], hot_rows, slice_rows).running_sum(
        sized, F.col("__size") + 1, "__next"
    )
    return (
        ended.withColumn("byte_end", F.col("__next") - 1)
        .withColumn("byte_start", F.col("__next") - 1 - F.col("__size"))
        .withColumn("raw_record_sha256", F.sha2("raw_record", 256))
        .drop("__size", "__next")
    )


def split_log_text(files: DataFrame, stream: str = "source_stream_id") -> DataFrame:
    """Whole log texts to (stream, ordinal, line)."""
    return files.select(stream, F.posexplode(F.split("content", "\n")).alias("o", "raw_record")).select(
        stream, F.col("o").cast("long").alias("record_ordinal"), "raw_record"
    )


def byte_gaps(records: DataFrame, stream: str = "source_stream_id") -> DataFrame:
    """Records that do not start one byte after the one before, or whose size or hash is wrong."""
    seen = SlicedOrder([stream], ["record_ordinal"]).previous(
        records, {"__end": "byte_end", "__at": "observation_offset_ns"}
    )
    reason = (
        F.when(F.col("byte_end") - F.col("byte_start") != F.octet_length("raw_record"), "SIZE_DIFFERS")
        .when(F.sha2("raw_record", 256) != F.col("raw_record_sha256"), "HASH_DIFFERS")
        .when(F.col("__end").isNull() & (F.col("byte_start") != 0), "FIRST_NOT_AT_ZERO")
        .when(F.col("__end") + 1 != F.col("byte_start"), "NOT_CONTIGUOUS")
        .when(F.col("__at") > F.col("observation_offset_ns"), "CLOCK_WENT_BACK")
    )
    return seen.withColumn("violation", reason).where("violation IS NOT NULL").drop("__end", "__at")


def tagged_lines(records: DataFrame) -> DataFrame:
    """``kind, external_id, internal_id`` of the lines that carry a request id."""
    record = F.col("raw_record")
    kind = (
        F.when(record.rlike(RECEIVED), "RECEIVED")
        .when(record.rlike(ADDED), "ADDED")
        .when(record.rlike(INTERNAL_ABORT), "INTERNAL_ABORT")
        .when(record.rlike(EXTERNAL_ABORT), "EXTERNAL_ABORT")
    )
    # most lines name no request and meet no pattern
    tagged = records.where(F.contains(record, F.lit("cmpl-"))).withColumn("kind", kind).where("kind IS NOT NULL")
    patterns = {"RECEIVED": RECEIVED, "ADDED": ADDED, "INTERNAL_ABORT": INTERNAL_ABORT,
                "EXTERNAL_ABORT": EXTERNAL_ABORT}
    external = F.coalesce(
        *[F.when(F.col("kind") == k, F.regexp_extract("raw_record", p, 1)) for k, p in patterns.items()]
    )
    internal = F.coalesce(
        *[F.when(F.col("kind") == k, F.regexp_extract("raw_record", patterns[k], 2))
          for k in ("ADDED", "INTERNAL_ABORT")]
    )
    return tagged.withColumn("external_id", external).withColumn("suffix", internal)


def correlate(records: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request: one Received, one Added, both abort lines iff cancelled, ids and order agreeing.

    ``requests``: external_id, cancelled, and run_id if the records have it: ids repeat from run to
    run. An id in the log that no request has is a row of its own, FOREIGN_REQUEST_ID.
    """
    tagged = tagged_lines(records)
    runs = "run_id" in records.columns and "run_id" in requests.columns
    key = ["run_id", "external_id"] if runs else ["external_id"]

    def at(kind: str):
        return F.min(F.when(F.col("kind") == kind, F.struct("observation_offset_ns", "record_ordinal")))

    lines = tagged.groupBy(*key).agg(
        *[
            F.count_if(F.col("kind") == k).alias(k.lower())
            for k in ("RECEIVED", "ADDED", "EXTERNAL_ABORT", "INTERNAL_ABORT")
        ],
        F.count_distinct("suffix").alias("suffixes"),
        F.max(F.when(F.col("kind") == "ADDED", F.col("suffix"))).alias("suffix"),
        F.count_distinct("source_stream_id").alias("streams"),
        at("RECEIVED").alias("t1"), at("ADDED").alias("t2"),
        at("INTERNAL_ABORT").alias("t3"), at("EXTERNAL_ABORT").alias("t4"),
    )
    joined = requests.withColumn("__wanted", F.lit(True)).join(lines, key, "full_outer").fillna(
        0, ["received", "added", "external_abort", "internal_abort", "suffixes"]
    )
    one_each = (F.col("external_abort") == 1) & (F.col("internal_abort") == 1)
    ordered = (
        F.coalesce(F.col("t1") < F.col("t2"), F.lit(True))
        & F.coalesce(F.col("t2") < F.col("t3"), F.lit(True))
        & F.coalesce(F.col("t3") < F.col("t4"), F.lit(True))
    )
    status = (
        F.when(F.col("__wanted").isNull(), "FOREIGN_REQUEST_ID")
        .when(F.col("received") != 1, "RECEIVED_MISSING_OR_AMBIGUOUS")
        .when(F.col("added") != 1, "ADDED_MISSING_OR_AMBIGUOUS")
        .when(F.col("suffixes") > 1, "FOREIGN_INTERNAL_ID")
        .when(F.col("cancelled") & ~one_each, "ABORT_LINES_MISSING")
        .when(~F.col("cancelled") & (F.col("external_abort") + F.col("internal_abort") > 0), "UNEXPECTED_ABORT")
        .when(F.col("streams") > 1, "SEVERAL_STREAMS")
        .when(~ordered, "OUT_OF_ORDER")
        .otherwise("OK")
    )
    return joined.select(
        *key, status.alias("status"),
        F.concat(F.lit("cmpl-"), "external_id", F.lit("-0-"), "suffix").alias("internal_id"),
        F.col("t1.observation_offset_ns").alias("received_ns"),
        F.col("t2.observation_offset_ns").alias("added_ns"),
        F.col("t3.observation_offset_ns").alias("internal_abort_ns"),
        F.col("t4.observation_offset_ns").alias("external_abort_ns"),
    )
