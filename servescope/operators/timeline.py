"""Concurrency, contiguity, order, as-of and range joins over clocks and sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servescope.operators.sliced import HOT_ROWS, SLICE_ROWS, SlicedOrder


def concurrency_by_sequence(
    lifecycle: DataFrame, hot_rows: int = HOT_ROWS, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Peak active requests per run over ordered START / END events, warmup included.

    ``lifecycle``: run_id, sequence, request_id, kind. Broken evidence becomes counts, not an error.
    """
    delta = F.expr(
        "CASE kind WHEN 'CLIENT_REQUEST_STARTED' THEN 1L WHEN 'CLIENT_REQUEST_ENDED' THEN -1L ELSE 0L END"
    )
    active = SlicedOrder(["run_id"], ["sequence"], hot_rows, slice_rows).running_sum(lifecycle, delta, "active")
    peak = active.groupBy("run_id").agg(
        F.max("active").alias("max_concurrency"), F.min("active").alias("lowest_active")
    )
    per_request = (
        lifecycle.where("kind IN ('CLIENT_REQUEST_STARTED', 'CLIENT_REQUEST_ENDED')")
        .groupBy("run_id", "request_id")
        .agg(
            F.count_if(F.expr("kind = 'CLIENT_REQUEST_STARTED'")).alias("starts"),
            F.count_if(F.expr("kind = 'CLIENT_REQUEST_ENDED'")).alias("ends"),
            F.min(F.expr("CASE WHEN kind = 'CLIENT_REQUEST_STARTED' THEN sequence END")).alias("s"),
            F.max(F.expr("CASE WHEN kind = 'CLIENT_REQUEST_ENDED' THEN sequence END")).alias("e"),
        )
        .groupBy("run_id")
        .agg(
            F.count_if(F.expr("starts > 1")).alias("duplicate_starts"),
            F.count_if(F.expr("ends > 1 OR (ends = 1 AND (starts = 0 OR e < s))")).alias(
                "unmatched_ends"
            ),
            F.count_if(F.expr("starts > 0 AND ends = 0")).alias("unfinished"),
        )
    )
    return peak.join(per_request, "run_id", "left")


def concurrency_by_interval(
    requests: DataFrame, hot_rows: int = HOT_ROWS, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Peak over half-open [dispatch, terminal) intervals; at equal times terminals come first.

    Also whether two requests ever overlapped for a positive time.
    """
    marks = (
        requests.select(
            "run_id",
            F.explode(
                F.array(
                    F.struct(F.col("dispatch_ns").alias("at"), F.lit(1).alias("d")),
                    F.struct(F.col("terminal_ns").alias("at"), F.lit(-1).alias("d")),
                )
            ).alias("m"),
        )
        .groupBy("run_id", F.col("m.at").alias("at"))
        .agg(F.sum("m.d").alias("d"))
    )
    # terminals of an instant precede its dispatches, so the count after the instant is its peak
    order = SlicedOrder(["run_id"], ["at"], hot_rows, slice_rows)
    active = order.running_sum(marks, F.col("d"), "active")
    # every mark but the last of a run is followed by a positive-length piece at this count
    return active.groupBy("run_id").agg(
        F.max("active").alias("max_concurrency"),
        (F.max("active") >= 2).alias("positive_overlap"),
    )


def sequence_report(rows: DataFrame, keys: Sequence[str], sequence: str, first: int = 0) -> DataFrame:
    """Per key: is ``sequence`` exactly first..first+n-1? Aggregation only, so hot keys are fine."""
    return (
        rows.groupBy(*keys, sequence)
        .agg(F.count(F.lit(1)).alias("copies"))
        .groupBy(*keys)
        .agg(
            F.sum("copies").alias("row_count"),
            F.count(F.lit(1)).alias("distinct_count"),
            F.min(sequence).alias("lowest"),
            F.max(sequence).alias("highest"),
        )
        .withColumn("duplicates", F.col("row_count") - F.col("distinct_count"))
        .withColumn("missing", F.col("highest") - F.lit(first) + 1 - F.col("distinct_count"))
        .withColumn(
            "contiguous",
            (F.col("lowest") == first) & (F.col("duplicates") == 0) & (F.col("missing") == 0),
        )
    )


def out_of_order(ordered: SlicedOrder, rows: DataFrame, offset: str) -> DataFrame:
    """Rows whose offset is not strictly after the offset of the row before."""
    seen = ordered.previous(rows, {"previous_offset": offset})
    return seen.where(F.col("previous_offset") >= F.col(offset))


def as_of_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_at: str,
    right_at: str,
    hot_rows: int = HOT_ROWS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Each left row with the latest right row of its key at or before it (null if none).

    Union of both sides and "last right row so far"; at equal times the right row sorts first.
    """
    r = right.select(
        F.col(key),
        F.col(right_at).alias("__at"),
        F.lit(0).alias("__side"),
        F.lit(None).cast(left.drop(key).select(F.struct("*")).schema[0].dataType).alias("__left"),
        F.struct(*[c for c in right.columns if c != key]).alias("__right"),
    )
    lf = left.select(
        F.col(key),
        F.col(left_at).alias("__at"),
        F.lit(1).alias("__side"),
        F.struct(*[c for c in left.columns if c != key]).alias("__left"),
        F.lit(None).cast(right.drop(key).select(F.struct("*")).schema[0].dataType).alias("__right"),
    )
    order = SlicedOrder([key], ["__at", "__side"], hot_rows, slice_rows)
    matched = order.last_known(r.unionByName(lf), F.col("__right"), "__match")
    return matched.where("__side = 1").select(key, "__left.*", "__match.*")


def inside_phase(requests: DataFrame, phases: DataFrame) -> DataFrame:
    """Range check of every request against the interval of its own phase (equi join, then bounds)."""
    joined = requests.join(phases, ["run_id", "phase_name"], "left")
    inside = (F.col("dispatch_ns") >= F.col("started_ns")) & (F.col("terminal_ns") <= F.col("ended_ns"))
    return joined.withColumn("inside", F.coalesce(inside, F.lit(False)))
