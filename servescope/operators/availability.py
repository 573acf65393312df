"""Which metrics a request has, population eligibility, per-restart descriptions, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servescope.functions.keys import request_key
from servescope.operators.order_statistics import exact_percentiles
from servescope.operators.sliced import SlicedOrder

SERVER_METRICS = (
    "server_ttft", "server_generation_time", "server_queue_time", "server_mean_itl",
    "server_tokens_per_second",
)
CLIENT_METRICS = ("client_generation_tpot", "token_observation_itl")
ALL_METRICS = (*SERVER_METRICS, *CLIENT_METRICS)


def metric_availability(requests: DataFrame) -> DataFrame:
    """``<metric>_available`` per request; a metric may be used exactly where it is available."""
    return requests.select(
        "request_id", "repetition",
        *[F.col(m).isNotNull().alias(f"{m}_available") for m in ALL_METRICS],
    )


def availability_summary(available: DataFrame) -> DataFrame:
    """Counts per repetition and over everything (null repetition); eligible only if complete."""
    counts = [F.count(F.lit(1)).alias("total")]
    counts += [F.count_if(F.col(f"{m}_available")).alias(f"{m}_count") for m in ALL_METRICS]
    grouped = available.groupingSets([["repetition"], []], "repetition").agg(*counts)
    for m in ALL_METRICS:
        grouped = grouped.withColumn(f"{m}_allowed", F.col(f"{m}_count") == F.col("total"))
    return grouped


def describe_by_restart(samples: DataFrame) -> DataFrame:
    """p50 and p95 with n per metric and restart. The sample is too small for a p99: none is given."""
    return exact_percentiles(samples, ["metric", "repetition"], "value", {"p50": 0.50, "p95": 0.95})


def memory_stability(
    samples: DataFrame,
    expected: int = 5,
    spacing_ns: int = 200_000_000,
    floor_bytes: int = 67_108_864,
) -> DataFrame:
    """Five samples, spaced, whose range stays within max(ceil(1 % of the first), 64 MiB)."""
    stepped = SlicedOrder(["run_id"], ["observation_ns"]).previous(samples, {"__at": "observation_ns"})
    grouped = stepped.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("samples"),
        F.min(F.col("observation_ns") - F.col("__at")).alias("smallest_gap_ns"),
        F.min_by("allocated_bytes", "observation_ns").alias("first_bytes"),
        (F.max("allocated_bytes") - F.min("allocated_bytes")).alias("range_bytes"),
    )
    tolerance = F.greatest(F.expr("(first_bytes + 99) div 100"), F.lit(floor_bytes))
    return grouped.withColumn("tolerance_bytes", tolerance).withColumn(
        "stable",
        (F.col("samples") == expected)
        & F.coalesce(F.col("smallest_gap_ns") >= spacing_ns, F.lit(False))
        & (F.col("range_bytes") <= F.col("tolerance_bytes")),
    )


def usage_reconciliation(requests: DataFrame, token_events: DataFrame) -> DataFrame:
    """Prompt ids echoed, output ids rebuilt from the events, and usage adding up.

    The ids of one request are bounded by its output limit, so they fit one row.
    """
    key = request_key(requests)
    streamed = token_events.groupBy(*key).agg(
        F.flatten(
            F.transform(
                F.sort_array(F.collect_list(F.struct("chunk_index", "token_ids"))),
                lambda e: e["token_ids"],
            )
        ).alias("streamed_ids")
    )
    joined = requests.join(streamed, key, "left").withColumn(
        "streamed_ids", F.coalesce("streamed_ids", F.array().cast("array<bigint>"))
    )
    names = {
        "PROMPT_IDS_DIFFER": "NOT sent_prompt <=> returned_prompt",
        "OUTPUT_IDS_DIFFER": "NOT streamed_ids <=> final_ids",
        "USAGE_DOES_NOT_ADD_UP": "NOT prompt_tokens + completion_tokens <=> total_tokens",
        "LOCAL_PROMPT_COUNT_DIFFERS_FROM_SERVER_USAGE": "local_prompt_count <> prompt_tokens",
        "LOCAL_OUTPUT_COUNT_DIFFERS_FROM_SERVER_USAGE": "local_output_count <> completion_tokens",
    }
    listed = F.filter(
        F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in names.items()]), lambda x: x.isNotNull()
    )
    return joined.select(
        *key, F.size("streamed_ids").cast("long").alias("streamed_tokens"),
        F.array_join(listed, ",").alias("disagreements"),
    )
