"""Cancellation verdict: one feature row per probe, then one ordered chain of conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from servescope.operators.sliced import SlicedOrder
from servescope.operators.telemetry import COOLDOWN_NS, STABLE_NS, STEP_NS

COUNTERS = (
    "prompt_tokens", "generation_tokens", "preemptions", "prefix_queries", "prefix_hits",
    "success_abort", "success_length", "success_stop", "success_error", "success_repetition",
)
OTHER_REASONS = ("success_length", "success_stop", "success_error", "success_repetition")
AUXILIARY = ("preemptions", "prefix_queries", "prefix_hits")
DRAIN_LIMIT_NS = 10_000_000_000


def probe_features(observations: DataFrame) -> DataFrame:
    """Fold the scrapes of a probe in the order they were retained: phase by phase, by ordinal.

    Columns: probe_id, phase, phase_rank, phase_ordinal, scheduled_ns, dispatched_ns, completed_ns,
    process_id, running, waiting and one column per counter.
    """
    phase = F.col("phase")
    order = SlicedOrder(["probe_id"], ["phase_rank", "phase_ordinal"])
    before = (*COUNTERS, "phase", "scheduled_ns", "completed_ns")
    seen = order.previous(observations, {f"__{c}": c for c in before})

    def steps(test) -> Column:
        column = F.lit(True)
        for c in COUNTERS:
            column = column & test(F.col(c) - F.col(f"__{c}"))
        return column

    never_back = F.coalesce(steps(lambda x: x >= 0), F.lit(True))
    unchanged = F.coalesce(steps(lambda x: x == 0), F.lit(True))
    in_pre = (phase == "PRE_DISPATCH") & (F.col("phase_ordinal") > 0)
    settled = (F.col("phase_rank") >= 2) & ~((phase == "STABLE_GENERATION") & (F.col("phase_ordinal") == 0))
    scheduled_gap = F.when(F.col("__phase") == phase, F.col("scheduled_ns") - F.col("__scheduled_ns"))
    completed_gap = F.when(F.col("__phase") == phase, F.col("completed_ns") - F.col("__completed_ns"))
    loose = phase.isin("PRE_DISPATCH", "DRAIN")
    exact = phase.isin("STABLE_GENERATION", "COOLDOWN")
    spaced = (
        F.when(loose, (scheduled_gap >= STEP_NS) & (completed_gap >= STEP_NS)).when(exact, scheduled_gap == STEP_NS)
    )
    in_time = (
        (F.col("scheduled_ns") <= F.col("dispatched_ns"))
        & (F.col("dispatched_ns") <= F.col("completed_ns"))
        & F.coalesce(F.col("__completed_ns") <= F.col("completed_ns"), F.lit(True))
    )

    def edge(name: str, first: bool, column: str) -> Column:
        pick = F.min_by if first else F.max_by
        return pick(column, F.when(phase == name, F.col("phase_ordinal")))

    last_rank = F.struct("phase_rank", "phase_ordinal")
    baseline = {c: edge("PRE_DISPATCH", False, c) for c in COUNTERS}
    return seen.groupBy("probe_id").agg(
        F.count_if(phase == "PRE_DISPATCH").alias("pre_count"),
        F.count_if(phase == "DRAIN").alias("drain_count"),
        F.min("process_id").alias("lowest_process"),
        F.max("process_id").alias("highest_process"),
        F.bool_and(in_time).alias("in_time"),
        F.coalesce(F.bool_and(spaced), F.lit(True)).alias("spaced"),
        F.bool_and((F.col("running") == 0) & (F.col("waiting") == 0)).alias("quiescent"),
        F.bool_and(never_back).alias("never_back"),
        F.coalesce(F.bool_and(F.when(in_pre, unchanged)), F.lit(True)).alias("pre_stable"),
        F.coalesce(F.bool_and(F.when(settled, unchanged)), F.lit(True)).alias("later_stable"),
        edge("PRE_DISPATCH", False, "completed_ns").alias("pre_last_ns"),
        edge("DRAIN", True, "completed_ns").alias("drain_first_ns"),
        *[edge(p, first, c).alias(f"{name}_{c}")
          for p, first, name in (("DRAIN", False, "drain_last"), ("STABLE_GENERATION", True, "stable_first"),
                                 ("STABLE_GENERATION", False, "stable_last"), ("COOLDOWN", True, "cooldown_first"))
          for c in ("scheduled_ns", "dispatched_ns", "completed_ns")],
        edge("COOLDOWN", False, "completed_ns").alias("cooldown_last_ns"),
        F.min(F.when(phase == "LATER", F.col("completed_ns"))).alias("later_first_ns"),
        F.max("completed_ns").alias("last_retained_ns"),
        *[(F.max_by(c, last_rank) - baseline[c]).alias(f"retained_{c}") for c in COUNTERS],
        *[(edge("COOLDOWN", False, c) - baseline[c]).alias(f"delta_{c}") for c in COUNTERS],
    )


def classify_cancellation(
    probes: DataFrame, observations: DataFrame, expected_prompt_delta: int = 64
) -> DataFrame:
    """The verdict of every probe.

    ``probes``: probe_id, external_id, body_id, item_id, delivery_id, received_ns, added_ns,
    internal_abort_ns, external_abort_ns, correlated, dispatch_ns, first_delivery_ns, close_ns,
    server_process, residual_ns, residual_requests, residual_processes.
    """
    facts = probes.join(probe_features(observations), "probe_id", "left")

    def known(condition: str) -> Column:
        return F.coalesce(F.expr(condition), F.lit(False))

    others_zero = " AND ".join(f"retained_{c} = 0" for c in OTHER_REASONS)
    deltas_zero = " AND ".join(f"delta_{c} = 0" for c in OTHER_REASONS)
    shared = " AND ".join(
        f"{a}_{c} = {b}_{c}"
        for a, b in (("stable_first", "drain_last"), ("cooldown_first", "stable_last"))
        for c in ("scheduled_ns", "dispatched_ns", "completed_ns")
    )
    auxiliary_zero = " AND ".join(f"delta_{c} = 0" for c in AUXILIARY)
    verdict = (
        F.when(~known("body_id = concat('cmpl-', external_id) AND item_id = concat('cmpl-', external_id, '-0')"),
               "ID_CORRELATION_FAILURE")
        .when(F.expr("external_abort_ns IS NULL OR internal_abort_ns IS NULL"), "UNKNOWN_ACKNOWLEDGEMENT")
        .when(~known("correlated AND delivery_id = external_id"), "ID_CORRELATION_FAILURE")
        .when(~known("dispatch_ns < first_delivery_ns AND first_delivery_ns <= close_ns"), "TERMINAL_UNKNOWN")
        .when(
            ~known("dispatch_ns <= received_ns AND received_ns <= added_ns AND added_ns <= first_delivery_ns"
                   " AND close_ns <= internal_abort_ns AND internal_abort_ns <= external_abort_ns"),
            "TERMINAL_UNKNOWN")
        .when(~known("pre_count = 10 AND drain_count = 10"), "RESIDUAL_WORK_TIMEOUT")
        .when(~known("lowest_process = server_process AND highest_process = server_process"),
              "RESIDUAL_WORK_TIMEOUT")
        .when(~known("in_time"), "RESIDUAL_WORK_TIMEOUT")
        .when(~known("spaced AND pre_last_ns < dispatch_ns"), "RESIDUAL_WORK_TIMEOUT")
        .when(~known("quiescent"), "RESIDUAL_WORK_TIMEOUT")
        .when(
            ~known(f"drain_first_ns >= close_ns AND external_abort_ns <= drain_first_ns AND {shared}"
                   f" AND stable_last_completed_ns - stable_first_completed_ns >= {STABLE_NS}"
                   f" AND cooldown_last_ns - cooldown_first_completed_ns >= {COOLDOWN_NS}"
                   f" AND cooldown_last_ns - close_ns <= {DRAIN_LIMIT_NS}"
                   " AND external_abort_ns <= cooldown_last_ns"
                   " AND coalesce(later_first_ns > cooldown_last_ns, true)"),
            "RESIDUAL_WORK_TIMEOUT")
        .when(~known("never_back AND pre_stable"), "RESIDUAL_WORK_TIMEOUT")
        .when(~known(f"retained_success_abort IN (0, 1) AND {others_zero}"), "LATER_COMPLETION")
        .when(~known("later_stable"), "RESIDUAL_WORK_TIMEOUT")
        .when(~known(f"delta_success_abort IN (0, 1) AND {deltas_zero}"), "LATER_COMPLETION")
        .when(
            ~known(f"delta_prompt_tokens = {expected_prompt_delta} AND delta_generation_tokens >= 1 AND {auxiliary_zero}"),
            "RESIDUAL_WORK_TIMEOUT")
        .when(
            ~known("residual_ns >= last_retained_ns AND residual_requests = 0 AND residual_processes = 0"),
            "RESIDUAL_WORK_TIMEOUT")
        .otherwise("SERVER_ABORT_ACKNOWLEDGED_AND_DRAINED")
    )
    accepted = verdict == "SERVER_ABORT_ACKNOWLEDGED_AND_DRAINED"
    return facts.select(
        "probe_id", verdict.alias("classification"), accepted.alias("accepted"),
        F.when(accepted, F.col("delta_generation_tokens")).alias("generation_delta"),
        F.when(accepted, F.col("delta_success_abort")).alias("abort_delta"),
    )
