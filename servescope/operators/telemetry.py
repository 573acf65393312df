"""Selection, deltas, progression and cadence of scraped counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servescope.functions.rules import check_rules
from servescope.operators.sliced import SlicedOrder
from servescope.sources.scrapes import label_text


def series(samples: DataFrame) -> DataFrame:
    """One row per (scrape, metric, exact label set) with how often it occurs."""
    good = samples.where("violation IS NULL").withColumn("label_set", label_text())
    return good.groupBy("scrape_id", "metric", "label_set").agg(
        F.count(F.lit(1)).alias("matches"), F.max("value").alias("value")
    )


def exact_series(scrapes: DataFrame, samples: DataFrame, wanted: Sequence[tuple[str, str]]) -> DataFrame:
    """Each wanted (metric, label set) in each scrape: there once, absent, or ambiguous."""
    grid = scrapes.select(
        "scrape_id",
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(ls).alias("label_set")) for m, ls in wanted])
        ).alias("w"),
    ).select("scrape_id", "w.*")
    found = grid.join(series(samples), ["scrape_id", "metric", "label_set"], "left")
    status = (
        F.when(F.col("matches").isNull(), "ABSENT").when(F.col("matches") > 1, "DUPLICATE").otherwise("OK")
    )
    return found.select(
        "scrape_id", "metric", "label_set", status.alias("status"),
        F.when(status == "OK", F.col("value")).alias("value"),
    )


def quiescent_scrapes(scrapes: DataFrame, samples: DataFrame, gauges: Sequence[tuple[str, str]]) -> DataFrame:
    """Nothing running, nothing waiting; an absent gauge is not quiescence."""
    picked = exact_series(scrapes, samples, gauges)
    return picked.groupBy("scrape_id").agg(
        F.bool_and((F.col("status") == "OK") & F.coalesce(F.col("value") == 0, F.lit(False))).alias("quiescent")
    )


def label_inventory(samples: DataFrame) -> DataFrame:
    """Metric to its sorted label sets per scrape, duplicates kept; bounded by one scrape's text."""
    good = samples.where("violation IS NULL").withColumn("label_set", label_text())
    return good.groupBy("scrape_id", "metric").agg(
        F.array_join(F.array_sort(F.collect_list("label_set")), " | ").alias("label_sets")
    )


def scrape_pairs(scrapes: DataFrame, slot: str = "slot") -> DataFrame:
    """Every scrape of a slot with the one before it."""
    seen = SlicedOrder([slot], ["scrape_offset_ns"]).previous(
        scrapes.select(slot, "scrape_id", "scrape_offset_ns", "process_start_id"),
        {"before_id": "scrape_id", "before_ns": "scrape_offset_ns", "before_process": "process_start_id"},
    )
    return seen.where("before_id IS NOT NULL").select(
        "before_id", "before_ns", "before_process",
        F.col("scrape_id").alias("after_id"), F.col("scrape_offset_ns").alias("after_ns"),
        F.col("process_start_id").alias("after_process"),
    )


def counter_deltas(pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """Change of every series between two scrapes, or why there is none."""
    found = series(samples)
    inventory = label_inventory(samples)
    sides = pairs.select(
        "before_id", "after_id",
        F.explode(F.array(F.struct(F.col("before_id").alias("scrape_id"), F.lit("b").alias("side")),
                          F.struct(F.col("after_id").alias("scrape_id"), F.lit("a").alias("side")))).alias("s"),
    ).select("before_id", "after_id", "s.*")
    values = sides.join(found, "scrape_id").groupBy("before_id", "after_id", "metric", "label_set").agg(
        *[
            F.max(F.when(F.col("side") == side, F.col(column))).alias(name)
            for side, column, name in (
                ("b", "matches", "bn"), ("a", "matches", "an"),
                ("b", "value", "before"), ("a", "value", "after"),
            )
        ]
    )
    families = sides.join(inventory, "scrape_id").groupBy("before_id", "after_id", "metric").agg(
        F.max(F.when(F.col("side") == "b", F.col("label_sets"))).alias("bi"),
        F.max(F.when(F.col("side") == "a", F.col("label_sets"))).alias("ai"),
    )
    joined = values.join(families, ["before_id", "after_id", "metric"]).join(
        pairs, ["before_id", "after_id"]
    )
    status = (
        F.when(F.col("before_process") != F.col("after_process"), "RESTART")
        .when(F.col("after_ns") <= F.col("before_ns"), "REORDERED")
        .when(~F.col("bi").eqNullSafe(F.col("ai")), "LABEL_DRIFT")
        .when((F.coalesce("bn", F.lit(0)) != 1) | (F.coalesce("an", F.lit(0)) != 1), "ABSENT")
        .when(F.col("after") < F.col("before"), "RESET")
        .otherwise("OK")
    )
    return joined.select(
        "before_id", "after_id", "metric", "label_set", status.alias("status"),
        F.when(status == "OK", F.col("after") - F.col("before")).alias("delta"),
    )


def window_deltas(
    pairs: DataFrame, deltas: DataFrame, expected: Sequence[tuple[str, str, float]]
) -> DataFrame:
    """Measured deltas against the declared table; extra or missing series are named.

    The expectation is a constant of the policy, laid beside each window rather than joined.
    """
    grid = pairs.select(
        "before_id", "after_id",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), F.lit(ls).alias("label_set"),
                             F.lit(float(v)).alias("expected"))
                    for m, ls, v in expected
                ]
            )
        ).alias("e"),
    ).select("before_id", "after_id", "e.*")
    both = grid.join(deltas, ["before_id", "after_id", "metric", "label_set"], "full_outer")
    verdict = (
        F.when(F.col("expected").isNull(), "EXTRA")
        .when(F.col("status").isNull(), "MISSING")
        .when(F.col("status") != "OK", F.col("status"))
        .when(F.col("delta") == F.col("expected"), "MATCH")
        .otherwise("DIFFERS")
    )
    return both.select("before_id", "after_id", "metric", "label_set", "expected", "delta",
                       verdict.alias("verdict"))


def counter_progression(scrapes: DataFrame, samples: DataFrame) -> DataFrame:
    """Per process and series: never decreasing, never changing, and over how many scrapes."""
    stamped = series(samples).where("matches = 1").join(
        scrapes.select("scrape_id", "process_start_id", "scrape_offset_ns"), "scrape_id"
    )
    keys = ["process_start_id", "metric", "label_set"]
    seen = SlicedOrder(keys, ["scrape_offset_ns"]).previous(stamped, {"__before": "value"})
    step = F.col("value") - F.col("__before")
    return seen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("scrapes"),
        F.coalesce(F.bool_and(step >= 0), F.lit(True)).alias("progresses"),
        F.coalesce(F.bool_and(step == 0), F.lit(True)).alias("stable"),
        (F.max_by("value", "scrape_offset_ns") - F.min_by("value", "scrape_offset_ns")).alias("net_change"),
    )


def scrape_cadence(observations: DataFrame) -> DataFrame:
    """Spacing of the scheduled and completed times per probe and phase."""
    keys = ["probe_id", "phase"]
    seen = SlicedOrder(keys, ["scheduled_ns", "phase_ordinal"]).previous(
        observations, {"__s": "scheduled_ns", "__c": "completed_ns"}
    )
    return seen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("scrapes"),
        F.min(F.col("scheduled_ns") - F.col("__s")).alias("smallest_scheduled_gap_ns"),
        F.max(F.col("scheduled_ns") - F.col("__s")).alias("largest_scheduled_gap_ns"),
        F.min(F.col("completed_ns") - F.col("__c")).alias("smallest_completed_gap_ns"),
        (F.max("completed_ns") - F.min("completed_ns")).alias("total_ns"),
    )


# Spacing and span each probe phase has to keep.
STEP_NS = 100_000_000
STABLE_NS = 1_000_000_000
COOLDOWN_NS = 2_000_000_000


def cadence_verdict(cadence: DataFrame) -> DataFrame:
    """Before dispatch and while draining at least 100 ms apart; then exactly 100 ms, long enough."""
    spaced = (F.col("smallest_scheduled_gap_ns") >= STEP_NS) & (F.col("smallest_completed_gap_ns") >= STEP_NS)
    exact = (F.col("smallest_scheduled_gap_ns") == STEP_NS) & (F.col("largest_scheduled_gap_ns") == STEP_NS)
    ok = (
        F.when(F.col("phase").isin("PRE_DISPATCH", "DRAIN"), (F.col("scrapes") == 10) & spaced)
        .when(F.col("phase") == "STABLE_GENERATION", exact & (F.col("total_ns") >= STABLE_NS))
        .when(F.col("phase") == "COOLDOWN", exact & (F.col("total_ns") >= COOLDOWN_NS))
        .otherwise(True)
    )
    return cadence.withColumn("cadence_ok", F.coalesce(ok, F.lit(False)))


def scrape_chronology(observations: DataFrame) -> DataFrame:
    """Observations with scheduled > dispatched > completed, or completed before the one before."""
    seen = SlicedOrder(["probe_id"], ["scheduled_ns", "phase_rank", "phase_ordinal"]).previous(
        observations, {"__c": "completed_ns"}
    )
    reason = (
        F.when(F.col("dispatched_ns") < F.col("scheduled_ns"), "DISPATCHED_BEFORE_SCHEDULED")
        .when(F.col("completed_ns") < F.col("dispatched_ns"), "COMPLETED_BEFORE_DISPATCHED")
        .when(F.col("__c") > F.col("completed_ns"), "COMPLETION_WENT_BACK")
    )
    return seen.withColumn("violation", reason).where("violation IS NOT NULL").drop("__c")


def phase_order(phases: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per run: phases present once and in order, not overlapping, of positive length, passed."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("phase")) - 1
    seen = SlicedOrder(["run_id"], ["started_ns", "ended_ns"]).previous(
        phases.withColumn("__place", place), {"__end": "ended_ns", "__before": "__place"}
    )
    return seen.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("phases"),
        (F.lit(len(names)) - F.count_distinct(F.when(F.col("__place") >= 0, F.col("__place")))).alias("missing"),
        F.count_if(F.col("__place") < 0).alias("unknown"),
        F.count_if(F.col("__before") >= F.col("__place")).alias("out_of_order"),
        F.count_if(F.col("__end") > F.col("started_ns")).alias("overlaps"),
        F.count_if(F.col("ended_ns") <= F.col("started_ns")).alias("not_positive"),
        F.count_if(~F.col("passed")).alias("not_passed"),
    )


# The seventeen phases of one runtime repetition, in order.
RUNTIME_PHASES = (
    "LIVE_RESOURCE_AUDIT", "ENVIRONMENT_LOCK_VERIFICATION", "OFFLINE_SNAPSHOT_VERIFICATION",
    "RUNTIME_PROCESS_START", "MODEL_WEIGHT_LOAD", "ENGINE_READINESS_HEALTH", "JIT_COMPILATION_STATE",
    "CUDA_GRAPH_STATE", "ALLOCATOR_KV_STABILIZATION", "EXCLUDED_STABILIZATION_REQUESTS",
    "EXCLUDED_SHAPE_WARMUPS", "CANCELLATION_PROBE_DRAIN", "STEADY_STATE_GATE", "MEASURED_WINDOW",
    "FINAL_METRICS_DRAIN", "SHUTDOWN", "NO_RESIDUAL_PROCESS_VERIFICATION",
)


# Fixed value: how far a scrape may lie from the gate it stands for.
GATE_DISTANCE_NS = 1_000_000_000
# name: predicate over one measured window and its two scrapes
SCRAPE_PLACEMENT = {
    "process-changed": "baseline_process = final_process",
    "baseline-before-phase": "phase_start_ns <= baseline_ns",
    "baseline-after-dispatch": "baseline_ns < first_dispatch_ns",
    "window-inverted": "first_dispatch_ns <= last_terminal_ns",
    "terminal-after-phase": "last_terminal_ns <= phase_end_ns",
    "drain-inside-phase": "phase_end_ns < drain_ns",
    "final-before-drain": "drain_ns <= final_ns",
    "baseline-stale": f"first_dispatch_ns - baseline_ns <= {GATE_DISTANCE_NS}",
    "final-stale": f"final_ns - drain_ns <= {GATE_DISTANCE_NS}",
    "baseline-missing": "baseline_ns IS NOT NULL",
    "final-missing": "final_ns IS NOT NULL",
}


def measured_window(requests: DataFrame) -> DataFrame:
    """First dispatch and last terminal of each run's measured requests."""
    return requests.where("phase = 'MEASURED'").groupBy("run_id").agg(
        F.min("dispatch_ns").alias("first_dispatch_ns"), F.max("terminal_ns").alias("last_terminal_ns")
    )


def scrape_placement(windows: DataFrame) -> DataFrame:
    """Phase start, baseline scrape, dispatches, terminals, phase end, drain, final scrape, in order."""
    return check_rules(windows, SCRAPE_PLACEMENT)


def identity_chain(requests: DataFrame, responses: DataFrame, correlated: DataFrame) -> DataFrame:
    """Header id, body id, serving item and internal id of one request, joined on derived ids."""
    run = ["run_id"] if all("run_id" in df.columns for df in (requests, responses, correlated)) else []
    joined = (
        requests.withColumn("body_id", F.concat(F.lit("cmpl-"), "external_id"))
        .join(responses, [*run, "body_id"], "left")
        .join(correlated.select(*run, "external_id", "internal_id"), [*run, "external_id"], "left")
    )
    item = F.concat("body_id", F.lit("-0"))
    status = (
        F.when(F.col("header_id").isNull(), "RESPONSE_MISSING")
        .when(F.col("header_id") != F.col("external_id"), "HEADER_ID_DIFFERS")
        .when(F.col("item_id") != item, "ITEM_ID_DIFFERS")
        .when(F.col("internal_id").isNull(), "INTERNAL_ID_MISSING")
        .when(~F.col("internal_id").rlike("-0-[0-9a-f]{8}$")
              | ~F.startswith("internal_id", F.concat(item, F.lit("-"))), "INTERNAL_ID_DIFFERS")
        .otherwise("OK")
    )
    return joined.select(*run, "external_id", "internal_id", status.alias("status"))
