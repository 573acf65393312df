"""Run-to-run comparison: field compatibility, sample minimums, metric deltas, semantic checks.

Runs are compared along a table of pairs (``baseline``, ``candidate``); nothing is cross joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def struct_path(df: DataFrame, path: str) -> Column:
    """A dotted field of a policy as a column, checked against the schema while planning."""
    level: T.DataType = df.schema
    for part in path.split("."):
        if not isinstance(level, T.StructType) or part not in level.fieldNames():
            raise ValueError(f"unknown comparison field: {path}")
        level = level[part].dataType
    return F.col(path)


def display(df: DataFrame, path: str) -> Column:
    """How a field is shown in a mismatch: text as it is, nested values as JSON."""
    column = struct_path(df, path)
    kind = df.select(column).schema[0].dataType
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(column, {"ignoreNullFields": "false"})
    return column.cast("string")


def compatibility(
    runs: DataFrame, pairs: DataFrame, required: Sequence[str], allowed: Sequence[str]
) -> DataFrame:
    """One row per pair and differing field, with both values and whether it may differ."""
    fields = [(f, False) for f in required] + [(f, True) for f in allowed]
    values = runs.select(
        "run_id",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(f).alias("field"),
                        display(runs, f).alias("value"),
                        F.lit(ok).alias("allowed"),
                    )
                    for f, ok in fields
                ]
            )
        ).alias("v"),
    ).select("run_id", "v.*")
    left = values.select(
        F.col("run_id").alias("baseline"), "field", "allowed", F.col("value").alias("baseline_value")
    )
    right = values.select(
        F.col("run_id").alias("candidate"), "field", F.col("value").alias("candidate_value")
    )
    return (
        pairs.select("baseline", "candidate")
        .join(left, "baseline")
        .join(right, ["candidate", "field"])
        .where(~F.col("baseline_value").eqNullSafe(F.col("candidate_value")))
        .select("baseline", "candidate", "field", "baseline_value", "candidate_value", "allowed")
    )


def policy_mismatches(runs: DataFrame, policies: DataFrame) -> DataFrame:
    """What a policy pins about its two runs: stored self-hashes, their identities, the SLO policy.

    ``runs``: run_id, content_sha256 (stored), recomputed_sha256, slo_policy_sha256.
    ``policies``: baseline, candidate, baseline_sha256, candidate_sha256, slo_policy_sha256.
    None of these may differ.
    """
    side = runs.select("run_id", "content_sha256", "recomputed_sha256", F.col("slo_policy_sha256").alias("slo"))
    joined = policies
    for name in ("baseline", "candidate"):
        joined = joined.join(
            side.select(F.col("run_id").alias(name), F.struct("content_sha256", "recomputed_sha256", "slo").alias(name[0])),
            name,
        )
    checks = []
    for name in ("baseline", "candidate"):
        r = name[0]
        valid = F.col(f"{r}.content_sha256").eqNullSafe(F.col(f"{r}.recomputed_sha256"))
        checks += [
            (f"{name}_artifact_content_hash_valid", F.lit("true"), valid.cast("string")),
            (f"{name}_artifact_sha256", F.col(f"{name}_sha256"), F.col(f"{r}.content_sha256")),
            (f"{name}_slo_policy_sha256", F.col("slo_policy_sha256"), F.col(f"{r}.slo")),
        ]
    rows = F.array(*[
        F.struct(F.lit(f).alias("field"), a.alias("expected"), b.alias("found")) for f, a, b in checks
    ])
    return (
        joined.select("baseline", "candidate", F.explode(rows).alias("m"))
        .select("baseline", "candidate", "m.*")
        .where(~F.col("expected").eqNullSafe(F.col("found")))
        .withColumn("allowed", F.lit(False))
    )


def sample_minimum(
    summaries: DataFrame, metrics: Sequence[str], successes: int, samples: int
) -> DataFrame:
    """Enough successful requests, and enough samples in every distribution."""
    enough = F.col("successful") >= successes
    for metric in metrics:
        enough = enough & (F.coalesce(F.col(f"{metric}_count"), F.lit(0)) >= samples)
    return summaries.select("run_id", enough.alias("sample_minimum_met"))


def comparison_report(
    pairs: DataFrame,
    mismatches: DataFrame,
    minimums: DataFrame,
    summaries: DataFrame,
    *,
    failures_invalidate: bool,
) -> DataFrame:
    """Per pair: mismatch counts, sample minimums, and whether deltas may be taken at all."""
    found = mismatches.groupBy("baseline", "candidate").agg(
        F.count(F.lit(1)).alias("mismatches"),
        F.count_if(~F.col("allowed")).alias("forbidden"),
    )
    side = minimums.join(summaries.select("run_id", "failed"), "run_id")
    report = (
        pairs.select("baseline", "candidate")
        .join(side.select(F.col("run_id").alias("baseline"),
                          F.col("sample_minimum_met").alias("baseline_samples_met"),
                          F.col("failed").alias("__bf")), "baseline")
        .join(side.select(F.col("run_id").alias("candidate"),
                          F.col("sample_minimum_met").alias("candidate_samples_met"),
                          F.col("failed").alias("__cf")), "candidate")
        .join(found, ["baseline", "candidate"], "left")
        .fillna(0, ["mismatches", "forbidden"])
    )
    failing = F.lit(failures_invalidate) & (F.col("__bf") + F.col("__cf") > 0)
    return report.select(
        "baseline", "candidate",
        (F.col("mismatches") + failing.cast("long")).alias("mismatches"),
        "baseline_samples_met", "candidate_samples_met",
        ((F.col("forbidden") == 0) & ~failing & F.col("baseline_samples_met")
         & F.col("candidate_samples_met")).alias("compatible"),
    )


SCALARS = ("successful_request_throughput", "goodput", "failure_rate", "timeout_rate")
METRICS = ("ttft", "end_to_end", "tpot", "itl")


def metric_deltas(summaries: DataFrame, report: DataFrame) -> DataFrame:
    """Absolute and relative change per metric, only for compatible pairs.

    The gate is applied before the joins; a metric that is null on either side has no row.
    """
    names = [*SCALARS, *[f"{m}_{p}" for m in METRICS for p in ("p50", "p95", "p99")]]
    long = summaries.select(
        "run_id",
        F.explode(
            F.array(
                *[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"))
                  for n in names]
            )
        ).alias("m"),
    ).select("run_id", "m.metric", "m.value").where("value IS NOT NULL")
    gated = report.where("compatible").select("baseline", "candidate")
    left = long.select(F.col("run_id").alias("baseline"), "metric",
                       F.col("value").alias("baseline_value"))
    right = long.select(F.col("run_id").alias("candidate"), "metric",
                        F.col("value").alias("candidate_value"))
    change = F.col("candidate_value") - F.col("baseline_value")
    return (
        gated.join(left, "baseline")
        .join(right, ["candidate", "metric"])
        .withColumn("absolute_delta", change)
        .withColumn("relative_delta", F.try_divide(change, F.col("baseline_value")))
        .select("baseline", "candidate", "metric", "baseline_value", "candidate_value",
                "absolute_delta", "relative_delta")
    )


def taxonomy_differences(requests: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs whose ordered (case, phase, class, failure kind) lists differ.

    Request by request on its position, so no run is ever gathered into one list.
    """
    view = requests.select(
        "run_id", "request_index",
        F.struct("case_id", "phase", "terminal_class", "failure_kind").alias("taxon"),
    )
    left = pairs.join(view.withColumnRenamed("run_id", "baseline"), "baseline").withColumnRenamed(
        "taxon", "lt")
    right = pairs.join(view.withColumnRenamed("run_id", "candidate"), "candidate").withColumnRenamed(
        "taxon", "rt")
    both = left.join(right, ["baseline", "candidate", "request_index"], "full_outer")
    return both.groupBy("baseline", "candidate").agg(
        F.count_if(~F.col("lt").eqNullSafe(F.col("rt"))).alias("taxonomy_differences")
    )


def semantic_checks(
    runs: DataFrame, requests: DataFrame, pairs: DataFrame,
    inputs: Sequence[str], compatibility_fields: Sequence[str],
) -> DataFrame:
    """The eight named checks of a repeat pair; the policy passes when all do.

    ``runs`` carries the identities, ``semantic_fingerprint`` and the disjoint counts.
    """
    left = runs.select(F.col("run_id").alias("baseline"), F.struct(*runs.columns).alias("l"))
    right = runs.select(F.col("run_id").alias("candidate"), F.struct(*runs.columns).alias("r"))
    joined = (
        pairs.select("baseline", "candidate").join(left, "baseline").join(right, "candidate")
        .join(taxonomy_differences(requests, pairs), ["baseline", "candidate"], "left")
    )

    def same(fields: Sequence[str]) -> Column:
        column = F.lit(True)
        for f in fields:
            column = column & F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}"))
        return column

    checks = {
        "input-identities-match": same(inputs),
        "compatibility-fields-match": same(compatibility_fields),
        "semantic-fingerprints-match": same(["semantic_fingerprint"]),
        "attempted-count-unchanged": same(["attempted"]),
        "successful-count-unchanged": same(["successful"]),
        "failure-count-not-increased": F.col("r.failed") <= F.col("l.failed"),
        "timeout-count-not-increased": F.col("r.timed_out") <= F.col("l.timed_out"),
        "terminal-taxonomy-unchanged": F.coalesce("taxonomy_differences", F.lit(0)) == 0,
    }
    return joined.select(
        "baseline", "candidate",
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("check"), c.alias("passed")) for n, c in checks.items()])
        ).alias("c"),
    ).select("baseline", "candidate", "c.check", "c.passed")


def policy_passed(checks: DataFrame) -> DataFrame:
    return checks.groupBy("baseline", "candidate").agg(F.bool_and("passed").alias("policy_passed"))


RESTART_FIELDS = (
    "sent_prompt", "returned_prompt", "output_ids", "finish_reason", "prompt_tokens",
    "completion_tokens", "total_tokens", "output_text_sha256",
)
NONREPRODUCTION = "INVALID_SEMANTIC_NONREPRODUCTION"


def compare_restarts(
    records: DataFrame, fields: Sequence[str] = RESTART_FIELDS, restarts: Sequence[int] = (1, 2, 3)
) -> DataFrame:
    """Per case: do the later restarts say exactly what the first one said?"""
    value = F.struct(*fields)
    sides = [
        F.max(F.when(F.col("repetition_index") == i, value)).alias(f"r{i}") for i in restarts
    ]
    grouped = records.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_distinct("repetition_index").alias("repetitions"),
        F.coalesce(F.bool_or("replacement_run"), F.lit(False)).alias("replaced"),
        F.count_if(~F.col("repetition_index").isin(*restarts)).alias("foreign"),
        *sides,
    )
    first = restarts[0]
    differing = F.filter(
        F.array(
            *[
                F.when(
                    ~F.col(f"r{i}.{f}").eqNullSafe(F.col(f"r{first}.{f}")), F.lit(f"restart-{i}:{f}")
                )
                for i in restarts[1:]
                for f in fields
            ]
        ),
        lambda x: x.isNotNull(),
    )
    n = len(restarts)
    whole = (F.col("records") == n) & (F.col("repetitions") == n) & (F.col("foreign") == 0)
    status = (
        F.when(F.col("replaced"), "REPLACEMENT_RESTART")
        .when(~whole, "RESTARTS_INCOMPLETE")
        .when(F.size(differing) > 0, NONREPRODUCTION)
        .otherwise("COMMITTED")
    )
    return grouped.select(
        "case_id", status.alias("state"),
        F.when(status == NONREPRODUCTION, F.array_join(differing, ",")).alias("mismatches"),
    )


def experiment_state(comparisons: DataFrame, expected: DataFrame) -> DataFrame:
    """Per experiment: every expected case compared and equal, or which case ids are not.

    ``expected``: experiment, case_id. The list of bad ids is bounded by the declared case set.
    """
    joined = expected.join(comparisons, "case_id", "left")
    bad = F.when(F.col("state") == NONREPRODUCTION, F.col("case_id"))
    return joined.groupBy("experiment").agg(
        F.count(F.lit(1)).alias("expected_cases"),
        F.count_if(F.col("state").isin("COMMITTED", NONREPRODUCTION)).alias("compared_cases"),
        F.count_if(F.col("state") == NONREPRODUCTION).alias("invalid_cases"),
        F.array_join(F.array_sort(F.collect_set(bad)).cast("array<string>"), ",").alias("invalid_case_ids"),
    ).withColumn(
        "state",
        F.when(F.col("compared_cases") < F.col("expected_cases"), "INCOMPLETE")
        .when(F.col("invalid_cases") > 0, NONREPRODUCTION)
        .otherwise("COMMITTED"),
    )


def detached_records(
    records: DataFrame, evidence: DataFrame, fields: Sequence[str] = RESTART_FIELDS
) -> DataFrame:
    """Comparison records that no longer say what their request evidence says."""
    r = records.select("repetition_index", "case_id", F.struct(*fields).alias("r"))
    e = evidence.select("repetition_index", "case_id", F.struct(*fields).alias("e"))
    joined = r.join(e, ["repetition_index", "case_id"], "left")
    differing = F.filter(
        F.array(*[F.when(~F.col(f"r.{f}").eqNullSafe(F.col(f"e.{f}")), F.lit(f)) for f in fields]),
        lambda x: x.isNotNull(),
    )
    return joined.select(
        "repetition_index", "case_id",
        F.when(F.col("e").isNull(), "NO_EVIDENCE").otherwise(F.array_join(differing, ",")).alias("detached"),
    ).where("detached <> ''")
