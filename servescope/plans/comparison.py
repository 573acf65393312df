"""Queries that compare runs, restarts and repetitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from servescope.functions.scalars import content_identity
from servescope.operators import availability as av
from servescope.operators import compare as cp
from servescope.operators import request_metrics as rm
from servescope.operators import run_summary as rs
from servescope.operators.sliced import SlicedOrder
from servescope.plans import tables as t
from servescope.plans.metrics import _COUNTS1, _M, _SAMPLES1, _SEC, _WINDOW, OK, _wide
from servescope.session import cut
from servescope.plans.oracle import by_user, percentile_sql, sql

USER = "user_id"
REQUIRED = (
    "workload_identity.content_sha256", "workload_identity.case_ids", "model_identity.model_id",
    "configuration.sampling", "configuration.prompt_transformation", "hardware_identity",
)
ALLOWED = ("runtime_identity",)


def runs(s, d):
    """One run per user, with nested identities that repeat every few users."""
    return t.requests(s, d, USER).groupBy("run_id").agg(F.max("n").alias("n")).selectExpr(
        "run_id",
        """named_struct('content_sha256', sha2(CAST(run_id % 3 AS STRING), 256),
             'case_ids', array(concat('case-', run_id % 2), 'case-9')) AS workload_identity""",
        "named_struct('model_id', concat('model-', run_id div 8 % 2)) AS model_identity",
        """named_struct('sampling', named_struct('seed', run_id % 4 div 2, 'max_tokens', 32L),
             'prompt_transformation', CASE WHEN run_id % 13 = 0 THEN NULL ELSE 'none' END) AS configuration""",
        "concat('hw-', run_id % 6 div 5) AS hardware_identity",
        "concat('rt-', run_id % 7) AS runtime_identity")


def pairs(s, d):
    """Each run against the run six users on (same workload, mostly the same model)."""
    r = t.requests(s, d, USER).select("run_id").distinct()
    ahead = r.select((F.col("run_id") - 12).alias("baseline"), F.col("run_id").alias("candidate"))
    return ahead.join(r.select(F.col("run_id").alias("baseline")), "baseline")


def run_compatibility(s, d):
    return cp.compatibility(runs(s, d), pairs(s, d), REQUIRED, ALLOWED)


def policy_mismatches(s, d):
    """Runs with a stored identity over their counts; every 7th was changed after it was hashed."""
    counted = rs.counts_v2(t.requests(s, d, USER))
    fields = ["run_id", "attempted", "successful"]
    stored = counted.withColumn("content_sha256", content_identity(counted, fields)).withColumn(
        "successful", F.expr("successful + CASE WHEN run_id % 7 = 0 THEN 1 ELSE 0 END"))
    known = stored.withColumn("recomputed_sha256", content_identity(stored, fields)).withColumn(
        "slo_policy_sha256", F.expr("CASE WHEN run_id % 11 = 0 THEN 'other' ELSE 'slo' END"))
    pinned = known.select(F.col("run_id"), F.expr("CASE WHEN run_id % 13 = 0 THEN 'old' ELSE content_sha256 END").alias("h"))
    policies = pairs(s, d).join(pinned.selectExpr("run_id AS baseline", "h AS baseline_sha256"), "baseline").join(
        pinned.selectExpr("run_id AS candidate", "h AS candidate_sha256"), "candidate").withColumn("slo_policy_sha256", F.lit("slo"))
    return cp.policy_mismatches(known, policies)


def _summaries(s, d):
    return rs.run_summary_v1(cut(t.requests(s, d, USER)))


def _report(s, d, summaries, failures_invalidate=False):
    return cp.comparison_report(
        pairs(s, d), run_compatibility(s, d),
        cp.sample_minimum(summaries, cp.METRICS, 2, 1), summaries,
        failures_invalidate=failures_invalidate)


def sample_minimum(s, d):
    return cp.sample_minimum(_summaries(s, d), cp.METRICS, 3, 1)


def comparison_report(s, d):
    return _report(s, d, cut(_summaries(s, d)))


def comparison_report_strict(s, d):
    """A failure on either side is a mismatch and forbids the comparison."""
    return _report(s, d, cut(_summaries(s, d)), failures_invalidate=True)


def metric_deltas(s, d):
    summaries = cut(_summaries(s, d))
    return cp.metric_deltas(summaries, _report(s, d, summaries))


def semantic_checks(s, d):
    requests = t.requests(s, d, USER).withColumn("request_index", F.col("blk")).withColumn(
        "failure_kind", F.expr("CASE WHEN terminal_class <> 'SUCCESS' THEN terminal_class END"))
    known = rs.counts_v2(requests).withColumn("semantic_fingerprint", F.expr("run_id % 5")).withColumn(
        "workload_sha256", F.expr("run_id % 3")).withColumn("runtime", F.expr("run_id % 4"))
    return cp.semantic_checks(known, requests, pairs(s, d), ["workload_sha256"], ["runtime"])


def restart_records(s, d):
    """Case = the same block of three neighbouring users; each user is one repetition of it."""
    first = t.block_events(s, d).groupBy("user_id", "blk").agg(
        F.max("n").alias("n"),
        F.max(F.expr("CASE WHEN pos = n - 1 THEN event_type END")).alias("last_type"),
        F.sort_array(F.collect_list(F.struct("pos", "toks", "event_type"))).alias("e"))
    return first.selectExpr(
        "user_id div 3 * 1000000 + blk AS case_id", "user_id % 3 + 1 AS repetition_index", "user_id", "n",
        "array(n) AS sent_prompt", "array(n + CASE WHEN user_id % 17 = 0 THEN 1 ELSE 0 END) AS returned_prompt",
        "transform(slice(e, 2, 1), x -> x.toks) AS output_ids",
        "CASE WHEN last_type = 'error' THEN 'error' ELSE 'length' END AS finish_reason",
        "n AS prompt_tokens", "coalesce(get(e, 1).toks, 0L) AS completion_tokens", "n + coalesce(get(e, 1).toks, 0L) AS total_tokens",
        "sha2(CASE WHEN get(e, 1).event_type = 'purchase' THEN 'p' ELSE 'x' END, 256) AS output_text_sha256",
        "user_id % 71 = 0 AS replacement_run")


def restart_compare(s, d):
    return cp.compare_restarts(restart_records(s, d).where("user_id % 50 <> 7"))


def experiment_state(s, d):
    expected = t.requests(s, d).selectExpr("user_id div 3 * 1000000 + blk AS case_id").distinct().selectExpr(
        "case_id div 1000000 AS experiment", "case_id")
    return cp.experiment_state(restart_compare(s, d), expected)


def semantic_detached(s, d):
    evidence = restart_records(s, d)
    records = evidence.selectExpr(
        "case_id", "repetition_index", "sent_prompt", "returned_prompt", "output_ids",
        "CASE WHEN user_id % 11 = 0 THEN 'stop' ELSE finish_reason END AS finish_reason", "prompt_tokens",
        "completion_tokens + CASE WHEN user_id % 13 = 0 THEN 1 ELSE 0 END AS completion_tokens",
        "total_tokens", "output_text_sha256")
    return cp.detached_records(records, evidence.where("user_id % 19 <> 0"))


def _server_metrics(s, d):
    requests = t.requests(s, d)
    gaps = rm.output_gaps_v3(requests).select("request_id", "itl_mean_ns")
    return requests.join(gaps, "request_id", "left").withColumn("tpot_v3_ns", rm.tpot_v3()).selectExpr(
        "request_id", "repetition", "CASE WHEN user_id % 7 <> 0 THEN first_token_ns - dispatch_ns END AS server_ttft",
        "CASE WHEN output_tokens > 0 THEN terminal_ns - first_token_ns END AS server_generation_time",
        "dispatch_ns AS server_queue_time",
        "CASE WHEN token_events >= 2 THEN last_token_ns - first_token_ns END AS server_mean_itl",
        "try_divide(1D, output_tokens) AS server_tokens_per_second",
        "tpot_v3_ns AS client_generation_tpot", "itl_mean_ns AS token_observation_itl")


def metric_availability(s, d):
    return av.metric_availability(_server_metrics(s, d))


def availability_summary(s, d):
    return av.availability_summary(av.metric_availability(_server_metrics(s, d)))


def restart_descriptive(s, d):
    m = rs.measured(t.requests(s, d)).withColumn("ttft", rm.ttft()).withColumn("e2e", rm.end_to_end())
    samples = m.selectExpr("repetition", "stack(2, 'ttft', ttft, 'end_to_end', e2e) AS (metric, value)")
    return av.describe_by_restart(cut(samples))


def memory_stability(s, d):
    ranked = SlicedOrder(["user_id"], ["off_ns", "event_id"]).rank(t.clocked_events(s, d), "rn")
    samples = ranked.where("NOT (user_id % 10 = 3 AND rn % 7 = 5)").selectExpr(
        "user_id * 1000000 + (rn - 1) div 5 AS run_id", "off_ns AS observation_ns",
        "CAST(round(value * 1000000) AS BIGINT) AS allocated_bytes")
    return av.memory_stability(samples)


def usage_reconciliation(s, d):
    tokens = t.block_events(s, d).where("token_bearing").selectExpr(
        "run_id", "request_id", "pos AS chunk_index", "transform(sequence(1L, toks), i -> event_id * 10 + i) AS token_ids", "event_id")
    final = tokens.where("event_id % 41 <> 0").groupBy("run_id", "request_id").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "token_ids"))),
                              lambda x: x["token_ids"])).alias("final_ids"))
    requests = t.requests(s, d).join(final, ["run_id", "request_id"], "left").selectExpr(
        "run_id", "request_id", "array(dispatch_ns) AS sent_prompt",
        "array(dispatch_ns + CASE WHEN user_id % 31 = 0 THEN 1 ELSE 0 END) AS returned_prompt",
        "coalesce(final_ids, CAST(array() AS ARRAY<BIGINT>)) AS final_ids", "n AS prompt_tokens",
        "output_tokens AS completion_tokens", "n + output_tokens + CASE WHEN user_id % 23 = 0 THEN 1 ELSE 0 END AS total_tokens",
        "CASE WHEN user_id % 5 = 0 THEN n + blk % 2 END AS local_prompt_count",
        "CASE WHEN user_id % 3 = 0 THEN token_events END AS local_output_count")
    return av.usage_reconciliation(requests, tokens)


QUERIES = {
    "run_compatibility": run_compatibility,
    "policy_mismatches": policy_mismatches,
    "sample_minimum": sample_minimum,
    "comparison_report": comparison_report,
    "comparison_report_strict": comparison_report_strict,
    "metric_deltas": metric_deltas,
    "semantic_checks": semantic_checks,
    "restart_compare": restart_compare,
    "experiment_state": experiment_state,
    "semantic_detached": semantic_detached,
    "metric_availability": metric_availability,
    "availability_summary": availability_summary,
    "restart_descriptive": restart_descriptive,
    "memory_stability": memory_stability,
    "usage_reconciliation": usage_reconciliation,
}

_PAIRS = """pairs AS (SELECT a.run_id AS baseline, b.run_id AS candidate FROM (SELECT DISTINCT run_id FROM req) a
    JOIN (SELECT DISTINCT run_id FROM req) b ON b.run_id = a.run_id + 12)"""

_MISM = """fv AS (SELECT run_id, unnest([
      {'f': 'workload_identity.content_sha256', 'v': sha256(CAST(run_id % 3 AS VARCHAR)), 'ok': false},
      {'f': 'workload_identity.case_ids', 'v': '["case-' || (run_id % 2) || '","case-9"]', 'ok': false},
      {'f': 'model_identity.model_id', 'v': 'model-' || (run_id // 8 % 2), 'ok': false},
      {'f': 'configuration.sampling', 'v': '{"seed":' || (run_id % 4 // 2) || ',"max_tokens":32}', 'ok': false},
      {'f': 'configuration.prompt_transformation', 'v': CASE WHEN run_id % 13 = 0 THEN NULL ELSE 'none' END, 'ok': false},
      {'f': 'hardware_identity', 'v': 'hw-' || (run_id % 6 // 5), 'ok': false},
      {'f': 'runtime_identity', 'v': 'rt-' || (run_id % 7), 'ok': true}]) AS x FROM (SELECT DISTINCT run_id FROM req)),
    mism AS (SELECT baseline, candidate, l.x.f AS field, l.x.v AS baseline_value, r.x.v AS candidate_value, l.x.ok AS allowed
      FROM pairs JOIN fv l ON l.run_id = baseline JOIN fv r ON r.run_id = candidate AND r.x.f = l.x.f
      WHERE l.x.v IS DISTINCT FROM r.x.v)"""

_SUMMARY1 = f"""{_SAMPLES1},
    wide AS (SELECT run_id, {_wide('TTFT_NS', 'ttft')}, {_wide('END_TO_END_SUCCESS_NS', 'end_to_end')},
      {_wide('TPOT_NS', 'tpot')}, {_wide('ITL_NS', 'itl')} FROM dist GROUP BY run_id),
    base AS (SELECT run_id, {_COUNTS1},
      count(*) {_M} AND {OK}) / {_SEC} AS successful_request_throughput,
      count(*) {_M} AND slo_satisfied) / {_SEC} AS goodput,
      coalesce(count(*) {_M} AND outcome <> 'SUCCESS') / nullif(count(*) {_M}), 0), 0) AS failure_rate,
      coalesce(count(*) {_M} AND outcome = 'TIMEOUT') / nullif(count(*) {_M}), 0), 0) AS timeout_rate
      FROM req GROUP BY run_id HAVING count(*) {_M}) > 0),
    summ AS (SELECT base.*, wide.* EXCLUDE (run_id) FROM base LEFT JOIN wide ON wide.run_id = base.run_id)"""

_REPORT = f"""{_PAIRS}, {_MISM}, {_SUMMARY1},
    ok1 AS (SELECT run_id, successful >= 2 AND coalesce(ttft_count, 0) >= 1 AND coalesce(end_to_end_count, 0) >= 1
      AND coalesce(tpot_count, 0) >= 1 AND coalesce(itl_count, 0) >= 1 AS ok, failed FROM summ),
    report AS (SELECT p.baseline, p.candidate, coalesce(m.n, 0) AS mismatches, a.ok AS baseline_samples_met,
      b.ok AS candidate_samples_met, coalesce(m.bad, 0) = 0 AND a.ok AND b.ok AS compatible, a.failed + b.failed > 0 AS failing
      FROM pairs p JOIN ok1 a ON a.run_id = p.baseline JOIN ok1 b ON b.run_id = p.candidate
      LEFT JOIN (SELECT baseline, candidate, count(*) AS n, count(*) FILTER (WHERE NOT allowed) AS bad
        FROM mism GROUP BY ALL) m ON m.baseline = p.baseline AND m.candidate = p.candidate)"""

_LONG = "SELECT run_id, unnest([" + ", ".join(
    f"{{'m': '{n}', 'v': CAST({n} AS DOUBLE)}}"
    for n in [*cp.SCALARS, *[f"{m}_{p}" for m in cp.METRICS for p in ("p50", "p95", "p99")]]
) + "]) AS x FROM summ"

_RESTARTS = """rec AS (SELECT user_id, user_id // 3 * 1000000 + blk AS case_id, user_id % 3 + 1 AS rep, max(n) AS n,
      max(toks) FILTER (WHERE pos = 1) AS t0, coalesce(max(toks) FILTER (WHERE pos = 1), 0) AS t1, coalesce(max(event_type) FILTER (WHERE pos = 1) = 'purchase', false) AS p1,
      CASE WHEN max(event_type) FILTER (WHERE pos = n - 1) = 'error' THEN 'error' ELSE 'length' END AS fin,
      n + CASE WHEN user_id % 17 = 0 THEN 1 ELSE 0 END AS ret
    FROM be GROUP BY user_id, blk, n)"""

_DIFF = ", ".join(
    f"CASE WHEN r{i}.{c} IS DISTINCT FROM r1.{c} THEN 'restart-{i}:{f}' END"
    for i in (2, 3)
    for f, c in (("sent_prompt", "n"), ("returned_prompt", "ret"), ("output_ids", "t0"), ("finish_reason", "fin"),
                 ("prompt_tokens", "n"), ("completion_tokens", "t1"), ("total_tokens", "tot"), ("output_text_sha256", "p1"))
)
_COMPARED = f"""{_RESTARTS}, kept AS (SELECT *, n + t1 AS tot FROM rec WHERE user_id % 50 <> 7),
    compared AS (SELECT g.case_id, CASE WHEN replaced THEN 'REPLACEMENT_RESTART' WHEN c <> 3 THEN 'RESTARTS_INCOMPLETE'
        WHEN len(diffs) > 0 THEN 'INVALID_SEMANTIC_NONREPRODUCTION' ELSE 'COMMITTED' END AS state,
        CASE WHEN NOT replaced AND c = 3 AND len(diffs) > 0 THEN array_to_string(diffs, ',') END AS mismatches
      FROM (SELECT case_id, count(*) AS c, bool_or(user_id % 71 = 0) AS replaced FROM kept GROUP BY case_id) g
      LEFT JOIN (SELECT r1.case_id, [x FOR x IN [{_DIFF}] IF x IS NOT NULL] AS diffs
        FROM kept r1 JOIN kept r2 ON r2.case_id = r1.case_id AND r2.rep = 2
        JOIN kept r3 ON r3.case_id = r1.case_id AND r3.rep = 3 WHERE r1.rep = 1) x ON x.case_id = g.case_id)"""

_AVAIL = """av AS (SELECT r.request_id, repetition, user_id % 7 <> 0 AND first_token_ns IS NOT NULL AS server_ttft_available,
      output_tokens > 0 AS server_generation_time_available, true AS server_queue_time_available,
      token_events >= 2 AS server_mean_itl_available, output_tokens > 0 AS server_tokens_per_second_available,
      max_event_tokens <= 1 AND output_tokens >= 2 AS client_generation_tpot_available,
      max_event_tokens = 1 AND token_events >= 2 AS token_observation_itl_available FROM req r)"""

ORACLES = {
    "policy_mismatches": by_user(sql("req", f"""WITH {_PAIRS}, c AS (SELECT run_id,
          sha256('{{"attempted":' || count(*) {_M}) || ',"run_id":' || run_id || ',"successful":' || count(*) {_M} AND {OK}) || '}}') AS sha
          FROM req GROUP BY run_id),
        m AS (SELECT baseline, candidate, unnest([
          {{'f': 'baseline_artifact_content_hash_valid', 'e': 'true', 'v': CASE WHEN baseline % 7 = 0 THEN 'false' ELSE 'true' END}},
          {{'f': 'candidate_artifact_content_hash_valid', 'e': 'true', 'v': CASE WHEN candidate % 7 = 0 THEN 'false' ELSE 'true' END}},
          {{'f': 'baseline_artifact_sha256', 'e': CASE WHEN baseline % 13 = 0 THEN 'old' ELSE b.sha END, 'v': b.sha}},
          {{'f': 'candidate_artifact_sha256', 'e': CASE WHEN candidate % 13 = 0 THEN 'old' ELSE k.sha END, 'v': k.sha}},
          {{'f': 'baseline_slo_policy_sha256', 'e': 'slo', 'v': CASE WHEN baseline % 11 = 0 THEN 'other' ELSE 'slo' END}},
          {{'f': 'candidate_slo_policy_sha256', 'e': 'slo', 'v': CASE WHEN candidate % 11 = 0 THEN 'other' ELSE 'slo' END}}]) AS x
          FROM pairs JOIN c b ON b.run_id = baseline JOIN c k ON k.run_id = candidate)
        SELECT baseline, candidate, x.f AS field, x.e AS expected, x.v AS found, false AS allowed FROM m WHERE x.e <> x.v""")),
    "run_compatibility": by_user(sql("req", f"WITH {_PAIRS}, {_MISM} SELECT * FROM mism")),
    "sample_minimum": by_user(sql("req tev", f"""WITH {_SUMMARY1}
        SELECT run_id, successful >= 3 AND coalesce(ttft_count, 0) >= 1 AND coalesce(end_to_end_count, 0) >= 1
          AND coalesce(tpot_count, 0) >= 1 AND coalesce(itl_count, 0) >= 1 AS sample_minimum_met FROM summ""")),
    "comparison_report": by_user(sql("req tev", f"WITH {_REPORT} SELECT * EXCLUDE (failing) FROM report")),
    "comparison_report_strict": by_user(sql("req tev", f"""WITH {_REPORT} SELECT baseline, candidate, mismatches + CASE WHEN failing THEN 1 ELSE 0 END AS mismatches,
        baseline_samples_met, candidate_samples_met, compatible AND NOT failing AS compatible FROM report""")),
    "metric_deltas": by_user(sql("req tev", f"""WITH {_REPORT}, long AS ({_LONG})
        SELECT baseline, candidate, l.x.m AS metric, l.x.v AS baseline_value, r.x.v AS candidate_value,
          r.x.v - l.x.v AS absolute_delta, CASE WHEN l.x.v <> 0 THEN (r.x.v - l.x.v) / l.x.v END AS relative_delta
        FROM report JOIN long l ON l.run_id = baseline JOIN long r ON r.run_id = candidate AND r.x.m = l.x.m
        WHERE compatible AND l.x.v IS NOT NULL AND r.x.v IS NOT NULL""")),
    "semantic_checks": by_user(sql("req", f"""WITH {_PAIRS}, c AS (SELECT run_id, count(*) {_M}) AS attempted,
          count(*) {_M} AND {OK}) AS ok, count(*) {_M} AND terminal_class = 'FAILED') AS failed,
          count(*) {_M} AND terminal_class = 'TIMEOUT') AS timed_out,
          string_agg(case_id || phase || terminal_class, ',' ORDER BY blk) AS taxonomy
          FROM req GROUP BY run_id)
        SELECT baseline, candidate, x.c AS "check", x.p AS passed FROM (SELECT baseline, candidate, unnest([
          {{'c': 'input-identities-match', 'p': baseline % 3 = candidate % 3}},
          {{'c': 'compatibility-fields-match', 'p': baseline % 4 = candidate % 4}},
          {{'c': 'semantic-fingerprints-match', 'p': baseline % 5 = candidate % 5}},
          {{'c': 'attempted-count-unchanged', 'p': l.attempted = r.attempted}},
          {{'c': 'successful-count-unchanged', 'p': l.ok = r.ok}},
          {{'c': 'failure-count-not-increased', 'p': r.failed <= l.failed}},
          {{'c': 'timeout-count-not-increased', 'p': r.timed_out <= l.timed_out}},
          {{'c': 'terminal-taxonomy-unchanged', 'p': l.taxonomy = r.taxonomy}}]) AS x
        FROM pairs JOIN c l ON l.run_id = baseline JOIN c r ON r.run_id = candidate)""")),
    "restart_compare": sql("be", f"WITH {_COMPARED} SELECT * FROM compared"),
    "experiment_state": sql("be", f"""WITH {_COMPARED}
        SELECT e.case_id // 1000000 AS experiment, count(*) AS expected_cases,
          count(*) FILTER (WHERE state IN ('COMMITTED', 'INVALID_SEMANTIC_NONREPRODUCTION')) AS compared_cases,
          count(*) FILTER (WHERE state = 'INVALID_SEMANTIC_NONREPRODUCTION') AS invalid_cases,
          coalesce(string_agg(CAST(e.case_id AS VARCHAR), ',' ORDER BY e.case_id)
            FILTER (WHERE state = 'INVALID_SEMANTIC_NONREPRODUCTION'), '') AS invalid_case_ids,
          CASE WHEN count(*) FILTER (WHERE state IN ('COMMITTED', 'INVALID_SEMANTIC_NONREPRODUCTION')) < count(*) THEN 'INCOMPLETE'
               WHEN count(*) FILTER (WHERE state = 'INVALID_SEMANTIC_NONREPRODUCTION') > 0
                 THEN 'INVALID_SEMANTIC_NONREPRODUCTION' ELSE 'COMMITTED' END AS state
        FROM (SELECT DISTINCT user_id // 3 * 1000000 + blk AS case_id FROM be) e LEFT JOIN compared c ON c.case_id = e.case_id
        GROUP BY e.case_id // 1000000"""),
    "semantic_detached": sql("be", f"""WITH {_RESTARTS} SELECT rep AS repetition_index, case_id,
        CASE WHEN user_id % 19 = 0 THEN 'NO_EVIDENCE' WHEN user_id % 11 = 0 AND user_id % 13 = 0
               THEN 'finish_reason,completion_tokens'
             WHEN user_id % 11 = 0 THEN 'finish_reason' ELSE 'completion_tokens' END AS detached
        FROM rec WHERE user_id % 19 = 0 OR user_id % 11 = 0 OR user_id % 13 = 0"""),
    "metric_availability": sql("req", f"WITH {_AVAIL} SELECT * FROM av"),
    "availability_summary": sql("req", f"""WITH {_AVAIL} SELECT repetition, count(*) AS total, """ + ", ".join(
        f"count(*) FILTER (WHERE {m}_available) AS {m}_count, count(*) FILTER (WHERE {m}_available) = count(*) AS {m}_allowed"
        for m in av.ALL_METRICS) + " FROM av GROUP BY GROUPING SETS ((repetition), ())"),
    "restart_descriptive": sql("req", f"""WITH s AS (
        SELECT 'ttft' AS metric, repetition, first_token_ns - dispatch_ns AS v FROM req WHERE {OK} AND phase = 'MEASURED'
        UNION ALL SELECT 'end_to_end', repetition, terminal_ns - dispatch_ns FROM req WHERE {OK} AND phase = 'MEASURED')
        SELECT metric, repetition, sample_count, p50, p95 FROM ({percentile_sql('s', 'metric, repetition', 'v')})"""),
    "memory_stability": sql("ev", """WITH s AS (SELECT *, off_ns - lag(off_ns) OVER (PARTITION BY run_id ORDER BY off_ns) AS gap FROM (
          SELECT user_id * 1000000 + rn0 // 5 AS run_id, off_ns, CAST(round(value * 1000000) AS BIGINT) AS b
          FROM ev WHERE NOT (user_id % 10 = 3 AND (rn0 + 1) % 7 = 5)))
        SELECT run_id, count(*) AS samples, min(gap) AS smallest_gap_ns, arg_min(b, off_ns) AS first_bytes,
          max(b) - min(b) AS range_bytes, greatest((arg_min(b, off_ns) + 99) // 100, 67108864) AS tolerance_bytes,
          count(*) = 5 AND coalesce(min(gap) >= 200000000, false)
            AND max(b) - min(b) <= greatest((arg_min(b, off_ns) + 99) // 100, 67108864) AS stable
        FROM s GROUP BY run_id"""),
    "usage_reconciliation": sql("req be", """SELECT r.run_id, r.request_id, output_tokens AS streamed_tokens,
        array_to_string([x FOR x IN [
          CASE WHEN user_id % 31 = 0 THEN 'PROMPT_IDS_DIFFER' END,
          CASE WHEN coalesce(lost, 0) > 0 THEN 'OUTPUT_IDS_DIFFER' END,
          CASE WHEN user_id % 23 = 0 THEN 'USAGE_DOES_NOT_ADD_UP' END,
          CASE WHEN user_id % 5 = 0 AND blk % 2 = 1 THEN 'LOCAL_PROMPT_COUNT_DIFFERS_FROM_SERVER_USAGE' END,
          CASE WHEN user_id % 3 = 0 AND token_events <> output_tokens
               THEN 'LOCAL_OUTPUT_COUNT_DIFFERS_FROM_SERVER_USAGE' END] IF x IS NOT NULL], ',') AS disagreements
        FROM req r LEFT JOIN (SELECT request_id, count(*) FILTER (WHERE event_id % 41 = 0) AS lost FROM be
          WHERE token_bearing GROUP BY request_id) l ON l.request_id = r.request_id"""),
}
