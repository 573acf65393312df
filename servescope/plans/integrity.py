"""Queries over order, contiguity, agreement and id sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from servescope.functions.rules import violation_report, violation_rows
from servescope.operators import integrity as ig
from servescope.operators import timeline as tl
from servescope.operators.sliced import SlicedOrder
from servescope.plans import tables as t
from servescope.plans.oracle import rules_sql, sql
from servescope.session import cut


def max_concurrency_sequence(s, d):
    return tl.concurrency_by_sequence(cut(t.sequenced(t.stream_events(s, d))))


def sequence_gaps(s, d):
    lines = t.table(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"))
    report = tl.sequence_report(lines, ["l_orderkey"], "line", first=1)
    return report.where("NOT contiguous").drop("contiguous")


def out_of_order_events(s, d):
    """Two events of a user within the same second count as not strictly ordered seconds."""
    events = t.clocked_events(s, d).withColumn("tick", F.expr("off_ns div 60000000000"))
    found = tl.out_of_order(SlicedOrder(["user_id"], ["off_ns", "event_id"]), events, "tick")
    return found.select("user_id", "event_id", "tick", F.col("previous_offset").alias("previous_tick"))


def asof_scrape(s, d):
    events = t.clocked_events(s, d)
    gates = events.where("event_type = 'purchase'").selectExpr("user_id", "event_id", "off_ns")
    views = events.where("event_type = 'view'").selectExpr(
        "user_id", "event_id AS scrape_id", "off_ns AS scrape_ns"
    )
    joined = tl.as_of_join(gates, views, "user_id", "off_ns", "scrape_ns")
    return joined.selectExpr(
        "user_id", "event_id", "off_ns", "scrape_id", "scrape_ns",
        """CASE WHEN scrape_ns IS NULL THEN 'ABSENT'
             WHEN off_ns - scrape_ns > 86400000000000 THEN 'STALE' ELSE 'FRESH' END AS freshness""",
    )


def phases(s, d):
    """Phase of a run: one UTC day, from its first to its last event (cut short on every 7th day)."""
    day = F.expr("off_ns div 86400000000000")
    return (
        t.block_events(s, d)
        .groupBy("run_id", day.alias("phase_name"))
        .agg(F.min("off_ns").alias("started_ns"), F.max("off_ns").alias("ended_ns"))
        .withColumn("ended_ns", F.expr(
            "CASE WHEN phase_name % 7 = 6 THEN ended_ns - 3600000000000 ELSE ended_ns END"))
    )


def request_in_phase(s, d):
    requests = t.requests(s, d).withColumn("phase_name", F.expr("terminal_ns div 86400000000000"))
    return tl.inside_phase(requests, phases(s, d)).select("request_id", "phase_name", "inside")


def orphan_events(s, d):
    known = t.requests(s, d).where("n >= 6")
    return (
        ig.orphans(t.stream_events(s, d), known, ["run_id", "request_id"])
        .groupBy("run_id", "request_id", "kind")
        .agg(F.count(F.lit(1)).alias("events"))
    )


def request_event_consistency(s, d):
    checked = ig.request_event_consistency(t.requests(s, d), t.stream_events(s, d))
    return violation_report(checked, ["run_id", "request_id"])


def _cases(s, d):
    first = t.table(s, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("prompt"), F.count(F.lit(1)).alias("expected_tokens")
    )
    left = first.selectExpr("conv_id AS case_id", "length(prompt) % 7 AS prompt_class",
                            "expected_tokens % 3 AS expected")
    right = t.table(s, d, "benchmark").selectExpr(
        "item_id * 3 AS case_id", "length(text) % 7 AS prompt_class", "item_id % 3 AS expected"
    )
    return left, right


def case_agreement(s, d):
    left, right = _cases(s, d)
    return ig.case_agreement(left, right, ["prompt_class", "expected"])


def prompt_agreement(s, d):
    """Workload prompts (benchmark) against measured prompts (first user turn), as word arrays."""
    measured = t.table(s, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("text"))
    words = "split(trim(text), ' ')"
    left = t.table(s, d, "benchmark").selectExpr("item_id AS case_id", f"{words} AS declared")
    right = measured.selectExpr("conv_id AS case_id", f"{words} AS sent")
    return ig.prompt_agreement(left, right)


def id_overlap(s, d):
    groups = {
        "excluded": "phase = 'WARMUP'",
        "cancellation": "terminal_class = 'CANCELLED'",
        "measured": "phase = 'MEASURED'",
    }
    return ig.id_overlap(ig.tag_groups(t.requests(s, d), groups), ["run_id"], "request_id")


def set_difference(s, d):
    r = t.requests(s, d)
    return ig.set_difference(
        r.where("phase = 'MEASURED'"), t.server_events(s, d).where("kind = 'SSE_DONE_SENT'"),
        ["run_id", "request_id"])


def path_collisions(s, d):
    pages = t.table(s, d, "pages").selectExpr(
        "regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '[0-9?#].*$', '') AS tail", "page_id"
    ).selectExpr("CASE WHEN page_id % 3 = 0 THEN upper(tail) ELSE tail END AS path")
    return ig.path_collisions(pages, [])


def case_order(s, d):
    """Workload = one user; its declared case order is the order of its requests."""
    workloads = t.requests(s, d).groupBy("run_id", "user_id", F.expr("blk div 64").alias("part")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("blk", "case_id"))), lambda x: x["case_id"])
        .alias("case_ids"))
    return ig.case_order(workloads.withColumn("workload", F.concat_ws("-", "user_id", "part")))


def top_violations(s, d):
    checked = ig.request_event_consistency(t.requests(s, d), t.stream_events(s, d))
    rows = violation_rows(checked, ["run_id", "request_id"])
    return ig.top_violations(rows, "run_id", ["request_id", "rule"]).withColumn(
        "rank", F.col("rank").cast("long"))


def dedup_requests(s, d):
    arrivals = t.stream_events(s, d).where("kind = 'CLIENT_REQUEST_STARTED'").select(
        "run_id", "request_id", "off_ns", "kind_rank", "case_id")
    return ig.dedup_requests(arrivals, ["run_id", "request_id"], ["off_ns", "kind_rank"]).drop("kind_rank")


QUERIES = {
    "max_concurrency_sequence": max_concurrency_sequence,
    "max_concurrency_interval": lambda s, d: tl.concurrency_by_interval(
        cut(t.requests(s, d).select("run_id", "dispatch_ns", "terminal_ns"))),
    "sequence_gaps": sequence_gaps,
    "out_of_order_events": out_of_order_events,
    "asof_scrape": asof_scrape,
    "request_in_phase": request_in_phase,
    "orphan_events": orphan_events,
    "request_event_consistency": request_event_consistency,
    "case_agreement": case_agreement,
    "prompt_agreement": prompt_agreement,
    "id_overlap": id_overlap,
    "set_difference": set_difference,
    "path_collisions": path_collisions,
    "case_order": case_order,
    "top_violations": top_violations,
    "server_event_tally": lambda s, d: ig.server_event_tally(t.server_events(s, d)),
    "dedup_requests": dedup_requests,
}

_TALLY = """tally AS (SELECT r.*, starts, terminals, ends, dones, start_ns, terminal_event_ns, end_ns,
      event_class, delta_total, delta_events, odd_case, odd_phase
    FROM req r LEFT JOIN (SELECT e.request_id,
      count(*) FILTER (WHERE kind = 'CLIENT_REQUEST_STARTED') AS starts,
      count(*) FILTER (WHERE kind = 'REQUEST_TERMINAL') AS terminals,
      count(*) FILTER (WHERE kind = 'CLIENT_REQUEST_ENDED') AS ends,
      count(*) FILTER (WHERE kind = 'SSE_DONE') AS dones,
      count(*) FILTER (WHERE e.case_id <> q.case_id) AS odd_case,
      count(*) FILTER (WHERE e.phase <> q.phase) AS odd_phase,
      min(off_ns) FILTER (WHERE kind = 'CLIENT_REQUEST_STARTED') AS start_ns,
      max(off_ns) FILTER (WHERE kind = 'REQUEST_TERMINAL') AS terminal_event_ns,
      max(off_ns) FILTER (WHERE kind = 'CLIENT_REQUEST_ENDED') AS end_ns,
      max(e.terminal_class) AS event_class,
      coalesce(sum(token_delta_count), 0) AS delta_total, count(token_delta_count) AS delta_events
      FROM sev e JOIN req q ON q.request_id = e.request_id GROUP BY e.request_id) x
    ON x.request_id = r.request_id)"""

_CASES = """l AS (SELECT conv_id AS case_id, length(arg_min(text, turn)) % 7 AS prompt_class, count(*) % 3 AS expected
      FROM conversations WHERE role = 'user' GROUP BY conv_id),
    r AS (SELECT item_id * 3 AS case_id, length(text) % 7 AS prompt_class, item_id % 3 AS expected FROM benchmark)"""

ORACLES = {
    "max_concurrency_sequence": sql("seq", """WITH active AS (
        SELECT run_id, sum(CASE kind WHEN 'CLIENT_REQUEST_STARTED' THEN 1 WHEN 'CLIENT_REQUEST_ENDED' THEN -1
          ELSE 0 END) OVER (PARTITION BY run_id ORDER BY sequence ROWS UNBOUNDED PRECEDING) AS a FROM seq),
        per AS (SELECT run_id, request_id, count(*) FILTER (WHERE kind = 'CLIENT_REQUEST_STARTED') AS s,
          count(*) FILTER (WHERE kind = 'CLIENT_REQUEST_ENDED') AS e FROM seq GROUP BY ALL)
        SELECT a.run_id, CAST(max(a) AS BIGINT) AS max_concurrency, CAST(min(a) AS BIGINT) AS lowest_active,
          any_value(p.duplicate_starts) AS duplicate_starts, any_value(p.unmatched_ends) AS unmatched_ends,
          any_value(p.unfinished) AS unfinished
        FROM active a JOIN (SELECT run_id, count(*) FILTER (WHERE s > 1) AS duplicate_starts,
            count(*) FILTER (WHERE e > 1 OR (e = 1 AND s = 0)) AS unmatched_ends,
            count(*) FILTER (WHERE s > 0 AND e = 0) AS unfinished FROM per GROUP BY run_id) p
          ON p.run_id = a.run_id GROUP BY a.run_id"""),
    "max_concurrency_interval": sql("req", """SELECT run_id, CAST(max(active) AS BIGINT) AS max_concurrency,
        coalesce(bool_or(active >= 2 AND next_at > at_ns), false) AS positive_overlap FROM (
        SELECT run_id, at_ns, lead(at_ns) OVER (PARTITION BY run_id ORDER BY at_ns, d) AS next_at,
          sum(d) OVER (PARTITION BY run_id ORDER BY at_ns, d ROWS UNBOUNDED PRECEDING) AS active
        FROM (SELECT run_id, dispatch_ns AS at_ns, 1 AS d FROM req
              UNION ALL SELECT run_id, terminal_ns, -1 FROM req)) GROUP BY run_id"""),
    "sequence_gaps": """SELECT l_orderkey, count(*) AS row_count, count(DISTINCT l_linenumber) AS distinct_count,
        CAST(min(l_linenumber) AS BIGINT) AS lowest, CAST(max(l_linenumber) AS BIGINT) AS highest,
        count(*) - count(DISTINCT l_linenumber) AS duplicates,
        max(l_linenumber) - count(DISTINCT l_linenumber) AS missing
        FROM lineitem GROUP BY l_orderkey
        HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*) OR count(*) <> count(DISTINCT l_linenumber)""",
    "out_of_order_events": sql("ev", """SELECT user_id, event_id, tick, previous_tick FROM (
        SELECT user_id, event_id, off_ns // 60000000000 AS tick,
          lag(off_ns // 60000000000) OVER (PARTITION BY user_id ORDER BY off_ns, event_id) AS previous_tick FROM ev)
        WHERE previous_tick >= tick"""),
    "asof_scrape": sql("ev", """WITH g AS (SELECT * FROM ev WHERE event_type = 'purchase'),
        v AS (SELECT user_id, event_id AS scrape_id, off_ns AS scrape_ns FROM ev WHERE event_type = 'view')
        SELECT g.user_id, g.event_id, g.off_ns, v.scrape_id, v.scrape_ns,
          CASE WHEN scrape_ns IS NULL THEN 'ABSENT' WHEN g.off_ns - scrape_ns > 86400000000000 THEN 'STALE'
               ELSE 'FRESH' END AS freshness
        FROM g ASOF LEFT JOIN v ON g.user_id = v.user_id AND g.off_ns >= v.scrape_ns"""),
    "request_in_phase": sql("req", """WITH ph AS (SELECT run_id, off_ns // 86400000000000 AS day,
          min(off_ns) AS s, max(off_ns) - CASE WHEN (off_ns // 86400000000000) % 7 = 6 THEN 3600000000000 ELSE 0 END AS e
          FROM be GROUP BY run_id, off_ns // 86400000000000)
        SELECT request_id, terminal_ns // 86400000000000 AS phase_name,
          dispatch_ns >= s AND terminal_ns <= e AS inside
        FROM req JOIN ph ON ph.run_id = req.run_id AND day = terminal_ns // 86400000000000"""),
    "orphan_events": sql("sev req", """SELECT run_id, request_id, kind, count(*) AS events FROM sev
        WHERE request_id NOT IN (SELECT request_id FROM req WHERE n >= 6) GROUP BY ALL"""),
    "request_event_consistency": sql("req sev", f"""WITH {_TALLY}
        {rules_sql('tally', 'run_id, request_id', ig.REQUEST_EVENT_RULES)}"""),
    "case_agreement": f"""WITH {_CASES} SELECT case_id, status, fields FROM (
        SELECT coalesce(l.case_id, r.case_id) AS case_id,
          CASE WHEN r.case_id IS NULL THEN 'LEFT_ONLY' WHEN l.case_id IS NULL THEN 'RIGHT_ONLY'
               WHEN l.prompt_class <> r.prompt_class OR l.expected <> r.expected THEN 'FIELDS_DIFFER' END AS status,
          CASE WHEN l.prompt_class <> r.prompt_class AND l.expected <> r.expected THEN 'prompt_class,expected'
               WHEN l.prompt_class <> r.prompt_class THEN 'prompt_class'
               WHEN l.expected <> r.expected THEN 'expected' END AS fields
        FROM l FULL OUTER JOIN r ON l.case_id = r.case_id) WHERE status IS NOT NULL""",
    "prompt_agreement": """SELECT case_id, declared_tokens, sent_tokens, coalesce(same, false) AS agrees, CASE WHEN sent_tokens IS NULL THEN 'NOT_SENT' WHEN declared_tokens IS NULL THEN 'NOT_DECLARED'
          WHEN same THEN 'AGREES' ELSE 'DIFFERS' END AS status FROM (SELECT coalesce(item_id, conv_id) AS case_id, len(string_split(trim(b.text), ' ')) AS declared_tokens,
        len(string_split(trim(c.text), ' ')) AS sent_tokens,
        string_split(trim(b.text), ' ') = string_split(trim(c.text), ' ') AS same
        FROM benchmark b FULL JOIN (SELECT conv_id, arg_min(text, turn) AS text FROM conversations
          WHERE role = 'user' GROUP BY conv_id) c ON c.conv_id = item_id)""",
    "id_overlap": sql("req", """WITH g AS (
          SELECT run_id, request_id, 'excluded' AS g FROM req WHERE phase = 'WARMUP'
          UNION ALL SELECT run_id, request_id, 'cancellation' FROM req WHERE terminal_class = 'CANCELLED'
          UNION ALL SELECT run_id, request_id, 'measured' FROM req WHERE phase = 'MEASURED')
        SELECT run_id, request_id, count(*) AS uses, string_agg(DISTINCT g, ',' ORDER BY g) AS id_groups
        FROM g GROUP BY ALL HAVING count(*) > 1"""),
    "set_difference": sql("req srv", """WITH l AS (SELECT run_id, request_id FROM req WHERE phase = 'MEASURED'),
        r AS (SELECT run_id, request_id FROM srv WHERE kind = 'SSE_DONE_SENT')
        SELECT *, 'LEFT_ONLY' AS side FROM (SELECT * FROM l EXCEPT SELECT * FROM r)
        UNION ALL SELECT *, 'RIGHT_ONLY' FROM (SELECT * FROM r EXCEPT SELECT * FROM l)"""),
    "path_collisions": """WITH p AS (SELECT CASE WHEN page_id % 3 = 0 THEN upper(tail) ELSE tail END AS path FROM (
          SELECT page_id, regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '[0-9?#].*$', '') AS tail FROM pages))
        SELECT lower(path) AS folded, count(DISTINCT path) AS spellings, min(path) AS first_spelling
        FROM p GROUP BY lower(path) HAVING count(DISTINCT path) > 1""",
    "case_order": sql("req", """SELECT user_id || '-' || (blk // 64) AS workload, count(*) AS cases,
        count(*) = count(DISTINCT case_id) AS unique_ids,
        list(case_id ORDER BY blk) = list(case_id ORDER BY case_id) AS sorted_ids
        FROM req GROUP BY user_id, blk // 64"""),
    "top_violations": sql("req sev", f"""WITH {_TALLY}, bad AS (
        {rules_sql('tally', 'run_id, request_id', ig.REQUEST_EVENT_RULES)}),
        long AS (SELECT run_id, request_id, unnest(string_split(violations, ',')) AS rule FROM bad)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY request_id, rule) AS rank FROM long)
        WHERE rank <= 20"""),
    "server_event_tally": sql("srv", """SELECT run_id, request_id,
        CAST(coalesce(sum(token_delta_count), 0) AS BIGINT) AS tokens_sent,
        count(*) FILTER (WHERE kind = 'REQUEST_ACCEPTED') AS accepted,
        count(*) FILTER (WHERE kind = 'RESPONSE_HEADERS_SENT') AS headers,
        count(*) FILTER (WHERE kind = 'SSE_COMMENT_SENT') AS comments,
        count(*) FILTER (WHERE kind = 'SSE_TOKEN_EVENT_SENT') AS token_events,
        count(*) FILTER (WHERE kind = 'SSE_DONE_SENT') AS dones,
        count(*) FILTER (WHERE kind = 'HTTP_ERROR_SENT') AS http_errors,
        count(*) FILTER (WHERE kind = 'STALL_STARTED') AS stalls,
        count(*) FILTER (WHERE kind = 'REQUEST_HANDLER_ENDED') AS ended FROM srv GROUP BY ALL"""),
    "dedup_requests": sql("sev", """SELECT run_id, request_id, min(off_ns) AS off_ns, min(case_id) AS case_id,
        count(*) AS copies FROM sev WHERE kind = 'CLIENT_REQUEST_STARTED' GROUP BY ALL"""),
}
