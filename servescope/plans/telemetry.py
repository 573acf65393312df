"""Queries over scrapes, logs, phases and cancellation probes."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from servescope.functions.rules import violation_report
from servescope.operators import cancellation as cn
from servescope.operators import telemetry as tm
from servescope.operators.sliced import SlicedOrder
from servescope.plans import tables as t
from servescope.plans.oracle import sql
from servescope.session import cut, shared_folder
from servescope.sources import logs as lg
from servescope.sources import scrapes as sc
from servescope.sources.lines import read_lines

TYPES = ("click", "error", "purchase", "signup", "view")
DAY = 86_400_000_000_000


def scrapes(s, d):
    """One scrape per slot (user % 8) and day: counters per event type in cents, two gauges.

    Broken on purpose by (slot + day): a value cut in half (% 13), an extra label set (% 17),
    a bad line (% 19), a negative value (% 23), a missing type (% 29); a new process every ten days.
    """
    types = "array(" + ", ".join(f"'{x}'" for x in TYPES) + ")"
    daily = (
        t.clocked_events(s, d)
        .groupBy(F.expr("user_id % 8").alias("slot"), F.expr(f"off_ns div {DAY}").alias("day"))
        .agg(*[F.sum(F.expr(f"CASE WHEN event_type = '{x}' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END")).alias(x)
               for x in TYPES], F.count(F.lit(1)).alias("n"))
    )
    upto = Window.partitionBy("slot").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    total = daily.select("slot", "day", "n", *[F.sum(x).over(upto).alias(x) for x in TYPES])
    line = """concat('ev_total{engine="0",reason="', x, '"} ', CASE WHEN (slot + day) % 13 = 0
        THEN v div 2 ELSE v END, '.0', chr(10))"""
    values = "map(" + ", ".join(f"'{x}', {x}" for x in TYPES) + ")"
    text = f"""concat('# HELP ev_total events', chr(10),
        array_join(transform(filter({types}, x -> NOT ((slot + day) % 29 = 0 AND x = 'view')),
          x -> transform(array(element_at({values}, x)), v -> {line})[0]), ''),
        CASE WHEN (slot + day) % 17 = 0 THEN concat('ev_total{{reason="click",engine="1"}} 5', chr(10)) ELSE '' END,
        CASE WHEN (slot + day) % 19 = 0 THEN concat('not a sample', chr(10), 'bad{{a=1}} 2', chr(10)) ELSE '' END,
        CASE WHEN (slot + day) % 23 = 0 THEN concat('ev_total{{engine="0",reason="neg"}} -1', chr(10)) ELSE '' END,
        'running{{engine="0"}} ', n % 2, chr(10), chr(10), 'waiting{{engine="0"}} ', n % 3 div 2, '.0', chr(10))"""
    return total.selectExpr(
        "slot", "day", "slot * 1000 + day AS scrape_id",
        "concat('p', slot, '-', day div 10) AS process_start_id",
        f"day * {DAY} + {DAY - 1} AS scrape_offset_ns", f"{text} AS exposition_text")


def _samples(s, d):
    return sc.read_samples(scrapes(s, d))


def scrape_samples(s, d):
    return _samples(s, d).select("scrape_id", "line_number", "metric",
                                 sc.label_text().alias("labels"), "value", "violation")


WANTED = [("ev_total", f'engine="0",reason="{x}"') for x in TYPES]
GAUGES = [("running", 'engine="0"'), ("waiting", 'engine="0"')]


def exact_series(s, d):
    return tm.exact_series(scrapes(s, d), _samples(s, d), WANTED)


def counter_deltas(s, d):
    scraped = cut(scrapes(s, d))
    return tm.counter_deltas(tm.scrape_pairs(scraped), sc.read_samples(scraped)).where("metric = 'ev_total'")


def window_deltas(s, d):
    scraped = cut(scrapes(s, d))
    pairs = tm.scrape_pairs(scraped)
    deltas = tm.counter_deltas(pairs, sc.read_samples(scraped)).where("metric = 'ev_total'")
    return tm.window_deltas(pairs, deltas, [(m, ls, 0.0) for m, ls in WANTED[:4]] + [("ev_total", 'engine="2"', 1.0)])


def log_lines(s, d):
    """The log of a run: lines of its requests in clock order; some lines lost, doubled or foreign."""
    r = cut(t.requests(s, d).drop("stream_events")).selectExpr(
        "*", "concat('cmpl-', request_id, '-0') AS item",
        "concat('cmpl-', request_id, '-0-', substring(md5(request_id), 1, 8)) AS internal",
        "coalesce(first_token_ns, dispatch_ns) AS add_ns")
    lines = """filter(array(
        struct(dispatch_ns AS at, 0 AS k, concat('INFO Received request ', item, ': prompt of ', n) AS line),
        CASE WHEN user_id % 19 = 0 THEN struct(dispatch_ns AS at, 1 AS k, concat('INFO Received request ', item, ': again') AS line) END,
        CASE WHEN user_id % 17 <> 0 THEN struct(add_ns AS at, 2 AS k, concat('INFO Added request ', internal, '.') AS line) END,
        struct(add_ns AS at, 3 AS k, concat('DEBUG step – ', last_type) AS line),
        CASE WHEN terminal_class = 'FAILED' THEN struct(terminal_ns AS at, 4 AS k, concat('INFO Aborted request(s) ',
          CASE WHEN user_id % 29 = 0 THEN concat(item, '-00000000') ELSE internal END, '.') AS line) END,
        CASE WHEN terminal_class = 'FAILED' AND user_id % 23 <> 0 OR user_id % 31 = 0
          THEN struct(CASE WHEN user_id % 37 = 0 THEN dispatch_ns - 1 ELSE terminal_ns END AS at, 5 AS k,
            concat('INFO Request ', item, ' aborted.') AS line) END), l -> l IS NOT NULL)"""
    spread = r.selectExpr("run_id", "request_id", f"explode({lines}) AS l").selectExpr(
        "concat('run-', run_id) AS source_stream_id", "run_id", "request_id", "l.at AS observation_offset_ns",
        "l.k AS k", "l.line AS raw_record")
    ranked = SlicedOrder(["source_stream_id"], ["observation_offset_ns", "k", "request_id"]).rank(spread, "rn")
    return ranked.withColumn("record_ordinal", F.col("rn") - 1).drop("rn")


def log_offsets(s, d):
    kept = lg.retain_records(cut(log_lines(s, d)))
    return kept.select("source_stream_id", "record_ordinal", "byte_start", "byte_end", "raw_record_sha256")


LOG_ROWS = 1000


def log_files(s, d):
    """A run's log as files of ``LOG_ROWS`` lines each, as a server rotates them, read by byte range."""
    folder = f"{shared_folder(s)}/logs-{uuid.uuid4().hex}"
    lines = log_lines(s, d).withColumn("part", F.expr(f"record_ordinal div {LOG_ROWS}"))
    lines.repartition("source_stream_id", "part").sortWithinPartitions("source_stream_id", "part", "record_ordinal").select(
        "source_stream_id", "part", "raw_record").write.partitionBy("source_stream_id", "part").text(folder)
    return read_lines(s, folder).select(
        F.regexp_extract("source_file", "source_stream_id=([^/]*)/", 1).alias("source_stream_id"),
        F.regexp_extract("source_file", "part=([0-9]+)/", 1).cast("long").alias("part"),
        "line_ordinal", "byte_start", "byte_end", "terminated", F.sha2("value", 256).alias("raw_record_sha256"))


def log_byte_gaps(s, d):
    """Records after a run's lines lost every 50th record: the byte positions show the holes."""
    kept = cut(lg.retain_records(cut(log_lines(s, d))))
    lost = kept.where("record_ordinal % 50 <> 49")
    return lg.byte_gaps(lost).select("source_stream_id", "record_ordinal", "violation")


def _correlated(s, d):
    wanted = t.requests(s, d).selectExpr("run_id", "request_id AS external_id", "terminal_class = 'FAILED' AS cancelled")
    return lg.correlate(log_lines(s, d), wanted)


def log_correlation(s, d):
    return _correlated(s, d).select("run_id", "external_id", "status", "internal_id")


def identity_chain(s, d):
    r = t.requests(s, d)
    responses = r.where("user_id % 13 <> 0").selectExpr(
        "run_id", "concat('cmpl-', request_id) AS body_id",
        "CASE WHEN user_id % 41 = 0 THEN 'other' ELSE request_id END AS header_id",
        "concat('cmpl-', request_id, CASE WHEN user_id % 43 = 0 THEN '-1' ELSE '-0' END) AS item_id")
    return tm.identity_chain(r.selectExpr("run_id", "request_id AS external_id"), responses, _correlated(s, d))


def phase_order(s, d):
    """A user's requests as the runtime phases of its run, two of them swapped for some users."""
    names = "array(" + ", ".join(f"'{n}'" for n in tm.RUNTIME_PHASES) + ")"
    phases = t.requests(s, d).selectExpr(
        "user_id AS run_id",
        f"""coalesce(get({names}, CAST(CASE WHEN user_id % 5 = 0 AND blk = 2 THEN 3 WHEN user_id % 5 = 0 AND blk = 3 THEN 2
              ELSE blk END AS INT)), 'UNKNOWN') AS phase""",
        "dispatch_ns - CASE WHEN user_id % 7 = 0 AND blk = 4 THEN 864000000000000 ELSE 0 END AS started_ns",
        "CASE WHEN user_id % 11 = 0 AND blk = 1 THEN dispatch_ns ELSE terminal_ns END AS ended_ns",
        "terminal_class <> 'FAILED' AS passed")
    return tm.phase_order(cut(phases), tm.RUNTIME_PHASES)


def scrape_placement(s, d):
    """The window of each user's requests, with scrapes and gates set around it; some misplaced."""
    windows = tm.measured_window(t.requests(s, d, "user_id")).selectExpr(
        "*", "first_dispatch_ns - 2000000000 AS phase_start_ns",
        "last_terminal_ns + CASE WHEN run_id % 5 = 0 THEN -1 ELSE 10 END AS phase_end_ns",
        "first_dispatch_ns - CASE WHEN run_id % 7 = 0 THEN 1500000000 WHEN run_id % 11 = 0 THEN 0 WHEN run_id % 13 = 0 THEN 3000000000 ELSE 1000000000 END AS baseline_ns",
        "last_terminal_ns + CASE WHEN run_id % 17 = 0 THEN 10 ELSE 20 END AS drain_ns",
        "CASE WHEN run_id % 23 <> 0 THEN last_terminal_ns + CASE WHEN run_id % 19 = 0 THEN 15 ELSE 1000000000 END END AS final_ns",
        "'p' AS baseline_process", "CASE WHEN run_id % 29 = 0 THEN 'q' ELSE 'p' END AS final_process")
    return violation_report(tm.scrape_placement(windows), ["run_id"])


def probe_observations(s, d):
    """The scrape schedule of a cancellation probe around every request.

    Broken by user: a late scrape (% 11), a lost one (% 13), a foreign process (% 31),
    running work (% 37), odd counters (% 29, % 41), a completion before its dispatch (% 53).
    """
    shape = """concat(
        transform(sequence(0L, 9L), i -> struct('PRE_DISPATCH' AS phase, 0L AS phase_rank, i AS i, dispatch_ns - 2000000000 + i * 100000000 AS at)),
        transform(sequence(0L, CASE WHEN user_id % 13 = 0 THEN 8L ELSE 9L END), i -> struct('DRAIN' AS phase, 1L AS phase_rank, i AS i, dispatch_ns + 300000000 + i * 100000000 AS at)),
        transform(sequence(0L, 10L), i -> struct('STABLE_GENERATION' AS phase, 2L AS phase_rank, i AS i, dispatch_ns + 1200000000 + i * 100000000 AS at)),
        transform(sequence(0L, 20L), i -> struct('COOLDOWN' AS phase, 3L AS phase_rank, i AS i, dispatch_ns + 2200000000 + i * 100000000 AS at)))"""
    rows = cut(t.requests(s, d).select("request_id", "user_id", "n", "blk", "dispatch_ns")).selectExpr(
        "request_id", "user_id", "n", "blk", f"explode({shape}) AS o")
    after = "o.phase_rank > 0"
    return rows.selectExpr(
        "request_id AS probe_id", "o.phase AS phase", "o.phase_rank AS phase_rank", "o.i AS phase_ordinal",
        "o.at + CASE WHEN user_id % 11 = 0 AND o.phase_rank = 0 AND o.i = 5 THEN 50000000 ELSE 0 END AS scheduled_ns",
        "o.at + 50000001 AS dispatched_ns",
        "o.at + CASE WHEN user_id % 53 = 0 AND o.i = 3 THEN 50000000 ELSE 50000002 END AS completed_ns",
        "CASE WHEN user_id % 31 = 0 AND o.phase_rank = 3 AND o.i = 4 THEN 'q' ELSE 'p' END AS process_id",
        "CASE WHEN user_id % 37 = 0 AND o.phase_rank = 1 AND o.i = 2 THEN 1 ELSE 0 END AS running", "0 AS waiting",
        f"blk * 100 + CASE WHEN {after} THEN CASE WHEN user_id % 41 = 0 THEN 63 ELSE 64 END ELSE 0 END AS prompt_tokens",
        f"blk * 50 + CASE WHEN {after} THEN n ELSE 0 END AS generation_tokens",
        "blk AS preemptions", "blk AS prefix_queries", "blk AS prefix_hits",
        f"blk + CASE WHEN {after} THEN blk % 2 ELSE 0 END AS success_abort",
        f"blk + CASE WHEN user_id % 29 = 0 AND {after} THEN 1 ELSE 0 END AS success_length",
        "blk AS success_stop", "blk AS success_error", "blk AS success_repetition")


def cancellation_class(s, d):
    probes = t.requests(s, d).selectExpr(
        "request_id AS probe_id", "request_id AS external_id", "dispatch_ns", "'p' AS server_process",
        "concat('cmpl-', request_id, CASE WHEN user_id % 19 = 0 THEN 'x' ELSE '' END) AS body_id",
        "concat('cmpl-', request_id, '-0') AS item_id",
        "CASE WHEN user_id % 47 = 0 THEN 'z' ELSE request_id END AS delivery_id", "true AS correlated",
        "dispatch_ns + 10000000 AS received_ns", "dispatch_ns + 20000000 AS added_ns",
        "dispatch_ns + CASE WHEN user_id % 23 = 0 THEN 250000000 ELSE 100000000 END AS first_delivery_ns",
        "dispatch_ns + 200000000 AS close_ns", "dispatch_ns + 210000000 AS internal_abort_ns",
        "CASE WHEN user_id % 17 <> 0 THEN dispatch_ns + 220000000 END AS external_abort_ns",
        "dispatch_ns + 5000000000 AS residual_ns", "0 AS residual_requests",
        "CASE WHEN user_id % 43 = 0 THEN 1 ELSE 0 END AS residual_processes")
    return cn.classify_cancellation(probes, probe_observations(s, d))


def scrape_cadence(s, d):
    return tm.cadence_verdict(tm.scrape_cadence(probe_observations(s, d)))


def scrape_chronology(s, d):
    return tm.scrape_chronology(probe_observations(s, d)).select(
        "probe_id", "phase", "phase_ordinal", "violation")


QUERIES = {
    "scrape_samples": scrape_samples,
    "exact_series": exact_series,
    "quiescent_scrapes": lambda s, d: tm.quiescent_scrapes(scrapes(s, d), _samples(s, d), GAUGES),
    "label_inventory": lambda s, d: tm.label_inventory(_samples(s, d)),
    "counter_deltas": counter_deltas,
    "window_deltas": window_deltas,
    "counter_progression": lambda s, d: tm.counter_progression(scrapes(s, d), _samples(s, d)),
    "log_files": log_files,
    "log_offsets": log_offsets,
    "log_byte_gaps": log_byte_gaps,
    "log_correlation": log_correlation,
    "identity_chain": identity_chain,
    "phase_order": phase_order,
    "scrape_placement": scrape_placement,
    "scrape_cadence": scrape_cadence,
    "scrape_chronology": scrape_chronology,
    "cancellation_class": cancellation_class,
}

# The oracle never builds the texts: it writes down the samples the texts stand for.
_S = f"""daily AS (SELECT user_id % 8 AS slot, off_ns // {DAY} AS day, count(*) AS n, """ + ", ".join(
    f"coalesce(sum(CAST(round(value * 100) AS BIGINT)) FILTER (WHERE event_type = '{x}'), 0) AS {x}" for x in TYPES
) + f""" FROM ev GROUP BY ALL),
  tot AS (SELECT slot, day, n, slot * 1000 + day AS scrape_id, """ + ", ".join(
    f"sum({x}) OVER (PARTITION BY slot ORDER BY day) AS {x}" for x in TYPES
) + f""" FROM daily),
  smp AS (SELECT slot, day, scrape_id, x.m AS metric, x.l AS labels, CAST(x.v AS DOUBLE) AS value FROM (
    SELECT slot, day, scrape_id, unnest([""" + ", ".join(
    f"""{{'m': 'ev_total', 'l': 'engine="0",reason="{x}"', 'v': CAST(CASE WHEN (slot + day) % 13 = 0 THEN {x} // 2 ELSE {x} END AS BIGINT),
        'k': {'(slot + day) % 29 <> 0' if x == 'view' else 'true'}}}""" for x in TYPES
) + """,
      {'m': 'ev_total', 'l': 'engine="1",reason="click"', 'v': 5, 'k': (slot + day) % 17 = 0},
      {'m': 'running', 'l': 'engine="0"', 'v': n % 2, 'k': true},
      {'m': 'waiting', 'l': 'engine="0"', 'v': n % 3 // 2, 'k': true}]) AS x FROM tot) WHERE x.k),
  inv AS (SELECT scrape_id, metric, string_agg(labels, ' | ' ORDER BY labels) AS label_sets FROM smp GROUP BY ALL),
  prs AS (SELECT * FROM (SELECT slot, day, scrape_id AS after_id, lag(scrape_id) OVER w AS before_id, lag(day) OVER w AS bday
    FROM tot WINDOW w AS (PARTITION BY slot ORDER BY day)) WHERE before_id IS NOT NULL),
  dl AS (SELECT before_id, after_id, metric, label_set, status, CASE WHEN status = 'OK' THEN av - bv END AS delta FROM (
    SELECT p.before_id, p.after_id, 'ev_total' AS metric, g.labels AS label_set, b.value AS bv, a.value AS av,
      CASE WHEN p.day // 10 <> bday // 10 THEN 'RESTART' WHEN ib.label_sets <> ia.label_sets THEN 'LABEL_DRIFT'
           WHEN b.value IS NULL OR a.value IS NULL THEN 'ABSENT' WHEN a.value < b.value THEN 'RESET' ELSE 'OK' END AS status
    FROM prs p JOIN (SELECT DISTINCT before_id, after_id, labels FROM prs JOIN smp
        ON (smp.scrape_id = before_id OR smp.scrape_id = after_id) AND metric = 'ev_total') g
      ON g.before_id = p.before_id AND g.after_id = p.after_id
    LEFT JOIN smp b ON b.scrape_id = p.before_id AND b.metric = 'ev_total' AND b.labels = g.labels
    LEFT JOIN smp a ON a.scrape_id = p.after_id AND a.metric = 'ev_total' AND a.labels = g.labels
    LEFT JOIN inv ib ON ib.scrape_id = p.before_id AND ib.metric = 'ev_total'
    LEFT JOIN inv ia ON ia.scrape_id = p.after_id AND ia.metric = 'ev_total'))"""

_LOG = """r AS (SELECT *, 'cmpl-' || request_id || '-0' AS item, md5(request_id)[1:8] AS sfx,
      coalesce(first_token_ns, dispatch_ns) AS add_ns FROM req),
    ln AS (SELECT run_id, user_id, request_id, dispatch_ns AS at_ns, 0 AS k, 'INFO Received request ' || item || ': prompt of ' || n AS line FROM r
      UNION ALL SELECT run_id, user_id, request_id, dispatch_ns, 1, 'INFO Received request ' || item || ': again' FROM r WHERE user_id % 19 = 0
      UNION ALL SELECT run_id, user_id, request_id, add_ns, 2, 'INFO Added request ' || item || '-' || sfx || '.' FROM r WHERE user_id % 17 <> 0
      UNION ALL SELECT run_id, user_id, request_id, add_ns, 3, 'DEBUG step – ' || last_type FROM r
      UNION ALL SELECT run_id, user_id, request_id, terminal_ns, 4, 'INFO Aborted request(s) ' || item || '-'
        || CASE WHEN user_id % 29 = 0 THEN '00000000' ELSE sfx END || '.' FROM r WHERE terminal_class = 'FAILED'
      UNION ALL SELECT run_id, user_id, request_id, CASE WHEN user_id % 37 = 0 THEN dispatch_ns - 1 ELSE terminal_ns END, 5,
        'INFO Request ' || item || ' aborted.' FROM r WHERE terminal_class = 'FAILED' AND user_id % 23 <> 0 OR user_id % 31 = 0),
    lo AS (SELECT 'run-' || run_id AS source_stream_id, row_number() OVER w - 1 AS record_ordinal,
      CAST(sum(strlen(line) + 1) OVER (PARTITION BY run_id ORDER BY at_ns, k, request_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1 AS byte_end,
      strlen(line) AS size, sha256(line) AS raw_record_sha256 FROM ln
      WINDOW w AS (PARTITION BY run_id ORDER BY at_ns, k, request_id))"""

_STATUS = """CASE WHEN user_id % 19 = 0 THEN 'RECEIVED_MISSING_OR_AMBIGUOUS'
    WHEN user_id % 17 = 0 THEN 'ADDED_MISSING_OR_AMBIGUOUS'
    WHEN terminal_class = 'FAILED' AND user_id % 29 = 0 THEN 'FOREIGN_INTERNAL_ID'
    WHEN terminal_class = 'FAILED' AND user_id % 23 = 0 AND user_id % 31 <> 0 THEN 'ABORT_LINES_MISSING'
    WHEN terminal_class <> 'FAILED' AND user_id % 31 = 0 THEN 'UNEXPECTED_ABORT'
    WHEN terminal_class = 'FAILED' AND user_id % 37 = 0 THEN 'OUT_OF_ORDER' ELSE 'OK' END"""
_INTERNAL = """CASE WHEN user_id % 17 <> 0 THEN 'cmpl-' || request_id || '-0-' || md5(request_id)[1:8] END"""

_PROBE = """ob AS (SELECT request_id AS probe_id, user_id, phase, phase_rank, i AS phase_ordinal,
      at_ns + CASE WHEN user_id % 11 = 0 AND phase_rank = 0 AND i = 5 THEN 50000000 ELSE 0 END AS scheduled_ns,
      at_ns + 50000001 AS dispatched_ns, at_ns + CASE WHEN user_id % 53 = 0 AND i = 3 THEN 50000000 ELSE 50000002 END AS completed_ns
    FROM (SELECT request_id, user_id, 'PRE_DISPATCH' AS phase, 0 AS phase_rank, i, dispatch_ns - 2000000000 + i * 100000000 AS at_ns
            FROM req, range(10) t(i)
          UNION ALL SELECT request_id, user_id, 'DRAIN', 1, i, dispatch_ns + 300000000 + i * 100000000
            FROM req, range(10) t(i) WHERE NOT (user_id % 13 = 0 AND i = 9)
          UNION ALL SELECT request_id, user_id, 'STABLE_GENERATION', 2, i, dispatch_ns + 1200000000 + i * 100000000 FROM req, range(11) t(i)
          UNION ALL SELECT request_id, user_id, 'COOLDOWN', 3, i, dispatch_ns + 2200000000 + i * 100000000 FROM req, range(21) t(i)))"""

ORACLES = {
    "scrape_placement": sql("req", """SELECT run_id, array_to_string(v, ',') AS violations FROM (SELECT user_id AS run_id, [x FOR x IN [
          CASE WHEN user_id % 29 = 0 THEN 'process-changed' END,
          CASE WHEN user_id % 13 = 0 AND user_id % 7 <> 0 AND user_id % 11 <> 0 THEN 'baseline-before-phase' END,
          CASE WHEN user_id % 11 = 0 AND user_id % 7 <> 0 THEN 'baseline-after-dispatch' END,
          CASE WHEN user_id % 5 = 0 THEN 'terminal-after-phase' END,
          CASE WHEN user_id % 17 = 0 AND user_id % 5 <> 0 THEN 'drain-inside-phase' END,
          CASE WHEN user_id % 19 = 0 AND user_id % 17 <> 0 AND user_id % 23 <> 0 THEN 'final-before-drain' END,
          CASE WHEN user_id % 7 = 0 OR (user_id % 13 = 0 AND user_id % 11 <> 0) THEN 'baseline-stale' END,
          CASE WHEN user_id % 23 = 0 THEN 'final-missing' END] IF x IS NOT NULL] AS v
        FROM req WHERE phase = 'MEASURED' GROUP BY user_id) WHERE len(v) > 0"""),
    "scrape_samples": sql("ev", f"""WITH {_S}, txt AS (SELECT scrape_id, metric, labels, value, CAST(NULL AS VARCHAR) AS violation,
            CASE metric WHEN 'ev_total' THEN CASE WHEN labels LIKE 'engine="1"%' THEN 10 ELSE 0 END WHEN 'running' THEN 40 ELSE 50 END AS k FROM smp
          UNION ALL SELECT scrape_id, NULL, NULL, NULL, 'MALFORMED_SAMPLE', 20 FROM tot WHERE (slot + day) % 19 = 0
          UNION ALL SELECT scrape_id, NULL, NULL, NULL, 'MALFORMED_LABELS', 21 FROM tot WHERE (slot + day) % 19 = 0
          UNION ALL SELECT scrape_id, NULL, NULL, NULL, 'NOT_FINITE_OR_NEGATIVE', 30 FROM tot WHERE (slot + day) % 23 = 0)
        SELECT scrape_id, row_number() OVER (PARTITION BY scrape_id ORDER BY k, labels) + CASE WHEN k = 50 THEN 1 ELSE 0 END AS line_number,
          metric, labels, value, violation FROM txt"""),
    "exact_series": sql("ev", f"""WITH {_S}, w(label_set) AS (VALUES {', '.join(f"('{ls}')" for _, ls in WANTED)})
        SELECT g.scrape_id, 'ev_total' AS metric, g.label_set, CASE WHEN value IS NULL THEN 'ABSENT' ELSE 'OK' END AS status, value
        FROM (SELECT scrape_id, label_set FROM tot CROSS JOIN w) g
        LEFT JOIN smp ON smp.scrape_id = g.scrape_id AND metric = 'ev_total' AND labels = label_set"""),
    "quiescent_scrapes": sql("ev", f"WITH {_S} SELECT scrape_id, n % 2 = 0 AND n % 3 <> 2 AS quiescent FROM tot"),
    "label_inventory": sql("ev", f"WITH {_S} SELECT * FROM inv"),
    "counter_deltas": sql("ev", f"WITH {_S} SELECT * FROM dl"),
    "window_deltas": sql("ev", f"""WITH {_S}, w(label_set, expected) AS (VALUES
            {', '.join(f"('{ls}', 0.0::DOUBLE)" for _, ls in WANTED[:4])}, ('engine="2"', 1.0::DOUBLE))
        SELECT coalesce(g.before_id, dl.before_id) AS before_id, coalesce(g.after_id, dl.after_id) AS after_id, 'ev_total' AS metric,
          coalesce(g.label_set, dl.label_set) AS label_set, expected, delta,
          CASE WHEN expected IS NULL THEN 'EXTRA' WHEN status IS NULL THEN 'MISSING' WHEN status <> 'OK' THEN status
               WHEN delta = expected THEN 'MATCH' ELSE 'DIFFERS' END AS verdict
        FROM (SELECT before_id, after_id, label_set, expected FROM prs CROSS JOIN w) g
        FULL OUTER JOIN dl ON dl.before_id = g.before_id AND dl.after_id = g.after_id AND dl.label_set = g.label_set"""),
    "counter_progression": sql("ev", f"""WITH {_S}, p AS (SELECT 'p' || slot || '-' || (day // 10) AS process_start_id, metric,
            labels AS label_set, day, value, value - lag(value) OVER (PARTITION BY slot, day // 10, metric, labels ORDER BY day) AS step FROM smp)
        SELECT process_start_id, metric, label_set, count(*) AS scrapes, coalesce(bool_and(step >= 0), true) AS progresses,
          coalesce(bool_and(step = 0), true) AS stable, arg_max(value, day) - arg_min(value, day) AS net_change FROM p GROUP BY ALL"""),
    "log_files": log_files,
    "log_offsets": sql("req", f"""WITH {_LOG} SELECT source_stream_id, record_ordinal, byte_end - size AS byte_start, byte_end,
        raw_record_sha256 FROM lo"""),
    "log_files": sql("req", f"""WITH {_LOG}, p AS (SELECT *, record_ordinal // {LOG_ROWS} AS part FROM lo),
        f AS (SELECT *, min(byte_end - size) OVER (PARTITION BY source_stream_id, part) AS base FROM p)
        SELECT source_stream_id, part, record_ordinal % {LOG_ROWS} AS line_ordinal, byte_end - size - base AS byte_start, byte_end - base AS byte_end,
          true AS terminated, raw_record_sha256 FROM f"""),
    "log_byte_gaps": sql("req", f"""WITH {_LOG} SELECT source_stream_id, record_ordinal, 'NOT_CONTIGUOUS' AS violation FROM lo
        WHERE record_ordinal > 0 AND record_ordinal % 50 = 0"""),
    "log_correlation": sql("req", f"SELECT run_id, request_id AS external_id, {_STATUS} AS status, {_INTERNAL} AS internal_id FROM req"),
    "identity_chain": sql("req", f"""SELECT run_id, request_id AS external_id, {_INTERNAL} AS internal_id,
        CASE WHEN user_id % 13 = 0 THEN 'RESPONSE_MISSING' WHEN user_id % 41 = 0 THEN 'HEADER_ID_DIFFERS'
             WHEN user_id % 43 = 0 THEN 'ITEM_ID_DIFFERS' WHEN user_id % 17 = 0 THEN 'INTERNAL_ID_MISSING' ELSE 'OK' END AS status FROM req"""),
    "phase_order": sql("req", """WITH p AS (SELECT user_id AS run_id, CASE WHEN user_id % 5 = 0 AND blk = 2 THEN 3
            WHEN user_id % 5 = 0 AND blk = 3 THEN 2 WHEN blk > 16 THEN -1 ELSE blk END AS place,
          dispatch_ns - CASE WHEN user_id % 7 = 0 AND blk = 4 THEN 864000000000000 ELSE 0 END AS s,
          CASE WHEN user_id % 11 = 0 AND blk = 1 THEN dispatch_ns ELSE terminal_ns END AS e, terminal_class <> 'FAILED' AS passed FROM req)
        SELECT run_id, count(*) AS phases, 17 - count(DISTINCT place) FILTER (WHERE place >= 0) AS missing,
          count(*) FILTER (WHERE place < 0) AS unknown, count(*) FILTER (WHERE before >= place) AS out_of_order,
          count(*) FILTER (WHERE ended > s) AS overlaps, count(*) FILTER (WHERE e <= s) AS not_positive,
          count(*) FILTER (WHERE NOT passed) AS not_passed
        FROM (SELECT *, lag(place) OVER w AS before, lag(e) OVER w AS ended FROM p WINDOW w AS (PARTITION BY run_id ORDER BY s, e))
        GROUP BY run_id"""),
    "scrape_cadence": sql("req", f"""WITH {_PROBE}, c AS (SELECT probe_id, phase, count(*) AS scrapes,
            min(sg) AS smallest_scheduled_gap_ns, max(sg) AS largest_scheduled_gap_ns, min(cg) AS smallest_completed_gap_ns,
            max(completed_ns) - min(completed_ns) AS total_ns
          FROM (SELECT *, scheduled_ns - lag(scheduled_ns) OVER w AS sg, completed_ns - lag(completed_ns) OVER w AS cg
            FROM ob WINDOW w AS (PARTITION BY probe_id, phase ORDER BY scheduled_ns, phase_ordinal)) GROUP BY ALL)
        SELECT *, CASE WHEN phase IN ('PRE_DISPATCH', 'DRAIN') THEN scrapes = 10 AND smallest_scheduled_gap_ns >= 100000000
              AND smallest_completed_gap_ns >= 100000000
            ELSE smallest_scheduled_gap_ns = 100000000 AND largest_scheduled_gap_ns = 100000000
              AND total_ns >= CASE phase WHEN 'COOLDOWN' THEN 2000000000 ELSE 1000000000 END END AS cadence_ok FROM c"""),
    "scrape_chronology": sql("req", f"""WITH {_PROBE} SELECT probe_id, phase, phase_ordinal, 'COMPLETED_BEFORE_DISPATCHED' AS violation
        FROM ob WHERE completed_ns < dispatched_ns"""),
    "cancellation_class": sql("req", """WITH c AS (SELECT *, CASE
          WHEN user_id % 19 = 0 THEN 'ID_CORRELATION_FAILURE' WHEN user_id % 17 = 0 THEN 'UNKNOWN_ACKNOWLEDGEMENT'
          WHEN user_id % 47 = 0 THEN 'ID_CORRELATION_FAILURE' WHEN user_id % 23 = 0 THEN 'TERMINAL_UNKNOWN'
          WHEN user_id % 13 = 0 OR user_id % 31 = 0 OR user_id % 53 = 0 OR user_id % 11 = 0 OR user_id % 37 = 0 THEN 'RESIDUAL_WORK_TIMEOUT'
          WHEN user_id % 29 = 0 THEN 'LATER_COMPLETION' WHEN user_id % 41 = 0 OR user_id % 43 = 0 THEN 'RESIDUAL_WORK_TIMEOUT'
          ELSE 'SERVER_ABORT_ACKNOWLEDGED_AND_DRAINED' END AS cls FROM req)
        SELECT request_id AS probe_id, cls AS classification, cls = 'SERVER_ABORT_ACKNOWLEDGED_AND_DRAINED' AS accepted,
          CASE WHEN cls = 'SERVER_ABORT_ACKNOWLEDGED_AND_DRAINED' THEN n END AS generation_delta,
          CASE WHEN cls = 'SERVER_ABORT_ACKNOWLEDGED_AND_DRAINED' THEN blk % 2 END AS abort_delta FROM c"""),
}
