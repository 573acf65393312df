"""Oracle SQL pieces: the adapters of ``tables.py`` again, as plain DuckDB CTEs."""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": (
        (),
        """SELECT event_id, user_id, event_type, value,
                  (epoch_us(ts) - 1704067200000000) * 1000 AS off_ns,
                  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn0
           FROM events""",
    ),
    "be": (
        ("ev",),
        """SELECT *, user_id % 4 AS run_id, user_id || '-' || blk AS request_id,
                  pos > 0 AND pos < n - 1 AND toks > 0 AS token_bearing
           FROM (SELECT *, rn0 // 8 AS blk, rn0 % 8 AS pos,
                        count(*) OVER (PARTITION BY user_id, rn0 // 8) AS n,
                        CAST(CASE event_type WHEN 'purchase' THEN 2 WHEN 'error' THEN 0
                             ELSE 1 END AS BIGINT) AS toks
                 FROM ev)""",
    ),
    "req": (
        ("be",),
        """SELECT *, 'case-' || (blk % 16) AS case_id, user_id % 3 + 1 AS repetition,
                  CASE WHEN blk = 0 THEN 'WARMUP' ELSE 'MEASURED' END AS phase,
                  CASE WHEN last_type = 'error' THEN 'FAILED'
                       WHEN last_type = 'signup' AND blk % 5 = 0 THEN 'CANCELLED'
                       WHEN last_type = 'signup' THEN 'TIMEOUT' ELSE 'SUCCESS' END AS terminal_class,
                  CASE WHEN last_type = 'error' THEN
                         ['TRANSPORT_ERROR', 'HTTP_ERROR', 'PROTOCOL_ERROR', 'MALFORMED_STREAM',
                          'TOKEN_ACCOUNTING_ERROR', 'UNEXPECTED_ERROR'][blk % 6 + 1]
                       WHEN last_type = 'signup' AND blk % 5 = 0 THEN 'CANCELLED'
                       WHEN last_type = 'signup' THEN 'TIMEOUT' ELSE 'SUCCESS' END AS outcome,
                  CAST(CASE WHEN last_type = 'error' AND blk % 2 = 0 THEN 503 ELSE 200 END AS BIGINT)
                    AS http_status,
                  2 + blk % 3 AS input_tokens,
                  CASE WHEN run_id = 3 AND user_id % 11 = 0 THEN NULL ELSE output_tokens END
                    AS output_value,
                  CASE WHEN run_id = 2 AND user_id % 13 = 0 THEN NULL ELSE 2 + blk % 3 END
                    AS input_value,
                  (last_type NOT IN ('error', 'signup')
                     AND terminal_ns - dispatch_ns <= 260000000000000)
                    <> (user_id % 29 = 0 AND blk % 3 = 1) AS slo_satisfied
           FROM (SELECT run_id, request_id, user_id, blk, max(n) AS n,
                        min(off_ns) AS dispatch_ns,
                        min(off_ns) FILTER (WHERE pos = 1) AS first_body_ns,
                        min(off_ns) FILTER (WHERE token_bearing) AS first_token_ns,
                        max(off_ns) FILTER (WHERE token_bearing) AS last_token_ns,
                        max(off_ns) AS terminal_ns,
                        CAST(coalesce(sum(toks) FILTER (WHERE token_bearing), 0) AS BIGINT)
                          AS output_tokens,
                        count(*) FILTER (WHERE token_bearing) AS token_events,
                        coalesce(max(toks) FILTER (WHERE token_bearing), 0) AS max_event_tokens,
                        max(event_type) FILTER (WHERE pos = n - 1) AS last_type
                 FROM be GROUP BY ALL)""",
    ),
    "tev": (
        ("be",),
        """SELECT run_id, request_id, pos AS chunk_index, off_ns AS event_offset_ns,
                  toks AS tokens_in_chunk,
                  CASE WHEN toks = 2 AND event_id % 2 = 0 THEN [off_ns - 1000, off_ns] END
                    AS per_token_offsets_ns
           FROM be WHERE token_bearing""",
    ),
    "sev": (
        ("be",),
        """SELECT run_id, request_id, 'case-' || (blk % 16) AS case_id,
                  CASE WHEN blk = 0 THEN 'WARMUP' ELSE 'MEASURED' END AS phase,
                  kind, kind_rank, event_id, pos, off_ns,
                  CASE WHEN kind LIKE 'SSE%' THEN pos - 1 END AS sse_event_sequence,
                  CASE WHEN kind = 'SSE_TOKEN_EVENT' THEN event_type END AS sse_data,
                  CASE WHEN kind = 'SSE_TOKEN_EVENT' AND event_id % 97 <> 0 THEN toks END
                    AS token_delta_count,
                  CASE WHEN kind <> 'REQUEST_TERMINAL' THEN NULL WHEN event_id % 89 = 0 THEN 'FAILED'
                       WHEN event_type = 'error' THEN 'FAILED' WHEN event_type <> 'signup' THEN 'SUCCESS'
                       WHEN blk % 5 = 0 THEN 'CANCELLED' ELSE 'TIMEOUT' END AS terminal_class,
                  CASE WHEN kind <> 'REQUEST_TERMINAL' THEN NULL WHEN event_type = 'error' THEN 'HTTP_STATUS'
                       WHEN event_type <> 'signup' THEN NULL WHEN blk % 5 = 0 THEN 'CANCELLED'
                       ELSE 'TIMEOUT' END AS failure_kind
           FROM (SELECT *, 0 AS kind_rank, 'CLIENT_REQUEST_STARTED' AS kind FROM be WHERE pos = 0
                 UNION ALL SELECT *, 1, 'CLIENT_REQUEST_STARTED' FROM be
                   WHERE pos = 0 AND user_id % 41 = 0 AND blk = 2
                 UNION ALL SELECT *, 2, 'SSE_TOKEN_EVENT' FROM be WHERE token_bearing
                 UNION ALL SELECT *, 2, 'SSE_COMMENT' FROM be WHERE pos > 0 AND pos < n - 1 AND toks = 0
                 UNION ALL SELECT *, 3, 'SSE_DONE' FROM be
                   WHERE pos = n - 1 AND event_type NOT IN ('error', 'signup')
                 UNION ALL SELECT *, 4, 'REQUEST_TERMINAL' FROM be WHERE pos = n - 1
                 UNION ALL SELECT *, 5, 'CLIENT_REQUEST_ENDED' FROM be
                   WHERE pos = n - 1 AND NOT (user_id % 37 = 0 AND blk = 1))""",
    ),
    "seq": (
        ("sev",),
        """SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY off_ns, kind_rank, request_id, pos) - 1
                    AS sequence FROM sev""",
    ),
    "srv": (
        ("be",),
        """SELECT run_id, request_id, kind, off_ns,
                  CASE WHEN kind = 'SSE_TOKEN_EVENT_SENT' THEN toks END AS token_delta_count
           FROM (SELECT *, 'REQUEST_ACCEPTED' AS kind FROM be WHERE pos = 0
                 UNION ALL SELECT *, 'RESPONSE_HEADERS_SENT' FROM be WHERE pos = 1
                 UNION ALL SELECT *, 'SSE_TOKEN_EVENT_SENT' FROM be WHERE token_bearing
                 UNION ALL SELECT *, 'SSE_COMMENT_SENT' FROM be WHERE pos > 0 AND pos < n - 1 AND toks = 0
                 UNION ALL SELECT *, CASE event_type WHEN 'error' THEN 'HTTP_ERROR_SENT'
                     WHEN 'signup' THEN 'STALL_STARTED' ELSE 'SSE_DONE_SENT' END FROM be WHERE pos = n - 1
                 UNION ALL SELECT *, 'REQUEST_HANDLER_ENDED' FROM be WHERE pos = n - 1)""",
    ),
}


def rules_sql(source: str, keys: str, rules: dict[str, str]) -> str:
    """Bad rows of ``source`` with the names of their false rules, in declared order."""
    cases = ", ".join(f"CASE WHEN NOT ({rule}) THEN '{name}' END" for name, rule in rules.items())
    return f"""SELECT {keys}, array_to_string(v, ',') AS violations
        FROM (SELECT {keys}, [x FOR x IN [{cases}] IF x IS NOT NULL] AS v FROM {source})
        WHERE len(v) > 0"""


def sql(needs: str, body: str) -> str:
    """``WITH`` the named CTEs (and what they need), then ``body``."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in CTES[name][0]:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in needs.split():
        add(name)
    head = ",\n".join(f"{name} AS ({CTES[name][1]})" for name in ordered)
    body = body.strip()
    if not head:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def percentile_sql(source: str, keys: str, value: str) -> str:
    """Type 7 from order statistics, for the three reported percentiles."""
    picks = []
    for name, p in (("p50", "0.5"), ("p95", "0.95"), ("p99", "0.99")):
        h = f"((n - 1) * CAST({p} AS DOUBLE))"
        lo = f"max(v) FILTER (WHERE i = floor{h})"
        hi = f"max(v) FILTER (WHERE i = ceil{h})"
        frac = f"(max{h} - floor(max{h}))"
        picks.append(f"{lo} + {frac} * ({hi} - {lo}) AS {name}")
    return f"""SELECT {keys}, max(n) AS sample_count, {', '.join(picks)}
        FROM (SELECT {keys}, v, count(*) OVER (PARTITION BY {keys}) AS n,
                     row_number() OVER (PARTITION BY {keys} ORDER BY v) - 1 AS i
              FROM (SELECT {keys}, CAST({value} AS DOUBLE) AS v FROM {source})
              WHERE v IS NOT NULL)
        GROUP BY {keys}"""


def by_user(query: str) -> str:
    """The same oracle with one run per user."""
    return query.replace("user_id % 4 AS run_id", "user_id AS run_id")
