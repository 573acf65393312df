"""Agreement between record types: orphans, event and case agreement, id groups, limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from servescope.functions.rules import check_rules


def orphans(children: DataFrame, parents: DataFrame, keys: Sequence[str]) -> DataFrame:
    return children.join(parents.select(*keys), list(keys), "left_anti")


# name: predicate over a request joined with the tally of its events
REQUEST_EVENT_RULES = {
    "one-start": "coalesce(starts, 0) = 1",
    "one-terminal": "coalesce(terminals, 0) = 1",
    "one-end": "coalesce(ends, 0) = 1",
    "case-agrees": "odd_case = 0",
    "phase-agrees": "odd_phase = 0",
    "start-not-after-dispatch": "start_ns <= dispatch_ns",
    "terminal-event-at-terminal": "terminal_event_ns = terminal_ns",
    "terminal-not-after-end": "terminal_event_ns <= end_ns",
    "terminal-class-agrees": "event_class = terminal_class",
    "token-deltas-agree": "delta_total = output_tokens",
    "token-events-agree": "delta_events = token_events",
    "done-iff-success": "(coalesce(dones, 0) = 1) = (terminal_class = 'SUCCESS')",
}


def request_event_consistency(requests: DataFrame, events: DataFrame) -> DataFrame:
    """Events are folded per request (map side first), then met with the request once."""
    keyed = events.join(
        requests.select("run_id", "request_id", F.col("case_id").alias("__case"),
                        F.col("phase").alias("__phase")),
        ["run_id", "request_id"],
    )
    kind = F.col("kind")

    def at(name: str):
        return F.when(kind == name, F.col("off_ns"))

    tally = keyed.groupBy("run_id", "request_id").agg(
        F.count_if(kind == "CLIENT_REQUEST_STARTED").alias("starts"),
        F.count_if(kind == "REQUEST_TERMINAL").alias("terminals"),
        F.count_if(kind == "CLIENT_REQUEST_ENDED").alias("ends"),
        F.count_if(kind == "SSE_DONE").alias("dones"),
        F.count_if(F.col("case_id") != F.col("__case")).alias("odd_case"),
        F.count_if(F.col("phase") != F.col("__phase")).alias("odd_phase"),
        F.min(at("CLIENT_REQUEST_STARTED")).alias("start_ns"),
        F.max(at("REQUEST_TERMINAL")).alias("terminal_event_ns"),
        F.max(at("CLIENT_REQUEST_ENDED")).alias("end_ns"),
        F.max(F.when(kind == "REQUEST_TERMINAL", F.col("terminal_class"))).alias("event_class"),
        F.coalesce(F.sum("token_delta_count"), F.lit(0)).alias("delta_total"),
        F.count_if(F.col("token_delta_count").isNotNull()).alias("delta_events"),
    )
    return check_rules(requests.join(tally, ["run_id", "request_id"], "left"), REQUEST_EVENT_RULES)


def prompt_agreement(declared: DataFrame, sent: DataFrame, key: str = "case_id") -> DataFrame:
    """Token lists (``declared``, ``sent``) case by case, the cases of one side only included."""
    both = declared.select(key, "declared").join(sent.select(key, "sent"), key, "full_outer")
    status = (
        F.when(F.col("sent").isNull(), "NOT_SENT")
        .when(F.col("declared").isNull(), "NOT_DECLARED")
        .when(F.col("declared") == F.col("sent"), "AGREES")
        .otherwise("DIFFERS")
    )
    return both.select(
        key, F.array_size("declared").cast("long").alias("declared_tokens"), F.array_size("sent").cast("long").alias("sent_tokens"),
        (status == "AGREES").alias("agrees"), status.alias("status"))


def case_agreement(left: DataFrame, right: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Case by case: only on one side, or the fields that differ. Agreeing cases are dropped."""
    a = left.select("case_id", F.struct(*fields).alias("l"))
    b = right.select("case_id", F.struct(*fields).alias("r"))
    both = a.join(b, "case_id", "full_outer")
    differs = F.filter(
        F.array(*[F.when(~F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}")), F.lit(f)) for f in fields]),
        lambda x: x.isNotNull(),
    )
    status = (
        F.when(F.col("r").isNull(), "LEFT_ONLY")
        .when(F.col("l").isNull(), "RIGHT_ONLY")
        .when(F.size(differs) > 0, "FIELDS_DIFFER")
    )
    return (
        both.select("case_id", status.alias("status"),
                    F.when(status == "FIELDS_DIFFER", F.array_join(differs, ",")).alias("fields"))
        .where("status IS NOT NULL")
    )


def tag_groups(rows: DataFrame, groups: dict[str, str]) -> DataFrame:
    """``id_group`` of each row by condition, in one pass; a row may belong to several groups."""
    tags = F.filter(
        F.array(*[F.when(F.expr(condition), F.lit(name)) for name, condition in groups.items()]),
        lambda x: x.isNotNull(),
    )
    return rows.withColumn("id_group", F.explode(tags))


def id_overlap(tagged: DataFrame, scope: Sequence[str], id_column: str) -> DataFrame:
    """Ids found in more than one group, or twice in one, within the scope."""
    return (
        tagged.groupBy(*scope, id_column)
        .agg(
            F.count(F.lit(1)).alias("uses"),
            F.array_join(F.array_sort(F.collect_set("id_group")), ",").alias("id_groups"),
        )
        .where("uses > 1")
    )


def set_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only; one shuffle for both directions."""
    tagged = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    return (
        tagged.groupBy(*keys)
        .agg(F.max("l").alias("l"), F.max("r").alias("r"))
        .where("l <> r")
        .select(*keys, F.expr("CASE WHEN l = 1 THEN 'LEFT_ONLY' ELSE 'RIGHT_ONLY' END").alias("side"))
    )


def path_collisions(files: DataFrame, scope: Sequence[str], path: str = "path") -> DataFrame:
    """Paths of one scope that differ only in letter case."""
    distinct = files.select(*scope, path).distinct()
    return (
        distinct.groupBy(*scope, F.lower(path).alias("folded"))
        .agg(F.count(F.lit(1)).alias("spellings"), F.min(path).alias("first_spelling"))
        .where("spellings > 1")
    )


def top_violations(violations: DataFrame, source: str, order: Sequence[str], limit: int = 20) -> DataFrame:
    """The first ``limit`` violations of each source; Spark trims per partition before the shuffle."""
    w = Window.partitionBy(source).orderBy(*order)
    return violations.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def case_order(workloads: DataFrame) -> DataFrame:
    """Per workload (an ordered array ``case_ids``): ids unique, and is the order the sorted one?"""
    return workloads.select(
        "workload",
        F.size("case_ids").cast("long").alias("cases"),
        (F.size(F.array_distinct("case_ids")) == F.size("case_ids")).alias("unique_ids"),
        (F.array_sort("case_ids") == F.col("case_ids")).alias("sorted_ids"),
    )


def server_event_tally(server_events: DataFrame) -> DataFrame:
    """Events by kind and tokens sent, per request."""
    kinds = {
        "REQUEST_ACCEPTED": "accepted",
        "RESPONSE_HEADERS_SENT": "headers",
        "SSE_COMMENT_SENT": "comments",
        "SSE_TOKEN_EVENT_SENT": "token_events",
        "SSE_DONE_SENT": "dones",
        "HTTP_ERROR_SENT": "http_errors",
        "STALL_STARTED": "stalls",
        "REQUEST_HANDLER_ENDED": "ended",
    }
    return server_events.groupBy("run_id", "request_id").agg(
        F.coalesce(F.sum("token_delta_count"), F.lit(0)).alias("tokens_sent"),
        *[F.count_if(F.col("kind") == kind).alias(name) for kind, name in kinds.items()],
    )


def dedup_requests(arrivals: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First arrival of each id, with the number of copies seen."""
    return (
        arrivals.groupBy(*keys)
        .agg(
            F.min(F.struct(*order, *[c for c in arrivals.columns if c not in {*keys, *order}])).alias("f"),
            F.count(F.lit(1)).alias("copies"),
        )
        .select(*keys, "f.*", "copies")
    )
