"""Spans of regular-expression matches and their digests, as SQL expressions within a row.

A span is ``struct<kind string, rank int, start long, end long>``: code points, end exclusive;
``rank`` is the place of the kind in its list.
"""

from __future__ import annotations

from collections.abc import Sequence

SPAN = "array<struct<kind:string,rank:int,start:bigint,end:bigint>>"
_RUN = 256


def sql_text(value: str) -> str:
    """A SQL string literal for any pattern."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def running(values: str) -> str:
    """Running sums before each element of an array of bigint, with the total as the last element.

    Runs of 256 are summed one by one and then shifted by what lies before them, so that a text with
    a million matches costs no quadratic copying. ``values`` is bound once, not evaluated for each run.
    """
    part = "aggregate({a}, struct({zero} AS s, array({zero}) AS o), (p, x) -> struct(p.s + x AS s, array_append(p.o, p.s + x) AS o)).o"
    runs = f"transform(sequence(0, greatest(size(vals) - 1, 0) div {_RUN}), c -> slice(vals, c * {_RUN} + 1, {_RUN}))"
    inner = f"transform({runs}, r -> {part.format(a='r', zero='0L')})"
    return (
        f"transform(array({values}), vals -> transform(array({inner}), i -> "
        f"transform(array({part.format(a='transform(i, r -> element_at(r, -1))', zero='0L')}), b -> "
        "concat(flatten(zip_with(slice(i, 1, size(i)), slice(b, 1, size(i)), "
        "(r, before) -> transform(slice(r, 1, size(r) - 1), x -> x + before))), array(element_at(b, -1))))[0])[0])[0]"
    )


def matches(text: str, pattern: str, guard: str = "true") -> str:
    """``array<struct<start, end, found>>`` of all leftmost non-overlapping matches.

    The text between the matches and the matches themselves come from two passes of the same
    pattern; a running sum of their lengths gives the places. Rows without ``guard`` skip both.
    """
    p = sql_text(pattern)
    found = f"regexp_extract_all({text}, {p}, 0)"
    lengths = (f"zip_with(f, slice(split({text}, {p}, -1), 1, size(f)), (m, g) -> "
               "struct(CAST(char_length(g) AS BIGINT) AS gap, CAST(char_length(m) AS BIGINT) AS len))")
    placed = (f"transform(array({lengths}), l -> transform(array({running('transform(l, x -> x.gap + x.len)')}), s -> "
              "zip_with(zip_with(l, slice(s, 1, size(l)), (x, b) -> struct(b + x.gap AS start, b + x.gap + x.len AS end)), f, "
              "(x, m) -> struct(x.start AS start, x.end AS end, m AS found)))[0])[0]")
    empty = "CAST(array() AS array<struct<start:bigint,end:bigint,found:string>>)"
    return f"CASE WHEN {guard} THEN transform(array({found}), f -> CASE WHEN size(f) = 0 THEN {empty} ELSE {placed} END)[0] ELSE {empty} END"


def ordered(spans: str) -> str:
    """By start, then by rank of the kind."""
    return (f"transform(array_sort(transform({spans}, s -> struct(s.start, s.rank, s.end, s.kind))), "
            "s -> struct(s.kind AS kind, s.rank AS rank, s.start AS start, s.end AS end))")


def listed(spans: str) -> str:
    """``kind:start:end`` of ordered spans, comma-joined."""
    return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"


def digest_columns(spans: str, base: Sequence[str]) -> list[str]:
    """Counts per base kind, the digest of the base spans and the list of all, for ``selectExpr``."""
    kinds = ", ".join(f"'{k}'" for k in base)
    counts = [f"CAST(size(filter({spans}, s -> s.kind = '{k}')) AS BIGINT) AS n_{k}" for k in base]
    inner = f"filter({spans}, s -> s.kind IN ({kinds}))"
    return [*counts, f"sha2({listed(inner)}, 256) AS base_sha256", f"{listed(spans)} AS spans"]
