"""Column helpers used inside the jobs: identities, markers, headers, paths, JSON shape, clocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed patterns: tokens of HTTP fields, and the synthetic input and output markers.
TOKEN = "[!#$%&'*+.^_`|~0-9A-Za-z-]+"
QUOTED = '"(?:[^"\\\\\\x00-\\x08\\x0A-\\x1F\\x7F]|\\\\[^\\x00-\\x08\\x0A-\\x1F\\x7F])*"'
OUTPUT_MARKER = "<t[0-9]{3}>"
INPUT_MARKER = "<p[0-9]{3}>"


def canonical_text(df: DataFrame, fields: Sequence[str]) -> Column:
    """Compact JSON with sorted keys and nulls kept; doubles as fixed-scale text, no negative zero.

    Null for a row with a non-finite double. Naive timestamps are refused while planning.
    """
    shown, bad = [], F.lit(False)
    for name in sorted(fields):
        kind = df.schema[name].dataType
        column = F.col(name)
        if isinstance(kind, T.TimestampNTZType):
            raise ValueError(f"naive timestamp in a canonical identity: {name}")
        if isinstance(kind, T.TimestampType):
            column = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            bad = bad | F.coalesce(F.isnan(column) | (F.abs(column) == float("inf")), F.lit(False))
            column = F.when(column == 0, F.lit("0.000000000")).otherwise(
                column.try_cast("decimal(38,9)").cast("string")
            )
        shown.append(column.alias(name))
    text = F.to_json(F.struct(*shown), {"ignoreNullFields": "false"})
    return F.when(~bad, text)


def content_identity(df: DataFrame, fields: Sequence[str]) -> Column:
    return F.sha2(canonical_text(df, fields), 256)


def self_hash_holds(df: DataFrame, fields: Sequence[str], stored: str) -> Column:
    return F.col(stored).eqNullSafe(content_identity(df, fields))


def marker_count(text: str, marker: str = OUTPUT_MARKER) -> Column:
    """Tokens in a text that is nothing but markers; null for any other text."""
    exact = F.col(text).rlike(f"^(?:{marker})+$") & ~F.contains(text, F.lit("\n"))
    return F.when(exact, F.size(F.regexp_extract_all(text, F.lit(marker), F.lit(0))).cast("long"))


def content_type(column: str) -> dict[str, Column]:
    """Media type and parameters of a Content-Type value; ``malformed`` where the grammar fails.

    A parameter value is a token or a quoted string; names may not repeat.
    """
    parameter = f"[ \\t]*{TOKEN}[ \\t]*=[ \\t]*(?:{TOKEN}|{QUOTED})[ \\t]*"
    whole = f"^[ \\t]*{TOKEN}/{TOKEN}[ \\t]*(?:;{parameter})*$"
    pairs = f";[ \\t]*({TOKEN})[ \\t]*=[ \\t]*({TOKEN}|{QUOTED})"
    names = F.transform(F.regexp_extract_all(column, F.lit(pairs), F.lit(1)), F.lower)
    values = F.regexp_extract_all(column, F.lit(pairs), F.lit(2))
    ok = F.col(column).rlike(whole) & (F.size(F.array_distinct(names)) == F.size(names))
    media = F.lower(F.regexp_extract(column, f"^[ \\t]*({TOKEN}/{TOKEN})", 1))
    shown = F.array_join(F.zip_with(names, values, lambda n, v: F.concat(n, F.lit("="), v)), ";")
    return {
        "malformed": ~F.coalesce(ok, F.lit(False)),
        "media_type": F.when(ok, media),
        "parameters": F.when(ok, shown),
    }


def header_effective(headers: DataFrame, message: str = "message_id") -> DataFrame:
    """The one value of each header name; null and MISSING_OR_AMBIGUOUS where it is not one."""
    return headers.groupBy(message, "normalized_name").agg(
        F.count(F.lit(1)).alias("copies"),
        F.when(F.count(F.lit(1)) == 1, F.max("normalized_value")).alias("effective_value"),
    )


def unsafe_path(path: str) -> Column:
    """Absolute, empty, or with an empty, ``.`` or ``..`` part."""
    parts = F.split(path, "/")
    return (F.col(path) == "") | F.arrays_overlap(parts, F.array(F.lit(""), F.lit("."), F.lit("..")))


def json_has_duplicate_keys(column: str) -> Column:
    """A field name repeated in one object at any depth; null for broken JSON. A variant takes no repeats."""
    return F.when(F.get_json_object(column, "$").isNotNull(), F.try_parse_json(column).isNull())


def exact_keys(column: str, names: Sequence[str]) -> Column:
    """The object has exactly these field names."""
    keys = F.array_sort(F.json_object_keys(column))
    return F.coalesce(keys == F.array(*[F.lit(n) for n in sorted(names)]), F.lit(False))


def metrics_shape(column: str, names: Sequence[str]) -> Column:
    """Exactly the named metrics, each null or a finite number >= 0."""
    values = F.map_values(F.from_json(column, "map<string,double>"))
    fine = F.forall(values, lambda v: v.isNull() | (~F.isnan(v) & (v >= 0) & (v < float("inf"))))
    return exact_keys(column, names) & F.coalesce(fine, F.lit(False))


def utc_audit(started: str, ended: str) -> Column:
    """Both audit stamps carry a zero offset and the end is not before the start."""
    zero = "(Z|[+]00:00)$"
    return (
        F.when(~F.col(started).rlike(zero) | ~F.col(ended).rlike(zero), "NOT_UTC")
        .when(F.try_to_timestamp(started).isNull() | F.try_to_timestamp(ended).isNull(), "NOT_A_TIME")
        .when(F.try_to_timestamp(ended) < F.try_to_timestamp(started), "END_BEFORE_START")
        .otherwise("OK")
    )

