"""Metric expositions (one text per scrape) to one row per sample line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed patterns: a sample line, and one label of a label set.
SAMPLE = r"^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{(.*)\})?\s+(\S+)$"
LABEL = r'([A-Za-z_][A-Za-z0-9_]*)="((?:\\.|[^"\\])*)"'


def read_samples(scrapes: DataFrame, key: str = "scrape_id") -> DataFrame:
    """``key, line_number, metric, labels, value, violation``.

    ``labels`` is an array of (name, value) sorted by name; a bad line keeps its row with the
    reason in ``violation`` and null metric.
    """
    lines = scrapes.select(key, F.posexplode(F.split("exposition_text", "\n")).alias("line_number", "line"))
    lines = lines.where("line <> '' AND NOT startswith(line, '#')")
    parts = lines.select(
        key,
        F.col("line_number").cast("long").alias("line_number"),
        F.col("line").rlike(SAMPLE).alias("__shape"),
        F.regexp_extract("line", SAMPLE, 1).alias("__metric"),
        F.regexp_extract("line", SAMPLE, 2).alias("__labels"),
        F.regexp_extract("line", SAMPLE, 3).alias("__value"),
    )
    whole = F.regexp_extract_all("__labels", F.lit(LABEL), F.lit(0))
    names = F.regexp_extract_all("__labels", F.lit(LABEL), F.lit(1))
    raw = F.regexp_extract_all("__labels", F.lit(LABEL), F.lit(2))
    unescaped = F.transform(
        raw, lambda v: F.get(F.from_json(F.concat(F.lit('["'), v, F.lit('"]')), "array<string>"), F.lit(0))
    )
    joined = F.array_join(whole, ",")
    number = F.col("__value").try_cast("double")
    violation = (
        F.when(~F.col("__shape"), "MALFORMED_SAMPLE")
        .when(number.isNull(), "MALFORMED_VALUE")
        .when(F.isnan(number) | (number < 0) | (number == float("inf")), "NOT_FINITE_OR_NEGATIVE")
        .when((F.col("__labels") != joined) & (F.col("__labels") != F.concat(joined, F.lit(","))), "MALFORMED_LABELS")
        .when(F.size(F.array_distinct(names)) != F.size(names), "DUPLICATE_LABEL")
    )
    labels = F.array_sort(
        F.zip_with(names, unescaped, lambda n, v: F.struct(n.alias("name"), v.alias("value")))
    )
    parsed = parts.select("*", violation.alias("violation"), labels.alias("labels"), number.alias("value"))
    good = F.col("violation").isNull()
    return parsed.select(
        key, "line_number",
        F.when(good, F.col("__metric")).alias("metric"),
        F.when(good, F.col("labels")).alias("labels"),
        F.when(good, F.col("value")).alias("value"),
        "violation",
    )


def exposition_violations(scrapes: DataFrame, key: str = "scrape_id") -> DataFrame:
    """Scrape-level faults: empty or unterminated text, stored hash that differs."""
    reason = (
        F.when(F.coalesce(F.length("exposition_text"), F.lit(0)) == 0, "EMPTY")
        .when(~F.endswith("exposition_text", F.lit("\n")), "NOT_TERMINATED")
        .when(F.sha2("exposition_text", 256) != F.col("sha256"), "HASH_DIFFERS")
    )
    return scrapes.select(key, reason.alias("violation")).where("violation IS NOT NULL")


def label_text(labels: str = "labels"):
    """Sorted labels in their exposition form, as a join key or for display."""
    return F.array_join(
        F.transform(labels, lambda p: F.concat(p["name"], F.lit('="'), p["value"], F.lit('"'))), ","
    )
