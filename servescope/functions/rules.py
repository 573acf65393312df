"""Rule sets: named predicates whose failures become an array of names on the row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = Mapping[str, "str | Column"]


def _column(rule: str | Column) -> Column:
    return F.expr(rule) if isinstance(rule, str) else rule


def failed_rules(rules: Rules) -> Column:
    """Names of the rules that are false on the row; a null predicate does not apply."""
    named = [F.when(~_column(rule), F.lit(name)) for name, rule in rules.items()]
    return F.filter(F.array(*named), lambda name: name.isNotNull())


def check_rules(df: DataFrame, rules: Rules, out: str = "violations") -> DataFrame:
    return df.withColumn(out, failed_rules(rules))


def violation_report(checked: DataFrame, keys: list[str], column: str = "violations") -> DataFrame:
    """Only the bad rows, their violations as sorted-by-declaration text."""
    return checked.where(F.size(column) > 0).select(
        *keys, F.array_join(column, ",").alias(column)
    )


def violation_rows(checked: DataFrame, keys: list[str], column: str = "violations") -> DataFrame:
    """One row per violation."""
    return checked.select(*keys, F.explode(column).alias("rule"))


def clean_rows(checked: DataFrame, column: str = "violations") -> DataFrame:
    return checked.where(F.size(column) == 0).drop(column)
