"""Exact type-7 percentiles; a group of any size never ends up in one task.

Ordinary groups are sorted in one aggregate. A group with more than ``HOT_SAMPLES`` samples takes
two passes: the first counts its samples per bucket (1/65,536 of an octave) and so finds the
buckets that hold the wanted ranks; the second looks only at the samples of these buckets (at most
two per percentile), folded to distinct values with their counts. Both the histogram of a group and
the distinct values of one bucket stay small whatever the group's size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from servescope.operators.sliced import hot_keys

P50_P95_P99 = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
_STEPS = 65_536
HOT_SAMPLES = 1_048_576


def bucket(value: Column, steps: int = _STEPS) -> Column:
    """Monotone in ``value``: octave and position in the octave, mirrored below zero."""
    size = F.abs(value)
    octave = F.floor(F.log2(size))
    step = F.floor((size / F.pow(F.lit(2.0), octave) - 1) * steps)
    # octaves of a double lie in -1074..1023; the shift keeps every key of a positive value positive
    key = (octave + 1100) * steps + step
    return F.when(value == 0, F.lit(0)).when(value > 0, key).otherwise(-key).cast("long")


def exact_percentiles(
    samples: DataFrame,
    keys: Sequence[str],
    value: str,
    percentiles: Mapping[str, float] = P50_P95_P99,
    hot_samples: int = HOT_SAMPLES,
) -> DataFrame:
    """Per key: ``sample_count`` and one column per percentile. Null, infinite and NaN samples are not counted."""
    keys = list(keys)
    rows = samples.select(*keys, F.col(value).cast("double").alias("__v")).where(
        F.abs("__v") < F.lit(float("inf"))
    )
    hot = hot_keys(rows, keys, hot_samples)
    cold = _sorted_groups(rows.join(hot, keys, "left_anti"), keys, percentiles)
    return cold.unionByName(_two_passes(rows.join(hot, keys, "left_semi"), keys, percentiles))


def _sorted_groups(rows: DataFrame, keys: list[str], percentiles: Mapping[str, float]) -> DataFrame:
    """One aggregate over groups of a bounded size."""
    sorted_values = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("__v")).alias("__a"))
    last = F.size("__a") - 1

    def at(rank: Column) -> Column:
        return F.get("__a", rank.cast("int"))

    return sorted_values.select(
        *keys,
        F.size("__a").cast("long").alias("sample_count"),
        *[
            (
                at(F.floor(last * F.lit(p)))
                + (last * F.lit(p) - F.floor(last * F.lit(p)))
                * (at(F.ceil(last * F.lit(p))) - at(F.floor(last * F.lit(p))))
            ).alias(name)
            for name, p in percentiles.items()
        ],
    )


def _two_passes(rows: DataFrame, keys: list[str], percentiles: Mapping[str, float]) -> DataFrame:
    rows = rows.withColumn("__b", bucket(F.col("__v")))
    histogram = rows.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__c"))
    return percentiles_by_bucket(rows, histogram, keys, percentiles)


def percentiles_by_bucket(
    rows: DataFrame, histogram: DataFrame, keys: Sequence[str], percentiles: Mapping[str, float] = P50_P95_P99
) -> DataFrame:
    """Per key of a counted ``histogram(keys, __b, __c)``: the percentiles, read from those of its
    ``rows(keys, __b, __v)`` whose bucket holds a wanted rank."""
    keys = list(keys)
    named = [*keys, "__b"]

    def lower(p: float) -> Column:
        return F.floor((F.col("__n") - 1) * F.lit(p))

    def upper(p: float) -> Column:
        return F.ceil((F.col("__n") - 1) * F.lit(p))

    wanted = F.array_distinct(
        F.array(*[rank for p in percentiles.values() for rank in (lower(p), upper(p))])
    )
    before = (
        Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    )
    hit = (
        histogram.withColumn("__before", F.coalesce(F.sum("__c").over(before), F.lit(0)))
        .withColumn("__n", F.sum("__c").over(Window.partitionBy(*keys)))
        .withColumn(
            "__wanted",
            F.filter(
                wanted,
                lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__c")),
            ),
        )
        .where(F.size("__wanted") > 0)
        .select(*named, "__before", "__n", "__wanted")
    )
    inside = (
        Window.partitionBy(*named).orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    )
    ranked = (
        rows.join(hit, named)
        .groupBy(*named, "__v")
        .agg(
            F.count(F.lit(1)).alias("__c"),
            F.first("__before").alias("__before"),
            F.first("__n").alias("__n"),
            F.first("__wanted").alias("__wanted"),
        )
        .withColumn("__start", F.col("__before") + F.coalesce(F.sum("__c").over(inside), F.lit(0)))
        .withColumn(
            "__rank",
            F.explode(
                F.filter(
                    "__wanted",
                    lambda r: (r >= F.col("__start")) & (r < F.col("__start") + F.col("__c")),
                )
            ),
        )
    )
    columns = [F.max("__n").alias("sample_count")]
    for name, p in percentiles.items():
        columns.append(F.max(F.when(F.col("__rank") == lower(p), F.col("__v"))).alias(f"__lo_{name}"))
        columns.append(F.max(F.when(F.col("__rank") == upper(p), F.col("__v"))).alias(f"__hi_{name}"))
    picked = ranked.groupBy(*keys).agg(*columns)
    n = F.col("sample_count")
    return picked.select(
        *keys,
        "sample_count",
        *[
            (
                F.col(f"__lo_{name}")
                + ((n - 1) * F.lit(p) - F.floor((n - 1) * F.lit(p)))
                * (F.col(f"__hi_{name}") - F.col(f"__lo_{name}"))
            ).alias(name)
            for name, p in percentiles.items()
        ],
    )
