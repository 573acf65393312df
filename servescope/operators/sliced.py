"""Ordered computations over keys of any size.

A window over ``run_id`` alone puts a whole run into one task, and one run may hold a third of all
rows, all of them within one second. A counting pass finds such keys. Their rows are dealt by a range
exchange over (key, order): Spark samples the order and sets bounds of equal depth, whatever the clock
does, so a slice holds about ``slice_rows`` rows and ties of the clock are cut by the order's further
columns. The dealt rows are written once, so that every pass sees the same slices. What a slice needs
from the slices before it is one small value, aggregated per (key, slice), carried along the slices of
the key and joined back. Every other key is one window and costs one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from servescope.session import cut

HOT_ROWS = 4_194_304
SLICE_ROWS = 1_048_576
_UPTO = (Window.unboundedPreceding, Window.currentRow)


def hot_keys(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Keys with more than ``rows`` rows; whether the list is broadcast is left to its measured size."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    return counted.where(F.col("__rows") > rows).select(*keys)


class SlicedOrder:
    """The rows of each key (columns ``keys``) in the order of the columns ``order``, nulls first."""

    def __init__(
        self, keys: Sequence[str], order: Sequence[str], hot_rows: int = HOT_ROWS, slice_rows: int = SLICE_ROWS
    ):
        self.keys = list(keys)
        self.order = list(order)
        self.hot_rows = hot_rows
        self.slice_rows = slice_rows

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """The rows of ordinary keys, and those of hot keys with their ``__slice`` (None without any)."""
        hot = df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > self.hot_rows)
        total = hot.agg(F.sum("__rows")).first()[0]
        if not total:
            return df, None
        named = cut(hot).select(*[F.col(k).alias(f"__hot_{k}") for k in self.keys])
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__hot_{k}")) for k in self.keys])
        kept = cut(df)
        dealt = (
            kept.join(named, same, "left_semi")
            .repartitionByRange(-(-total // self.slice_rows), *self.keys, *self.order)
            .withColumn("__slice", F.spark_partition_id())
        )
        return kept.join(named, same, "left_anti"), cut(dealt)

    def _carry(
        self,
        df: DataFrame,
        value: Column | None,
        local: Callable[[WindowSpec], Column],
        summary: Column,
        carried: Callable[[WindowSpec], Column],
        combine: Callable[[Column, Column], Column],
        out: str,
    ) -> DataFrame:
        columns = [F.col(c) for c in df.columns]
        valued = df if value is None else df.withColumn("__value", value)
        cold, hot = self.split(valued)
        plain = cold.select(*columns, local(Window.partitionBy(*self.keys).orderBy(*self.order)).alias(out))
        if hot is None:
            return plain
        on = [*self.keys, "__slice"]
        before = (
            Window.partitionBy(*self.keys)
            .orderBy("__slice")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carries = hot.groupBy(*on).agg(summary.alias("__summary")).select(
            *[F.col(k).alias(f"__of_{k}") for k in on], carried(before).alias("__carry")
        )
        inside = Window.partitionBy(*on).orderBy(*self.order)
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in on])
        joined = hot.withColumn("__local", local(inside)).join(carries, same)
        return plain.unionByName(joined.select(*columns, combine(F.col("__local"), F.col("__carry")).alias(out)))

    def running_sum(self, df: DataFrame, value: Column, out: str) -> DataFrame:
        """Sum of ``value`` up to and including the row."""
        return self._carry(
            df,
            value,
            lambda w: F.sum("__value").over(w.rowsBetween(*_UPTO)),
            F.sum("__value"),
            lambda w: F.sum("__summary").over(w),
            lambda local, carry: local + F.coalesce(carry, F.lit(0)),
            out,
        )

    def rank(self, df: DataFrame, out: str) -> DataFrame:
        """Position in the key's order, from 1."""
        return self._carry(
            df,
            None,
            lambda w: F.row_number().over(w).cast("long"),
            F.count(F.lit(1)),
            lambda w: F.sum("__summary").over(w),
            lambda local, carry: local + F.coalesce(carry, F.lit(0)),
            out,
        )

    def running_max(self, df: DataFrame, value: Column, out: str) -> DataFrame:
        return self._carry(
            df,
            value,
            lambda w: F.max("__value").over(w.rowsBetween(*_UPTO)),
            F.max("__value"),
            lambda w: F.max("__summary").over(w),
            lambda local, carry: F.greatest(local, carry),
            out,
        )

    def last_known(self, df: DataFrame, value: Column, out: str) -> DataFrame:
        """The latest non-null ``value`` at or before the row."""
        order = F.struct(*self.order)
        return self._carry(
            df,
            value,
            lambda w: F.last("__value", ignorenulls=True).over(w.rowsBetween(*_UPTO)),
            F.max_by("__value", F.when(F.col("__value").isNotNull(), order)),
            lambda w: F.last("__summary", ignorenulls=True).over(w),
            lambda local, carry: F.coalesce(local, carry),
            out,
        )

    def previous(self, df: DataFrame, columns: Mapping[str, str | Column]) -> DataFrame:
        """Columns of the row just before, as ``{new name: column}``; null on the first row."""
        picked = F.struct(*[F.col(c).alias(n) if isinstance(c, str) else c.alias(n)
                            for n, c in columns.items()])
        joined = self._carry(
            df,
            picked,
            lambda w: F.lag("__value").over(w),
            F.max_by("__value", F.struct(*self.order)),
            lambda w: F.last("__summary").over(w),
            lambda local, carry: F.coalesce(local, carry),
            "__previous",
        )
        return joined.select(
            *[F.col(c) for c in df.columns],
            *[F.col(f"__previous.{name}").alias(name) for name in columns],
        )
