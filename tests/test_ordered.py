"""Sliced order against plain windows, with slices far smaller than the keys."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from servescope.operators import integrity as ig
from servescope.operators import timeline as tl
from servescope.operators.sliced import SlicedOrder


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    data, i = [], 0
    for key, n in (("hot", 600), ("b", 40), ("c", 1)):
        for _ in range(n):
            data.append((key, rng.randint(0, 900), i, rng.choice([None, rng.randint(-5, 5)])))
            i += 1
    return spark.createDataFrame(data, "k string, at long, id long, v long").cache()


def order():
    return SlicedOrder(["k"], ["at", "id"], hot_rows=100, slice_rows=60)


def window():
    return Window.partitionBy("k").orderBy("at", "id")


def upto():
    return window().rowsBetween(Window.unboundedPreceding, Window.currentRow)


@pytest.mark.parametrize(("sliced", "plain"), [
    (lambda df: order().rank(df, "x"), lambda: F.row_number().over(window())),
    (lambda df: order().running_sum(df, F.coalesce("v", F.lit(0)), "x"),
     lambda: F.sum(F.coalesce("v", F.lit(0))).over(upto())),
    (lambda df: order().running_max(df, F.col("v"), "x"), lambda: F.max("v").over(upto())),
    (lambda df: order().last_known(df, F.col("v"), "x"), lambda: F.last("v", ignorenulls=True).over(upto())),
    (lambda df: order().previous(df, {"x": "id"}), lambda: F.lag("id").over(window())),
])
def test_sliced_equals_plain_window(rows, sliced, plain):
    got = {r.id: r.x for r in sliced(rows).select("id", "x").collect()}
    want = {r.id: r.x for r in rows.select("id", plain().alias("x")).collect()}
    assert got == want


def test_a_run_within_one_instant_is_dealt_evenly(spark):
    # all rows of the hot key share a clock value: the further columns of the order cut it
    rows = spark.range(40_000).selectExpr("if(id % 10 = 0, NULL, 'hot') AS k", "id div 20000 AS at", "id")
    cold, hot = SlicedOrder(["k"], ["at", "id"], hot_rows=3_000, slice_rows=2_000).split(rows)
    depth = [r["count"] for r in hot.groupBy("__slice").count().collect()]
    assert cold.count() == 0 and sum(depth) == 40_000 and len(depth) >= 18 and max(depth) <= 4_000
    got = SlicedOrder(["k"], ["at", "id"], hot_rows=3_000, slice_rows=2_000).rank(rows, "x")
    assert got.where("x <> if(k IS NULL, id div 10, id - id div 10 - 1) + 1").isEmpty()


@pytest.mark.parametrize("hot_rows", [0, 100])
def test_concurrency_puts_terminals_before_dispatches(spark, hot_rows):
    df = spark.createDataFrame([(1, 0, 10), (1, 10, 20), (2, 0, 10), (2, 9, 20)], "run_id long, dispatch_ns long, terminal_ns long")
    got = {r.run_id: (r.max_concurrency, r.positive_overlap) for r in tl.concurrency_by_interval(df, hot_rows, 2).collect()}
    assert got == {1: (1, False), 2: (2, True)}


@pytest.mark.parametrize("hot_rows", [0, 100])
def test_concurrency_by_sequence_names_broken_evidence(spark, hot_rows):
    s, e = "CLIENT_REQUEST_STARTED", "CLIENT_REQUEST_ENDED"
    events = [(1, 0, "a", s), (1, 1, "b", s), (1, 2, "a", e), (1, 3, "c", e), (1, 4, "b", s)]
    df = spark.createDataFrame(events, "run_id long, sequence long, request_id string, kind string")
    row = tl.concurrency_by_sequence(df, hot_rows, 2).first()
    assert (row.max_concurrency, row.duplicate_starts, row.unmatched_ends, row.unfinished) == (2, 1, 1, 1)


def test_sequence_report(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("a", 1), ("a", 4), ("b", 0), ("b", 1)], "k string, n long")
    got = {r.k: r for r in tl.sequence_report(df, ["k"], "n").collect()}
    assert got["b"].contiguous and not got["a"].contiguous
    assert (got["a"].duplicates, got["a"].missing) == (1, 2)


@pytest.mark.parametrize("hot_rows", [0, 100])
def test_as_of_join_takes_the_right_row_at_equal_times(spark, hot_rows):
    left = spark.createDataFrame([("u", 5, "l1"), ("u", 1, "l0"), ("v", 9, "l2")], "k string, at long, name string")
    right = spark.createDataFrame([("u", 2, "r1"), ("u", 5, "r2"), ("v", 10, "r3")], "k string, seen long, scrape string")
    got = {r.name: r.scrape for r in tl.as_of_join(left, right, "k", "at", "seen", hot_rows, 2).collect()}
    assert got == {"l0": None, "l1": "r2", "l2": None}


def test_prompts_of_one_side_are_told(spark):
    declared = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, []), (5, ["x"])], "case_id long, declared array<string>")
    sent = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"]), (3, []), (4, ["z", "y"])], "case_id long, sent array<string>")
    got = {r.case_id: (r.status, r.declared_tokens, r.sent_tokens, r.agrees) for r in ig.prompt_agreement(declared, sent).collect()}
    assert got == {1: ("AGREES", 2, 2, True), 2: ("DIFFERS", 1, 1, False), 3: ("AGREES", 0, 0, True),
                   4: ("NOT_DECLARED", None, 2, False), 5: ("NOT_SENT", 1, None, False)}
