"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and share 150 % of all words;
a source stops at twice its words, and what it leaves is shared by weight among the others until none is
above. In the limit every target is ``min(2 size, level x weight)``, so the level is found by one pass
over sources ordered by ``size / weight``.

Blocks: the documents of a source are shuffled by a hash, laid end to end and cut into blocks of equal
numbers of words, ``BLOCK`` at most. Slots: the i-th slot is the i-th point of the golden-ratio sequence,
mapped through the cumulative shares of slots to a source, and the slots of a source are ranked. The
r-th slot of a source takes its block r modulo the number of its blocks, so the schedule decides which
words stand where in the mix, and every stretch of it is near the targets. A source whose slots fall
short by the discrepancy gets the missing ones at the end (slots of the same number, ordered by source and
rank), one that has too many drops its last, and its last block is cut at the target, so each source takes
its target rounded to a word. No block is taken
more than twice, so no document is.

Running sums within a source are cut into ranges of the hash, and those over slots into ranges of the
index, so a source with a third of all rows is spread over tasks. Windows over a whole source see one row
per range; those over sources one row per source. All of it is DataFrame work.

Null or wordless texts have size 0 and take 0. Null sources are one source, the last. Rows with a null or
repeated id are documents of their own; those of equal id and size are laid in any order. Texts of any
length are counted whole. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from servescope.session import cut

WEIGHTS = (3, 1, 2)
BLOCK = 4096
RANGES = 1024
SLOT_RANGE = 65_536
CELLS = 1024
# an odd number next to 2^31 over the golden ratio: multiples modulo 2^31 visit every point once
_PERIOD, _GOLDEN = 2**31, 1_327_217_885
_UPTO = (Window.unboundedPreceding, Window.currentRow)


def source_targets(sizes: DataFrame, percent: int = 150) -> DataFrame:
    """``source, source_size, target`` of ``sizes(source, size)``."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = "CASE (i - 1) % 3 " + " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(WEIGHTS)) + " END"
    weighed = totals.withColumn("i", F.row_number().over(order)).withColumn("w", F.expr(weights))
    filling = Window.orderBy(F.expr("source_size / w"), "i")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    levels = weighed.select(
        "source", "source_size", "w",
        (F.sum("source_size").over(everything) * percent / 100).alias("total"),
        F.coalesce(F.sum("source_size").over(before) * 2, F.lit(0)).alias("full"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("open"))
    # the first source in the filling order that its level does not fill sets the level of the rest
    level = F.expr("(total - full) / open")
    first = F.min(F.when(level <= F.expr("2 * source_size / w"), F.struct("full", level.alias("level")))).over(everything)
    return levels.withColumn("found", first).select(
        "source", "source_size", F.expr("CAST(coalesce(least(2 * source_size, w * found.level), 0) AS DOUBLE)").alias("target"))


def _laid_out(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every document with its place (``start``, ``end`` in words) in its source, and the targets."""
    sizes = cut(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.expr(r"CAST(coalesce(regexp_count(text, '[^\\x20\\x09-\\x0D]+'), 0) AS BIGINT)").alias("size")).withColumn(
        "h", F.expr("xxhash64(doc_id, size)")))
    targets = cut(source_targets(sizes).withColumn("blocks", F.expr(f"greatest(1L, (source_size + {BLOCK - 1}) div {BLOCK})")).withColumn(
        "words", F.expr("CAST(round(target) AS BIGINT)")).withColumn(
        "slots", F.expr("CASE WHEN source_size = 0 THEN 0L ELSE CAST(ceil(words * blocks / source_size) AS BIGINT) END")).withColumn(
        "key", F.expr("coalesce(source, '')")).withColumn("none", F.col("source").isNull()))

    on = ["key", "none", "range"]
    placed = sizes.select("*", F.coalesce("source", F.lit("")).alias("key"), F.col("source").isNull().alias("none"),
                          F.expr(f"CAST(pmod(shiftright(h, 40), {RANGES}) AS INT)").alias("range"))
    ranges = placed.groupBy(*on).agg(F.sum("size").alias("here")).select(*on, F.coalesce(F.sum("here").over(
        Window.partitionBy("key", "none").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*on).orderBy("h", "doc_id", "size").rowsBetween(*_UPTO)
    laid = placed.withColumn("upto", F.sum("size").over(inside)).join(ranges, on).join(
        targets.select("key", "none", "source_size", "target", "blocks"), ["key", "none"]).withColumn(
        "end", F.expr("base + upto")).withColumn("start", F.expr("end - size")).withColumn("row", F.monotonically_increasing_id())
    return cut(laid), targets


def _parts(laid: DataFrame, targets: DataFrame) -> DataFrame:
    """``slot, rank, block, row, doc_id, source, start, end``: the words of each document in each slot."""
    # block b of n covers the words from floor(b L / n) to floor((b + 1) L / n)
    first = "CAST(floor(((start + 1) * CAST(blocks AS DECIMAL(20, 0)) - 1) / source_size) AS BIGINT)"
    last = "CAST(floor((end * CAST(blocks AS DECIMAL(20, 0)) - 1) / source_size) AS BIGINT)"
    pieces = laid.where("size > 0").select(
        "row", "doc_id", "source", "key", "none", "start", "end", F.expr(f"explode(sequence({first}, {last}))").alias("block"))
    return pieces.join(slot_blocks(targets), ["key", "none", "block"]).select(
        "slot", "rank", "block", "row", "doc_id", "source", F.expr("greatest(start, block_start) - start").alias("from"),
        F.expr("least(end, block_start + taken) - start").alias("to")).where("to > from").selectExpr(
        "slot", "rank", "block", "row", "doc_id", "source", "from AS start", "to AS end")


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself, ``slot, rank, block, source, doc_id, start, end``: slots in the order of the schedule,
    each with one block of its source, as the words from ``start`` to ``end`` of documents."""
    return _parts(*_laid_out(docs)).select("slot", "rank", "block", "source", "doc_id", "start", "end")


def mixed(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, slots`` per row of ``docs(doc_id, text, source)``;
    ``slots`` lists where the document's words stand in the mix, at most twice each."""
    laid, targets = _laid_out(docs)
    sums = _parts(laid, targets).groupBy("row").agg(
        F.sum(F.expr("end - start")).alias("taken"), F.sort_array(F.collect_list(F.struct("slot", "rank", "start", "end"))).alias("slots"))
    nowhere = F.array().cast("array<struct<slot:bigint,rank:bigint,start:bigint,end:bigint>>")
    return laid.join(sums, "row", "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"),
        F.coalesce("slots", nowhere).alias("slots"))


def schedule(targets: DataFrame) -> DataFrame:
    """``slot, key, none, rank``: which source each slot takes, and its place among the source's slots.

    ``targets(key, none, slots)``. A slot's point falls into one of ``CELLS`` cells; a source is listed in
    the cells it touches, so the lookup is an equi join on cells of equal size.
    """
    total = targets.agg(F.sum("slots")).first()[0] or 0
    upto = Window.orderBy("none", "key").rowsBetween(*_UPTO)
    shares = targets.where("slots > 0").select("key", "none", "slots", F.sum("slots").over(upto).alias("upto")).select(
        "key", "none", "slots", F.expr(f"(upto - slots) / {max(total, 1)}D").alias("low"), F.expr(f"upto / {max(total, 1)}D").alias("high"))
    cells = shares.select("key", "none", "low", "high", F.expr(
        f"explode(sequence(CAST(floor(low * {CELLS}) AS INT), CAST(least(floor(high * {CELLS}), {CELLS - 1}) AS INT)))").alias("cell"))
    points = targets.sparkSession.range(total).select(
        F.col("id").alias("slot"), F.expr(f"((id % {_PERIOD}L) * {_GOLDEN}L) % {_PERIOD}L / {_PERIOD}D").alias("u"))
    picked = points.withColumn("cell", F.expr(f"CAST(floor(u * {CELLS}) AS INT)")).join(cells, "cell").where(
        "u >= low AND u < high").select("slot", "key", "none", F.expr(f"slot div {SLOT_RANGE}L").alias("range"))
    on = ["key", "none", "range"]
    before = picked.groupBy(*on).agg(F.count(F.lit(1)).alias("here")).select(*on, F.coalesce(F.sum("here").over(
        Window.partitionBy("key", "none").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    ranked = picked.withColumn("local", F.row_number().over(Window.partitionBy(*on).orderBy("slot"))).join(before, on).select(
        "slot", "key", "none", F.expr("base + local - 1").alias("rank"))
    got = ranked.groupBy("key", "none").agg(F.count(F.lit(1)).alias("got"))
    short = targets.join(got, ["key", "none"], "left").where("coalesce(got, 0) < slots").select(
        F.lit(total).cast("long").alias("slot"), "key", "none", F.expr("explode(sequence(coalesce(got, 0), slots - 1))").alias("rank"))
    return ranked.join(targets.select("key", "none", "slots"), ["key", "none"]).where("rank < slots").select(
        "slot", "key", "none", "rank").unionByName(short)


def slot_blocks(targets: DataFrame) -> DataFrame:
    """``slot, key, none, rank, block, block_start, taken``: the block of each slot, and its words from the
    start; the slot in which a source reaches its target takes only what is left."""
    edges = lambda b: f"CAST(floor({b} * CAST(source_size AS DECIMAL(20, 0)) / blocks) AS BIGINT)"
    slots = schedule(targets.select("key", "none", "slots")).join(
        targets.select("key", "none", "blocks", "source_size", "words"), ["key", "none"]).withColumn("block", F.expr("rank % blocks"))
    framed = slots.withColumn("block_start", F.expr(edges("block"))).withColumn("block_end", F.expr(edges("(block + 1)")))
    # the words of all slots of the source before this one are known from its rank
    left = "words - ((rank div blocks) * source_size + block_start)"
    return framed.select(
        "slot", "key", "none", "rank", "block", "block_start",
        F.expr(f"greatest(0L, least({left}, block_end - block_start))").alias("taken"))
