"""Benchmark items inside documents: size-partitioned MinHash containment search, then exact containment.

Items are partitioned by their number of five-word shingles (upper bounds 16, 64, 256, ...). An item's
sketch is its bottom-k MinHash: the k smallest shingle hashes. A document that holds at least the share
t of an item misses at most (1 - t) n of its shingles, so with k = floor((1 - t) n) + 1 one sketch
hash is always in the document. Each partition takes k from its upper bound, up to ``SKETCH``; beyond
that an item at t = 0.75 is missed with odds of at most 0.25^64. Documents keep their whole shingle
set, so their length does not dilute the similarity. A candidate counts if the exact share of the
item's shingles that the whole document holds is at least t.

Items are a stated query set: they come to the driver in blocks of at most ``BLOCK`` shingles (16 MB),
each block is one pass over all documents, and there is no limit on the number of blocks.

An item of fewer than five words is one shingle, its whole sequence, and is found only in a document
that is that sequence. Null, empty or wordless texts on either side match nothing. Repeated rows on
either side give repeated pairs; null ids are carried as they are. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servescope.llm.words import pieces, shingle_sets

SKETCH = 64
BLOCK = 2_000_000
_BITS = 20


def contained_items(docs: DataFrame, items: DataFrame, percent: int = 75, block: int = BLOCK) -> DataFrame:
    """``doc_id, item_id, n_item, n_shared`` for every item of which a document holds ``percent`` or more."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _item_sets, "item_id long, hashes binary")
    out = "doc_id long, item_id long, n_item long, n_shared long"
    passes = [docs.mapInArrow(_search(docs.sparkSession.sparkContext.broadcast(part), percent), out)
              for part in _blocks(sets, block)]
    found = docs.sparkSession.createDataFrame([], out)
    for one in passes:
        found = found.union(one)
    return found


def _item_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = [s.tobytes() for s in shingle_sets(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(hashes, pa.binary())], names=["item_id", "hashes"])


def _blocks(sets: DataFrame, block: int) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    part: list[tuple[int | None, np.ndarray]] = []
    size = 0
    for row in sets.where("length(hashes) > 0").toLocalIterator():
        hashes = np.frombuffer(bytes(row.hashes), np.uint64)
        if part and size + len(hashes) > block:
            yield part
            part, size = [], 0
        part.append((row.item_id, hashes))
        size += len(hashes)
    if part:
        yield part


def sketch_size(n: int, percent: int) -> int:
    """Sketch hashes for an item of ``n`` shingles, from the upper bound of its size partition."""
    upper = 16
    while upper < n:
        upper *= 4
    return min(n, SKETCH, (100 - percent) * upper // 100 + 1)


def _search(held, percent: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = held.value
        sizes = [sketch_size(len(h), percent) for _, h in items]
        # shingle sets are sorted, so the first hashes are the smallest
        sketch = np.concatenate([h[:k] for (_, h), k in zip(items, sizes)])
        owner = np.repeat(np.arange(len(items)), sizes)
        order = np.argsort(sketch, kind="stable")
        sketch, owner = sketch[order], owner[order]
        maybe = np.zeros(1 << _BITS, bool)
        maybe[sketch & np.uint64((1 << _BITS) - 1)] = True
        for batch in (piece for whole in batches for piece in pieces(whole)):
            rows: list[tuple[int, int, int, int]] = []
            for at, s in enumerate(shingle_sets(batch.column("text"))):
                s_low = s[maybe[s & np.uint64((1 << _BITS) - 1)]]
                lo, hi = np.searchsorted(sketch, s_low, "left"), np.searchsorted(sketch, s_low, "right")
                for item in sorted({int(owner[j]) for a, b in zip(lo[hi > lo], hi[hi > lo]) for j in range(a, b)}):
                    item_id, h = items[item]
                    shared = int(np.isin(h, s, assume_unique=True).sum())
                    if 100 * shared >= percent * len(h):
                        rows.append((at, item_id, len(h), shared))
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(columns[0], pa.int64())), *[pa.array(c, pa.int64()) for c in columns[1:]]],
                names=["doc_id", "item_id", "n_item", "n_shared"])

    return search
