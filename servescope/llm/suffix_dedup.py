"""Repeated strings of at least ``WIDTH`` bytes, by sparse prefix doubling over ranks of start positions.

A string's name doubles inside a task: the name of 2h bytes is made of the names of its halves. Between
tasks Spark sorts (rank, name of a longer string) pairs; a start whose pair is unique leaves, the others
get the pair's place as their new rank, until ``WIDTH`` bytes are reached. One row per byte and round is
20 times the input, so the starts go through the rounds in blocks:

1. Anchor: of the 50-byte strings inside the ``WIDTH`` bytes from a start, the one of the smallest name.
   Equal strings have equal anchors at equal distance, so the starts before one anchor are named by it
   and their distance, and the sort needs one row for a block of up to 128 starts.
2. A block has a core, the bytes that all its strings share, and a hull, the bytes they cover. The rank
   of a block is that of (anchor, block, core): 273 bytes of every string in it are compared. A unique
   core ends all its starts; a repeated hull makes all of them repeats.
3. Blocks with a repeated core and their own hull go on in sub-blocks of 16 starts (385 bytes), and what
   is open then as single starts (400 bytes). A round gets the bytes of one row per different hull.

Names are 64 bits and compared within a rank, so a round adds 64 bits to the comparison; different strings
of one rank meet with odds of 2^-64 a pair. No group is gathered: ranks and counts are aggregates with
map-side combine, and rows meet their rank in joins that Spark can split. A text is read in pieces of
``PIECE`` bytes.

Null or empty text: 0 bytes, nothing removed. Rows of equal id and text are treated alike, and each is a
repeat of the other; a null id is an id. Texts of any length are read whole; other columns are ignored;
an empty table gives an empty result. There are no ties: a start is a repeat or not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servescope.session import cut

WIDTH = 400
ANCHOR = 50
BLOCKS = (128, 16, 1)
PIECE = 1 << 17
_U = np.uint64
_A, _B = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_PLACE = _U((1 << 24) - 1)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of two names in this order."""
    h = a * _A
    h += b
    h ^= h >> _U(29)
    h *= _B
    h ^= h >> _U(32)
    return h


class Names:
    """Names of the strings of a buffer, doubled from 1 to 256 bytes."""

    def __init__(self, data: np.ndarray):
        self.by = {1: (data.astype(_U) + _U(1)) * _A}
        k = 1
        while 2 * k <= min(len(data), 256):
            self.by[2 * k] = pair(self.by[k][:-k], self.by[k][k:])
            k *= 2

    def of(self, at: np.ndarray, length: int) -> np.ndarray:
        """Of the strings of ``length`` bytes at ``at``."""
        name, done = None, 0
        for k in (256, 128, 64, 32, 16, 8, 4, 2, 1):
            while done + k <= length:
                part = self.by[k][at + done]
                name, done = part if name is None else pair(name, part), done + k
        return name

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of strings of 256 to 768 bytes, each by its length."""
        length = end - start
        ends = pair(self.by[256][start], self.by[256][end - 256])
        return pair(pair(ends, self.by[256][start + (length - 256) // 2]), length.astype(_U))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    w = 1
    while 2 * w <= width:
        values, w = np.minimum(values[:-w], values[w:]), 2 * w
    return np.minimum(values[: len(values) - (width - w)], values[width - w :])


def anchors(names: Names) -> tuple[np.ndarray, np.ndarray]:
    """For every start of a buffer the place of its anchor, and the names of all 50-byte strings."""
    n = len(names.by[1]) - ANCHOR + 1
    short = names.of(np.arange(n), ANCHOR)
    # the place in the low bits lets the first of equals win
    marked = (short & ~_PLACE) | np.arange(n, dtype=_U)
    return (_sliding_least(marked, WIDTH - ANCHOR + 1) & _PLACE).astype(np.int64), short


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the runs in which no column changes."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(new)) - 1


def blocks_of(names: Names, start: np.ndarray, away: np.ndarray, group: np.ndarray, size: int):
    """Blocks of starts that lie ``away`` bytes before their anchor, in runs of one ``group``: index of
    the first and last start, number of the block, names of core and hull."""
    block = away // size
    first, last = _runs(group, start + away, block, start - np.arange(len(start)))
    anchor = start[first] + away[first]
    core = names.of(anchor - block[first] * size, WIDTH - size + 1)
    hull = names.between(start[first], start[last] + WIDTH) if size > 1 else core
    # a hull is told apart by where it lies in the block, too
    return first, last, block[first], core, pair(hull, away[first].astype(_U))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def first_blocks(texts: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """Pieces of (row, start, starts, away, class, hull) over all texts."""
    whole = pa.concat_arrays([texts.cast(pa.large_binary()).fill_null(b"")])
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)
    for low in range(int(offsets[0]), int(offsets[-1]) - WIDTH + 1, PIECE):
        high = min(low + PIECE + WIDTH - 1, int(offsets[-1]))
        start = np.arange(high - low - WIDTH + 1)
        row = np.searchsorted(offsets, start + low, "right") - 1
        fits = start + low + WIDTH <= offsets[row + 1]
        if not fits.any():
            continue
        names = Names(data[low:high])
        anchor, short = anchors(names)
        start, row = start[fits], row[fits]
        away = anchor[start] - start
        first, last, block, core, hull = blocks_of(names, start, away, row, BLOCKS[0])
        cls = pair(pair(short[anchor[start[first]]], core), block.astype(_U))
        yield row[first], start[first] + low - offsets[row[first]], last - first + 1, away[first], cls, hull


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, id, h, text``: equal (id, h) means equal id and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).selectExpr(
        "doc_id", "coalesce(doc_id, 0L) AS id", "xxhash64(text, doc_id IS NULL) AS h", "text")


def _packed(keyed: DataFrame, *others: str) -> DataFrame:
    """Texts as compressed bytes, since they move twice."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            texts = [(v.as_buffer() if v.is_valid else pa.py_buffer(b"")) for v in batch.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in (*others, "id", "h")], pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary())], names=[*others, "id", "h", "n_bytes", "body"])

    head = ", ".join(f"{c} long" for c in (*others, "id", "h", "n_bytes"))
    return keyed.select(*others, "id", "h", "text").mapInArrow(pack, f"{head}, body binary")


def _unpack(body, size: int) -> bytes:
    return pa.Codec("zstd").decompress(body.as_buffer(), size, asbytes=True) if size else b""


def _classes(docs: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, cls, _ in first_blocks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([_signed(cls)], names=["cls"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "cls long")


def _first_rows(keyed: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = np.asarray(batch.column("id")), np.asarray(batch.column("h"))
            for row, start, starts, away, cls, hull in first_blocks(batch.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row]), pa.array(hashes[row]), pa.array(start), pa.array(starts.astype(np.int32)),
                     pa.array(away.astype(np.int32)), _signed(cls), _signed(hull)], names=["id", "h", "start", "starts", "away", "cls", "hull"])

    found = keyed.select("id", "h", "text").mapInArrow(rows, "id long, h long, start long, starts int, away int, cls long, hull long")
    return found.withColumn("open", F.lit(True))


def _ranked(counts: DataFrame, *by: str) -> DataFrame:
    """The repeated among the counted pairs, sorted; their place is the new rank."""
    return cut(counts.where("n > 1").sort(*by).select(*by, F.monotonically_increasing_id().alias("rank")))


def _told(rows: DataFrame, counts: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows that a repeated pair leaves, by their hull: those of a repeated hull, all of whose starts
    are repeats, and one row for each hull of the ranks that have several (``open``: it has no copy)."""
    row = [c for c in rows.columns if c not in (*on, "hull")]
    repeated = cut(rows.join(_ranked(counts, *on), on).drop(*on))
    hulls = cut(repeated.groupBy("rank", "hull").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*row)).alias("row")))
    done = repeated.join(hulls.where("n > 1").select("rank", "hull"), ["rank", "hull"], "left_semi")
    several = hulls.groupBy("rank").agg(F.count(F.lit(1)).alias("kinds"), F.bool_or(F.expr("n = 1 AND row.open")).alias("any")).where("kinds > 1 AND any")
    mixed = hulls.join(several.select("rank"), "rank").withColumn("row", F.col("row").withField("open", F.expr("n = 1 AND row.open")))
    return done.where("open").select("id", "h", "start", "starts"), mixed.select("row.*", "rank")


def _contexts(keyed: DataFrame, blocks: DataFrame) -> DataFrame:
    """The blocks with the bytes of their hull."""
    row = ("start", "starts", "away", "rank", "open")
    wanted = blocks.groupBy("id", "h").agg(F.collect_list(F.struct(*row)).alias("blocks"))  # no more than the text has

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = _unpack(batch.column("body")[i], batch.column("n_bytes")[i].as_py())
                found = batch.column("blocks").slice(i, 1).flatten()
                cuts = [text[a : a + n + WIDTH - 1] for a, n in zip(found.field("start").to_pylist(), found.field("starts").to_pylist())]
                own = [pa.array([batch.column(c)[i].as_py()] * len(found), pa.int64()) for c in ("id", "h")]
                yield pa.RecordBatch.from_arrays(
                    [*own, *[found.field(k) for k in row], pa.array(cuts, pa.binary())], names=["id", "h", *row, "bytes"])

    # one of the rows with this id and text
    texts = _packed(keyed).groupBy("id", "h").agg(F.first("n_bytes").alias("n_bytes"), F.first("body").alias("body"))
    return texts.join(wanted, ["id", "h"]).mapInArrow(
        slices, "id long, h long, start long, starts int, away int, rank long, open boolean, bytes binary")


def _finer(contexts: DataFrame, size: int) -> DataFrame:
    """Sub-blocks of the contexts: ``id, h, start, starts, away, origin, open, parent, block, core, hull``."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pa.concat_arrays([batch.column("bytes").cast(pa.large_binary())])
            offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
            data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)
            at, starts, away = (np.asarray(batch.column(c)).astype(np.int64) for c in ("start", "starts", "away"))
            low = 0
            while low < len(at):
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + PIECE, "right")) - 1)
                names = Names(data[offsets[low] : offsets[high]])
                row = np.repeat(np.arange(low, high), starts[low:high])
                inside = np.arange(len(row)) - np.repeat(np.cumsum(starts[low:high]) - starts[low:high], starts[low:high])
                first, last, block, core, hull = blocks_of(
                    names, offsets[row] - offsets[low] + inside, away[row] - inside, row, size)
                r, k = row[first], inside[first]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(r)), batch.column("h").take(pa.array(r)), pa.array(at[r] + k),
                     pa.array((last - first + 1).astype(np.int32)), pa.array((away[r] - k).astype(np.int32)), pa.array(at[r]),
                     batch.column("open").take(pa.array(r)), batch.column("rank").take(pa.array(r)), pa.array(block.astype(np.int32)),
                     _signed(core), _signed(hull)],
                    names=["id", "h", "start", "starts", "away", "origin", "open", "parent", "block", "core", "hull"])
                low = high

    return contexts.mapInArrow(
        split, "id long, h long, start long, starts int, away int, origin long, open boolean, parent long, block int, core long, hull long")


def _repeats(keyed: DataFrame) -> DataFrame:
    """``id, h, start, starts``: runs of starts whose ``WIDTH`` bytes also start elsewhere."""
    classes = _classes(keyed).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    done, mixed = _told(_first_rows(keyed), classes, ["cls"])
    contexts = cut(_contexts(keyed, mixed))
    for size in BLOCKS[1:]:
        rows, on = cut(_finer(contexts, size)), ["parent", "block", "core"]
        more, mixed = _told(rows, rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n")), on)
        done = done.union(more)
        if size > 1:
            bytes_of = contexts.select("id", "h", F.col("start").alias("origin"), "bytes")
            contexts = cut(mixed.join(bytes_of, ["id", "h", "origin"]).withColumn(
                "bytes", F.expr(f"substring(bytes, CAST(start - origin AS INT) + 1, starts + {WIDTH - 1})")).drop("origin"))
    return done


def repeated_parts(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` per row of ``docs(doc_id, text)``: the maximal runs of bytes (start,
    end) that are covered by a string of ``WIDTH`` bytes which also starts elsewhere, and the other bytes."""
    keyed = _keyed(docs)
    spans = _repeats(keyed).groupBy("id", "h").agg(F.collect_set(F.struct("start", "starts")).alias("starts"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, rest = [], []
            for body, size, starts in zip(batch.column("body"), batch.column("n_bytes").to_pylist(), batch.column("starts").to_pylist()):
                text, found, done, kept = _unpack(body, size), [], 0, []
                for a, b in sorted((x["start"], x["start"] + x["starts"] - 1 + WIDTH) for x in starts or ()):
                    if found and a <= found[-1]["end"]:
                        found[-1]["end"] = max(b, found[-1]["end"])
                    else:
                        found.append({"start": a, "end": b})
                for s in found:
                    kept.append(text[done : s["start"]])
                    done = s["end"]
                runs.append(found)
                rest.append(b"".join([*kept, text[done:]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(runs, span), pa.array(rest, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"])

    joined = _packed(keyed, "doc_id").join(spans, ["id", "h"], "left").select("doc_id", "n_bytes", "body", "starts")
    return joined.mapInArrow(remove, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
