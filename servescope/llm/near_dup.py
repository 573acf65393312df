"""Near-duplicate groups by a MinHash LSH forest.

1. Every document gets 256 MinHash values of its five-word shingles. Equal shingle sets form one
   class and go on as their smallest id.
2. The forest: the signature is read in 16 orders, each starting 16 values further on. In each
   order the classes are sorted globally by (values from that start on), so rows with a long common
   prefix stand side by side. A row's candidates are the rows after it, up to ``WINDOW``, while at
   least two values agree. The rows at a cut between partitions are compared in a small second
   scan. A candidate goes on if at least ``AGREE`` of the 256 values agree in their low four bits.
   A spanning forest of these is confirmed on full shingle sets and joined to components. This scan
   only makes the labels few; what it misses, the next step finds.
3. Regions: rows with the same two values at an order's start. A region with more than one
   component is compared in full, without any window: it is cut into blocks of about ``BLOCK`` rows,
   each pair of blocks is one unit of work, and every pair of rows of different components that
   reaches ``AGREE`` is tested on its full sets there. Signatures are dealt to the units first; full
   sets only follow for rows that have such a pair in the unit. Blocks of one large component are not
   compared with each other. A unit gives at most one link for each component it joins; a pair is
   tested in the first order only that has it in one region.

At a similarity of 0.75 a pair shares a prefix of two values in one of 16 orders with odds of
1 - 2e-6, and fails ``AGREE`` with odds of 1e-5. The work on a region of many different documents
grows with the square of its size, spread over the pairs of blocks.

Null ``doc_id``: the row is linked with nothing, its component is null and it is kept. Null, empty
or wordless text: no shingles, linked with nothing. Repeated rows share a component; rows of one id
with different texts are one node. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servescope.llm.components import components
from servescope.llm.words import pieces, shingle_sets
from servescope.session import cut

VALUES = 256
ORDERS = 16
WINDOW = 64
AGREE = 167
BLOCK = 1024
HEAP = 2_000_000  # shingles of a block
_PREFIX = 16  # bytes: four whole values before the low four bits of all values
_RNG = np.random.default_rng(20240601)
_MULTIPLY = _RNG.integers(0, 2**64, VALUES, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 2**64, VALUES, dtype=np.uint64)


def near_duplicates(docs: DataFrame, per_mille: int = 750) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``.

    Two documents are linked if their shingle sets have a Jaccard similarity of at least
    ``per_mille`` / 1000.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut(docs.mapInArrow(_sign, "doc_id long, n_shingles long, digest binary, mins binary"))
    real = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut(real.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("mins").alias("mins"), F.first("n_shingles").alias("weight")))
    member = real.select("doc_id", "digest").join(classes.select("digest", "rep"), "digest").select("doc_id", "rep").distinct()
    # one id with several texts ties their classes together
    lowest = member.groupBy("doc_id").agg(F.min("rep").alias("m"), F.max("rep").alias("top")).where("m <> top")
    ties = member.join(lowest, "doc_id").where("rep <> m").selectExpr("rep AS a", "m AS b")

    forest = classes.selectExpr("rep AS doc", "rep AS label", "mins")
    first = _candidates(forest)
    near = cut(first.selectExpr("a AS doc").union(first.selectExpr("b AS doc")).distinct())
    texts = cut(docs.join(near.selectExpr("doc AS doc_id"), "doc_id", "left_semi"))
    linked = cut(_confirm(first, texts, per_mille).union(ties))
    found = components(linked)

    labelled = classes.selectExpr("rep AS doc", "digest", "mins", "weight").join(
        found.selectExpr("id AS doc", "component AS label"), "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    more = _across(cut(labelled), docs, per_mille)
    # links between components join the components, not their members
    named = found.selectExpr("id AS a", "component AS la"), found.selectExpr("id AS b", "component AS lb")
    joined = components(more.join(named[0], "a", "left").join(named[1], "b", "left").selectExpr("coalesce(la, a) AS a", "coalesce(lb, b) AS b"))

    class_of = (classes.select("digest", "rep").join(found.selectExpr("id AS rep", "component"), "rep", "left")
                .selectExpr("digest", "coalesce(component, rep) AS id").join(joined, "id", "left")
                .selectExpr("digest", "coalesce(component, id) AS component"))
    return (signed.select("doc_id", "n_shingles", F.when(F.expr("n_shingles > 0 AND doc_id IS NOT NULL"), F.col("digest")).alias("digest"))
            .join(class_of, "digest", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (piece for whole in batches for piece in pieces(whole)):
        sets = list(shingle_sets(batch.column("text")))
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(_minimums(sets), pa.binary())],
            names=["doc_id", "n_shingles", "digest", "mins"])


def _minimums(sets: list[np.ndarray]) -> list[bytes]:
    out = np.full((len(sets), VALUES), 2**32 - 1, np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        h = np.concatenate([sets[i] for i in full])
        starts = np.concatenate(([0], np.cumsum([len(sets[i]) for i in full])[:-1]))
        for k in range(VALUES):
            out[full, k] = np.minimum.reduceat(((h * _MULTIPLY[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32), starts)
    # whole values where an order starts, then the low four bits of all
    step = VALUES // ORDERS
    starts_of = out.reshape(len(sets), ORDERS, step)[:, :, :4].reshape(len(sets), -1)
    low = (out & np.uint32(15)).astype(np.uint8)
    packed = low[:, 0::2] << 4 | low[:, 1::2]
    return [x.tobytes() + y.tobytes() for x, y in zip(starts_of, packed)]


def _candidates(forest: DataFrame) -> DataFrame:
    """Distinct ``a < b`` from ``forest(doc, label, mins)``: a spanning forest of the neighbours in each order."""
    paths = forest.mapInArrow(_paths, "tree int, path binary, doc long, label long")
    order = ["tree", "path", "doc"]
    out = "a long, b long, tree int, path binary, doc long, label long, side int, part int"
    ranged = paths.repartitionByRange(*order).sortWithinPartitions(*order)
    scanned = cut(ranged.mapInArrow(_scan("tree", True), out))
    cuts = (scanned.where("doc IS NOT NULL")
            .selectExpr("part + side AS cut", "tree", "path", "doc", "label")
            .repartition("cut").sortWithinPartitions("cut", *order))
    pairs = scanned.where("a IS NOT NULL").select("a", "b").union(
        cuts.mapInArrow(_scan("cut", False), out).select("a", "b"))
    return cut(pairs.distinct())


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per order: four whole values from the order's start, then the low bits of all, from there on."""
    head, step = ORDERS * _PREFIX, VALUES // ORDERS // 2
    for batch in batches:
        n = batch.num_rows
        signature = np.frombuffer(b"".join(batch.column("mins").to_pylist()), np.uint8).reshape(n, -1)
        for tree in range(ORDERS):
            rows = np.hstack([signature[:, _PREFIX * tree : _PREFIX * (tree + 1)], np.roll(signature[:, head:], -step * tree - 2, axis=1)])
            path = pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), n, [None, pa.py_buffer(np.ascontiguousarray(rows))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, tree, np.int32)), path.cast(pa.binary()), batch.column("doc"), batch.column("label")],
                names=["tree", "path", "doc", "label"])


def _scan(group: str, edges: bool) -> Callable:
    """Over sorted rows: candidate pairs; with ``edges`` also the first and last rows of the partition."""

    def rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        n = batch.num_rows
        path = np.frombuffer(b"".join(batch.column("path").to_pylist()), np.uint8).reshape(n, -1)
        g = batch.column(group).to_numpy().astype(np.int64) * 1024 + batch.column("tree").to_numpy()
        return g, path, batch.column("doc").to_numpy(), batch.column("label").to_numpy(), batch.column("tree").to_numpy()

    def pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        n = len(a)
        kinds = (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), *[pa.nulls(n, k) for k in kinds]],
            names=["a", "b", "tree", "path", "doc", "label", "side", "part"])

    def edge_batch(rows: tuple[np.ndarray, ...], side: int, part: int) -> pa.RecordBatch:
        _, path, doc, label, tree = rows
        n = len(doc)
        return pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(tree), pa.array([p.tobytes() for p in path], pa.binary()),
             pa.array(doc), pa.array(label), pa.array(np.full(n, side, np.int32)), pa.array(np.full(n, part, np.int32))],
            names=["a", "b", "tree", "path", "doc", "label", "side", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, head = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = rows_of(batch)
            carried = 0 if held is None else len(held[0])
            held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new))
            if edges and (head is None or len(head[0]) < WINDOW):
                head = tuple(x[:WINDOW] for x in (new if head is None else tuple(np.concatenate(y) for y in zip(head, new))))
            a, b = _neighbours(*held[:4], carried)
            if len(a):
                yield pair_batch(a, b)
            held = tuple(x[-WINDOW:] for x in held)
        if edges and held is not None:
            yield edge_batch(head, 0, part)
            yield edge_batch(held, 1, part)

    return run


def _neighbours(group: np.ndarray, path: np.ndarray, doc: np.ndarray, label: np.ndarray, carried: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows at most ``WINDOW`` apart that share a prefix of two values and agree in the low bits of ``AGREE``.

    Rows joined by pairs found so far count as one, so only a spanning forest comes out. Pairs of two
    carried rows came out before.
    """
    prefix = np.ascontiguousarray(path[:, :8]).view(np.uint64).ravel()
    low = path[:, _PREFIX:]
    n = len(doc)
    label = np.unique(label, return_inverse=True)[1]
    at = np.arange(n)
    found_a, found_b = [], []
    for s in range(1, WINDOW + 1):
        at = at[at + s < n]
        at = at[(prefix[at] == prefix[at + s]) & (group[at] == group[at + s])]
        if not len(at):
            break
        i = at[(at + s >= carried) & (label[at] != label[at + s])]
        if not len(i):
            continue
        apart = low[i] ^ low[i + s]
        i = i[(apart < 16).sum(1) + (apart & 15 == 0).sum(1) >= AGREE]
        if not len(i):
            continue
        # one pair for each two labels, then one label for all that are joined
        lo, hi = np.minimum(label[i], label[i + s]), np.maximum(label[i], label[i + s])
        pick = np.unique(lo * np.int64(n + 1) + hi, return_index=True)[1]
        i, lo, hi = i[pick], lo[pick].tolist(), hi[pick].tolist()
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while x in root:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        keep = np.zeros(len(i), bool)
        for k, (x, y) in enumerate(zip(lo, hi)):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
                keep[k] = True
        i = i[keep]
        to = np.arange(label.max() + 1)
        for x in list(root):
            to[x] = find(x)
        label = to[label]
        found_a.append(doc[i])
        found_b.append(doc[i + s])
    if not found_a:
        return doc[:0], doc[:0]
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    return a[a != b], b[a != b]


def _confirm(pairs: DataFrame, texts: DataFrame, per_mille: int) -> DataFrame:
    """The pairs ``a, b`` whose full shingle sets are similar enough."""
    left = pairs.join(texts.selectExpr("doc_id AS a", "text AS text_a"), "a")
    both = left.join(texts.selectExpr("doc_id AS b", "text AS text_b"), "b")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (piece for whole in batches for piece in pieces(whole, 256)):
            mask = []
            for x, y in zip(shingle_sets(part.column("text_a")), shingle_sets(part.column("text_b"))):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                mask.append(1000 * shared >= per_mille * (len(x) + len(y) - shared) > 0)
            yield part.select(["a", "b"]).filter(pa.array(mask, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(confirm, "a long, b long")


def _across(forest: DataFrame, docs: DataFrame, per_mille: int) -> DataFrame:
    """Links ``a, b`` between labels: every pair of ``forest(doc, digest, mins, weight, label)`` in one region."""
    prefixes = f"transform(sequence(0, {ORDERS - 1}), t -> xxhash64(t, substring(mins, {_PREFIX} * t + 1, 8)))"
    rows = forest.select("doc", "label", "weight", F.expr(f"posexplode({prefixes}) AS (tree, region)"))
    mixed = rows.groupBy("region").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("region")
    rows = cut(rows.join(mixed, "region"))
    # a large label has blocks of its own, the others of a region share theirs
    by_label = rows.groupBy("region", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).selectExpr(
        "*", f"n > {BLOCK} OR w > {HEAP} AS large").selectExpr("*", "CASE WHEN large THEN label ELSE 0L END AS own")
    on = ["region", "large", "own"]
    parts = by_label.groupBy(*on).agg(F.expr(f"CAST(greatest(ceil(sum(n) / {BLOCK}), ceil(sum(w) / {HEAP})) AS INT)").alias("parts"))
    blocks = cut(parts.select(*on, F.expr("explode(sequence(0, parts - 1))").alias("block")))
    x = blocks.selectExpr("region", "struct(large, own, block) AS x")
    y = blocks.selectExpr("region", "struct(large, own, block) AS y")
    units = x.join(y, "region").where("x <= y AND NOT (x.large AND y.large AND x.own = y.own)").selectExpr(
        "region", "x", "y", "xxhash64(region, x, y) AS unit")
    sides = units.selectExpr("region", "unit", "explode(CASE WHEN x = y THEN array(struct(x AS b, 2 AS side)) "
                             "ELSE array(struct(x AS b, 0 AS side), struct(y AS b, 1 AS side)) END) AS s").selectExpr(
        "region", "s.b.large AS large", "s.b.own AS own", "s.b.block AS block", "unit", "s.side AS side")
    placed = rows.join(by_label.select("region", "label", "large", "own"), ["region", "label"]).join(parts, on).withColumn(
        "block", F.expr("CAST(pmod(xxhash64(doc), parts) AS INT)"))
    work = placed.join(sides, [*on, "block"]).select("unit", "side", "tree", "doc", "label")
    # stored, so that its size is known before the texts are dealt
    near = cut(forest.join(rows.select("doc").distinct(), "doc").select("doc", "digest", "mins"))
    alike = cut(_by_unit(work.join(near.drop("digest"), "doc"), _alike, "unit long, side int, tree int, doc long, label long, mins binary"))
    wanted = cut(near.join(alike.select("doc").distinct(), "doc").select("doc", "digest"))
    sets = docs.join(wanted.selectExpr("doc AS doc_id"), "doc_id", "left_semi").mapInArrow(_sets, "digest binary, shingles binary")
    held = cut(wanted.join(sets.groupBy("digest").agg(F.first("shingles").alias("shingles")), "digest").drop("digest"))
    return cut(_by_unit(alike.join(held, "doc"), lambda unit: _linked(unit, per_mille), "a long, b long").distinct())


def _by_unit(rows: DataFrame, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``work`` makes of the rows of each unit, which come by side and doc."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            unit = batch.column("unit").to_numpy()
            starts = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)]
            for low, high in zip(starts, starts[1:]):
                part = batch.slice(low, high - low)
                if high > low and kept and kept[0].column("unit")[0] != part.column("unit")[0]:
                    yield from work(pa.Table.from_batches(kept))
                    kept = []
                if high > low:
                    kept.append(part)
        if kept:
            yield from work(pa.Table.from_batches(kept))

    return rows.repartition("unit").sortWithinPartitions("unit", "side", "doc").mapInArrow(run, schema)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in (piece for whole in batches for piece in pieces(whole, 256)):
        sets = [s.tobytes() for s in shingle_sets(part.column("text"))]
        digests = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], names=["digest", "shingles"])


def _agreeing(unit: pa.Table, label: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """A row of a unit and the rows that it is to be tested with: those of another ``label`` (as it stands
    then) that reach ``AGREE`` and meet the row in this region first."""
    side, tree = (unit.column(c).to_numpy() for c in ("side", "tree"))
    n, head = len(side), ORDERS * _PREFIX
    signature = np.frombuffer(b"".join(unit.column("mins").to_pylist()), np.uint8).reshape(n, -1)
    prefix = np.ascontiguousarray(signature[:, :head].reshape(n, ORDERS, _PREFIX)[:, :, :8]).view(np.uint64).reshape(n, ORDERS)
    # the four bits of all values as four planes
    bits = np.unpackbits(signature[:, head:], axis=1).reshape(n, VALUES, 4).transpose(0, 2, 1)
    planes = np.packbits(bits, axis=2).view(np.uint64).reshape(n, 4, -1)
    planes = [np.ascontiguousarray(planes[:, k]) for k in range(4)]
    crossed = side[0] != 2
    second = int(np.searchsorted(side, 1)) if crossed else 0
    for i in range(second if crossed else n):
        start = second if crossed else i + 1
        apart = (planes[0][start:] ^ planes[0][i]) | (planes[1][start:] ^ planes[1][i]) | (planes[2][start:] ^ planes[2][i]) | (
            planes[3][start:] ^ planes[3][i])
        at = start + np.flatnonzero((np.bitwise_count(apart).sum(1, dtype=np.int64) <= VALUES - AGREE) & (label[start:] != label[i]))
        same = prefix[at] == prefix[i]
        at = at[same.any(1) & (same.argmax(1) == tree[i]) & (tree[at] == tree[i])]
        if len(at):
            yield i, at


def _alike(unit: pa.Table) -> Iterator[pa.RecordBatch]:
    """The rows of a unit that have a pair to be tested."""
    wanted = np.zeros(unit.num_rows, bool)
    for i, at in _agreeing(unit, unit.column("label").to_numpy()):
        wanted[i] = True
        wanted[at] = True
    if wanted.any():
        yield from unit.filter(pa.array(wanted)).select(["unit", "side", "tree", "doc", "label", "mins"]).to_batches()


def _linked(unit: pa.Table, per_mille: int) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the confirmed links between labels of one unit of work."""
    doc = unit.column("doc").to_numpy()
    label = np.unique(unit.column("label").to_numpy(), return_inverse=True)[1]
    sets = [np.frombuffer(s, np.uint64) for s in unit.column("shingles").to_pylist()]
    a, b = [], []
    for i, at in _agreeing(unit, label):
        sizes = np.array([len(sets[j]) for j in at])
        whole = np.concatenate([sets[j] for j in at])
        place = np.minimum(np.searchsorted(sets[i], whole), len(sets[i]) - 1)
        shared = np.add.reduceat((sets[i][place] == whole).astype(np.int64), np.concatenate(([0], np.cumsum(sizes)[:-1])))
        at = at[1000 * shared >= per_mille * (sizes + len(sets[i]) - shared)]
        at = at[np.unique(label[at], return_index=True)[1]]
        if len(at):
            a += [doc[i]] * len(at)
            b += doc[at].tolist()
            label[np.isin(label, label[at])] = label[i]
    if a:
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
