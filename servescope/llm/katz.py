"""Scores of a Katz backoff language model, learnt from the training part of the corpus.

Tokens are words with A-Z lower-cased, then one end. Every training word is in the model's vocabulary and
keeps its own pairs; words that training lacks are one class.

    P(t)     = c(t) / (N + 1), 1 / (N + 1) for the class
    P(t | v) = d c(v, t) / c(v)   if the pair (v, t) was seen; d is the Good-Turing discount of its count
             = alpha(v) P(t)      else; alpha(v) makes the row of v sum to one exactly

Discounts hold for counts up to 5 and come from the counts of counts; where those give none inside
(0, 1), one constant is discounted instead. A context whose counts leave no discount has one more in its
denominator; one that has seen the whole vocabulary is scaled to one. The order is two.

A caller may set ``VOCABULARY`` to a number of words: the most frequent ones, without splitting a count. The
class then holds all others, with P = (c + 1) / (N + 1), and a word w of it is multiplied by
(c(w) + 1) / (words + distinct words of the class + 1).

Tables: the ``NUMBERED`` most frequent words have numbers of 16 bits. Pairs of numbered words are four bytes,
in buckets by pair, merged from sorted packed arrays, so a frequent pair is one entry per batch of documents
and never a group of rows. Each occurrence of any other word goes, with its neighbours, to the bucket of the
word: that holds its count, its pairs with numbered words and, dealt once more, those with other words after
it. A text's score is the sum of log P(t) alpha(v) over its pairs plus log(P(t | v) / (P(t) alpha(v))) for
the seen ones; so a bucket adds what it knows and answers with one packed row per batch. What a
numbered word's context needs is summed over the buckets. Buckets follow the size of the corpus, and a
bucket's requests are spread over copies of it when there are many. Words, and pairs of two words without
numbers, are told apart by 64-bit hashes. To the driver come at most ``NUMBERED`` words, counts and contexts,
and six counts of counts.

A null or empty text is one end. A null ``doc_id`` is in training. Repeated rows count as often as they
occur, each gets its own row. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servescope.llm.words import mix, pieces, tokens, word_hashes
from servescope.session import shared_folder

VOCABULARY: int | None = None
NUMBERED = 65_000
NOTHING, RARE, END, UNKNOWN, BEGIN = 65_531, 65_532, 65_533, 65_534, 65_535  # the first two: neighbours of a word without number
DISCOUNTED = 5
BUCKET_BYTES = 1 << 25
BUCKETS = (32, 4096)
_END_HASH = np.uint64(xxhash.xxh3_64_intdigest(b" end"))  # no word holds a space
_NO_ID = -(2**63)
_NAME = np.dtype([("id", np.int64), ("mark", np.int64)])
_ARRAYS = ("a", "b", "c", "d", "e", "f")
_BINARIES = ", ".join(f"{c} binary" for c in _ARRAYS)


def katz_scores(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row of ``docs(doc_id, text)``."""
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False)).alias("held_out"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = BUCKETS[0]
    while buckets < BUCKETS[1] and buckets * BUCKET_BYTES < size:
        buckets *= 2
    copies = max(1, math.ceil(size / (buckets * BUCKET_BYTES)))

    counted = docs.where("NOT held_out").select("text").mapInArrow(_count_words(buckets // 4), "bucket int, a binary, b binary")
    words = _stored(_by_bucket(counted).mapInArrow(
        _merge(np.uint64), "bucket int, a binary, b binary, entries long, total long, counts array<long>, entries_of array<long>"))
    distinct, train = words.agg(F.coalesce(F.sum("entries"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    held = docs.sparkSession.sparkContext.broadcast(fitted_vocabulary(words, distinct, train))

    paired = docs.where("NOT held_out").select("text").mapInArrow(_count_pairs(held, buckets), f"bucket int, {_BINARIES}")
    pairs = _stored(_by_bucket(paired).mapInArrow(_merge_pairs(buckets), f"bucket int, to int, kind int, {_BINARIES}, seen array<long>"))
    seen = pairs.selectExpr("posexplode(seen) AS (r, n)").groupBy("r").agg(F.sum("n").alias("n"))
    discount = discounts({row.r + 1: row.n for row in seen.collect()})
    parts = [f"n{r}" for r in range(1, DISCOUNTED + 1)] + ["seen"]
    contexts = pairs.where("kind = 0").select("bucket", *_ARRAYS).mapInArrow(
        _contexts(held), "context int, " + ", ".join(f"{c} long" for c in parts)).groupBy("context").agg(*[F.sum(c).alias(c) for c in parts])
    rows = np.stack([c.to_numpy().astype(np.int64) for c in contexts.toArrow().columns], axis=1)
    weights = docs.sparkSession.sparkContext.broadcast(Vocabulary(**held.value).weights(rows, discount))

    asked = docs.select("doc_id", "text").mapInArrow(_ask(held, weights, buckets, copies), f"bucket int, copy int, kind int, batch long, {_BINARIES}")
    spread = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    tables = pairs.select(F.col("to").alias("bucket"), spread.alias("copy"), "kind", F.lit(0).cast("long").alias("batch"), *_ARRAYS)
    answers = asked.union(tables).repartition("bucket", "copy").sortWithinPartitions("bucket", "copy", "kind").mapInArrow(
        _answer(held, weights, discount), f"batch long, kind int, {_BINARIES}")
    each = answers.repartition("batch").sortWithinPartitions("batch", "kind").mapInArrow(
        _sum, "id long, n_tokens long, n_known long, base_score double, score double")
    doc_id = F.when(F.col("id") != _NO_ID, F.col("id"))
    return each.select(
        doc_id.alias("doc_id"), F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False)).alias("held_out"),
        "n_tokens", "n_known", F.lit(train).cast("long").alias("train_tokens"), "base_score", "score")


def fitted_vocabulary(words: DataFrame, distinct: int, train: int) -> dict:
    """The words with numbers and their counts: plain arrays for a broadcast of ``NUMBERED`` entries."""
    most = NUMBERED if VOCABULARY is None else min(VOCABULARY, NUMBERED)
    top = words.selectExpr("explode(arrays_zip(counts, entries_of)) AS x").groupBy(F.col("x.counts").alias("c")).agg(
        F.sum("x.entries_of").alias("n")).orderBy(F.desc("c")).limit(most).collect()
    least, room = 2**62, most + 1  # the end is counted too
    for row in top:
        room -= row.n
        if room < 0:
            break
        least = row.c
    rows = sorted((-r[1], r[0]) for r in words.select("a", "b").mapInArrow(_at_least(least), "word long, count long").collect())
    end = words.select("a", "b").mapInArrow(_count_of(_END_HASH), "n long").agg(F.sum("n")).first()[0] or 0
    rows = [(c, h) for c, h in rows if h % 2**64 != int(_END_HASH)]
    hashes = np.array([h % 2**64 for _, h in rows], np.uint64)
    order = np.argsort(hashes)
    counts = np.zeros(65_536, np.int64)
    counts[: len(rows)] = [-c for c, _ in rows]
    counts[END] = end
    return {"hashes": hashes[order], "ids": order.astype(np.int32), "counts": counts, "train": train, "distinct": distinct,
            "classed": VOCABULARY is not None}


class Vocabulary:
    """The numbered words with their counts, and what the formulas need of the rest. ``classed``: the rest is
    one class; else each word of it is in the model, and the class is what training lacks."""

    def __init__(self, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray, train: int, distinct: int, classed: bool):
        self.hashes, self.ids, self.counts, self.train, self.distinct, self.classed = hashes, ids, counts, train, distinct, classed
        self.class_words = train - int(counts.sum()) if classed else 0
        self.class_distinct = distinct - len(ids) - int(counts[END] > 0) if classed else 0
        self.of = counts.copy()  # P(t) times N + 1
        self.of[UNKNOWN] = self.class_words + 1
        self.of[END] = max(counts[END], 1)
        with np.errstate(divide="ignore"):
            self.log_chance = np.log10(self.of / (train + 1))
        self.log_base = np.log10((counts + 1) / (train + distinct + 1))

    def weights(self, contexts: np.ndarray, discount: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 alpha of the numbered contexts, and with their denominator, from rows of ``_contexts``."""
        log_alpha, log_scale = np.zeros(65_536), np.zeros(65_536)
        if len(contexts):
            v, n, seen = contexts[:, 0], contexts[:, 1:-1], contexts[:, -1]
            total = self.counts.copy()
            total[BEGIN], total[UNKNOWN] = self.counts[END], self.class_words
            log_alpha[v], log_scale[v] = self.backoff(total[v], n @ taken(discount), seen)
        return log_alpha, log_scale

    def backoff(self, total: np.ndarray, off: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 alpha of contexts of ``total`` pairs, ``off`` of them discounted, after which words of ``seen``
        tokens were seen; and log10 of alpha times the denominator."""
        size = total + (off <= 0)  # no discount: one more in the denominator
        rest = (self.train + 1 - seen) / (self.train + 1)
        full = rest <= 0
        log_alpha = np.where(full, 0, np.log10(np.where(off > 0, off, 1) / size / np.where(full, 1, rest)))
        return log_alpha, log_alpha + np.log10(np.where(full, total - off, size))

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), UNKNOWN, np.int32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], UNKNOWN).astype(np.int32)


def discounts(n: dict[int, int], k: int = DISCOUNTED) -> np.ndarray:
    """Good-Turing discounts d[r] of counts r = 1..k from counts of counts; d is 1 beyond."""
    d = np.ones(k + 2)
    if all(n.get(r, 0) for r in range(1, k + 2)):
        over = (k + 1) * n[k + 1] / n[1]
        if over < 1:
            turing = [((r + 1) * n[r + 1] / (r * n[r]) - over) / (1 - over) for r in range(1, k + 1)]
            if all(0 < x < 1 for x in turing):
                d[1 : k + 1] = turing
                return d
    ones, twos = n.get(1, 0), n.get(2, 0)
    off = ones / (ones + 2 * twos) if ones and twos else 0.5
    d[1 : k + 1] = 1 - off / np.arange(1, k + 1)
    return d


def taken(discount: np.ndarray) -> np.ndarray:
    """What a pair of count 1..k loses by its discount."""
    r = np.arange(1, DISCOUNTED + 1)
    return r * (1 - discount[r])


def _log_kept(counts: np.ndarray, discount: np.ndarray) -> np.ndarray:
    return np.log10(discount[np.minimum(counts, len(discount) - 1)] * counts)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted keys are in the sorted ones, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _named(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The names of pairs of words without numbers."""
    return mix(mix(before) + after)


class Numbered:
    """The seen pairs of a bucket, both words with numbers: what they add to a score."""

    def __init__(self, arrays: list, v: Vocabulary, log_scale: np.ndarray, discount: np.ndarray):
        self.keys = _unpack(arrays[0], np.uint32)
        self.more = _log_kept(_unpack(arrays[1], np.int64), discount) - log_scale[self.keys >> np.uint32(16)] - v.log_chance[self.keys & np.uint32(65_535)]

    def score(self, keys: np.ndarray) -> np.ndarray:
        at, seen = _find(self.keys, keys)
        more = np.zeros(len(keys))
        more[seen] = self.more[at[seen]]
        return more


class Others:
    """The words without numbers of a bucket: their counts, pairs and backoff weights."""

    def __init__(self, arrays: list, dealt: list[list], v: Vocabulary, log_scale: np.ndarray, discount: np.ndarray):
        self.v = v
        self.words, self.counts, left, n_left, right, n_right = [
            _unpack(x, t) for x, t in zip(arrays, (np.uint64, np.int64, np.uint64, np.int64, np.uint64, np.int64))]
        before, after, n_both, n_after = [
            np.concatenate([np.zeros(0, t), *[_unpack(d[i], t) for d in dealt]]) for i, t in enumerate((np.uint64, np.uint64, np.int64, np.int64))]
        of, size, low = np.searchsorted(self.words, before), len(self.words), np.uint64(65_535)
        context, counts = np.concatenate(((right >> np.uint64(16)).astype(np.int64), of)), np.concatenate((n_right, n_both))
        off = np.zeros(size)
        for r, lost in enumerate(taken(discount), 1):
            off += lost * np.bincount(context[counts == r], minlength=size)
        seen = np.bincount(context, np.concatenate((v.of[right & low], n_after)), size)
        self.log_chance = np.log10(np.maximum(self.counts, 1) / (v.train + 1))
        self.log_alpha, scale = v.backoff(self.counts, off, seen) if not v.classed else (np.zeros(size), np.zeros(size))
        names = _named(before, after)
        order = np.argsort(names)
        self.tables = [
            (left, _log_kept(n_left, discount) - log_scale[left & low] - self.log_chance[left >> np.uint64(16)]),
            (right, _log_kept(n_right, discount) - scale[right >> np.uint64(16)] - v.log_chance[right & low]),
            (names[order], (_log_kept(n_both, discount) - scale[of] - np.log10(n_after / (v.train + 1)))[order])]

    def score(self, words: np.ndarray, before: np.ndarray, after: np.ndarray, next_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the words, and what they and their pairs add."""
        v = self.v
        at, found = _find(self.words, words)
        n = np.zeros(len(words), np.int64)
        n[found] = self.counts[at[found]]
        if v.classed:
            return n, np.log10((n + 1) / (v.class_words + v.class_distinct + 1))
        more = np.full(len(words), v.log_chance[UNKNOWN])
        more[found] = self.log_chance[at[found]] + self.log_alpha[at[found]]
        wide = at.astype(np.uint64) << np.uint64(16)
        both = after == RARE
        asked = [(found & (before != RARE), wide | before), (found & ~both, wide | after)]
        names = np.zeros(len(words), np.uint64)
        names[both] = _named(words[both], next_words)
        for (rows, keys), (table, adds) in zip([*asked, (found & both, names)], self.tables):
            rows = np.flatnonzero(rows)
            where, seen = _find(table, keys[rows])
            more[rows[seen]] += adds[where[seen]]
        return n, more


def _stored(table: DataFrame) -> DataFrame:
    """A table partitioned by bucket in the shared folder."""
    path = f"{shared_folder(table.sparkSession).rstrip('/')}/katz-{uuid.uuid4().hex}"
    table.write.partitionBy("bucket").parquet(path)
    columns = [*[f for f in table.schema if f.name != "bucket"], table.schema["bucket"]]
    return table.sparkSession.read.schema(type(table.schema)(columns)).parquet(path).select(*table.columns)


def _by_bucket(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket")


def _packed_rows(bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """One entry per bucket of rows sorted by bucket."""
    if not len(bucket):
        return
    starts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
    for a, b in zip(starts[:-1], starts[1:]):
        yield int(bucket[a]), [x[a:b].tobytes() for x in arrays]


def _batch(rows: list[tuple[int, list[bytes]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[1][i] for r in rows], pa.binary()) for i in range(2)]], names=["bucket", "a", "b"])


def _count_words(buckets: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, ids, words = tokens(batch.column("text"))
            hashes = np.append(word_hashes(words), _END_HASH)
            counts = np.append(np.bincount(ids, minlength=len(words)), batch.num_rows)
            bucket = (hashes % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((hashes, bucket))
            yield _batch(list(_packed_rows(bucket[order], hashes[order], counts[order].astype(np.uint32))))

    return count


def _pack(x: np.ndarray | None) -> bytes | None:
    if x is None:
        return None
    raw = x.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpack(packed, kind: type) -> np.ndarray:
    """Of a packed scalar; a null is an empty array."""
    buffer = packed.as_buffer() if packed is not None and packed.is_valid else None
    size = int.from_bytes(buffer[:8].to_pybytes(), "little") if buffer else 0
    return np.frombuffer(pa.Codec("zstd").decompress(buffer.slice(8), size), kind) if size else np.zeros(0, kind)


def _rows(numbers: dict[str, tuple], arrays: list[tuple]) -> pa.RecordBatch:
    """Numbers by column, then up to six arrays per row."""
    columns = [pa.array(values, kind) for values, kind in numbers.values()]
    columns += [pa.array([_pack(r[i]) if i < len(r) else None for r in arrays], pa.binary()) for i in range(len(_ARRAYS))]
    return pa.RecordBatch.from_arrays(columns, names=[*numbers, *_ARRAYS])


class Sequence:
    """The pairs of a batch: tokens with the one before, and the words without numbers with both neighbours."""

    def __init__(self, texts: pa.Array, v: Vocabulary):
        self.lengths, ids, words = tokens(texts)
        hashes = word_hashes(words)
        token = v.look_up(hashes)[ids].astype(np.uint16)
        ends, n = np.cumsum(self.lengths), len(self.lengths)
        self.after = np.insert(token, ends, END)
        self.before = np.empty_like(self.after)
        self.before[1:] = self.after[:-1]
        self.before[np.concatenate(([0], (ends + np.arange(1, n + 1))[:-1]))] = BEGIN
        rare = np.flatnonzero(token == UNKNOWN)
        self.at = np.repeat(np.arange(n, dtype=np.int32), self.lengths + 1)
        self.rare_at = np.repeat(np.arange(n, dtype=np.int32), self.lengths)[rare]
        self.rare = hashes[ids[rare]]
        place = rare + self.rare_at
        self.rare_before, self.rare_after = self.before[place], self.after[place + 1]
        self.with_number = np.ones(len(self.after), bool)
        if v.classed:
            self.rare_before, self.rare_after = np.full(len(rare), NOTHING, np.uint16), np.full(len(rare), NOTHING, np.uint16)
        else:
            self.with_number = (self.before != UNKNOWN) & (self.after != UNKNOWN)
            self.rare_before[self.rare_before == UNKNOWN] = RARE
            self.rare_after[self.rare_after == UNKNOWN] = RARE
        self.ids, self.hashes, self.place = ids, hashes, rare

    def keys(self) -> np.ndarray:
        pick = self.with_number
        return self.before[pick].astype(np.uint32) << np.uint32(16) | self.after[pick]

    def neighbours(self, rows: np.ndarray, step: int) -> np.ndarray:
        """The hashes of the words next to the given words without numbers."""
        return self.hashes[self.ids[self.place[rows] + step]]


def _pair_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def _word_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes % np.uint64(buckets // 2)).astype(np.int32)


def _parts(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The runs of sorted bucket numbers."""
    starts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)])) if len(bucket) else np.zeros(1, int)
    for a, b in zip(starts[:-1], starts[1:]):
        yield int(bucket[a]), slice(a, b)


def _count_pairs(held, buckets: int) -> Callable:
    """Counted pairs of numbered words by bucket, and the occurrences of other words with both neighbours."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(**held.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            s = Sequence(batch.column("text"), v)
            keys, counts = np.unique(s.keys(), return_counts=True)
            bucket = _pair_bucket(keys, buckets)
            order = np.argsort(bucket, kind="stable")
            keys, counts = keys[order], counts[order].astype(np.uint32)
            found = [(to, keys[part], counts[part]) for to, part in _parts(bucket[order])]
            bucket = _word_bucket(s.rare, buckets)
            order = np.argsort(bucket, kind="stable")
            for to, part in _parts(bucket[order]):
                rows = order[part]
                both = rows[s.rare_before[rows] == RARE]
                found.append((-1 - to, s.rare[rows], s.rare_before[rows], s.rare_after[rows], s.neighbours(both, -1)))
            yield _rows({"bucket": ([r[0] for r in found], pa.int32())}, [r[1:] for r in found])

    return count


def _fold(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)


def _merge_pairs(buckets: int) -> Callable:
    """Per bucket its table (kind 0) and, for words without numbers, their pairs with such words before
    them, dealt by these (kind 1); counts of counts come with the table."""

    def row(bucket: int, found: list[tuple], counts: list[np.ndarray]) -> pa.RecordBatch:
        few = np.concatenate(counts)
        seen = np.bincount(few[few <= DISCOUNTED + 1], minlength=DISCOUNTED + 2)[1:].tolist()
        rows = _rows({"bucket": ([bucket] * len(found), pa.int32()), "to": ([r[0] for r in found], pa.int32()),
                      "kind": ([0] + [1] * (len(found) - 1), pa.int32())}, [r[1:] for r in found])
        return rows.append_column("seen", pa.array([seen] + [None] * (len(found) - 1), pa.list_(pa.int64())))

    def others(bucket: int, parts: list[tuple]) -> pa.RecordBatch:
        word, before, after, words_before = [np.concatenate([p[i] for p in parts]) for i in range(4)]
        words, of, n = np.unique(word, return_inverse=True, return_counts=True)
        wide = of.astype(np.uint64) << np.uint64(16)
        tables = [np.unique((wide | x)[(x != NOTHING) & (x != RARE)], return_counts=True) for x in (before, after)]
        both = before == RARE
        names, first, n_both = np.unique(_named(words_before, word[both]), return_index=True, return_counts=True)
        left, right, n_right = words_before[first], word[both][first], n[of[both][first]]
        to = _word_bucket(left, buckets)
        order = np.argsort(to, kind="stable")
        found = [(bucket, words, n, tables[0][0], tables[0][1], tables[1][0], tables[1][1])]
        found += [(-1 - q, *[x[order[part]] for x in (left, right, n_both, n_right)]) for q, part in _parts(to[order])]
        return row(bucket, found, [tables[0][1], tables[1][1], n_both])

    def numbered(bucket: int, parts: list[tuple]) -> pa.RecordBatch:
        keys, counts = _fold(parts)
        return row(bucket, [(bucket, keys, counts)], [counts])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, size = None, [], 0
        for batch in batches:
            for bucket, *arrays in zip(*[batch.column(i) for i in range(5)]):
                bucket = bucket.as_py()
                if bucket != now:
                    if parts:
                        yield (numbered if now >= 0 else others)(now, parts)
                    now, parts, size = bucket, [], 0
                if bucket < 0:
                    parts.append([_unpack(x, t) for x, t in zip(arrays, (np.uint64, np.uint16, np.uint16, np.uint64))])
                    continue
                parts.append((_unpack(arrays[0], np.uint32), _unpack(arrays[1], np.uint32).astype(np.int64)))
                size += len(parts[-1][0])
                if size > 4_000_000 and size > 2 * len(parts[0][0]):
                    parts = [_fold(parts)]
                    size = len(parts[0][0])
        if parts:
            yield (numbered if now >= 0 else others)(now, parts)

    return merge


def _contexts(held) -> Callable:
    """Of the numbered contexts the pairs of counts 1..k and the tokens of the words seen after them, by task."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(**held.value)
        total = np.zeros((65_536, DISCOUNTED + 1), np.int64)
        for batch in batches:
            for bucket, *arrays in zip(*[batch.column(i) for i in range(7)]):
                if bucket.as_py() >= 0:
                    keys, counts = _unpack(arrays[0], np.uint32), _unpack(arrays[1], np.int64)
                    context, tokens_of = keys >> np.uint32(16), v.of[keys & np.uint32(65_535)]
                else:
                    keys, counts = _unpack(arrays[2], np.uint64), _unpack(arrays[3], np.int64)
                    context, tokens_of = (keys & np.uint64(65_535)).astype(np.int64), _unpack(arrays[1], np.int64)[keys >> np.uint64(16)]
                for r in range(1, DISCOUNTED + 1):
                    total[:, r - 1] += np.bincount(context[counts == r], minlength=65_536)
                total[:, -1] += np.bincount(context, tokens_of, 65_536).astype(np.int64)
        found = np.flatnonzero(total[:, -1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.astype(np.int32)), *[pa.array(total[found, i]) for i in range(DISCOUNTED + 1)]],
            names=["context", *[f"n{r}" for r in range(1, DISCOUNTED + 1)], "seen"])

    return add


def _merge(kind: type) -> Callable:
    """Sorted distinct entries with summed counts, one row per bucket; what is held is folded now and then."""

    def row(bucket: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, counts = _fold(parts)
        values, entries = np.unique(counts, return_counts=True)
        lists = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array([bucket], pa.int32()), pa.array([keys.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary()),
             pa.array([len(keys)], pa.int64()), pa.array([int(counts.sum())], pa.int64()),
             pa.array([values.tolist()], lists), pa.array([entries.tolist()], lists)],
            names=["bucket", "a", "b", "entries", "total", "counts", "entries_of"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, size = None, [], 0
        for batch in batches:
            for bucket, a, b in zip(*[batch.column(i) for i in range(3)]):
                bucket = bucket.as_py()
                if bucket != now:
                    if parts:
                        yield row(now, parts)
                    now, parts, size = bucket, [], 0
                parts.append((np.frombuffer(a.as_py(), kind), np.frombuffer(b.as_py(), np.uint32).astype(np.int64)))
                size += len(parts[-1][0])
                if size > 4_000_000 and size > 2 * len(parts[0][0]):
                    parts = [_fold(parts)]
                    size = len(parts[0][0])
        if parts:
            yield row(now, parts)

    return merge


def _at_least(least: int) -> Callable:
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("a"), batch.column("b")):
                keys, counts = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.int64)
                big = counts >= least
                yield pa.RecordBatch.from_arrays([pa.array(keys[big].astype(np.int64)), pa.array(counts[big])], names=["word", "count"])

    return pick


def _count_of(word: np.uint64) -> Callable:
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [int(np.frombuffer(b.as_py(), np.int64)[np.frombuffer(a.as_py(), np.uint64) == word].sum())
                 for a, b in zip(batch.column("a"), batch.column("b"))]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n"])

    return pick


def _ask(held, weights, buckets: int, copies: int) -> Callable:
    """Per part of a batch: what is known at once (kind 3), its pairs by bucket and its other words by theirs (kind 2)."""
    def by_document(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        docs, counts = np.unique(at, return_counts=True)
        return docs.astype(np.uint16), counts.astype(np.uint32)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, (log_alpha, _) = Vocabulary(**held.value), weights.value
        for batch in (p for b in batches for p in pieces(b, 2048)):
            n = batch.num_rows
            s = Sequence(batch.column("text"), v)
            names = np.zeros(n, _NAME)
            names["id"] = batch.column("doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            names["mark"] = [xxhash.xxh3_64_intdigest(t) - 2**63 for t in batch.column("text").fill_null("").cast(pa.large_binary()).to_pylist()]
            known, own = s.after != UNKNOWN, np.zeros((n, 4))
            own[:, 0] = s.lengths + 1
            own[:, 1] = np.bincount(s.at, known & (v.counts[s.after] > 0), n)
            own[:, 2] = np.bincount(s.at, np.where(known, v.log_base[s.after], 0.0), n)
            score = np.where(known | v.classed, v.log_chance[s.after], 0.0) + np.where((s.before != UNKNOWN) | v.classed, log_alpha[s.before], 0.0)
            own[:, 3] = np.bincount(s.at, score, n)
            key = xxhash.xxh3_64_intdigest(names.tobytes()) - 2**63
            found = [(key % buckets, 3, names, own)]
            keys = s.keys()
            order = np.sort(_pair_bucket(keys, buckets).astype(np.uint64) << np.uint64(48) | s.at[s.with_number].astype(np.uint64) << np.uint64(32) | keys)
            at, keys = (order >> np.uint64(32)).astype(np.uint16), order.astype(np.uint32)
            found += [(to, 2, *by_document(at[part]), keys[part]) for to, part in _parts((order >> np.uint64(48)).astype(np.int32))]
            bucket = _word_bucket(s.rare, buckets)
            order = np.argsort(bucket, kind="stable")
            for to, part in _parts(bucket[order]):
                rows = order[part]
                both = rows[s.rare_after[rows] == RARE]
                found.append((-1 - to, 2, *by_document(s.rare_at[rows]), s.rare[rows], s.rare_before[rows], s.rare_after[rows], s.neighbours(both, 1)))
            yield _rows({"bucket": ([r[0] for r in found], pa.int32()), "copy": ([key % copies] * len(found), pa.int32()),
                         "kind": ([r[1] for r in found], pa.int32()), "batch": ([key] * len(found), pa.int64())}, [r[2:] for r in found])

    return ask


def _answer(held, weights, discount: np.ndarray) -> Callable:
    """What is known at once (kind 0), and of each bucket documents, scores, base scores and known words (kind 1)."""
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, (_, log_scale) = Vocabulary(**held.value), weights.value
        none = [None] * len(_ARRAYS)
        now, table, arrays, dealt = None, None, none, []
        for batch in batches:
            for i in range(batch.num_rows):
                bucket, copy, kind, key = [batch.column(j)[i].as_py() for j in range(4)]
                cells = [batch.column(4 + j)[i] for j in range(len(_ARRAYS))]
                if (bucket, copy) != now:
                    now, table, arrays, dealt = (bucket, copy), None, none, []
                head = {"batch": ([key], pa.int64()), "kind": ([int(kind == 2)], pa.int32())}
                if kind == 0:
                    arrays = cells
                elif kind == 1:
                    dealt.append(cells)
                elif kind == 3:
                    yield _rows(head, [(_unpack(cells[0], _NAME), _unpack(cells[1], float))])
                else:
                    if table is None:
                        table = Numbered(arrays, v, log_scale, discount) if bucket >= 0 else Others(arrays, dealt, v, log_scale, discount)
                    docs, counts = _unpack(cells[0], np.uint16), _unpack(cells[1], np.uint32)
                    starts = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
                    if bucket >= 0:
                        yield _rows(head, [(docs, np.add.reduceat(table.score(_unpack(cells[2], np.uint32)), starts))])
                        continue
                    n, more = table.score(*[_unpack(x, t) for x, t in zip(cells[2:], (np.uint64, np.uint16, np.uint16, np.uint64))])
                    base = np.log10((n + 1) / (v.train + v.distinct + 1))
                    yield _rows(head, [(docs, *[np.add.reduceat(x, starts) for x in (more, base, (n > 0).astype(np.int64))])])

    return answer


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document from the answers of a batch; batches of equal rows come as one and are parted again."""
    def rows(names: np.ndarray, own: np.ndarray, times: int) -> pa.RecordBatch:
        long = [pa.array(np.repeat(np.rint(own[:, i] / times).astype(np.int64), times)) for i in (0, 1)]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(names["id"], times)), *long, *[pa.array(np.repeat(own[:, i] / times, times)) for i in (2, 3)]],
            names=["id", "n_tokens", "n_known", "base_score", "score"])

    now, names, own, times = None, None, None, 0
    for batch in batches:
        for i in range(batch.num_rows):
            key, kind = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            cells = [batch.column(2 + j)[i] for j in range(4)]
            if key != now:
                if times:
                    yield rows(names, own, times)
                now, names, times = key, _unpack(cells[0], _NAME), 0
                own = np.zeros((len(names), 4))
            if kind == 0:
                own += _unpack(cells[1], float).reshape(-1, 4)
                times += 1
                continue
            docs = _unpack(cells[0], np.uint16)
            own[docs, 3] += _unpack(cells[1], float)
            if cells[2].is_valid:
                own[docs, 2] += _unpack(cells[2], float)
                own[docs, 1] += _unpack(cells[3], np.int64)
    if times:
        yield rows(names, own, times)
