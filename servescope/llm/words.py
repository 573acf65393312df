"""Words and five-word shingles of whole Arrow batches of texts, as 64-bit hashes.

A word is a run of bytes other than space and 0x09-0x0D after A-Z are lower-cased. A null text is
an empty one. Words and shingles are told apart by 64-bit hashes: within one document or between
two of a million words each, two different shingles meet with odds of about 10^-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SHINGLE = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words per text, the index of each word in the list of distinct words, that list."""
    if texts.offset:  # the kernels below misread a view that does not start at 0
        texts = texts.take(pa.array(np.arange(len(texts))))
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string()).fill_null("")))
    flat = lists.flatten()
    real = np.asarray(pc.greater(pc.binary_length(flat), 0))
    ends = np.cumsum(np.asarray(pc.list_value_length(lists)), dtype=np.int64)
    before = np.concatenate(([0], np.cumsum(real, dtype=np.int64)))
    lengths = np.diff(before[np.concatenate(([0], ends))])
    coded = flat.filter(pa.array(real)).dictionary_encode()
    return lengths, np.asarray(coded.indices), coded.dictionary


def pieces(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batch in parts, so that what is derived from texts stays small next to the batch."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def word_hashes(words: pa.Array) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(texts: pa.Array, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """Per text its shingle hashes in text order, repeats included: all runs of ``width`` words; a
    shorter text is one shingle, a text without words has none."""
    lengths, ids, words = tokens(texts)
    h = word_hashes(words)[ids] if len(ids) else np.zeros(0, np.uint64)
    rolled = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for k in range(width if len(rolled) else 0):
        rolled = rolled * _STEP + h[k : k + len(rolled)]
    rolled = mix(rolled + np.uint64(width))
    start = 0
    for n in lengths.tolist():
        if n >= width:
            yield rolled[start : start + n - width + 1]
        elif n:
            whole = 0
            for x in h[start : start + n].tolist():
                whole = (whole * int(_STEP) + x) % 2**64
            yield mix(np.array([(whole + n) % 2**64], np.uint64))
        else:
            yield h[:0]
        start += n


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """Per text its distinct shingle hashes in ascending order."""
    for s in shingles(texts, width):
        yield np.unique(s)
