"""Secrets in texts: fixed patterns, and stretches of high entropy found by a sliding window.

A candidate string is a run of at least ``WINDOW`` characters of ``[A-Za-z0-9+/_=-]``. Each class of
characters (hex, base 64) has its own alphabet and threshold. A window of ``WINDOW`` characters moves
over a run; its Shannon entropy follows from the counts, which change by one character in and one
out, so a run of any length costs time in proportion to it. Overlapping windows above the threshold
are one span. The allow-list suppresses spans: plain words and numbers, UUIDs and placeholders. What a
fixed pattern covers is taken out of a span; the rest of it stays, so no part of a secret is left.

Null or empty text: no spans. Null ids and repeated rows are carried as they are; other columns are
ignored; an empty table gives an empty result. Spans that tie in start are ordered by kind. Any length of
text is searched whole, in time proportional to it and its spans.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servescope.llm.spans import SPAN

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "entropy")
WINDOW = 20
# class of characters, least entropy in bits of a window of 20
CLASSES = ((re.compile(r"[0-9A-Fa-f]+", re.A), 3.0), (re.compile(r"[A-Za-z0-9+/_=-]+", re.A), 3.7))
ALLOW = (
    r"[A-Za-z_/-]+",  # words and paths of words
    r"[0-9_/=-]+",  # numbers and dates
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",  # UUIDs
    r"(?i:.*(?:example|placeholder|changeme|dummy|xxxxx).*)",
)
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_HINT = re.compile(rb"password|passwd|secret|token|api_?key", re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # of AKIA[A-Z0-9]+ those of 20 characters or more
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}")


def find_secrets(docs: DataFrame, allow: Sequence[str] = ALLOW) -> DataFrame:
    """``doc_id, spans`` per row of ``docs(doc_id, text)``; spans are ordered by start, then kind."""
    allowed = re.compile("|".join(f"(?:{x})" for x in allow) or r"(?!)", re.A)
    rank = {k: i for i, k in enumerate(KINDS)}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("rank", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                spans = sorted((a, rank[k], b, k) for k, a, b in secrets_in(value.as_py() or "", allowed))
                rows.append([{"kind": k, "rank": r, "start": a, "end": b} for a, r, b, k in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(find, f"doc_id long, spans {SPAN}")


def secrets_in(text: str, allowed: re.Pattern) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of one text."""
    found = []
    if _HINT.search(text.encode()):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    base = sorted((a, b) for _, a, b in found)
    ends = list(accumulate((b for _, b in base), max))
    for run in _RUN.finditer(text):
        spans = dense_stretches(run[0])
        if not spans or allowed.fullmatch(text, *run.span()):
            continue
        for a, b in spans:
            a, b = run.start() + a, run.start() + b
            if not allowed.fullmatch(text, a, b):
                found += [("entropy", *rest) for rest in _without(a, b, base, ends)]
    return found


def _without(a: int, b: int, base: list[tuple[int, int]], ends: list[int]) -> Iterator[tuple[int, int]]:
    """What is left of a span without the spans of ``base``, whose ends so far ascend in ``ends``."""
    for x, y in base[bisect_right(ends, a):]:
        if x >= b:
            break
        if a < x:
            yield a, x
        a = max(a, y)
    if a < b:
        yield a, b


def dense_stretches(run: str) -> list[tuple[int, int]]:
    """Merged windows of a run whose entropy reaches the threshold of their class."""
    out: list[tuple[int, int]] = []
    for cls, least in CLASSES:
        for m in cls.finditer(run):
            part = m[0]
            if len(part) < WINDOW:
                continue
            for at, bits in enumerate(window_entropies(part)):
                if bits >= least:
                    a, b = m.start() + at, m.start() + at + WINDOW
                    if out and out[-1][0] <= a <= out[-1][1]:
                        out[-1] = (out[-1][0], max(b, out[-1][1]))
                    else:
                        out.append((a, b))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


_TERM = [0.0, *(c * math.log2(c) for c in range(1, WINDOW + 1))]


def window_entropies(part: str) -> Iterator[float]:
    """Shannon entropy of every window of ``WINDOW`` characters, from counts kept up to date."""
    counts: dict[str, int] = {}
    total = 0.0
    for i, c in enumerate(part):
        if i >= WINDOW:
            gone = part[i - WINDOW]
            n = counts[gone]
            total += _TERM[n - 1] - _TERM[n]
            counts[gone] = n - 1
        n = counts.get(c, 0)
        total += _TERM[n + 1] - _TERM[n]
        counts[c] = n + 1
        if i >= WINDOW - 1:
            yield math.log2(WINDOW) - total / WINDOW


def masked(docs: DataFrame, by: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of every secret replaced, overlapping spans as one; ``n_chars``, if there,
    follows the text."""
    allowed = re.compile("|".join(f"(?:{x})" for x in ALLOW), re.A)

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, done = [], 0
        for _, a, b in sorted(secrets_in(text, allowed), key=lambda s: s[1:]):
            if a >= done:
                out += [text[done:a], by]
            done = max(done, b)
        return "".join([*out, text[done:]]) if out else text

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([clean(v.as_py()) for v in batch.column("text")], batch.schema.field("text").type)
            yield batch.set_column(batch.schema.get_field_index("text"), "text", texts)

    done = docs.mapInArrow(mask, docs.schema)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return done
