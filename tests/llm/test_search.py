"""Spelling variants, repeated byte strings and whitening against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from servescope.llm import queries, spelling, suffix_dedup, whitening

FOLDER = "/root/testdata/sf0.001"


# --- spelling variants -------------------------------------------------------------------------

def variants_of(counts, ratio=10):
    near, holes = defaultdict(set), defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].add(w)
            less = w[:i] + w[i + 1 :]
            if less in counts:
                near[w].add(less), near[less].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def test_variants_against_brute_force(spark):
    draw = random.Random(3)
    counts = {"".join(draw.choice("abé") for _ in range(draw.randint(1, 7))): draw.choice((2, 3, 25, 300, 4000)) for _ in range(700)}
    table = spark.createDataFrame([(w, n, 1, "k") for w, n in counts.items()], "word string, n long, i int, key string")
    assert {tuple(r) for r in spelling.variant_groups(table).collect()} == variants_of(counts)
    assert spelling.variant_groups(table.where("false")).count() == 0


def test_noisy_words_against_brute_force(spark):
    texts = [(i, t) for i, t in enumerate([None, "", "Éléphant éLÉPHANT elephant9elephants", "wordword " * 200, "x" * 40_000])]
    texts += [(3, "wordword " * 200), (None, "wordword lettering")]
    table = spark.createDataFrame([(*t, "w", 5) for t in texts], "doc_id long, text string, word string, h int")
    counts = Counter()
    for i, text in texts:
        for m in re.finditer("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in m[0])
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    got = {r.word: r.n for r in spelling.noisy_words(table).collect()}
    assert got == {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    assert spelling.noisy_words(table.where("false")).count() == 0


# --- repeated strings --------------------------------------------------------------------------

def parts_of(texts, width=400):
    """Removed runs of each text, by a table of all strings of ``width`` bytes."""
    where = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - width + 1):
            if where[t[i : i + width]] > 1:
                gone[i : i + width] = 1
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone))))
        out.append(list(zip(edges[::2].tolist(), edges[1::2].tolist())))
    return out


def check_parts(spark, rows):
    table = spark.createDataFrame([(i, t, b"x", 0, 3) for i, t in rows], "doc_id long, text string, body binary, start int, h int")
    got = suffix_dedup.repeated_parts(table).collect()
    want = parts_of([(t or "").encode() for _, t in rows])
    expect = Counter()
    for (i, t), spans in zip(rows, want):
        data = (t or "").encode()
        kept = b"".join(data[a:b] for a, b in zip([0, *[e for _, e in spans]], [*[s for s, _ in spans], len(data)]))
        expect[i, len(data), tuple(spans), hashlib.md5(kept).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), hashlib.md5(r.kept).hexdigest()) for r in got) == expect


def prose(draw, n):
    return " ".join("".join(draw.choice("abcdefghé") for _ in range(draw.randint(2, 9))) for _ in range(n))


def test_repeats_in_edited_copies(spark):
    draw = random.Random(7)
    first, passage = prose(draw, 900), prose(draw, 75)
    rows = [(0, first), (1, first), (2, first[:2000] + "!" + first[2001:]), (3, first[150:3300]), (4, prose(draw, 400)), (None, passage), (None, passage)]
    for k in range(12):  # copies with one edit in about 300 characters, and a passage among other words
        copy = list(first)
        for at in range(draw.randrange(300), len(copy), draw.randint(250, 450)):
            copy[at] = draw.choice(("", "#", "xyz"))
        rows += [(10 + k, "".join(copy)), (30 + k, prose(draw, draw.randint(3, 60)) + passage + prose(draw, draw.randint(3, 60)))]
    check_parts(spark, rows)


def test_repeats_at_the_edges(spark):
    line = "the same line again and again, and once more. "
    check_parts(spark, [
        (1, None), (2, ""), (3, "z" * 399), (4, "z" * 400), (5, "y" * 400), (6, "y" * 401), (7, "x" * 3000), (8, line * 40), (8, line * 40),
        (9, "q" + line * 30), (10, "中" * 300), (11, "中" * 300 + "w"), (12, "a" * 399 + "b" + "a" * 399 + "b")])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.repeated_parts(empty).count() == 0


def test_repeats_in_texts_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    draw = random.Random(11)
    text = prose(draw, 3000)
    check_parts(spark, [(1, text), (2, text[:7000] + "?" + text[7200:]), (3, "v" + text[900:2600])])


# --- whitening ---------------------------------------------------------------------------------

def fitted(vectors):
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors], dtype=np.int64)
    u = np.unique(x, axis=0)
    n, total = len(u), u.sum(axis=0)
    centred = (n * u - total) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return x, n, total, values[::-1], vectors[:, ::-1]


def check_whitening(spark, rows, components, distinct=True):
    table = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, n int, x double")
    got = defaultdict(dict)
    for r in whitening.whiten(table).collect():
        got[r.vec_id][r.component] = r
    x, n, total, values, vectors = fitted([v for _, v in rows])
    white = ((n * x - total) / n) @ vectors[:, :components] / np.sqrt(values[:components])
    mine = np.array([[got[i][k + 1].whitened for k in range(components)] for i, _ in rows])
    assert all(len(got[i]) == components for i, _ in rows)
    if distinct:
        assert np.abs(mine * np.sign((mine * white).sum(axis=0)) - white).max() < 1e-9
    for (i, _), row in zip(rows, x):
        one = got[i][1]
        assert one.n == n and int(one.deviation) == sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total))
        assert one.identity_error < 1e-9
    assert [got[rows[0][0]][k + 1].explained for k in range(components)] == pytest.approx(values[:components] / values.sum(), rel=1e-9)


def test_whitening_against_a_dense_solver(spark):
    draw = np.random.default_rng(1)
    vectors = draw.normal(size=(300, 24)) @ np.diag(0.8 ** np.arange(24)) * 5
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(500 + i, vectors[0].tolist()) for i in range(200)]
    check_whitening(spark, rows, 16)


def test_whitening_of_low_rank_and_equal_variances(spark):
    draw = np.random.default_rng(2)
    low = np.round(draw.normal(size=(80, 3)) * 4) @ np.round(draw.normal(size=(3, 9)) * 2)  # rank 3 in 9 entries
    check_whitening(spark, [(i, v.tolist()) for i, v in enumerate(low)], 3)
    corners = [[float(s * (i == k)) for k in range(5)] for i in range(5) for s in (-3, 3)]  # five equal variances
    check_whitening(spark, list(enumerate(corners)), 5, distinct=False)


def test_whitening_drops_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [3.0, 1.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (7, [1.0]), (None, [5.0, 5.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(table).collect()
    assert {r.vec_id for r in got} == {0, 1, None} and {r.component for r in got} == {1, 2} and {r.n for r in got} == {3}
    assert whitening.whiten(table.where("vec_id = 0")).count() == 0
    assert whitening.whiten(table.where("false")).count() == 0
    large = spark.createDataFrame([(0, [2.0**40, 0.0]), (1, [0.0, 2.0**40]), (2, [5.0, 7.0])], "vec_id long, embedding array<double>")
    assert max(int(r.deviation) for r in whitening.whiten(large).collect()) > 2**63


@pytest.mark.parametrize("name", ["op11_spelling", "op12_suffix_dedup", "op13_whitening"])
def test_queries_read_the_tables(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).count() > 0
