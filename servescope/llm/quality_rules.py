"""Document quality by weak supervision: rules vote, expectation-maximisation weighs them.

Features are SQL expressions within a row. Each rule votes good (1), bad (-1) or abstains (0). The
corpus is tabulated to its vote patterns, at most 3^8 = 6,561 rows whatever its size; on that table
EM fits, for a hidden class good or bad, how often each rule casts each vote. The posterior of good
then replaces an all-must-pass filter. What is held of a rule beforehand weighs as much as a fifth of
the corpus, and a rule's bad vote stays at least as likely under bad as under good, so the classes
cannot swap; ties and repeated rows only change counts.

Null, empty or wordless text: no words, all counts 0, ``base_failed``. Null ids and repeated rows are
carried; other columns are ignored (``good_documents`` keeps them); an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\\x20\\x09-\\x0D]+"
# name: (good if, bad if), over the features; in between a rule abstains
RULES = {
    "length": ("n_words >= 50", "n_words < 20"),
    "symbols": ("50 * n_symbols <= n_words", "5 * n_symbols > n_words"),
    "letters": ("20 * n_letters >= 17 * word_chars", "4 * n_letters < 3 * word_chars"),
    "repeats": ("50 * n_repeat_words <= n_words", "10 * n_repeat_words > n_words"),
    "lines": ("n_lines >= 3 AND n_dup_lines = 0", "n_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines"),
    "word_length": ("word_chars BETWEEN 3 * n_words AND 10 * n_words", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    "capitals": ("5 * n_capitals <= word_chars", "2 * n_capitals > word_chars"),
    "shouting": ("20 * n_marks <= n_words", "5 * n_marks > n_words"),
}
ROUNDS = 30
# what is held of a rule before any document is seen, and its weight as a share of the corpus
GOOD = {1: 0.895, 0: 0.10, -1: 0.005}
BAD = {1: 0.75, 0: 0.05, -1: 0.20}
PRIOR = 0.85
WEIGHT = 0.2


def features(text: str) -> Column:
    """One struct of counts; every count covers the whole text."""
    t = "__text"
    hashes = "transform(sequence(0, size(w) - 5), i -> xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]))"
    # places of windows that occur again, in order; a place covers five words or up to the next one
    places = ("array_sort(flatten(transform(array(array_sort(transform(h, (x, i) -> struct(x AS h, i AS i)))), s -> "
              "zip_with(slice(s, 1, size(s) - 1), slice(s, 2, size(s)), "
              "(a, b) -> CASE WHEN a.h = b.h THEN array(a.i, b.i) ELSE array() END))[0]))")
    covered = ("5 + aggregate(zip_with(slice(p, 1, size(p) - 1), slice(p, 2, size(p)), (a, b) -> least(5, b - a)), 0, (s, x) -> s + x)")
    repeated = (f"CASE WHEN size(w) < 6 THEN 0 ELSE transform(array({hashes}), h -> "
                f"CASE WHEN size(array_distinct(h)) = size(h) THEN 0 ELSE transform(array({places}), p -> {covered})[0] END)[0] END")
    lines = f"filter(split({t}, '\\n', -1), l -> l RLIKE '{WORD}')"
    return F.expr(f"""transform(array(coalesce(CAST({text} AS STRING), '')), {t} ->
        transform(array(struct(regexp_extract_all({t}, '{WORD}', 0) AS w, {lines} AS l)), x -> struct(
            CAST(size(x.w) AS BIGINT) AS n_words,
            CAST(char_length(array_join(x.w, '')) AS BIGINT) AS word_chars,
            CAST(regexp_count({t}, '[#*$%&|<>]') AS BIGINT) AS n_symbols,
            CAST(size(x.l) AS BIGINT) AS n_lines,
            CAST(size(x.l) - size(array_distinct(x.l)) AS BIGINT) AS n_dup_lines,
            CAST(transform(array(x.w), w -> {repeated})[0] AS BIGINT) AS n_repeat_words,
            CAST(regexp_count({t}, '\\\\p{{Lu}}') AS BIGINT) AS n_capitals,
            CAST(regexp_count({t}, '\\\\p{{L}}') AS BIGINT) AS n_letters,
            CAST(regexp_count({t}, '[!?]') AS BIGINT) AS n_marks))[0])[0]""")


BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def votes(struct: str) -> list[Column]:
    """A vote per rule, over the features in the named struct."""

    def at(rule: str) -> str:
        return re.sub(r"\b(n_\w+|word_chars)\b", rf"{struct}.\1", rule)

    return [F.expr(f"CASE WHEN {at(good)} THEN 1 WHEN {at(bad)} THEN -1 ELSE 0 END") for good, bad in RULES.values()]


def fit(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[dict[int, float]]]:
    """Log-odds of good, and per rule the log-odds that each vote adds, from counted vote patterns."""
    rules = len(RULES)
    good, bad, prior = [GOOD] * rules, [BAD] * rules, PRIOR
    weight = WEIGHT * sum(n for _, n in patterns) + 1
    for _ in range(ROUNDS):
        sums = [[{v: weight * x for v, x in held.items()} for _ in range(rules)] for held in (GOOD, BAD)]
        total = [weight * PRIOR, weight * (1 - PRIOR)]
        for votes_, n in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(good[j][v] / bad[j][v]) for j, v in enumerate(votes_))
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
            for j, v in enumerate(votes_):
                sums[0][j][v] += n * p
                sums[1][j][v] += n * (1 - p)
            total[0] += n * p
            total[1] += n * (1 - p)
        prior = min(0.999, max(0.5, total[0] / sum(total)))
        for j in range(rules):
            for table, s in ((good, sums[0][j]), (bad, sums[1][j])):
                table[j] = {v: x / sum(s.values()) for v, x in s.items()}
            if bad[j][-1] < good[j][-1]:  # a rule that tells nothing
                good[j] = bad[j] = _pooled(sums[0][j], sums[1][j])
    return math.log(prior / (1 - prior)), [{v: math.log(good[j][v] / bad[j][v]) for v in (1, 0, -1)} for j in range(rules)]


def _pooled(a: dict[int, float], b: dict[int, float]) -> dict[int, float]:
    both = {v: a[v] + b[v] for v in a}
    return {v: x / sum(both.values()) for v, x in both.items()}


def judged(docs: DataFrame) -> DataFrame:
    """``docs`` as one struct ``row``, with structs ``quality`` (features) and ``verdict`` (base_failed,
    posterior, kept) beside it, so that no column of ``docs`` can clash."""
    with_features = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), features("text").alias("quality"))
    names = list(RULES)
    cast = [v.alias(f"v_{n}") for n, v in zip(names, votes("quality"))]
    counted = with_features.select(*cast).groupBy(*[f"v_{n}" for n in names]).count().collect()
    patterns = sorted((tuple(int(x) for x in row[:-1]), row[-1]) for row in counted)
    prior, weights = fit(patterns)
    odds = F.lit(prior)
    for vote, weight in zip(votes("quality"), weights):
        odds = odds + F.when(vote == 1, F.lit(weight[1])).when(vote == -1, F.lit(weight[-1])).otherwise(F.lit(weight[0]))
    failed = F.expr(re.sub(r"\b(n_\w+)", r"quality.\1", BASE_FAILED))
    posterior = 1 / (1 + F.exp(-odds))
    verdict = F.struct(failed.alias("base_failed"), posterior.alias("posterior"))
    return with_features.withColumn("verdict", verdict).withColumn(
        "verdict", F.expr("struct(verdict.base_failed, verdict.posterior, NOT verdict.base_failed AND verdict.posterior >= 0.5 AS kept)"))


def quality(docs: DataFrame) -> DataFrame:
    """Features, ``base_failed``, ``posterior`` of good and ``kept`` per row of ``docs(doc_id, text)``."""
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select(
        "row.doc_id", *[f"quality.{c}" for c in counts], "verdict.base_failed", "verdict.kept", "verdict.posterior")


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``."""
    return judged(docs).where("verdict.kept").select(*[F.col(f"row.`{c}`") for c in docs.columns])
