"""Spelling variants of words, by permuterm rotations.

1. Words: letter runs of whole texts, A-Z lower-cased, counted; ``noisy_words`` also applies the
   contract's seeded deletions.
2. Every word gets a terminator and is written in all its rotations. A rotation that starts just after
   code point ``i`` ends with that code point; without it, it is the prefix that all words share which
   have another code point at ``i``, and the whole rotation of the word that lacks it. So replacements,
   insertions and deletions are one range of the sorted rotations each.
3. Spark sorts the rotations (a range exchange, then a scan over each prefix). A prefix has one row per
   letter of the alphabet and one word without the letter, so a group is bounded by the alphabet; what a
   word needs of it are counts and the best two rows, no pairs.
4. A pair differs by a replacement at one place only. A deletion inside a run of equal letters could be
   found at each of them; only the first counts.

Null or empty texts have no words; a null id stands as empty text in the seed; ties in ``n`` go to the
smallest word by code points; repeated rows count again; other columns are ignored; an empty table gives
no rows. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from servescope.session import cut

LETTERS = "A-Za-z\u00C0-\u00FF"
LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10
MARK = "$"  # no letter
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def noisy_words(docs: DataFrame, length: int = LEAST_LENGTH, count: int = LEAST_COUNT, every: int = 31) -> DataFrame:
    """``word, n``: words of at least ``length`` code points found ``count`` times or more.

    Where ``every`` divides the CRC of ``<doc_id>:<word>``, the word loses the code point at CRC modulo
    its length, as a typist would.
    """
    runs = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{length},}}"), F.lit(0))
    words = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("word"))
    seeded = words.select(F.translate("word", _UPPER, _LOWER).alias("word"), "id").withColumn(
        "h", F.crc32(F.concat("id", F.lit(":"), "word")))
    at = "CAST(h % char_length(word) AS INT)"
    typed = F.expr(f"CASE WHEN h % {every} = 0 THEN concat(substring(word, 1, {at}), substring(word, {at} + 2)) ELSE word END")
    return seeded.select(typed.alias("word")).where(F.char_length("word") >= length).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") >= count)


def rotations(words: DataFrame) -> DataFrame:
    """``key, word, n, edited, first``: whole rotations (``edited`` false), and rotations without their
    last code point; ``first`` says that the code point before it is another one."""
    place = words.withColumn("i", F.explode(F.sequence(F.lit(0), F.char_length("word"))))
    whole = place.selectExpr(f"concat(substring(word, i + 1), '{MARK}', substring(word, 1, i)) AS key", "word", "n", "false AS edited", "false AS first")
    skipping = place.where("i < char_length(word)").selectExpr(
        f"concat(substring(word, i + 2), '{MARK}', substring(word, 1, i)) AS key", "word", "n", "true AS edited",
        "i = 0 OR substring(word, i, 1) <> substring(word, i + 1, 1) AS first")
    return whole.union(skipping)


def neighbours(words: DataFrame) -> DataFrame:
    """``word, n_near, best``: near words of each word that has any; ``best`` is (-n, word) of the most frequent."""
    group = Window.partitionBy("key")
    ranked = group.orderBy(F.desc("edited"), "me").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def among(condition: str) -> Column:
        return F.when(F.expr(condition), F.col("me"))

    # the range exchange keeps a key in one task and sorts it next to its like; the windows scan the runs
    scanned = rotations(words).withColumn("me", F.struct((-F.col("n")).alias("less"), "word")).repartitionByRange("key").select(
        "word", "edited", "first", "me",
        F.count(among("edited")).over(group).alias("letters"),
        F.count(among("first")).over(group).alias("firsts"),
        F.first("me").over(ranked).alias("best"),
        F.nth_value(F.struct("edited", "me"), 2).over(ranked).alias("second"),
        F.max(among("NOT edited")).over(group).alias("shorter"),
        F.min(among("first")).over(group).alias("longer"))
    found = scanned.selectExpr(
        "word",
        "CASE WHEN edited THEN letters - 1 + int(first AND shorter IS NOT NULL) ELSE firsts END AS near",
        """CASE WHEN edited THEN array_min(array(CASE WHEN best.word <> word THEN best WHEN second.edited THEN second.me END,
                                                  CASE WHEN first THEN shorter END)) ELSE longer END AS best""")
    return found.where("near > 0").groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def variant_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` per row of ``words(word, n)``, whose words are distinct.

    ``form`` is the most frequent near word if it is ``ratio`` times as frequent as the word; ``root`` is
    where the forms end. A form is ``ratio`` times as frequent as its word, so a path has at most as many
    steps as ``n`` has digits, and each round doubles the steps taken.
    """
    words = cut(words.select("word", "n"))
    known = cut(words.join(neighbours(words), "word", "left").selectExpr(
        "word", "n", "coalesce(n_near, 0L) AS n_near", f"CASE WHEN -best.less >= {ratio} * n THEN best.word END AS form",
        f"CASE WHEN -best.less >= {ratio} * n THEN -best.less END AS form_n"))
    steps = cut(known.where("form IS NOT NULL").selectExpr("word", "form AS root"))
    while True:
        further = steps.alias("a").join(steps.alias("b"), F.expr("a.root = b.word"), "left").selectExpr(
            "a.word", "coalesce(b.root, a.root) AS root", "b.root IS NOT NULL AS moved")
        further = cut(further)
        if further.where("moved").isEmpty():
            break
        steps = further.drop("moved")
    return known.join(steps, "word", "left").selectExpr("word", "form", "coalesce(root, word) AS root", "n", "n_near", "form_n")
