"""Conversations as training text, proved by a grammar round trip, with the spans that bear loss.

A turn is ``<s>[INST] role`` newline ``text [/INST]</s>``. A deterministic parser reads the text back: it
cuts at the closing mark, takes no turn with a control string left inside, cuts the role at the first
newline that no backslash guards, and drops one backslash before any character. A conversation is first rendered as it is; if the parser does not give back the
same roles and texts, it is rendered with escapes (a backslash is doubled, one goes into each control
string of a text, and before each newline of a role) and compared again. ``round_trip`` says that the
rendering that is returned reads back identically.

Turns are in order of turn, then role and text, so reruns agree; a null turn comes first, null roles and
texts are empty, repeated rows are repeated turns. Rows with a null ``conv_id`` are one conversation. A
conversation is one row by its nature, so its turns are gathered; other columns are ignored; an empty
table gives an empty result. All of it is SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servescope.llm.spans import running, sql_text

OPEN, CLOSE = "<s>[INST] ", " [/INST]</s>"
LOSS_ROLE = "assistant"
# fixed values: control strings and what stands for them inside a text
_ESCAPES = (("\\", "\\\\"), ("[INST]", "[\\INST]"), ("[/INST]", "[\\/INST]"), ("<s>", "<\\s>"), ("</s>", "<\\/s>"))


def escaped(text: str) -> str:
    for plain, guarded in _ESCAPES:
        text = f"replace({text}, {sql_text(plain)}, {sql_text(guarded)})"
    return text


def unescaped(text: str) -> str:
    return f"regexp_replace({text}, {sql_text(chr(92) * 2 + '(.)').replace('(.)', '((?s:.))')}, '$1')"


def parsed(formatted: str) -> str:
    """``array<struct<role, text>>`` that the parser reads from a formatted text."""
    # what follows the last closing mark is empty in a sound text and a broken turn in any other
    parts = f"split({formatted}, {sql_text(_quoted(CLOSE))}, -1)"
    head = f"substring(p, {len(OPEN) + 1})"
    role = f"regexp_extract({head}, {sql_text(r'(?s)^((?:[^\n\\]|\\.)*+)' + chr(10))}, 1)"
    # a control string inside a turn is no text: only an escaped one may stand there
    sound = f"startswith(p, {sql_text(OPEN)}) AND NOT {head} RLIKE {sql_text('|'.join(_quoted(m) for m, _ in _ESCAPES[1:]))}"
    turn = (f"CASE WHEN {sound} THEN transform(array({role}), r -> struct("
            f"{unescaped('r')} AS role, {unescaped(f'substring({head}, char_length(r) + 2)')} AS text))[0] END")
    return (f"transform(array({parts}), a -> transform(CASE WHEN element_at(a, -1) = '' THEN slice(a, 1, size(a) - 1) ELSE a END, "
            f"p -> {turn}))[0]")


def _quoted(mark: str) -> str:
    return "".join(f"\\{c}" if c in "[]<>/" else c for c in mark)


def formatted_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans, turns, round_trip`` per conversation of ``(conv_id, turn, role, text)``.

    ``turns`` are read back from ``formatted``; ``loss_spans`` are ``struct<start, end>`` in code points.
    """
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    gathered = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("t")).selectExpr(
        "conv_id", "transform(t, x -> struct(x.role AS role, x.text AS text)) AS source")

    def rendered(role: str, text: str) -> str:
        pieces = f"concat({sql_text(OPEN)}, {role}, '\\n')"
        return f"transform(source, x -> struct({pieces} AS head, {text} AS body, x.role = '{LOSS_ROLE}' AS loss))"

    joined = "array_join(transform({r}, x -> concat(x.head, x.body, " + sql_text(CLOSE) + ")), '')"
    role_escaped = f"replace({escaped('x.role')}, '\\n', {sql_text(chr(92) + chr(10))})"
    plain = gathered.withColumn("r", F.expr(rendered("x.role", "x.text"))).withColumn("formatted", F.expr(joined.format(r="r"))).withColumn(
        "same", F.expr(f"{parsed('formatted')} <=> source"))
    final = plain.withColumn("r", F.expr(f"CASE WHEN same THEN r ELSE {rendered(role_escaped, escaped('x.text'))} END")).withColumn(
        "formatted", F.expr(f"CASE WHEN same THEN formatted ELSE {joined.format(r='r')} END")).withColumn("turns", F.expr(parsed("formatted")))
    lengths = f"transform(r, x -> CAST(char_length(x.head) + char_length(x.body) + {len(CLOSE)} AS BIGINT))"
    spans = (f"transform(array({running(lengths)}), b -> filter(zip_with(r, slice(b, 1, size(r)), (x, s) -> CASE WHEN x.loss THEN "
             "struct(s + char_length(x.head) AS start, s + char_length(x.head) + char_length(x.body) AS end) END), x -> x IS NOT NULL))[0]")
    return final.select("conv_id", "formatted", F.expr(spans).alias("loss_spans"), "turns", F.expr("turns <=> source").alias("round_trip"))
