"""Personal data: patterns propose spans, validators confirm them, nearby words adjust the score.

All of it is SQL within a row. Fixed kinds (email, ip, card, phone) count whenever their pattern and
validator hold. Further kinds (iban with mod 97, a card of 13 digits with Luhn, a social security
number, a local phone number) count if their score, with 0.3 added for a context word within 40
characters on either side, reaches ``LEAST``, and if they do not overlap a fixed one. Repetitions in
the patterns are possessive and starts are tied to the start of a run, so any text takes time in
proportion to its length.

Null or empty text: no spans. Null ids and repeated rows are carried as they are; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servescope.llm.spans import matches, sql_text

BASE = ("email", "ip", "card", "phone")
LEAST = 0.6
NEAR = 40
PIECE = 1024
_DIGITS = "regexp_replace({m}.found, '[^0-9]', '')"


def luhn(digits: str) -> str:
    double = "CASE WHEN 2 * d > 9 THEN 2 * d - 9 ELSE 2 * d END"
    digit = f"transform(array(CAST(substring({digits}, length({digits}) - i, 1) AS INT)), d -> CASE WHEN i % 2 = 1 THEN {double} ELSE d END)[0]"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (s, i) -> s + {digit}) % 10 = 0"


def mod97(iban: str) -> str:
    """The first four characters go last, letters count as 10 to 35; the rest by 97 has to be 1."""
    code = "(ascii(c) - CASE WHEN c >= 'A' THEN 55 ELSE 48 END)"
    step = f"(r * CASE WHEN c >= 'A' THEN 100 ELSE 10 END + {code}) % 97"
    return f"aggregate(split(concat(substring({iban}, 5), substring({iban}, 1, 4)), ''), 0, (r, c) -> CASE WHEN c = '' THEN r ELSE {step} END) = 1"


def _count(low: int, high: int, then: str = "true") -> str:
    return f"transform(array({_DIGITS}), n -> length(n) BETWEEN {low} AND {high} AND {then})[0]"


_IP_PART = "transform(array(regexp_replace(p, '^0+', '')), z -> z = '' OR length(z) < 3 OR (length(z) = 3 AND z <= '255'))[0]"
# length of an IBAN by country; codes that are not listed take the longest run
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU"}
_LISTED = "|".join(codes.replace(" ", "|") for codes in IBAN_LENGTHS.values())
_IBAN = "|".join([*[rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items()],
                  rf"(?!{_LISTED})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}+"])
# kind: pattern, cheap condition on the text, validator of a match m, score, context words
KINDS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains({t}, '@')", "true", 0.9,
              "mail|contact|write"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "{t} RLIKE '[0-9][.][0-9]++[.][0-9]++[.][0-9]'",
           f"forall(split({{m}}.found, '[.]'), p -> {_IP_PART})", 0.7, "ip|host|server|address"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "{t} RLIKE '[0-9](?:[ -]?[0-9]){13}'", _count(14, 19, luhn("n")), 0.8, "card|visa|credit|karte|carte"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "contains({t}, '+')", _count(10, 15), 0.7, "phone|call|tel|mobile|fax"),
    "iban": (rf"(?<![A-Za-z0-9])(?:{_IBAN})(?![A-Za-z0-9])", "{t} RLIKE '[A-Z]{2}[0-9]{2}'",
             mod97("replace({m}.found, ' ', '')"), 0.8, "iban|bank|account|konto"),
    "card13": (r"(?<![0-9-])[0-9]{4}(?:[\x20-]?[0-9]{3}){3}(?![0-9-])", "{t} RLIKE '[0-9]{4}(?:[ -]?[0-9]{3}){3}'", _count(13, 13, luhn("n")), 0.4,
               "card|visa|credit|karte|carte"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "{t} RLIKE '[0-9]{3}-[0-9]{2}-[0-9]{4}'",
            "NOT {m}.found RLIKE '^(?:000|666|9)|-00-|-0000$'", 0.4, "ssn|social|security"),
    "local_phone": (r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9.-])", "{t} RLIKE '[0-9]{3}[.-][0-9]{4}'", "true", 0.4,
                    "phone|call|tel|mobile|fax"),
}


def _cut(start: str, length: str) -> str:
    """Characters of the text from ``start``, from the two pieces that hold them: a place in a long text is
    found by walking to it."""
    at = f"CAST(({start}) div {PIECE} AS INT)"
    two = f"concat(coalesce(get(pieces, {at}), ''), coalesce(get(pieces, {at} + 1), ''))"
    return f"substring({two}, CAST(({start}) % {PIECE} AS INT) + 1, CAST({length} AS INT))"


def pii_spans(text: str) -> str:
    """``array<struct<kind, rank, start, end, score>>`` of a text column, ordered by start, then kind."""
    parts = []
    for rank, (kind, (pattern, guard, valid, score, words)) in enumerate(KINDS.items()):
        around = f"concat({_cut(f'greatest(m.start - {NEAR}, 0)', f'least(m.start, {NEAR})')}, ' ', {_cut('m.end', str(NEAR))})"
        scored = f"CAST({score} AS DOUBLE) + CASE WHEN lower({around}) RLIKE {sql_text(words)} THEN 0.3D ELSE 0D END"
        parts.append(
            f"transform(filter({matches('t', pattern, guard.replace('{t}', 't'))}, m -> {valid.replace('{m}', 'm')}), "
            f"m -> struct(m.start AS start, {rank} AS rank, m.end AS end, '{kind}' AS kind, {scored} AS score))")
    base = f"filter(a, s -> s.rank < {len(BASE)})"
    clear = "NOT exists(b, x -> x.start < s.end AND s.start < x.end)"
    kept = f"filter(a, s -> s.rank < {len(BASE)} OR (s.score >= {LEAST} AND {clear}))"
    pieces = f"regexp_extract_all(t, '(?s).{{1,{PIECE}}}', 0)"
    return (f"transform(array(coalesce(CAST({text} AS STRING), '')), t -> transform(array({pieces}), pieces -> transform(array(concat({', '.join(parts)})), a -> "
            f"transform(array({base}), b -> transform(array_sort({kept}), "
            "s -> struct(s.kind AS kind, s.rank AS rank, s.start AS start, s.end AS end, s.score AS score)))[0])[0])[0])[0]")


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` per row of ``docs(doc_id, text)``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(pii_spans("text")).alias("spans"))
