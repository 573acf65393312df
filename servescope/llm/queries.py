"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from servescope.llm import chat, decontaminate, katz, licenses, mixing, near_dup, pii, quality_rules, secrets, spelling, suffix_dedup, urls, whitening
from servescope.llm.spans import digest_columns

_WORDS = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents")).selectExpr("doc_id", *digest_columns("spans", secrets.BASE))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_verdicts(_table(spark, sf_dir, "pages"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents")).selectExpr("doc_id", *digest_columns("spans", pii.BASE))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(added)
    loss = f"array_join(transform(loss_spans, s -> {chat.unescaped('substring(formatted, CAST(s.start AS INT) + 1, CAST(s.end - s.start AS INT))')}), '')"
    return chat.formatted_conversations(turns).withColumn("loss", F.expr(loss)).selectExpr(
        "conv_id", "CAST(size(turns) AS BIGINT) AS n_turns",
        "sha2(array_join(transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')), ''), 256) AS turns_sha256",
        "CAST(char_length(loss) AS BIGINT) AS loss_chars", "sha2(loss, 256) AS loss_sha256",
        "CAST(char_length(formatted) AS BIGINT) AS formatted_chars")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(_table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_rules(_table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(spelling.noisy_words(_table(spark, sf_dir, "documents")))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_parts(_table(spark, sf_dir, "documents")).selectExpr(
        "doc_id", "n_bytes", "n_bytes - length(kept) AS n_removed", "CAST(size(spans) AS BIGINT) AS n_spans", "sha2(kept, 256) AS kept_sha256")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    return done.withColumn("deviation", done["deviation"].cast("long"))


QUERIES = {f.__name__: f for f in (
    op1_near_duplicates, op2_katz_scores, op3_mixing, op4_benchmark_leaks, op5_secrets, op6_urls, op7_pii, op8_chat, op9_quality, op10_licenses,
    op11_spelling, op12_suffix_dedup, op13_whitening)}

_SHINGLES = """{name}_w AS (SELECT {key} AS id, row_number() OVER () AS r, regexp_extract_all({lower}, '{words}') AS w FROM {table}),
    {name}_s AS (SELECT id, r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END) AS s FROM {name}_w)"""


def _shingles(name: str, table: str, key: str) -> str:
    return _SHINGLES.format(name=name, table=table, key=key, lower=_LOWER, words=_WORDS)


_NEAR = f"""WITH RECURSIVE {_shingles('d', 'documents', 'doc_id')},
    n AS (SELECT r, id, count(*) AS n FROM d_s GROUP BY ALL),
    meet AS (SELECT x.r AS a, y.r AS b, count(*) AS c FROM d_s x JOIN d_s y ON x.s = y.s AND x.r < y.r GROUP BY ALL),
    link AS (SELECT p.id AS a, q.id AS b FROM meet JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
    step AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
    reach AS (SELECT DISTINCT id AS a, id AS b FROM n UNION SELECT reach.a, step.b FROM reach JOIN step ON reach.b = step.a),
    least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
    SELECT d_w.id AS doc_id, coalesce(n.n, 0) AS n_shingles, CASE WHEN n.n > 0 THEN coalesce(m, d_w.id) ELSE d_w.id END AS component_id,
           d_w.id = CASE WHEN n.n > 0 THEN coalesce(m, d_w.id) ELSE d_w.id END AS kept
    FROM d_w LEFT JOIN n ON n.r = d_w.r LEFT JOIN least ON least.a = d_w.id"""

_LEAKS = f"""WITH {_shingles('d', 'documents', 'doc_id')}, {_shingles('i', 'benchmark', 'item_id')},
    n AS (SELECT r, id, count(*) AS n FROM i_s GROUP BY ALL),
    meet AS (SELECT d_s.id AS doc_id, d_s.r AS dr, i_s.r AS ir, count(*) AS c FROM d_s JOIN i_s USING (s) GROUP BY ALL)
    SELECT doc_id, n.id AS item_id, n.n AS n_item, c AS n_shared FROM meet JOIN n ON n.r = ir WHERE 100 * c >= 75 * n.n"""


def _chat_sql() -> str:
    def escaped(text: str) -> str:
        for plain, guarded in chat._ESCAPES:
            text = f"replace({text}, '{plain}', '{guarded}')"
        return text

    marks = r"\[INST\]|\[/INST\]|<s>|</s>|\\"
    frame = len(chat.OPEN) + 1 + len(chat.CLOSE)
    return rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    hard AS (SELECT *, bool_or(regexp_matches(role || text, '{marks}') OR contains(role, chr(10))) OVER (PARTITION BY conv_id) AS h FROM t)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
           CAST(sum({frame} + CASE WHEN h THEN length({escaped('text')}) + length(replace({escaped('role')}, chr(10), '\' || chr(10)))
                ELSE length(text) + length(role) END) AS BIGINT) AS formatted_chars
    FROM hard GROUP BY conv_id"""


def _license_sql() -> str:
    known = ", ".join(f"('{s}', '{k}')" for k, v in licenses.SENTENCES.items() for s in v)
    # each step reads the column that the step before wrote
    steps, previous = [], "l0"
    for k, (_, sequence) in enumerate(licenses.RULES):
        chain = f";{';;'.join(sequence)};"
        steps.append(f"l{k + 1} AS (SELECT *, replace(c{k}, '{chain}', ';|;') AS c{k + 1} FROM {previous})")
        previous = f"l{k + 1}"
    names = ", ".join(f"CASE WHEN contains(c{k}, ';{';;'.join(s)};') THEN '{n}' END" for k, (n, s) in enumerate(licenses.RULES))
    plain = (r"regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[.!?:;]+([\x20\x09-\x0D]|$)|\n[^a-z0-9\n]*\n', 'E', 'g'), "
             r"'[^a-z0-9\nE]+', ' ', 'g'), '[ \n]*\n[ \n]*', chr(10), 'g')")
    distinct = "(SELECT coalesce(string_agg(x, ',' ORDER BY i), '') FROM (SELECT x, min(i) AS i FROM (SELECT unnest({v}) AS x, unnest(range(len({v}))) AS i) WHERE {w} GROUP BY x))"
    return f"""WITH known(s, k) AS (VALUES {known}),
    d AS (SELECT row_number() OVER () AS r, doc_id, string_split({plain}, 'E') AS p FROM documents),
    u AS (SELECT r, unnest(p) AS u, unnest(range(len(p))) AS i FROM d),
    v AS (SELECT r, i, u, trim(replace(u, chr(10), ' ')) AS w FROM u),
    l AS (SELECT r, i, trim(unnest(string_split(u, chr(10)))) AS s, unnest(range(len(string_split(u, chr(10))))) AS k FROM v
          WHERE w NOT IN (SELECT s FROM known)),
    e AS (SELECT r, (i, 0) AS i, w AS s FROM v UNION ALL SELECT r, (i, k), s FROM l WHERE s NOT IN (SELECT w FROM v x WHERE x.r = l.r AND x.i = l.i)),
    f AS (SELECT r, string_agg(k, ',' ORDER BY i) AS a, string_agg(k || ';', ';' ORDER BY i) AS b FROM e JOIN known USING (s) GROUP BY r),
    l0 AS (SELECT d.r, doc_id, coalesce(a, '') AS sentence_ids, ';' || coalesce(b, '') || ';' AS c0 FROM d LEFT JOIN f ON f.r = d.r),
    {', '.join(steps)},
    g AS (SELECT *, [x FOR x IN [{names}] IF x IS NOT NULL] AS v, string_split(c{len(licenses.RULES)}, ';') AS u FROM {previous})
    SELECT doc_id, sentence_ids, {distinct.format(v='v', w='true')} AS licenses, {distinct.format(v='u', w="x NOT IN ('', '|')")} AS fragments,
           CAST(len(list_distinct(v)) AS BIGINT) AS n_licenses FROM g"""


# a CRC step takes a byte into the state (a number from 0), or shifts a bit out of it (-1)
_CRC = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, flatten([
        [('0x' || hex(encode({s}))[2 * i - 1:2 * i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR i IN range(1, strlen({s}) + 1)])),
        lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s % 2 = 1 THEN xor(s // 2, 3988292384::BIGINT) ELSE s // 2 END))"""

_VARIANTS = f"""WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
        unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]{{7,}}')) AS run FROM documents),
    told AS (SELECT translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, id, count(*) AS c FROM runs GROUP BY ALL),
    seeded AS (SELECT w, c, {_CRC.format(s="(id || ':' || w)")} AS h FROM told),
    typed AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM seeded),
    words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM typed WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
    place AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words),
    cuts AS (SELECT word, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM place),
    shorter AS (SELECT DISTINCT cuts.word AS x, words.word AS y FROM cuts JOIN words ON words.word = a || b),
    near AS (SELECT x, y FROM shorter UNION SELECT y, x FROM shorter
        UNION SELECT p.word, q.word FROM cuts p JOIN cuts q ON p.i = q.i AND p.a = q.a AND p.b = q.b AND p.word <> q.word),
    best AS (SELECT x, count(*) AS n_near, max(n) AS most FROM near JOIN words ON y = word GROUP BY x),
    named AS (SELECT x, min(y) AS y FROM near JOIN best USING (x) JOIN words ON y = word WHERE n = most GROUP BY x),
    known AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * n THEN y END AS form, CASE WHEN most >= 10 * n THEN most END AS form_n
        FROM words LEFT JOIN best ON best.x = word LEFT JOIN named ON named.x = word),
    path AS (SELECT word, word AS root FROM known UNION ALL SELECT path.word, form FROM path JOIN known ON path.root = known.word WHERE form IS NOT NULL)
    SELECT known.word, known.form, path.root, known.n, known.n_near, known.form_n FROM known JOIN path ON path.word = known.word
    JOIN known k ON k.word = path.root AND k.form IS NULL"""

_REPEATS = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS t FROM documents),
    s AS (SELECT r, i, md5(t[i:i + 399]) AS m FROM (SELECT r, t, unnest(range(1, octet_length(t) - 398)) AS i FROM d)),
    c AS (SELECT m FROM s GROUP BY m HAVING count(*) > 1),
    q AS (SELECT r, i, i - lag(i, 1, -1000) OVER (PARTITION BY r ORDER BY i) > 400 AS new FROM s JOIN c USING (m)),
    g AS (SELECT r, i, count(*) FILTER (new) OVER (PARTITION BY r ORDER BY i) AS k FROM q),
    p AS (SELECT r, k, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY r, k),
    x AS (SELECT r, k, b - a AS n, t[lag(b, 1, 1) OVER (PARTITION BY r ORDER BY k):a - 1] AS t FROM p JOIN d USING (r)),
    y AS (SELECT r, CAST(sum(n) AS BIGINT) AS n, count(*) AS k, string_agg(hex(x.t), '' ORDER BY x.k) AS h, max(b) AS z
          FROM x JOIN p USING (r, k) GROUP BY r)
    SELECT doc_id, octet_length(t) AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(k, 0) AS n_spans,
           sha256(CASE WHEN n IS NULL THEN t ELSE unhex(h || hex(t[z:])) END) AS kept_sha256
    FROM d LEFT JOIN y USING (r)"""

ORACLES = {
    "op1_near_duplicates": _NEAR,
    "op4_benchmark_leaks": _LEAKS,
    "op8_chat": _chat_sql(),
    "op10_licenses": _license_sql(),
    "op11_spelling": _VARIANTS,
    "op12_suffix_dedup": _REPEATS,
}
