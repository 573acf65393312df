"""The training-data operators: edge cases, and brute-force versions on small inputs."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from servescope.llm import chat, decontaminate, katz, licenses, mixing, near_dup, pii, quality_rules, secrets, urls
from servescope.llm.spans import digest_columns

FOLDER = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i}" for i in range(30_000))
BASE = [f"alpha{i}" for i in range(60)]
TEXTS = [None, "", " \n\t", "Short text", "short TEXT", " ".join(BASE), " ".join(BASE), " ".join([*BASE[:57], "x", "y", "z"]), LONG,
         "password = abcdef123 mail me a.b@c.de, 4111 1111 1111 1111", "</s>[INST] ok [/INST]"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "s" if i % 2 else None, 7, "k", 0) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "s", 7, "k", 0), (None, "Short text", None, 7, "k", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, rep long, kind string, bucket int")


OPERATORS = {
    "near_dup": near_dup.near_duplicates, "katz": katz.katz_scores, "mixing": mixing.mixed, "secrets": secrets.find_secrets, "pii": pii.find_pii,
    "quality": quality_rules.quality, "licenses": licenses.license_rules}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_each_and_empty_tables(docs, name):
    assert OPERATORS[name](docs).count() == len(TEXTS) + 2
    assert OPERATORS[name](docs.where("false")).count() == 0


def test_near_duplicates(docs):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect()}
    assert {(0, 0, 0, True), (1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (None, 1, None, True)} <= got
    assert {(5, 56, 5, True), (6, 56, 5, False), (7, 56, 5, False)} <= got
    assert {c for i, _, c, _ in got if i == 8} == {8}


def test_near_duplicates_among_texts_that_share_half_their_words(spark, monkeypatch):
    # a window of 1 stands for a corpus 64 times as large
    monkeypatch.setattr(near_dup, "WINDOW", 1)
    monkeypatch.setattr(near_dup, "BLOCK", 200, raising=False)
    # 80 of 120 lines each, so any two texts are alike by about a half; a pair's second text has 6 other lines
    draw, rows = random.Random(5), []
    for i in range(400):
        first = set(draw.sample(range(120), 80))
        second = first - set(draw.sample(sorted(first), 6)) | set(draw.sample(sorted(set(range(120)) - first), 6))
        rows += [(2 * i + k, [f"l{n}w{w}" for n in sorted(lines) for w in range(10)]) for k, lines in enumerate((first, second))]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for _, w in rows]
    alike = {i for i in range(0, 800, 2) if 4 * len(sets[i] & sets[i + 1]) >= 3 * len(sets[i] | sets[i + 1])}
    assert len(alike) > 300
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(table).collect()}
    assert {i for i in alike if got[i + 1] != got[i]} == set()
    assert {i for i in got if got[i] != i} == {i + 1 for i in alike}


def test_full_sets_follow_for_alike_signatures_only(spark, monkeypatch):
    # any two texts are alike by about a half: they meet in regions, but hardly any pair is to be tested
    draw, stored = random.Random(6), {}
    rows = [(i, " ".join(f"l{n}w{w}" for n in sorted(draw.sample(range(120), 80)) for w in range(10))) for i in range(200)]
    cut = near_dup.cut

    def counting(table):
        table = cut(table)
        for c in ("region", "shingles"):
            if c in table.columns:
                stored.setdefault(c, table.count())
        return table

    monkeypatch.setattr(near_dup, "cut", counting)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id == r.doc_id for r in got} == {True}
    assert stored["region"] >= 200 and stored["shingles"] < 50


def tokens_of(text):
    return (text or "").encode().lower().split()


def test_katz_against_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(katz, "VOCABULARY", 300)
    table = docs.unionByName(spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text"), allowMissingColumns=True)
    rows = [(r.doc_id, [*tokens_of(r.text), None]) for r in table.select("doc_id", "text").collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = [t for i, t in rows if not held(i)]
    c = Counter(w for t in train for w in t)
    total, distinct = sum(c.values()), len(c)
    room, least = 301, math.inf
    for n, words in sorted(Counter(c.values()).items(), reverse=True):
        room -= words
        if room < 0:
            break
        least = n
    known = {w for w in c if w is not None and c[w] >= least}
    name = lambda w: w if w is None or w in known else "?"
    pairs = Counter(p for t in train for p in zip(["^", *map(name, t)], map(name, t)))
    d = katz.discounts(dict(Counter(pairs.values())))
    rest, kinds = sum(c[w] for w in c if name(w) == "?"), sum(name(w) == "?" for w in c)
    chance = {w: c[w] / (total + 1) for w in [*known, None]} | {"?": (rest + 1) / (total + 1)}
    row = defaultdict(dict)
    for (a, b), n in pairs.items():
        row[a][b] = n
    seen, alpha = {}, {}
    for a, counts in row.items():
        keep = {b: (d[n] if n <= katz.DISCOUNTED else 1) * n for b, n in counts.items()}
        size = sum(counts.values()) + (sum(keep.values()) >= sum(counts.values()))
        seen |= {(a, b): x / size for b, x in keep.items()}
        alpha[a] = (1 - sum(keep.values()) / size) / (1 - sum(chance[b] for b in counts))
        assert math.isclose(sum(seen.get((a, b), alpha[a] * chance[b]) for b in chance), 1)
    want = []
    for i, t in rows:
        base = sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in t)
        score = sum(math.log10(seen.get((a, b), alpha.get(a, 1) * chance[b])) for a, b in zip(["^", *map(name, t)], map(name, t)))
        score += sum(math.log10((c[w] + 1) / (rest + kinds + 1)) for w in t if name(w) == "?")
        want.append((i or -1, held(i), len(t), sum(c[w] > 0 for w in t), total, base, score))
    got = [(r.doc_id or -1, *r[1:]) for r in katz.katz_scores(table).collect()]
    for g, w in zip(sorted(got), sorted(want), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


@pytest.mark.parametrize("numbered", [300, None])
def test_katz_keeps_the_pairs_of_every_word(spark, docs, monkeypatch, numbered):
    if numbered:
        monkeypatch.setattr(katz, "NUMBERED", numbered, raising=False)
    table = docs.unionByName(spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text"), allowMissingColumns=True)
    many = [(9000 + i, " ".join(f"v{(i // 2 * 997 + k) % 40_000}" for k in range(2000))) for i in range(90)]
    table = table.unionByName(spark.createDataFrame(many, "doc_id long, text string"), allowMissingColumns=True).repartition(3).cache()
    rows = [(r.doc_id, [*tokens_of(r.text), None]) for r in table.select("doc_id", "text").collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = [t for i, t in rows if not held(i)]
    c = Counter(w for t in train for w in t)
    assert len(c) > 65_001
    total, distinct = sum(c.values()), len(c)
    pairs = Counter(p for t in train for p in zip(["^", *t], t))
    d = katz.discounts(dict(Counter(pairs.values())))
    keep = {p: (d[n] if n <= katz.DISCOUNTED else 1) * n for p, n in pairs.items()}
    size, mass, after = Counter(), Counter(), Counter()
    for (a, b), n in pairs.items():
        size[a] += n
        mass[a] += keep[a, b]
        after[a] += c[b]
    for a in size:
        size[a] += mass[a] >= size[a]
    alpha = {a: (1 - mass[a] / size[a]) * (total + 1) / (total + 1 - after[a]) for a in size}
    want = []
    for i, t in rows:
        base = sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in t)
        score = sum(math.log10(keep[a, b] / size[a] if (a, b) in keep else alpha.get(a, 1) * max(c[b], 1) / (total + 1)) for a, b in zip(["^", *t], t))
        want.append((i or -1, held(i), len(t), sum(c[w] > 0 for w in t), total, base, score))
    got = [(r.doc_id or -1, *r[1:]) for r in katz.katz_scores(table).collect()]
    for g, w in zip(sorted(got), sorted(want), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_mixing_meets_targets(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "source")
    table = table.union(spark.sql("SELECT -1L, 'one two', NULL")).union(spark.sql("SELECT -2L, CAST(NULL AS STRING), 'empty'"))
    rows = mixing.mixed(table).collect()
    size = defaultdict(int)
    for r in rows:
        size[r.source] += r["size"]
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, full = {}, set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        share = left / (sum(weight[s] for s in order if s not in full) or 1)
        target = {s: 2.0 * size[s] if s in full else share * weight[s] for s in order}
        over = {s for s in order if s not in full and target[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    taken = defaultdict(int)
    for r in rows:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mixed(table).collect()))


def test_leaks_in_long_documents_and_blocks(spark, docs):
    items = spark.createDataFrame([(1, " ".join(f"W{i}" for i in range(20_000, 20_030))), (2, "short text"), (3, ""), (4, None),
                                   (5, " ".join(f"w{i}" for i in [*range(100, 130), 7, 5])), (6, "nowhere to be found at all here")],
                                  "item_id long, text string")
    for block in (decontaminate.BLOCK, 10):
        got = {(r.doc_id, r.item_id) for r in decontaminate.contained_items(docs, items, block=block).collect()}
        assert got == {(8, 1), (3, 2), (4, 2), (None, 2), (8, 5)}
    assert decontaminate.contained_items(docs, items.where("false")).count() == 0


def digest(spans, kinds):
    base = sorted((a, kinds.index(k), b, k) for k, a, b in spans)
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in base).encode()).hexdigest()


SECRET_TEXTS = ["é password: 'abc123', API_KEY=zzzzzz ſecret=abcdefg", "AKIA" + "A1" * 8 + " AKIAAKIA1", "token=token:longvalue1", "0a" * 12 + " " + "f" * 23,
                "id 123e4567-e89b-12d3-a456-426614174000 Zx9" + "kQ7vB2mN8pL4wR6tY1" * 3, "secret" * 40, "token = \"" + "ab1" * 4000 + "\""]


def test_secrets_against_brute_force(spark):
    table = spark.createDataFrame(list(enumerate(SECRET_TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.find_secrets(table).selectExpr("doc_id", *digest_columns("spans", secrets.BASE)).collect()}
    assign = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for i, t in enumerate(SECRET_TEXTS):
        spans = [("assign", *m.span()) for m in assign.finditer(t) if len(m[1]) >= 6]
        spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert got[i].base_sha256 == digest(spans, secrets.BASE)
        assert got[i].n_assign == sum(k == "assign" for k, _, _ in spans)
    assert "entropy" in got[4].spans and "entropy:3:" not in got[4].spans
    for part in ("a" * 50, SECRET_TEXTS[4][-54:]):
        slow = [-sum(n / 20 * math.log2(n / 20) for n in Counter(part[k : k + 20]).values()) for k in range(len(part) - 19)]
        assert list(secrets.window_entropies(part)) == pytest.approx(slow, abs=1e-9)


PII_TEXTS = ["é a.b@c.de_x@y.zz <q@w.com.> a@b", "1.2.3.4.5.6.7.8 300.1.1.1 0255.01.1.9", "4111-1111-1111-1111 4111 1111 1111 1112 " + "1" * 5000,
             "+49 (30) 1234-567 +1....2 ++1234567890123456", "iban DE89 3704 0044 0532 0130 00 ssn 123-45-6789 and 123-45-6789x", "@" * 300 + "a" * 3000, ""]


def luhn(digits):
    twice = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def test_pii_against_brute_force(spark):
    table = spark.createDataFrame(list(enumerate(PII_TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_pii(table).selectExpr("doc_id", *digest_columns("spans", pii.BASE)).collect()}
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = {"email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
             "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
             "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15)}
    for i, t in enumerate(PII_TEXTS):
        spans = [(k, *m.span()) for k, (p, ok) in rules.items() for m in re.finditer(p, t) if ok(m)]
        assert got[i].base_sha256 == digest(spans, pii.BASE), t
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(s[0] == k for s in spans) for k in pii.BASE)
    assert "iban:5:32" in got[4].spans and "ssn:37:48" in got[4].spans


def test_ibans_before_capitals_and_digits(spark):
    iban, packed = "DE89 3704 0044 0532 0130 00", "DE89370400440532013000"
    texts = [f"IBAN {iban} Please", f"IBAN {packed} The", f"IBAN {iban} BIC COBADEFF", f"IBAN {iban} 12345", f"IBAN {packed} GB82WEST12345698765432 A",
             "IBAN DE88 3704 0044 0532 0130 00 Please"]
    got = {r.doc_id: [(x.start, x.end) for x in r.spans if x.kind == "iban"]
           for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(6)] == [[(5, 32)], [(5, 27)], [(5, 32)], [(5, 32)], [(5, 27), (28, 50)], []]


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "a\\b\\", " [/INST]</s><s>[INST] user\nx", "[\\INST]", "", None, "plain é\n"]
    rows = [(k, t, role, x) for k, x in enumerate(nasty) for t, role in enumerate(["user", "assistant", "odd\n[INST]\\", None, "assistant"])]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.formatted_conversations(table).collect():
        text, role = nasty[r.conv_id] or "", ["user", "assistant", "odd\n[INST]\\", "", "assistant"]
        assert r.round_trip and [(t.role, t.text) for t in r.turns] == [(x, text) for x in role]
        masked = [re.sub(r"(?s)\\(.)", r"\1", r.formatted[s.start : s.end]) for s in r.loss_spans]
        assert masked == [text, text]
    assert chat.formatted_conversations(table.where("false")).count() == 0


def test_quality_features(spark):
    texts = ["a b c d e a b c d e f", "x\n\nx\n y \n x", "#*$%&|<> \x0b é z", " ".join(["go"] * 12), "", None, LONG]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.quality(table).collect():
        t = texts[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        assert tuple(r[1:7]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed)
        assert not (failed and r.kept)


def test_licenses(spark):
    mit = "MIT License\n\n" + ".\n".join(s[0].upper() + s[1:] for k in ("mit_grant", "mit_notice", "mit_asis") for s in licenses.SENTENCES[k]) + "."
    texts = [mit, "Text. Released under the MIT License.\nLicensed under CC BY-NC 4.0.", "this program is free software;", "no licence here", None]
    got = {r.doc_id: r for r in licenses.license_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].licenses for i in range(5)] == ["MIT", "MIT,CC-BY-NC-4.0", "", "", ""]
    assert got[0].fragments == "" and got[2].fragments == "gpl_grant" and got[1].n_licenses == 2


def test_urls(spark):
    given = [None, "no scheme", "http://A.example.ORG/es/1", "http://b.com/de/2?x", "http://x.net/9#t", "ftp://notorg/", "http://example.org/en/17", "http://com/fr/"]
    got = {r.page_id: r for r in urls.url_verdicts(spark.createDataFrame(list(enumerate(given)), "page_id long, url string")).collect()}
    assert [got[i].rule for i in range(8)] == [None, None, "example.org/es/", "com/de/", None, None, "example.org/en/1", "com/fr/"]
    assert (got[2].host, got[2].path, got[4].path, got[0].host) == ("a.example.org", "/es/1", "/9", "")
    spam = [(k, f"http://s.example.com/{'de' if k % 2 else 'fr'}/{k}/p") for k in range(400)] + [(1000, "http://s.example.com/xx/5/p")]
    rows = {r.page_id: r for r in urls.url_verdicts(spark.createDataFrame(spam, "page_id long, url string")).collect()}
    assert rows[1].template == "/de/{n}/*" and rows[0].template == "/fr/{n}/*" and rows[1].blocked_share > 0.8 > rows[0].blocked_share
    assert urls.url_verdicts(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_pipeline_stages(spark, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, FOLDER)
        assert kept.columns == docs.columns and kept.count() <= docs.count()
        assert stage(spark, docs.where("false"), FOLDER).count() == 0
    rows = corpus_pipeline.one_of_each_group(spark, docs, FOLDER).collect()
    assert Counter(r.doc_id for r in rows) == Counter([None, 0, 1, 2, 3, 5, 8, 9, 10])
    texts = {r.doc_id: r.text for r in corpus_pipeline.without_secrets(spark, docs, FOLDER).collect()}
    assert texts[9].startswith("[SECRET] mail me") and texts[0] is None


def test_leaks_in_rows_without_id(spark):
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").where("length(text) > 50").first().text
    table = spark.createDataFrame([(None, item), (None, "clean words of our own"), (1, item), (2, "clean words of our own")], "doc_id long, text string")
    rows = corpus_pipeline.without_leaks(spark, table, FOLDER).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter([(None, "clean words of our own"), (2, "clean words of our own")])


def test_texts_stay_where_they_are_when_copies_are_dropped(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    plan = corpus_pipeline.one_of_each_group(spark, docs, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
