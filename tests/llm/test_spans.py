"""Secrets and personal data against Python's regular expressions."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from railframe.llm import pii, secrets
from railframe.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.001"

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


def base(text, rules):
    spans = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(rules.values()) for m in p.finditer(text or "") if ok(m))
    names = list(rules)
    return [sum(s[1] == k for s in spans) for k in range(len(rules))], ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)


SECRET_RULES = {"assign": (ASSIGN, lambda m: len(m[2]) >= 6), "access": (ACCESS, lambda m: len(m[0]) >= 20), "hex": (HEX, lambda m: len(m[0]) >= 24)}
PII_RULES = {
    "email": (EMAIL, lambda m: True),
    "ip": (IP, lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    "card": (CARD, lambda m: 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    "phone": (PHONE, lambda m: 10 <= len(digits(m[0])) <= 15),
}


def generated(seed, n=400):
    """Texts of fragments that meet the patterns' edges."""
    rng = random.Random(seed)
    parts = ["token", "Secret", "API_KEY", "apikey", "passwd", '"', "'", " ", "=", ":", "abcdef", "abc", ".", "AKIA", "ABCDEFGH23456789", "0123456789abcdef", "deadbeef", "é", "😀", "\n", "a@b", "@", "x.y", "..", "-", "_", "%", "192.168.0.1", "256.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "55555555555544447", "+1 (555) 123-4567", "+", "(", ")", "007", "12", "mail7.example.com", "日本"]
    return [None, ""] + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


def check(rows, texts, rules, counts):
    assert len(rows) == len(texts)
    for r in rows:
        n, said = base(texts[r["doc_id"]], rules)
        assert [r[c] for c in counts] == n, texts[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(r["spans"].split(","))
        starts = [int(s.split(":")[1]) for s in r["spans"].split(",") if s]
        assert starts == sorted(starts)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_secrets_of_tables_and_edges(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    counts = ["n_assign", "n_access", "n_hex"]
    check(QUERIES["op6_secret_scan"](spark, SF).collect(), docs, SECRET_RULES, counts)
    texts = generated(1) + ["ab" * 30_000, "token=" + "Z" * 50_000, "x" * 200_000]
    check(secrets.digest(secrets.secrets(frame(spark, texts))).collect(), dict(enumerate(texts)), SECRET_RULES, counts)
    assert secrets.digest(secrets.secrets(frame(spark, texts).limit(0))).count() == 0


def test_random_tokens_are_found_and_written_ones_left(spark):
    rng = random.Random(3)
    key = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    hidden = [key(40) for _ in range(30)]
    plain = ["internationalizations", "https/www/example/com/index", "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz", "abcdefghijklmnopqrstuvwxyz0123456789", "some_long_identifier_in_snake_case", "AnotherIdentifierInCamelCaseForm"] * 10
    texts = [f"see {k} here" for k in hidden] + [f"see {p} here" for p in plain]
    rows = secrets.digest(secrets.secrets(frame(spark, texts))).collect()
    spans = {r["doc_id"]: r["spans"] for r in rows}
    assert sum(spans[i] == "random:4:44" for i in range(len(hidden))) >= 28
    assert not any(spans[i] for i in range(len(hidden), len(texts)))
    clean = {r["doc_id"]: r["text"] for r in secrets.redacted(frame(spark, [*texts, None, 'a token = "abcdef12" b'])).collect()}
    assert clean[len(texts)] is None and clean[len(texts) + 1] == "a <assign>\" b" and clean[len(texts) - 1] == texts[-1]
    assert sum(clean[i] == "see <random> here" for i in range(len(hidden))) >= 28


def test_random_tokens_of_every_encoding_are_found(spark):
    rng = random.Random(5)
    upper, lower, digit = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    encodings = {"hex": ("0123456789ABCDEF", 40), "digits": (digit, 23), "lower": (lower, 96), "upper": (upper, 96), "base32": (upper + "234567", 72), "small32": (lower + "234567", 72), "base64": (upper + lower + digit + "+/", 40)}
    written = ["internationalizationofthecommunicationsdepartment", "THEQUICKBROWNFOXJUMPSOVERTHELAZYDOGANDRUNSAWAY", "12345678901234567890", "00000000001111111111", lower * 3, "THEDEPARTMENTOFINTERNATIONALTRADEANDCOMMERCE" * 2, "MODEL2SERIAL4NUMBER7COUNTRYOFORIGIN2345"]
    for name, (alphabet, n) in encodings.items():  # of digits, 24 and more are a base span
        texts = [f"see {''.join(rng.choice(alphabet) for _ in range(n))} here" for _ in range(30)] + [f"see {w} here" for w in written]
        spans = {r["doc_id"]: r["spans"] for r in secrets.digest(secrets.secrets(frame(spark, texts))).collect()}
        assert sum(spans[i] == f"random:4:{4 + n}" for i in range(30)) >= (27 if n > 23 else 20), name
        assert not any(spans[i] for i in range(30, len(texts))), name


def test_redaction_keeps_columns_with_the_operator_s_names(spark):
    docs = spark.createDataFrame([(1, "AKIA" + "A" * 16, "b", "t", 7)], "doc_id long, text string, base string, tokens string, spans int")
    assert secrets.redacted(docs).collect() == spark.createDataFrame([(1, "<access>", "b", "t", 7)], docs.schema).collect()


def test_personal_data_of_tables_and_edges(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    counts = ["n_email", "n_ip", "n_card", "n_phone"]
    check(QUERIES["op7_personal_data"](spark, SF).collect(), docs, PII_RULES, counts)
    texts = generated(2) + ["1" * 100_000, "a@b" + ".c" * 20_000, "a.b" * 30_000, "1.2" * 30_000, "1 " * 30_000, "+1" + " 2" * 30_000]
    check(pii.digest(pii.personal(frame(spark, texts))).collect(), dict(enumerate(texts)), PII_RULES, counts)
    assert pii.digest(pii.personal(frame(spark, texts).limit(0))).count() == 0


def test_terms_that_reveal_an_entity(spark):
    filler = [f"common words about nothing number {i}" for i in range(200)]
    texts = ["Write to Quimberly at q@example.com about common words", "Ask Quimberly, see q@example.com; words", "Quimberly again: q@example.com", *filler, "words about r@example.com", "common words: s@example.com"]
    spans = {r["doc_id"]: r["spans"] for r in pii.digest(pii.personal(frame(spark, texts))).collect()}
    assert spans[0] == "term:9:18,email:22:35" and "term:4:13" in spans[1] and "term:0:9" in spans[2]
    assert all("term" not in spans[i] for i in range(3, len(texts)))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(frame(spark, texts)).collect()}
    assert clean[0] == "Write to <term> at <email> about common words" and clean[5] == texts[5]


def test_terms_reveal_an_entity_from_anywhere_in_the_document(spark):
    far = "common words about nothing " * 40
    filler = [f"common words about nothing Li number {i}" if i % 2 else "common words about nothing" for i in range(200)]
    texts = [f"Ann wrote. {far}Mail q@example.com; {far}ask ANN", f"q@example.com {far}and Ann", f"see r@example.com {far}", f"r@example.com {far}Li", *filler, "Ann here"]
    spans = {r["doc_id"]: r["spans"].split(",") for r in pii.digest(pii.personal(frame(spark, texts))).collect()}
    places = lambda i: [f"term:{m.start()}:{m.end()}" for m in re.finditer("(?i)\\bann\\b", texts[i])]
    assert [s for s in spans[0] if "term" in s] == places(0) and len(places(0)) == 2
    assert [s for s in spans[1] if "term" in s] == places(1)
    assert not any("term" in s for i in range(2, len(texts)) for s in spans[i])
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(frame(spark, texts)).collect()}
    assert "ann" not in clean[0].lower() and clean[2] == f"see <email> {far}" and clean[204] == "Ann here"


def test_places_count_code_points(spark):
    texts = ["😀😀 a@b.cd 日本 +12 345 678 901"]
    row = pii.digest(pii.personal(frame(spark, texts))).first()
    assert row["spans"] == "email:3:9,phone:13:28"
    assert frame(spark, texts).select(F.length("text")).first()[0] == 28


def test_the_methods_add_spans_on_the_tables(spark):
    for name, kind in (("op6_secret_scan", "random:"), ("op7_personal_data", "term:")):
        spans = [r["spans"] for r in QUERIES[name](spark, "/root/testdata/sf0.01").select("spans").collect()]
        assert sum(kind in s for s in spans) > 5, name


def test_sanitised_rows_are_masked_each_at_its_own_spans(spark):
    texts = ["x +1 234 567 8901 y", "plain text", "mail a@b.com now", "plain text", None, "", "ip 10.0.0.1", "mail a@b.com now"]
    ids = [1, 1, 1, 2, 2, None, None, 3]
    docs = spark.createDataFrame([(i, t, "s", 7) for i, t in zip(ids, texts)], "doc_id long, text string, spans string, base int")
    out = pii.sanitised(docs)
    assert out.columns == docs.columns
    want = [(1, "x <phone> y"), (1, "plain text"), (1, "mail <email> now"), (2, "plain text"), (2, None), (None, ""), (None, "ip <ip>"), (3, "mail <email> now")]
    key = lambda r: (r[0] or 0, r[1] or "")
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=key) == sorted(want, key=key)
    assert all(r["spans"] == "s" and r["base"] == 7 for r in out.collect())
    assert pii.personal(docs).count() == len(texts)


def test_terms_of_a_class_need_more_than_a_few_documents(spark):
    """A word that stands in documents with cards only reveals that there is one; one common document proves nothing."""
    cards = [f"card 4111 1111 1111 1111 of customer number{'x' * i} billing" for i in range(8)]
    filler = [f"common words about nothing number{'y' * i} customer" for i in range(300)]
    spans = [r["spans"] for r in sorted(pii.digest(pii.personal(frame(spark, cards + filler))).collect(), key=lambda r: r["doc_id"])]
    billing = [f"term:{c.index('billing')}:{len(c)}" for c in cards]
    assert all(b in s for b, s in zip(billing, spans)) and not any(f":{c.index('number')}:" in s for c, s in zip(cards, spans))
    assert not any(spans[len(cards) :])


def test_secrets_keep_columns_of_other_names(spark):
    docs = spark.createDataFrame([(1, "AKIA" + "A" * 16, "b", "t", 7)], "doc_id long, text string, base string, tokens string, __x int")
    row = secrets.secrets(docs).first()
    assert row["tokens"] == "t" and row["__x"] == 7 and len(row["base"]) == 1
