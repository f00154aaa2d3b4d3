import random
import re
from hashlib import sha256

from framelode.llm import pii

#: The contract's patterns as they stand, matched plainly.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, digits[::-1])):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if ok:
                yield kind, m.start(), m.end()


def texts():
    rng = random.Random(3)
    letters = "ab1234567890 .-@+()%_é😀\n"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    out += ["".join(rng.choice("0123456789 -.+") for _ in range(rng.randint(10, 60))) for _ in range(3000)]
    out += ["a@b.c_d@e.f x@y@z.w..@a.b", "mail é jo@ex.org, 4111 1111 1111 1111 and 192.168.0.1", "1.2.3.4.5.6.7.8 999.1.1.1", "+1 (555) 010-9999 +123", "", "a" * 200_000, "1" * 100_000, "@" * 50_000, "+1" + "-" * 50_000]
    return out


def test_the_base_kinds_are_the_plain_patterns_matches():
    for text in texts()[:-4]:
        assert [s[:3] for s in pii.spans(text) if s[0] in pii.BASE_KINDS] == list(plain(text))
    for text in texts()[-4:]:
        assert pii.spans(text) == []


def test_iban_and_context():
    text = "iban DE89 3704 0044 0532 0130 00 ok, GB29NWBK60161331926819, DE89 3704 0044 0532 0130 01"
    assert [text[s:e] for k, s, e, _ in pii.spans(text) if k == "iban"] == ["DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819"]
    assert [k for k, *_ in pii.spans("call me: 555-010-9999")] == ["local_phone"]
    assert pii.spans("part 555-010-9999") == []


def test_redaction():
    assert pii.redact("to jo@ex.org or 10.0.0.1.") == "to [EMAIL] or [IP]."
    assert pii.redact("+10.0.0.1234567") == "[PHONE]"
    assert pii.redact(None) is None and pii.redact("clean") == "clean"


def test_query(spark, tmp_path):
    rows = [(i, t, "x") for i, t in enumerate([*texts()[::60], None, "jo@ex.org", "jo@ex.org"])] + [(None, "jo@ex.org", None)]
    spark.createDataFrame(rows, "doc_id long, text string, PII string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for i, text, _ in rows:
        base, every = list(plain(text or "")), [s[:3] for s in pii.spans(text)]
        shown = lambda s: ",".join(f"{k}:{a}:{b}" for k, a, b in s)
        scores = ",".join(f"{s[3]:.2f}" for s in pii.spans(text))
        expected.append((i, *(sum(s[0] == k for s in base) for k in pii.BASE_KINDS), sha256(shown(base).encode()).hexdigest(), shown(every), scores))
    assert sorted(map(str, map(tuple, pii.op8_pii(spark, str(tmp_path)).collect()))) == sorted(map(str, expected))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert pii.redacted(docs).columns == docs.columns
    assert {r.text for r in pii.redacted(docs.where("doc_id is null")).collect()} == {"[EMAIL]"}
    assert pii.found(docs.limit(0)).count() == 0


def test_iban_before_upper_case_words_and_numbers():
    own, other = "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19"
    for text, expected in [(f"IBAN {own} BIC COBADEFF", [own]), (f"{own} 2024", [own]), (f"{own} {other} END", [own, other]), (f"AB12 3456 7890 1234 {own} X", [own]), (f"{own[:-1]}1 BIC", [])]:
        assert [text[s:e] for k, s, e, _ in pii.spans(text) if k == "iban"] == expected
    assert pii.redact(f"IBAN {own} BIC COBADEFF").endswith(" BIC COBADEFF") and own not in pii.redact(f"IBAN {own} BIC COBADEFF")


def test_ibans_have_their_countrys_length():
    def found(text):
        return [text[s:e] for k, s, e, _ in pii.spans(text) if k == "iban"]

    assert found("GB82WEST12345698765432 PLEASE") == ["GB82WEST12345698765432"]
    assert found("NL91 ABNA 0417 1643 00 AND MORE 12") == ["NL91 ABNA 0417 1643 00"]
    for country, length in pii.IBAN_LENGTHS.items():
        for size in (length - 1, length, length + 1):
            body = "7" * (size - 4)
            check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
            assert found(f"x {country}{check:02d}{body} Y") == ([f"{country}{check:02d}{body}"] if size == length else [])


def test_words_near_by_raise_and_lower_scores():
    score = lambda text: {k: s for k, _, _, s in pii.spans(text)}
    own = "DE89 3704 0044 0532 0130 00"
    assert score(own)["iban"] == 0.9 and score(f"iban {own}")["iban"] == 1.0 and round(score(f"sample {own}")["iban"], 2) == 0.65
    assert score("call 555-010-9999") == {"local_phone": 0.6} and score("555-010-9999") == {} and score("order by phone: invoice 555-010-9999") == {}
    assert round(score("order jo@ex.org")["email"], 2) == 0.65 and score("mail jo@ex.org")["email"] == 1.0


def test_no_documents_and_ids_of_another_type(spark, tmp_path):
    spark.createDataFrame([], "doc_id int, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert pii.op8_pii(spark, f"{tmp_path}/none").count() == 0
    spark.createDataFrame([(7, "a@b.example"), (None, "x")], "doc_id int, text string").write.parquet(f"{tmp_path}/few/documents.parquet")
    assert {(r.doc_id, r.n_email) for r in pii.op8_pii(spark, f"{tmp_path}/few").collect()} == {(7, 1), (None, 0)}
