"""Feistel pseudonyms: bijection, formats, linkage, reversal, and texts that stay as they are."""

import pytest

from tallyframe.llm import pii


@pytest.mark.parametrize(("n", "radix"), [(1, 10), (2, 10), (3, 10), (4, 10), (3, 16), (2, 26)])
def test_permutation(n, radix):
    f = pii.Feistel("k")
    image = [f.digits(v, n, "t", radix) for v in range(radix**n)]
    assert sorted(image) == list(range(radix**n)) and image != list(range(radix**n))
    assert [f.digits(v, n, "t", radix, undo=True) for v in image] == list(range(radix**n))
    assert [pii.Feistel("other").digits(v, n, "t", radix) for v in range(radix**n)] != image


def test_below():
    f = pii.Feistel("k")
    assert sorted(f.below(v, 1000, "t") for v in range(1000)) == list(range(1000))


CASES = [
    ("card", "4111 1111 1111 1111"), ("card", "4111111111111111"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("ssn", "123-45-6789"), ("phone", "+1 (171) 555-2028"), ("phone", "+49 30 1234567"), ("ipv4", "152.143.123.131"),
    ("date", "1984-02-29"), ("date", "31.12.1999"), ("date", "01/02/2003"), ("email", "Jo.Doe-7@mail.example.com"), ("secret", '"24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'),
]


@pytest.mark.parametrize(("kind", "value"), CASES)
def test_formats(kind, value):
    p, u = pii.Pseudonyms("k"), pii.Pseudonyms("k", undo=True)
    text = f"so {value}, then"
    new, counts = p.replace(text)
    assert counts == {kind: 1} and new != text and value not in new
    assert p.replace(new)[1] == {kind: 1} and u.replace(new)[0] == text
    if kind not in ("ipv4", "secret"):
        assert [c.isalnum() for c in new] == [c.isalnum() for c in text]


@pytest.mark.parametrize("text", ["4111111111111112", "1234567890123", "999.1.1.1", "1.2.3.4.5", "2021-02-30", "000-12-3456", "version 2.0.1", "GB00 WEST 1234 5698 7654 32", "no @ here", "a@b", "x4111111111111111y", "12 of 34", "3.14159"])
def test_left_alone(text):
    assert pii.Pseudonyms("k").replace(text) == (text, {})


def test_neighbours():
    new, counts = pii.Pseudonyms("k").replace("+1 (826) 555-4081 190.137.223.204 token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"### 4785380592391139$$$")
    assert counts["phone"] == counts["ipv4"] == counts["secret"] == 1 and "555-4081" not in new and "190.137" not in new


@pytest.mark.parametrize(("kind", "value"), [*CASES, ("card", "4111-1111-1111-1111"), ("card", "378282246310005"), ("iban", "ES91 2100 0418 4502 0005 1332"), ("iban", "ES9121000418450200051332"), ("phone", "+49 30 1234 5678")])
@pytest.mark.parametrize(("before", "after"), [("", "12/26"), ("", "2024"), ("", "BIC"), ("", "EUR 20"), ("12", ""), ("7", ""), ("1234", ""), ("AB12", ""), ("IBAN", "2024"), ("12", "345"), ("1 2", "3 4"), ("99/99/2021", "12"), ("2024", "2025 77")])
def test_number_or_word_beside(kind, value, before, after):
    """The value does not stay, other groups may go with it only if together they are valid, and undoing is exact."""
    text = f"order {before} {value} {after} end".replace("  ", " ")
    for key in "abcdefgh":
        new, counts = pii.Pseudonyms(key).replace(text)
        assert counts and value not in new and pii.Pseudonyms(key, undo=True).replace(new)[0] == text, (key, text, new)


@pytest.mark.parametrize("text", ["4111 1111 1111 1111 12/26", "order 12 4111 1111 1111 1111", "id 7 4111111111111111", "ES91 2100 0418 4502 0005 1332 2024", "ES91 2100 0418 4502 0005 1332 BIC", "AB12 4111 1111 1111 1111"])
def test_only_the_value_goes(text):
    value = text[text.index("4111") :][: 16 if "id" in text else 19] if "4111" in text else text[:29]
    new, counts = pii.Pseudonyms("k").replace(text)
    assert counts == {"iban" if "ES91" in text else "card": 1} and value not in new
    assert new.startswith(text[: text.index(value)]) and new.endswith(text[text.index(value) + len(value) :])


def test_rows_of_numbers_are_undone():
    import random

    rng, hits = random.Random(4), 0
    bits = [v for _, v in CASES] + ["ES91 2100 0418 4502 0005 1332", "AB12", "BIC", "."]
    for k in range(300):
        text = " ".join(rng.choice(bits) if rng.random() < 0.2 else str(rng.randrange(10 ** rng.randrange(1, 6))) for _ in range(40))
        text = text.replace(CASES[6][1], "x")  # an address changes its length
        new, counts = pii.Pseudonyms(str(k)).replace(text)
        hits += sum(counts.values())
        assert pii.Pseudonyms(str(k), undo=True).replace(new) == (text, counts)
    assert hits > 1000


def test_planted_values_do_not_stay():
    """Independent of the scan: whatever stands around, no planted value is left."""
    import random

    rng = random.Random(8)
    fill = ["word", "12", "AB", "7", "2024", "(", "x@y", "#", ",", "T10:00", "-", "BIC", "1.5", "/", "é", '"']
    for k in range(400):
        kind, value = rng.choice([*CASES, ("date", "2020-01-02T10:00"), ("email", "jürgen.w@mail.example.org"), ("card", "4111-1111-1111-1111"), ("iban", "BE71 0961 2345 6769")])
        sides = [" ".join(rng.choice(fill) for _ in range(rng.randrange(4))) for _ in "ab"]
        text = f"{sides[0]} {value} {sides[1]}"
        new, counts = pii.Pseudonyms(str(k)).replace(text)
        secret = {"date": value[:10], "email": value.split("@")[0].lstrip("jü")}.get(kind, value)
        assert counts and secret not in new, (text, new)


@pytest.mark.parametrize("unit", ["a", "a.", "1", "A", "a1-", "x@", '"', "1 ", "+1"])
def test_long_lines_take_linear_time(unit):
    import time

    began = time.perf_counter()
    new, counts = pii.Pseudonyms("k").replace(unit * ((300_000 if unit != "1 " else 20_000) // len(unit)) + " 4111 1111 1111 1111 x")
    assert "4111 1111 1111 1111" not in new and time.perf_counter() - began < 20


def test_keys(spark, make):
    spark.conf.unset(pii.KEY_SETTING)
    own = pii.session_key(spark)
    assert len(own) == 64 and pii.session_key(spark) == own == spark.conf.get(pii.KEY_SETTING)
    rows = [(1, "call +1 (171) 555-2028")]
    assert pii.pseudonymise(make(rows)).collect()[0].text == pii.Pseudonyms(own).replace(rows[0][1])[0]


def test_frame(make, awkward):
    df = make(awkward, extra=True)
    out = pii.pseudonymise(df)
    assert out.schema == df.schema
    got, want = out.collect(), df.collect()
    assert len(got) == len(want)
    same = {(r.doc_id, r.text) for r in want if r.doc_id != 12}
    assert same == {(r.doc_id, r.text) for r in got if r.doc_id != 12}
    hit = next(r for r in got if r.doc_id == 12)
    assert "some.one" not in hit.text and "555-2028" not in hit.text and hit.n_chars == len(hit.text)
    assert sorted(pii.pseudonymise(out, undo=True).collect(), key=str) == sorted(want, key=str)
    assert pii.pseudonymise(make([])).collect() == []


def test_linkage_and_counts(make):
    rows = [(1, "call +1 (171) 555-2028"), (2, "or +1 (171) 555-2028, 4111111111111111"), (3, "nothing")]
    got = {r.doc_id: r for r in pii.pseudonymise(make(rows), counts=True).collect()}
    assert got[1].text[5:22] == got[2].text[3:20] and (got[2].pii_phone, got[2].pii_card, got[3].pii_phone) == (1, 1, 0)
    assert pii.pseudonymise(make(rows), key="other").collect()[0].text != got[1].text
    clash = pii.pseudonymise(make(rows, extra=True), counts=True)
    assert {(r.pii_email, r.pii_email_, r.pii_phone) for r in clash.collect()} == {("clash", 0, 1), ("clash", 0, 0)}


def test_query(spark):
    got = pii.op5_feistel_pseudonyms(spark, "/root/testdata/sf0.001")
    want = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got.count() == want.count()
    key = pii.session_key(spark)
    swap, u = pii.Pseudonyms(key), pii.Pseudonyms(key, undo=True)
    texts = {r.doc_id: r.text for r in want.collect()}
    rows = got.collect()
    assert all(r.text == swap.replace(texts[r.doc_id])[0] and u.replace(r.text)[0] == texts[r.doc_id] for r in rows)
    assert any(r.pii_total for r in rows) and all((r.text != texts[r.doc_id]) == (r.pii_total > 0) for r in rows)
