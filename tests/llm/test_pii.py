"""PII surrogates on texts made by hand: what is caught, what is left alone, and how surrogates look."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from skillstrata.llm import surrogates

# A text, and the strings in it that must not stay.
PRIVATE = [
    ("call +14155552671 now", ["+14155552671"]),
    ("fax 14155552671", ["14155552671"]),
    ("Tél. +33 1 23 45 67 89.", ["+33 1 23 45 67 89"]),
    ("ou 01 23 45 67 89 le soir", ["01 23 45 67 89"]),
    ("(415) 555-2671 or 415-555-2671", ["(415) 555-2671", "415-555-2671"]),
    ("+44 20 7946 0958, +49 (0)30 901820", ["+44 20 7946 0958", "+49 (0)30 901820"]),
    ("0170 1234567 mobil", ["0170 1234567"]),
    ("host 2001:db8::ff00:42:8329 down", ["2001:db8::ff00:42:8329"]),
    ("host 10.1.22.133 up", ["10.1.22.133"]),
    ("IBAN DE89 3704 0044 0532 0130 00", ["DE89 3704 0044 0532 0130 00"]),
    ("to GB82WEST12345698765432 today", ["GB82WEST12345698765432"]),
    ("card 4111 1111 1111 1111", ["4111 1111 1111 1111"]),
    ("SSN 078-05-1120", ["078-05-1120"]),
    ("mail jane.doe@mail.example.org or JANE.DOE@MAIL.EXAMPLE.ORG", ["jane.doe@", "JANE.DOE@"]),
    ("password: hunter2hunter2hunter2", ["hunter2hunter2hunter2"]),
    ("Dr. Maria Lopez came. Lopez left. Maria Lopez slept.", ["Maria Lopez", "Lopez"]),
    ("Herr Schmidt und Frau Müller; SCHMIDT bleibt, Schmidt geht", ["Schmidt", "Müller"]),
]
CLEAN = [
    "at 48.856614, 2.352222 north",
    "in 2020 100000 people",
    "std::vector and a::b at 12:30:45",
    "version 1.2.3.4.5 of 2024-06-01",
    "pages 120-135 of 1999",
    "1,234,567.89 in total",
    "3.14159265358979",
    "Lopezian art in Paris",
    "a@b, c at d.com",
    "the word token and the key: none",
]


def test_private_strings_go_and_clean_texts_stay(llm_spark):
    rows = [(k, text) for k, (text, _) in enumerate(PRIVATE)] + [(100 + k, text) for k, text in enumerate(CLEAN)]
    got = {r.doc_id: (r.text, r.n_entities) for r in surrogates.replace_pii(llm_spark.createDataFrame(rows, "doc_id int, text string"), "key").collect()}
    left = [(text, got[k][0]) for k, (text, private) in enumerate(PRIVATE) if any(x in got[k][0] for x in private)]
    changed = [(text, got[100 + k][0]) for k, text in enumerate(CLEAN) if got[100 + k] != (text, 0)]
    assert left == [] and changed == []


def test_a_name_and_its_family_name_stay_one_person(llm_spark):
    text = "Dr. Maria Lopez came. Lopez left. Maria Lopez slept. Mrs Lopez too."
    df = llm_spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = surrogates.replace_pii(df, "key").collect()[0].text
    m = re.fullmatch(r"Dr\. (\w+) (\w+) came\. (\w+) left\. (\w+) (\w+) slept\. Mrs (\w+) too\.", got)
    assert m and m[1] == m[4] and m[2] == m[3] == m[5] == m[6] and m[1] != m[2]


def test_account_numbers_keep_country_and_check(llm_spark):
    df = llm_spark.createDataFrame([(1, "DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432")], "doc_id int, text string")
    got = surrogates.replace_pii(df, "key").collect()[0].text.split(" and ")
    assert re.fullmatch(r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d", got[0]) and re.fullmatch(r"GB\d\d[A-Z]{4}\d{14}", got[1])
    for account in (x.replace(" ", "") for x in got):
        assert int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


@pytest.mark.parametrize("shape", ["{a}@{b}.com", "({a0}{b0}) 555-00{c0}"])
def test_no_shape_runs_out(llm_spark, shape):
    """Every string of a shape is a real entity: surrogates grow and stay different from all of them."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    if "@" in shape:
        rows = [shape.format(a=a, b=b) for a in letters for b in letters]
    else:
        rows = [f"({a}{b}) 555-{c}{d}00" for a in range(10) for b in range(10) for c in range(10) for d in range(10)][:3000]
    df = llm_spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    got = [r.text for r in surrogates.replace_pii(df, "key").collect()]
    assert len(set(got)) == len(rows) and not set(got) & set(rows)


def test_noise_is_an_hmac(llm_spark):
    import hashlib
    import hmac

    for key in ("k", "long" * 50):
        got = llm_spark.range(1).select(surrogates._noise(key, F.lit("a"), F.lit("b"))).head()[0]
        assert got == hmac.new(key.encode(), b"a\x1fb", hashlib.sha512).hexdigest()
