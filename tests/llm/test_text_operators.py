"""Operators on single texts: quality rules, BPE, token files, license scan, PII surrogates."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skillstrata.llm import bpe, licenses, suffix_quality, surrogates, token_files
from skillstrata.llm.common import qualified
from skillstrata.llm.queries import QUERIES
from skillstrata.llm.token_files import EliasFano
from skillstrata.llm.word_cache import WordCache
from skillstrata.session import scratch
from tests.llm.conftest import SMALL

BYTE_BPE, WORD_BPE = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "word_bpe_49k.json"))
WORD = r"[^\x20\x09-\x0D]+"
ALPHABET = (
    [" ", "  ", "\n", "\t", "a", "B", "the", "ing", "'s", "'ll", "1", "23", "é", "É", "ß", "中文", "😀", "!", "...", "\xa0", "　", "\r\n"]
    + ["<|endoftext|>", "é", "́", "Σ", "İ", "AAAA", "\x1c", "_", "'", ",", "|", "(", "ª", "ﬁ"]
)


def random_texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]


# Quality rules


def repeat_by_force(words: list[str]) -> list[int]:
    out = [0] * len(words)
    for i in range(len(words)):
        for j in range(len(words)):
            k = 0
            while i != j and max(i, j) + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


def test_longest_repeats_match_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        docs = [[rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.choice([0, 1, 2, 5, 20, 50]))] * rng.choice([1, 2, 3]) for _ in range(3)]
        flat = np.array([ord(c) for d in docs for c in d], np.int64)
        got = suffix_quality.repeat_lengths(flat, np.repeat(np.arange(3), [len(d) for d in docs]))
        want = [k for d in docs for k in repeat_by_force(d)]
        # Below the base window lengths may be left out.
        assert [g if g >= 5 else 0 for g in got] == [w if w >= 5 else 0 for w in want]


def quality_by_force(text: str | None) -> tuple:
    words = re.findall(WORD, text or "")
    windows: dict[tuple, list[int]] = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    inside = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [line for line in (text or "").split("\n") if re.search(WORD, line)]
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside), failed


def test_quality_query_matches_brute_force(llm_spark, documents):
    rows = QUERIES["op9_quality_rules"](llm_spark, SMALL).collect()
    assert len(rows) == len(documents)
    for r in rows:
        want = quality_by_force(documents[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.kept and r.base_failed)


def test_quality_rejects_one_long_repeat(llm_spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rest = " ".join(f"x{i}" for i in range(2000))
    df = llm_spark.createDataFrame([(1, f"{passage} {rest} {passage}"), (2, rest)], "doc_id long, text string")
    got = {r.doc_id: (r.longest_repeat, r.base_failed, r.kept) for r in suffix_quality.quality(df).collect()}
    assert got == {1: (60, False, False), 2: (0, False, True)}


def test_quality_of_odd_rows(odd, none):
    rows = suffix_quality.quality(odd).collect()
    assert len(rows) == 8 and [r.n for r in rows if r.doc_id == 2] == [None]
    assert {r.doc_id: r.kept for r in rows}[5] is True
    assert {r.n_words for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert suffix_quality.quality(none).count() == 0


# BPE and token files


def test_bpe_matches_the_library():
    texts = [*random_texts(1500, 3), *("a" * n for n in range(30)), "", " ", "   "]
    library = Tokenizer.from_file(BYTE_BPE)
    ids, sizes = bpe.Encoder(BYTE_BPE).encode(texts)
    ends = np.cumsum(sizes)
    v = bpe.vocabulary(BYTE_BPE)
    for text, end, size in zip(texts, ends, sizes, strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids[end - size : end].tolist() == want, text
        at = np.array(want, np.int64)
        assert bpe.gather(v.bytes, v.starts[at], v.lengths[at]).tobytes().decode() == library.decode(want, skip_special_tokens=False)


def test_bpe_forgets_without_changing_ids(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_CHUNKS", 3)
    encoder, library = bpe.Encoder(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    for text in random_texts(60, 4):
        assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_query(llm_spark, documents):
    library = Tokenizer.from_file(BYTE_BPE)
    for r in QUERIES["op7_bpe"](llm_spark, SMALL).collect():
        ids = library.encode(documents[r.doc_id].text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_bpe_of_odd_rows(odd, none):
    encoded = bpe.encode(odd, BYTE_BPE)
    rows = bpe.decode(encoded, BYTE_BPE).collect()
    assert len(rows) == 8 and {r.text for r in rows if r.doc_id in (2, 3)} == {""}
    assert {r.text for r in rows if r.doc_id == 1} == {"one two three four"} and {r.source for r in rows if r.doc_id == 6} == {None}
    assert bpe.decode(bpe.encode(none, BYTE_BPE), BYTE_BPE).count() == 0


def test_elias_fano_selects_every_value():
    rng = random.Random(5)
    for _ in range(60):
        values = np.cumsum([rng.choice([0, 1, 1, 2, 50, 3000]) for _ in range(rng.choice([1, 2, 5, 300, 900]))])
        stored = EliasFano.from_bytes(EliasFano.of(values).to_bytes(0))
        assert stored.all().tolist() == values.tolist()
        assert [stored.select(k) for k in range(len(values))] == values.tolist()
        a, b = sorted(rng.choices(range(len(values) + 1), k=2))
        assert stored.between(a, b).tolist() == values[a:b].tolist()
    assert EliasFano.from_bytes(EliasFano.of(np.zeros(0, np.int64)).to_bytes(0)).all().tolist() == []
    with pytest.raises(IndexError):
        EliasFano.of(np.array([1])).select(1)


def test_token_files_select_the_ends_of_each_stretch(llm_spark, documents, monkeypatch):
    """Read in stretches of three documents, with no list of all boundaries."""
    monkeypatch.setattr(EliasFano, "all", None)
    monkeypatch.setattr(token_files, "DOCS_AT_ONCE", 3)
    folder = qualified(llm_spark, scratch(llm_spark, "stretches"))
    rows = [(d, documents[d].text) for d in sorted(documents)[:40]]
    manifest = token_files.write(llm_spark.createDataFrame(rows, "doc_id long, text string"), folder, WORD_BPE, end_id=1)
    got = sorted((r.doc_id, r.start, r.n_tokens) for r in token_files.read(llm_spark, folder, manifest).collect())
    library, start = Tokenizer.from_file(WORD_BPE), 0
    for (doc, text), found in zip(rows, got, strict=True):
        n = len(library.encode(text, add_special_tokens=False).ids) + 1
        assert found == (doc, start, n)
        start += n


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 1000, 100_000))
    assert len(EliasFano.of(values).to_bytes(0)) < 100_000 * 11.5 / 8


def test_word_cache_matches_the_library(monkeypatch):
    texts, library = random_texts(2500, 6), Tokenizer.from_file(WORD_BPE)
    cache = WordCache(WORD_BPE)
    assert cache.by_word and cache.by_unit
    assert not WordCache(BYTE_BPE).by_word
    ids, sizes = cache.encode(texts)
    ends = np.cumsum(sizes)
    for text, end, size in zip(texts, ends, sizes, strict=True):
        assert ids[end - size : end].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_token_files_query(llm_spark, documents):
    library, start = Tokenizer.from_file(WORD_BPE), 0
    rows = {r.doc_id: r for r in QUERIES["op6_token_files"](llm_spark, SMALL).collect()}
    for doc_id in sorted(documents):
        ids = np.array([*library.encode(documents[doc_id].text or "", add_special_tokens=False).ids, 1], "<u4")
        r = rows.pop(doc_id)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not rows


def test_token_files_of_odd_rows(llm_spark, odd, none, monkeypatch):
    for name, df, n in (("odd", odd, 8), ("none", none, 0)):
        folder = f"file://{scratch(llm_spark, name)}"
        manifest = token_files.write(df, folder, WORD_BPE, end_id=1)
        rows = sorted(token_files.read(llm_spark, folder, manifest).collect(), key=lambda r: r.start)
        assert len(rows) == n and [r.doc_id for r in rows] == [r.doc_id for r in df.sort("doc_id").collect()]
        assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:n].tolist()


# License scan


def found(text: str) -> list[tuple]:
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.Rules())
    return [(h.license, h.start, h.end, h.missing, h.added) for h in scanner.hits(text)]


def test_licenses_by_wording():
    assert found("x y Licensed under CC BY-NC 4.0. z") == [("CC-BY-NC-4.0", 2, 7, (), ())]
    assert found("LICENSED UNDER CC BY-SA 4.0") == [("CC-BY-SA-4.0", 0, 5, (), ())]
    assert found("Licensed under CC BY 3.0.") == [] and found("a driver license was reserved") == []
    both = found("All rights reserved.\nThis work is licensed under the GNU General Public License, version 2.")
    assert [hit[0] for hit in both] == ["Proprietary", "GPL-2.0"]
    changed = "Licensed under the Apache License, Version 2.0 (the License); you may not use this program except in compliance with the License."
    assert found(changed) == [("Apache-2.0", 0, 21, ("file",), ("program",))]


def test_license_query_finds_every_notice(llm_spark, documents):
    notices = {text: name for name, text in licenses.TEMPLATES if len(text) < 90}
    want = sorted((d, name) for d, r in documents.items() for text, name in notices.items() for _ in range((r.text or "").count(text)))
    assert sorted((r.doc_id, r.license) for r in QUERIES["op3_license_scan"](llm_spark, SMALL).collect()) == want and want


def test_licenses_of_odd_rows(odd, none):
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0


# PII surrogates


def test_surrogates_keep_type_format_and_coreference(llm_spark):
    rows = [
        (1, "Ann.Lee@mail.example.com, ann.lee@mail.example.com, BOB@mail.example.com +1 (555) 123-4567"),
        (2, "Mr. John Smith met Mrs Jane Smith and Ms. Smith. Госпожа Анна Петренко, Господин Петренко"),
        (3, 'TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B" 4952935900253052 4952-9359-0025-3052 10.0.0.1 123-45-6789'),
        (4, "nothing here 2024 12.5"),
        (5, None),
        (6, "Mr. John Smith"),
        (6, "Mr. John Smith"),
    ]
    df = llm_spark.createDataFrame(rows, "doc_id long, text string")
    got: dict[int, str] = {r.doc_id: r.text for r in surrogates.replace_pii(df, "key").collect()}
    a, b, c = re.findall(r"\S+@[\w.]+\w", got[1])
    assert a == b and a.split("@")[1] == c.split("@")[1] and a.split("@")[0] != c.split("@")[0]
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}$", got[1])
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs (\w+) (\w+) and Ms\. (\w+)\. Госпожа (\w+) (\w+), Господин (\w+)", got[2])
    assert m[2] == m[4] == m[5] and m[3].endswith("ina") and m[1].endswith("ert") and m[6].endswith("ина")
    assert m[7] == m[8] and re.fullmatch("[А-я]+", m[7])
    m = re.fullmatch(r'TOKEN = "([0-9A-F]{40})" (\d{16}) ([\d-]{19}) ((?:\d+\.){3}\d+) \d{3}-\d{2}-\d{4}', got[3])
    assert m[2] == m[3].replace("-", "") and m[2][0] == "4"
    odds = [int(x) for x in m[2][-1::-2]]
    evens = [sum(map(int, str(2 * int(x)))) for x in m[2][-2::-2]]
    assert (sum(odds) + sum(evens)) % 10 == 0
    assert got[4] == rows[3][1] and got[5] is None and got[6] in got[2]
    again = {r.doc_id: r.text for r in surrogates.replace_pii(df, "key").collect()}
    other = {r.doc_id: r.text for r in surrogates.replace_pii(df, "other").collect()}
    assert again == got and other[1] != got[1]


def test_surrogates_stay_distinct_where_strings_are_few(llm_spark):
    # 40 of the 676 addresses of this shape: draws meet, and no surrogate is one of them.
    texts = [f"{a}{b}@x.com" for a in "abcdefgh" for b in "vwxyz"]
    df = llm_spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    new = [r.text for r in surrogates.replace_pii(df, "key").collect()]
    assert len(set(new)) == len(texts) and not set(new) & set(texts)


def test_surrogates_query_leaks_nothing(llm_spark, documents):
    entity = re.compile(r"\S+@\S+\.\w+|(?<!\d)\d{16}(?!\d)|\b\d{1,3}(?:\.\d{1,3}){3}\b|\+1 \(\d{3}\) \d{3}-\d{4}|[0-9A-Fa-f]{40}")
    rows = {r.doc_id: r for r in QUERIES["op1_pii_surrogates"](llm_spark, SMALL).collect()}
    assert rows.keys() == documents.keys()
    image: dict[str, set[str]] = {}
    for d, r in rows.items():
        old, new = entity.findall(documents[d].text or ""), entity.findall(r.text or "")
        assert len(old) == len(new) == r.n_entities and not set(old) & set(new)
        assert old or r.text == documents[d].text
        for x, y in zip(old, new, strict=True):
            image.setdefault(x.lower(), set()).add(y.lower())
    assert all(len(v) == 1 for v in image.values()) and len({y for v in image.values() for y in v}) == len(image)


def test_surrogates_of_odd_rows(odd, none):
    rows = surrogates.replace_pii(odd, "key").collect()
    assert len(rows) == 8 and {r.n_entities for r in rows} == {0} and [r.text for r in rows if r.doc_id == 2] == [None]
    assert surrogates.replace_pii(none, "key").count() == 0
