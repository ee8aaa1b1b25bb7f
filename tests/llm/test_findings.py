"""Cases in which operators did less than the whole job."""

from __future__ import annotations

import random
import subprocess
import sys

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from skillstrata.llm import common, line_templates, shingle_sets, word_cache


def shingles_by_force(text: str | None) -> frozenset:
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def kept_by_force(texts: dict[int, str | None]) -> set[int]:
    """The smallest id of each group that steps of similarity 0.8 or more connect."""
    sets, left, kept = {d: shingles_by_force(t) for d, t in texts.items()}, set(texts), set()
    while left:
        stack = [min(left)]
        kept.add(stack[0])
        left.discard(stack[0])
        while stack:
            x = sets[stack.pop()]
            near = {d for d in left if 5 * len(x & sets[d]) >= 4 * len(x | sets[d])}
            left -= near
            stack += near
    return kept


@pytest.mark.parametrize("sample", [20, 20_000])
def test_near_dedup_stage_takes_similarity_of_shingles(llm_spark, monkeypatch, sample):
    """Copies with some words replaced, chains of them, a passage common to unlike texts, short texts."""
    monkeypatch.setattr(shingle_sets, "SAMPLE_TEXTS", sample)
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(5000)}"
    passage, texts = [word() for _ in range(60)], []
    for size in (4, 5, 9, 30, 60, 150, 400):
        for _ in range(6):
            base = [word() for _ in range(size)]
            texts.append(base)
            for n in (0, 1, 1, 2, 4):
                copy = list(texts[-1] if n == 2 else base)
                for at in rng.sample(range(size), min(n, size)):
                    copy[at] = word()
                texts.append(copy)
        texts += [passage + [word() for _ in range(size)] for _ in range(6)]
    hot = [word() for _ in range(200)]
    texts += [hot[:at] + [word()] + hot[at + 1 :] for at in range(0, 200, 2)]
    by_id = dict(enumerate([*(" ".join(t) for t in texts), None, "", " \n"]))
    df = llm_spark.createDataFrame(list(by_id.items()), "doc_id long, text string")
    got = [r.doc_id for r in corpus_pipeline.near_dedup(llm_spark, df, "").collect()]
    want = kept_by_force(by_id)
    assert sorted(got) == sorted(want) and len(want) < len(texts) / 2


def test_near_dedup_stage_of_odd_rows(llm_spark, odd, none):
    kept = corpus_pipeline.near_dedup(llm_spark, odd, "")
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 5, 6]
    assert corpus_pipeline.near_dedup(llm_spark, none, "").count() == 0


@pytest.mark.parametrize("size", [100, 3000])
def test_templates_with_common_values_at_any_size(llm_spark, size):
    """Two fields of few values each, beside lines of the same length and beginning that stay."""
    rng = random.Random(size)
    names, other = [f"name{c}{d}" for c in "abcdefgh" for d in "abcde"], [f"{c}{d}{e}" for c in "klmno" for d in "aeiou" for e in "pqrst"]
    own = {k: " ".join(["Posted on the", *rng.choices(other, k=7), f"own{'x' * k}" if k < 3 else rng.choice(other)]) for k in range(0, size, 5)}
    rows = [(k, f"Posted on the wall by {rng.choice(names)} for {rng.choice(names)} in the forum" + f"\n{own.get(k)}" * (k in own)) for k in range(size)]
    got = {r.doc_id: r.text for r in line_templates.drop_templates(llm_spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [k for k, text in got.items() if "forum" in text] == [0]
    assert all(line in got[k] for k, line in own.items())


def test_rows_of_numbers_stay(llm_spark):
    """Different rows of numbers and code are data; equal ones recur, and so do lines of words with numbers."""
    rows = [(k, f"{k} {k + 1} {k * k}\nx{k} = y{k} + z{k + 2}\n1 2 3\n{k} 0 0 0 0 0 0 0 {k + 9} 0\nUpdated at {k} by staff") for k in range(6)]
    got = {r.doc_id: r.text.split("\n") for r in line_templates.drop_templates(llm_spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1].split("\n")
    assert all(got[k] == [line for i, line in enumerate(rows[k][1].split("\n")) if i in (0, 1, 3)] for k in range(1, 6))


def test_recurring_lines_without_blanks(llm_spark):
    """A line of a script without blanks is judged by its characters."""
    rows = [(k, f"第{'甲乙丙丁'[k]}篇文章的正文\n本网站版权所有未经许可不得转载\nสงวนลิขสิทธิ์ตามกฎหมาย") for k in range(4)]
    got = {r.doc_id: r.text.split("\n") for r in line_templates.drop_templates(llm_spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1].split("\n")
    assert all("版权" not in line and "สงวน" not in line for k in range(1, 4) for line in got[k])


def dropped(spark, rows):
    got = {r.doc_id: r.text.split("\n") for r in line_templates.drop_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    return {k: [line for line in text.split("\n") if line not in got[k]] for k, text in rows}


def test_short_lines_recur_as_they_are(llm_spark):
    """Lines of one or two words count exactly, numbers included."""
    rows = [(k, f"Read more\nShare\nPage {k}\nown{k}\n\ntext of number {'abcdefgh'[k]}") for k in range(6)]
    gone = dropped(llm_spark, rows)
    assert gone[0] == [] and all(gone[k] == ["Read more", "Share"] for k in range(1, 6))


def test_sentences_of_one_build_stay(llm_spark):
    """Variable words need more documents the more of them there are."""
    facts = [("France", "Paris", "Seine"), ("Hungary", "Budapest", "Danube"), ("Italy", "Rome", "Tiber"), ("Austria", "Vienna", "Danube"), ("Egypt", "Cairo", "Nile")]
    rows = [(k, f"The capital of {a} is {b} and it lies on the {c}\nown{'abcde'[k]} text") for k, (a, b, c) in enumerate(facts)]
    assert not any(dropped(llm_spark, rows).values())
    wall = [(k, f"Posted on the wall by name{'abcdefgh'[k % 8]} for everyone in the forum") for k in range(40)]
    assert [k for k, lines in dropped(llm_spark, wall).items() if not lines] == [0]


def test_templates_side_by_side_in_a_leaf(llm_spark):
    """Two templates that begin alike are told apart below the leaf."""
    one = [(k, f"sent from the mobile app of user name{chr(97 + k)} while on the road") for k in range(20)]
    two = [(100 + k, f"sent from the desktop client by member name{chr(97 + k)} during working hours today") for k in range(20)]
    gone = dropped(llm_spark, one + two)
    assert [k for k, lines in gone.items() if not lines] == [0, 100]


def test_rows_that_share_an_id_or_have_none_lose_their_own_lines(llm_spark):
    rows = [(1, "All rights reserved by us\na"), (2, "All rights reserved by us\nb"), (3, "All rights reserved by us\nc"), (3, "d\nAll rights reserved by us"), (None, "e\nAll rights reserved by us"), (None, "f")]
    got = sorted((r.doc_id or 0, r.text) for r in line_templates.drop_templates(llm_spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, "e"), (0, "f"), (1, "All rights reserved by us\na"), (2, "b"), (3, "c"), (3, "d")]


def test_a_line_of_megabytes(llm_spark):
    long = " ".join(f"w{k % 977}x" for k in range(400_000))
    rows = [(k, f"{long}\nown {k}") for k in range(3)]
    gone = dropped(llm_spark, rows)
    assert gone[0] == [] and gone[1] == gone[2] == [long]


CLASHING = ("kept", "n_words", "n_lines", "n_dropped", "_id", "_digest", "_n", "_doc", "_gone", "_size", "_source", "_copies", "_row_size", "ids", "n_tokens")


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_take_odd_rows_and_keep_columns_of_any_name(llm_spark, name, stage):
    """NULLs, empty and long texts, repeated rows, extra columns named like the operators' own, and no rows."""
    from pyspark.sql import functions as F

    words = " ".join(f"word{k}" for k in range(40))
    rows = [(1, words, "en", "a", 5), (1, words, "en", "a", 5), (2, None, None, None, None), (3, "", "en", "b", 0), (4, " \t\n", "en", "a", 3), (None, f"{words} more", "en", "b", 5)]
    rows += [(10 + k, " ".join(f"d{k}w{i}" for i in range(60)), "en", "ab"[k % 2], 5) for k in range(6)] + [(30, " ".join(f"l{k}" for k in range(50_000)), "en", None, 1)]
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("mine") for c in CLASHING})
    out = stage(llm_spark, docs, "")
    found = out.collect()
    assert found and {r.doc_id for r in found} >= {10, 30}
    if name != "encode_bpe":
        assert out.columns == docs.columns and all(r[c] == "mine" for r in found for c in CLASHING)
    assert stage(llm_spark, docs.limit(0), "").count() == 0


def test_near_dedup_stage_links_fingerprints_first(llm_spark, monkeypatch):
    """Operator 2's method finds links in the stage, which are verified on sets; the stage once searched without it."""
    seen, links = [], shingle_sets.simhash.links
    monkeypatch.setattr(shingle_sets.simhash, "links", lambda prints: seen.append(prints.count()) or links(prints))
    base = " ".join(f"w{n}" for n in range(400))
    texts = [base, base + " more", base + "  MORE", "another text of some words that has no copy", "w1 w2", None]
    df = llm_spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(llm_spark, df, "").collect()) == [0, 3, 4, 5]
    assert len(seen) == 1 and seen[0] >= 4


def test_near_dedup_stage_stores_no_key_of_one_set_alone(llm_spark, monkeypatch):
    """Texts that share nothing leave no key: cells of a fixed number once let more lone keys through the more there were."""
    held, keep = {}, shingle_sets.stored

    def stored(df, name):
        found = keep(df, name)
        held[name] = held.get(name, 0) + found.count()
        return found

    monkeypatch.setattr(shingle_sets, "stored", stored)
    rng = random.Random(5)
    texts = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(150)) for _ in range(6000)]
    df = llm_spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert corpus_pipeline.near_dedup(llm_spark, df, "").count() == 6000
    assert held.get("keys", 0) == held["members"] == 0


def test_near_dedup_numbers_sets_apart(llm_spark):
    """A set's number follows from its name, in tasks as in tables."""
    names = [shingle_sets.set_name(shingle_sets.shingle_set(f"a b c d e {k}", 5)) for k in range(50)]
    found, salt = shingle_sets.numbered(llm_spark.createDataFrame([(n,) for n in names], "name binary"))
    assert {bytes(r.name): r.fp % 2**64 for r in found.collect()} == {n: shingle_sets.numbered_as(n, salt) for n in names}


def test_workers_get_batches_bounded_by_bytes(llm_spark):
    """A batch was bounded by 10,000 rows alone: 16 MB of text and more, in several copies for each core of an executor."""
    rows = llm_spark.range(0, 3000, 1, 1).select(F.expr("repeat('x', 4000)").alias("text"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "bytes": [batch.nbytes]})

    found = rows.mapInArrow(run, "n long, bytes long").collect()
    assert sum(r.n for r in found) == 3000
    assert max(r.bytes for r in found) < common.BATCH_BYTES + 10_000


WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def test_word_cache_takes_each_word_of_a_batch_once(monkeypatch):
    """Texts stay in Arrow: NULL, empty words, odd blanks, words again in other cases and with punctuation."""
    texts = ["the Cat  the", None, "", "the\ncat. THE cat.", " \n", "\tthe\t É É, ÿß! İx Σ ´ x\xa0the a\x00b don't the<|endoftext|>", "Cat" * 50]
    cache, taken = word_cache.WordCache(WORD_BPE), []
    units = word_cache._units
    monkeypatch.setattr(word_cache, "_units", lambda words: taken.append(words.to_pylist()) or units(words))
    batch = pa.record_batch({"text": pa.array(["left out", *texts])})
    library = Tokenizer.from_file(WORD_BPE)
    for column in (batch.column(0)[1:], batch.column(0)[1:].cast(pa.large_string()), pa.array([None], pa.string())):
        ids, sizes = cache.encode(column)
        want = [library.encode(t or "", add_special_tokens=False).ids for t in column.to_pylist()]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
    assert [len(words) for words in taken] == [len({w for t in texts for w in (t or "").replace("\n", " ").split(" ")})] * 2 + [1]


def test_word_cache_starts_no_threads_beside_a_task():
    code = f"""
import os
from skillstrata.llm.token_files import word_cache
os.environ.pop("TOKENIZERS_PARALLELISM", None)
before = len(os.listdir("/proc/self/task"))
word_cache({WORD_BPE!r}).encode([f"{{a}}{{b}}" for a in range(100) for b in "abcdefghij"])
print(len(os.listdir("/proc/self/task")) - before)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert done.stdout.strip() == "0", done.stdout
