"""Merkle manifest, substring dedup and alignment of tokenizers, each against brute force."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skillstrata.llm import alignment, merkle, substrings
from skillstrata.llm.queries import QUERIES
from tests.llm.conftest import SMALL

WORD = r"[^\x20\x09-\x0D]+"
BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

# Merkle manifest


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_by_force(row: tuple) -> str:
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree_by_force(nodes: list[str]) -> tuple[str, list[list[str]]]:
    """Root, and for each leaf its steps as lists of left and right siblings."""
    paths, at = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, held = [], []
        for k in range(0, len(nodes), 16):
            run = nodes[k : k + 16]
            for i in range(len(run)):
                for leaf in at[k + i]:
                    paths[leaf].append((run[:i], run[i + 1 :]))
            above.append(h(*run))
            held.append([leaf for x in at[k : k + 16] for leaf in x])
        nodes, at = above, held
    return nodes[0], paths


def manifest_by_force(rows: list[tuple]) -> Counter:
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[1]].append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        own = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_by_force(r)))
        trees[s] = (own, *tree_by_force([leaf_by_force(r) for r in own]))
    root, upper = tree_by_force([trees[s][1] for s in order])
    out = Counter()
    for s, above in zip(order, upper, strict=True):
        own, subroot, paths = trees[s]
        for r, path in zip(own, paths, strict=True):
            steps = path + above
            node = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                node = (*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4]))
            node = leaf_by_force(node)
            for left, right in steps:
                node = h(*left, node, *right)
            proof = h(*(x for left, right in steps for x in left + right))
            out[r[0], leaf_by_force(r), subroot, root, proof, node, node == root] += 1
    return out


def merkle_rows(n_hot: int) -> list[tuple]:
    rows = [(i, "hot", "en", i, f"Text {i} É") for i in range(n_hot)]
    rows += [(1000 + i, f"s{i}", None, None, "One" * (i % 3)) for i in range(40)]
    rows += [(2000 + i, None, "de", 1, None) for i in range(17)] + [(3000 + i, "", "de", 1, "x") for i in range(16)]
    return rows + [(None, "hot", None, None, "No Id"), (5, "hot", "en", 5, "Text 5 É"), (7, "hot", "en", 8, "other text of 7")]


def manifest_rows(spark, tmp_path, df) -> Counter:
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return Counter(tuple(r) for r in QUERIES["op11_merkle_manifest"](spark, str(tmp_path)).collect())


@pytest.mark.parametrize("n_hot", [0, 300])
def test_manifest_matches_brute_force(llm_spark, tmp_path, n_hot):
    """A hot source of two inner levels, sources of one leaf, NULLs, repeated rows, a clashing column."""
    rows = merkle_rows(n_hot)
    df = llm_spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({c: F.lit("clash") for c in ("rank", "group", "leaf", "n")})
    assert manifest_rows(llm_spark, tmp_path, df) == manifest_by_force(rows)


def test_manifest_of_one_and_of_no_rows(llm_spark, tmp_path):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    one = [(1, "a", "en", 3, "Abc")]
    assert manifest_rows(llm_spark, tmp_path / "one", llm_spark.createDataFrame(one, schema)) == manifest_by_force(one)
    assert manifest_rows(llm_spark, tmp_path / "none", llm_spark.createDataFrame([], schema)) == Counter()


def test_proofs_of_some_leaves_read_their_branches_alone(llm_spark):
    df = llm_spark.createDataFrame(merkle_rows(300), "doc_id long, source string, lang string, n_chars long, text string")
    ranked = merkle.leaves(df)
    manifest = merkle.build(ranked)
    asked = ranked.where("doc_id in (17, 1003)").select("group", "rank", "doc_id", F.col("digest").alias("leaf"))
    got = manifest.prove(asked).select("doc_id", (merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok"), F.size("path").alias("steps")).collect()
    assert {(r.doc_id, r.ok, r.steps) for r in got} == {(17, True, 5), (1003, True, 2)}


# Substring dedup


def kept_by_force(rows: list[tuple[int | None, str | None]]) -> dict[int, tuple[int, int, str]]:
    """Words, removed words and kept text of each row, by its place in the order of ids."""
    seen, out = set(), {}
    for place, (_, text) in enumerate(rows):
        words, gone = re.findall(WORD, text or ""), set()
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone.update(range(i, i + 20))
            seen.add(window)
        out[place] = len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)
    return out


def test_substring_dedup_query(llm_spark, documents):
    order = sorted(documents)
    want = dict(zip(order, kept_by_force([(d, documents[d].text) for d in order]).values(), strict=True))
    rows = QUERIES["op12_substring_dedup"](llm_spark, SMALL).collect()
    assert len(rows) == len(documents) and sum(r.n_removed for r in rows)
    for r in rows:
        n_words, n_removed, text = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n_words, n_removed, hashlib.sha256(text.encode()).hexdigest())


def test_substring_dedup_matches_brute_force(llm_spark):
    """Repeats inside texts and across them, runs of one word, texts at the window's size, long texts."""
    rng = random.Random(5)
    passages = [[f"p{k}w{i}" for i in range(n)] for k, n in enumerate((19, 20, 21, 45, 200))]
    rows = []
    for d in range(160):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice([rng.choice(passages), ["a"] * rng.randint(1, 50), [f"x{rng.randrange(10**6)}" for _ in range(rng.randint(1, 60))], rng.choice(passages)[1:-1]])
        rows.append((d * 3 - 100, rng.choice([" ", "\n", "\t ", " é\x0b"]).join(words)))
    long = " ".join(f"{rng.randrange(10**4)}" for _ in range(400_000))
    rows += [(1000, long), (1001, f"{long} end"), (1002, None), (1003, ""), (1004, " \n")]
    df = llm_spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("unit", "n_words", "kept_text", "slice")})
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substrings.drop_repeats(df).collect()}
    assert got == dict(zip([d for d, _ in rows], kept_by_force(rows).values(), strict=True))
    assert got[1001][1] == 400_000


def test_substring_dedup_of_repeated_ids_and_odd_rows(llm_spark, odd, none):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (1, f"{text} more"), (None, text), (2, text)]
    got = [(r.doc_id, r.n_removed) for r in substrings.drop_repeats(llm_spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert Counter(got) == Counter([(None, 0), (1, 30), (1, 30), (1, 30), (2, 30)])
    rows = substrings.drop_repeats(odd).collect()
    assert len(rows) == 8 and {r.n_removed for r in rows} == {0} and {r.n_words for r in rows if r.doc_id == 5} == {30_000}
    assert substrings.drop_repeats(none).count() == 0


def test_gaps_and_estimates_lose_nothing():
    rng = np.random.default_rng(1)
    for top in (3, 300, 1 << 30, 1 << 39):
        values = np.unique(rng.integers(0, top, 500)).astype(np.uint64)
        assert substrings.unpacked_gaps(substrings.packed_gaps(values), len(values)).tolist() == values.tolist()
    assert substrings.unpacked_gaps(substrings.packed_gaps(np.zeros(0, np.uint64)), 0).tolist() == []


# Alignment


def pieces_of(model: sentencepiece.SentencePieceProcessor, ids: list[int]) -> list[bytes]:
    found = []
    for piece in map(model.id_to_piece, ids):
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        found.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
    return found


def aligned_by_force(texts: dict[int, str | None]) -> dict[int, tuple]:
    ranks = [line.split() for line in open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb")]
    bytes_a = {int(at): base64.b64decode(token) for token, at in ranks}
    a_of, b_of = Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_of.encode_special_tokens = True
    counts, own = Counter(), {}
    for d, text in texts.items():
        a, b = (a_of.encode(f" {text}", add_special_tokens=False).ids, b_of.encode(text)) if text else ([], [])
        parts_a, parts_b = [bytes_a[i] for i in a], pieces_of(b_of, b)
        if not text or b"".join(parts_a) != f" {text}".encode() or b"".join(parts_b) != f" {text}".encode():
            own[d] = [], [], [], ""
            continue
        ends_a, ends_b = np.cumsum([len(p) for p in parts_a]).tolist(), np.cumsum([len(p) for p in parts_b]).tolist()
        links = [(x, y) for x, e in zip(a, ends_a, strict=True) for y in [b[i] for i in np.flatnonzero(np.array(ends_b) == e)]]
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            x = [k for k, e in zip(a, ends_a, strict=True) if e <= end][i:]
            y = [k for k, e in zip(b, ends_b, strict=True) if e <= end][j:]
            groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
            i, j = i + len(x), j + len(y)
        own[d] = a, b, links, ";".join(groups)
        counts.update(links)
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return {
        d: (len(a), len(b), len(g.split(";")) if g else 0, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), h(g) if a else "")
        for d, (a, b, links, g) in own.items()
    }


TEXTS = ["", None, " ", "a", "A b\nc", "  two  spaces ", "<|endoftext|><s></s><unk><0x0A>", "▁x ▁", "ﬁ É é ß", "中文字 😀", "\x00\x01", "don't we'll", "1234567 8", "\n\n\n", "\xa0 　", "İΣ", "a" + " " * 1500 + "b"]


def test_alignment_matches_brute_force(llm_spark, tmp_path, documents):
    rng = random.Random(4)
    texts = dict(enumerate([*TEXTS, *("".join(rng.choice(["the ", "ing", "'s", "É", "\n", "  ", "中", "xq", "12", "."]) for _ in range(rng.randint(1, 60))) for _ in range(200))]))
    texts |= {1000 + d: r.text for d, r in list(documents.items())[:60]}
    df = llm_spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("links", F.lit("clash"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r[1:]) for r in QUERIES["op13_token_alignment"](llm_spark, str(tmp_path)).collect()}
    assert got == aligned_by_force(texts)


def test_alignment_of_odd_rows(llm_spark, odd, none):
    aligned = alignment.align(odd, BYTE_BPE, PIECES).cache()
    found = alignment.scored(aligned, BYTE_BPE, PIECES)
    rows = found.collect()
    assert len(rows) == 8 and "links" not in found.columns and {r.kept for r in rows} == {"clash"}
    assert {(r.n_a, r.n_b, r.n_groups, r.groups) for r in rows if r.doc_id in (2, 3)} == {(0, 0, 0, "")}
    assert len({(r.n_a, r.groups) for r in rows if r.doc_id == 1}) == 1
    assert alignment.scored(alignment.align(none, BYTE_BPE, PIECES), BYTE_BPE, PIECES).count() == 0


def test_alignment_of_a_text_of_megabytes():
    two = alignment.aligner(BYTE_BPE, PIECES)
    text = "word and " * 200_000 + " " * 100_000 + "\n" * 50_000 + "a" * 300_000
    a, b, groups, written, links = two.align(text)
    assert a > 400_000 and groups == written.count(b";") + 1 == len(links) // 4


def test_every_linked_pair_is_in_the_table():
    two = alignment.aligner(BYTE_BPE, PIECES)
    assert len(two.links.keys) <= sum(map(len, two.a.tokens)) * 2 + sum(map(len, two.b.tokens)) * 2
