"""Operators over the corpus: near-dedup, mixing, line dedup, URL rules, top-k search, the pipeline."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from skillstrata.llm import ball_tree, line_templates, mixing, simhash, url_rules
from skillstrata.llm.components import components
from skillstrata.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import connect, difference
from tests.llm.conftest import SMALL
from tests.llm.test_findings import kept_by_force

WORD = r"[^\x20\x09-\x0D]+"


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_matches_its_sql(llm_spark, name):
    assert difference(llm_spark, connect(SMALL), name, QUERIES[name], ORACLE_SQL[name], SMALL) is None


# SimHash


def print_by_force(text: str | None) -> int:
    words = re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def roots_by_force(values: list[int]) -> dict[int, int]:
    """For each value the smallest one it reaches by steps of at most two bits."""
    left, root = sorted(set(values)), {}
    for v in left:
        stack = [v] if v not in root else []
        while stack:
            x = stack.pop()
            if x not in root:
                root[x] = v
                stack += [y for y in left if y not in root and (x ^ y).bit_count() <= 2]
    return root


def check_components(rows, prints: dict[int, int]):
    root = roots_by_force(list(prints.values()))
    least: dict[int, int] = {}
    for d in sorted(prints):
        least.setdefault(root[prints[d]], d)
    assert {r.doc_id: r.fingerprint for r in rows} == {d: f"{p:016x}" for d, p in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == {d: least[root[p]] for d, p in prints.items()}


def test_near_dedup_query(llm_spark, documents):
    rows = QUERIES["op2_simhash_near_dedup"](llm_spark, SMALL).collect()
    assert len(rows) == len(documents)
    check_components(rows, {d: print_by_force(r.text) for d, r in documents.items()})


@pytest.mark.parametrize("block", [4, 256])
def test_links_in_large_blocks(llm_spark, monkeypatch, block):
    """Clusters of fingerprints a few bits apart, where most blocks exceed the bound and are cut on."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(7)
    values = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(60):
            values.add(base ^ sum(1 << b for b in rng.sample(range(40), rng.randint(0, 4))))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.links(llm_spark.createDataFrame([(v,) for v in signed], "fp long"))
    for r in links.collect():
        assert ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2
    root = roots_by_force(list(values))
    found = {r.node & (1 << 64) - 1: r.root for r in components(links).collect()}
    groups: dict[int, set] = defaultdict(set)
    for v in values:
        groups[root[v]].add(found.get(v, v if v < 1 << 63 else v - (1 << 64)))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_thresholds_add_up():
    rng = np.random.default_rng(1)
    bits = (rng.random((500, 64)) < 0.5).astype(float)
    bits[:, 1] = bits[:, 0]
    both = bits.T @ bits
    for m in (2, 3, 4):
        parts = simhash.correlated_parts(500, both, m)
        assert sorted(b for p in parts for b in p) == list(range(64)) and any({0, 1} <= set(p) for p in parts)
        chosen, _ = simhash.thresholds(500, both, parts, [10.0] * m)
        assert sum(chosen) == 2 - m + 1 and min(chosen) >= -1


def test_near_dedup_of_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 8 and {r.component_id for r in rows if r.doc_id in (2, 3, 4)} == {2}
    assert {r.component_id for r in rows if r.doc_id is None} == {None}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.collect()) == {1: 1, 2: 1, None: 1, 5: 1, 6: 1}


def test_components_of_a_long_path(llm_spark):
    nodes = list(range(40))
    random.Random(2).shuffle(nodes)
    path = llm_spark.createDataFrame([*zip(nodes, nodes[1:], strict=False), (100, 101), (100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(path).collect()}
    assert got == {**dict.fromkeys(range(40), 0), 100: 100, 101: 100}


# Mixing


def aims_by_force(sizes: dict, weights: dict, share: float, most: float) -> dict:
    aims, open_, left = {}, {s for s in sizes if weights[s] > 0}, share * sum(sizes.values())
    while open_:
        price = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if price * weights[s] >= most * sizes[s]}
        if not full:
            return aims | {s: price * weights[s] for s in open_}
        for s in full:
            aims[s] = most * sizes[s]
            left -= aims[s]
        open_ -= full
    return aims


def test_mixing_query(llm_spark, documents):
    rows = QUERIES["op4_mixing"](llm_spark, SMALL).collect()
    size = {d: len(re.findall(WORD, r.text or "")) for d, r in documents.items()}
    sizes = Counter()
    for d, r in documents.items():
        sizes[r.source] += size[d]
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes))}
    aims, taken, longest = aims_by_force(sizes, weights, 1.5, 2), Counter(), Counter()
    assert len(rows) == len(documents)
    for r in rows:
        source = documents[r.doc_id].source
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[source]) and r.target == pytest.approx(aims[source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[source] += r.taken
        longest[source] = max(longest[source], r.size)
    assert all(abs(taken[s] - aims[s]) <= 2 * longest[s] for s in sizes)
    assert 0 <= 1.5 * sum(sizes.values()) - sum(taken.values()) <= max(longest.values())
    again = QUERIES["op4_mixing"](llm_spark, SMALL).collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in rows}


def test_mixing_of_odd_and_hot_rows(llm_spark, odd, none):
    weights = llm_spark.createDataFrame([("a", 1.0), ("b", 1.0), (None, 1.0)], "source string, weight double")
    rows = mixing.mix(odd, weights).collect()
    assert len(rows) == 8 and all(r.taken <= 2 * r.size for r in rows) and {r.source_size for r in rows if r.source is None} == {1}
    assert mixing.mix(none, weights).count() == 0
    same = llm_spark.createDataFrame([(1, "x y", "a")] * 50 + [(2, "z", "b")], "doc_id long, text string, source string")
    rows = mixing.mix(same, weights, share=0.5).collect()
    assert len(rows) == 51 and abs(sum(r.taken for r in rows) - 50) <= 2 and {r.taken for r in rows if r.doc_id == 1} == {0, 2}
    mixed = mixing.mixed(same, weights, share=1.5)
    assert mixed.columns == same.columns and abs(sum(len(r.text.split()) for r in mixed.collect()) - 151) <= 2


def test_sources_without_weight_are_left_out(llm_spark):
    docs = llm_spark.createDataFrame([(1, "a b", "x"), (2, "c d", "y"), (3, "e f", "z")], "doc_id long, text string, source string")
    weights = llm_spark.createDataFrame([("x", 1.0), ("y", 0.0)], "source string, weight double")
    assert {r.source: (r.target, r.taken) for r in mixing.mix(docs, weights, 1.5, 2).collect()} == {"x": (4.0, 4), "y": (0.0, 0), "z": (0.0, 0)}


# Line dedup


def shape_by_force(line: str) -> tuple[str, ...]:
    """Tokens of a line with fields in place of numbers; short lines as they are."""
    plain = tuple(re.findall(WORD, line))
    tokens = tuple(re.findall("[\u0e00-\u109f\u3040-\u30ff\u3400-\u9fff]|[^\\x20\\x09-\\x0D\u0e00-\u109f\u3040-\u30ff\u3400-\u9fff]+", line))
    if len(tokens) < 3:
        return plain
    fields = tuple("<*>" if re.search("[0-9]", t) else t for t in tokens)
    return fields if 2 * sum(bool(re.search("[A-Za-z]|[^\\x00-\\x7f]", t)) for t in fields) >= len(fields) else tokens


def templates_by_force(lines: list[tuple], n: dict[tuple, int], rules, depth: int, found: list) -> None:
    """Groups of lines under one template, with the number of its variable words, as the tree parts them."""
    if sum(n[x] for x in lines) <= rules.min_docs or len(lines) < 2 or depth == line_templates.ROUNDS:
        return
    fixed, closed, even = [], [], []
    for place in zip(*lines, strict=True):
        held = Counter()
        for line, token in zip(lines, place, strict=True):
            held[token] += n[line]
        top = max(held.values())
        prevails = top >= rules.min_docs and 2 * top >= sum(held.values())
        # Of two tokens of one half each, either may prevail; the data of these tests have none.
        fixed.append(max(held, key=held.get) if prevails else None)
        closed.append(prevails and len(held) < rules.min_docs)
        even.append(sum(x * x for x in held.values()) if len(held) > 1 else -1)
    word = lambda t: t != "<*>" and not re.search("[0-9]", t)
    fit, most = [], 0
    for line in lines:
        n_fixed = sum(t == f and word(t) for t, f in zip(line, fixed, strict=True))
        other = any(t != f and c for t, f, c in zip(line, fixed, closed, strict=True))
        if not other and n_fixed >= rules.min_fixed and 100 * n_fixed >= rules.min_fixed_percent * len(line):
            fit.append(line)
            most = max(most, sum(t != f and word(t) for t, f in zip(line, fixed, strict=True)))
    rest = [x for x in lines if x not in set(fit)]
    if fit:
        found.append((fit, most))
        templates_by_force(rest, n, rules, depth + 1, found)
    else:
        parts = defaultdict(list)
        for line in rest:
            parts[line[even.index(max(even))]].append(line)
        for part in parts.values():
            templates_by_force(part, n, rules, depth + 1, found)


def lines_by_force(texts: dict[int, str | None], rules=line_templates.Rules()) -> dict[int, list[str]]:
    docs = defaultdict(set)
    for d, t in texts.items():
        for line in (t or "").split("\n"):
            docs[shape_by_force(line)].add(d)
    docs.pop((), None)
    first = {line: min(v) for line, v in docs.items() if len(v) >= rules.min_docs}
    leaves, found = defaultdict(list), []
    for line in docs:
        if len(line) >= rules.min_tokens:
            leaves[len(line), line[:3]].append(line)
    for lines in leaves.values():
        templates_by_force(lines, {x: len(docs[x]) for x in lines}, rules, 0, found)
    for lines, n_variable in found:
        where = set().union(*[docs[line] for line in lines])
        if len(where) >= rules.min_docs + n_variable**2:
            for line in lines:
                first[line] = min(first.get(line, min(where)), min(where))
    return {d: [line for line in (t or "").split("\n") if first.get(shape_by_force(line), d) == d] for d, t in texts.items()}


def test_line_dedup_query(llm_spark, documents):
    want = lines_by_force({d: r.text for d, r in documents.items()})
    rows = QUERIES["op5_line_dedup"](llm_spark, SMALL).collect()
    assert len(rows) == len(documents) and sum(r.n_dropped for r in rows)
    for r in rows:
        assert r.text_sha256 == hashlib.sha256("\n".join(want[r.doc_id]).encode()).hexdigest()
        assert r.n_lines - r.n_dropped == len(want[r.doc_id])


def test_templates_with_variable_fields(llm_spark):
    names = ("anna", "bert", "carl", "dora")
    rows = [(k, f"own line of {n} alone\nPosted on 2024-0{k + 1}-01 by user {n} in the forum today\nPage {k} of 9") for k, n in enumerate(names)]
    df = llm_spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text.split("\n") for r in line_templates.drop_templates(df).collect()}
    assert got[0] == rows[0][1].split("\n")
    assert all(got[k] == [f"own line of {n} alone"] for k, n in enumerate(names) if k)


def test_line_dedup_of_odd_rows(odd, none):
    rows = line_templates.drop_templates(odd).collect()
    assert len(rows) == 8 and {r.n_dropped for r in rows} == {0} and [r.text for r in rows if r.doc_id == 2] == [None]
    assert line_templates.drop_templates(none).count() == 0


# URL rules


def test_url_rules_match_brute_force(llm_spark):
    rng = random.Random(2)
    labels, paths = ["a", "b", "com", "net", "x"], ["", "/", "/a", "/a/", "/a/b", "/b", "/ab"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    rules = [(host(), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(60)] + [("a", None, "block"), (None, "/", "allow"), ("", "/", "block")]
    urls = [(rng.randint(0, 99), f"{rng.choice(['http', 'HTTPS'])}://{rng.choice([host(), host().upper(), 'a.b.com'])}{rng.choice(paths)}{rng.choice(['', '?q=://x', '#z'])}") for _ in range(500)]
    urls += [(None, None), (5, None), (None, "a.b/c"), (1, ""), (1, "://"), (7, "http:///a/b")] + [(9, "http://a.b.com/a/b")] * 200

    def judged(url):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        if not m:
            return "", "", None, "allow"
        h, p = m[1].lower(), m[2]
        fits = [(len(rh + rp), len(rh), rh + rp, v) for rh, rp, v in rules if rh and rp is not None and f".{h}".endswith(f".{rh}") and p.startswith(rp)]
        return h, p, max(fits)[2] if fits else None, max(fits)[3] if fits else "allow"

    pages = llm_spark.createDataFrame(urls, "page_id long, url string")
    got = Counter(tuple(r) for r in url_rules.judge(pages, llm_spark.createDataFrame(rules, "host string, path string, verdict string")).collect())
    assert got == Counter((i, *judged(u)) for i, u in urls)


def test_url_rules_of_empty_tables(llm_spark):
    rules = llm_spark.createDataFrame([], "host string, path string, verdict string")
    pages = llm_spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [tuple(r) for r in url_rules.judge(pages, rules).collect()] == [(1, "a.com", "/", None, "allow")]
    assert url_rules.judge(pages.limit(0), rules).count() == 0


# Top-k search


def test_top_k_matches_brute_force(llm_spark, monkeypatch):
    monkeypatch.setattr(ball_tree, "SHARD_ROWS", 40)
    monkeypatch.setattr(ball_tree, "BLOCK_ROWS", 4)
    monkeypatch.setattr(ball_tree, "LEAF_ROWS", 4)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(150)] + [(i, [0.5] * 6) for i in range(150, 200)]
    odd = [(200, None), (220, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (240, [float("nan")] * 6), (260, [float("inf")] * 6), (None, [1.0] * 6), (280, []), (300, [1.0]), (301, [2.0]), (320, [1e30] * 6)]
    # Repeated ids are rows of their own: other copies are found, and each copy of a query has its own ranks.
    again = [*rows[:3], (20, [2.0] * 6), (1, [3.0] * 6)]
    df = llm_spark.createDataFrame(rows + odd + again, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = defaultdict(list)
    for r in ball_tree.top_k(df, F.col("id") % 20 == 0, k=7).collect():
        got[r.query_id].append((r.rank, r.score, r.vec_id))
    whole = [(i, [min(int(np.floor(64 * x)), 2**63 - 1) for x in v]) for i, v in rows + odd[-4:] + again]
    want = defaultdict(list)
    for place, (q, of_q) in enumerate(whole):
        if q % 20 == 0:
            scores = [(max(min(sum(x * y for x, y in zip(of_q, v, strict=True)), 2**63 - 1), 1 - 2**63), i) for at, (i, v) in enumerate(whole) if at != place and len(v) == len(of_q)]
            want[q] += [(rank, *found) for rank, found in enumerate(sorted(scores, key=lambda s: (-s[0], s[1]))[:7], 1)]
    assert {q: sorted(found) for q, found in got.items()} == {q: sorted(found) for q, found in want.items() if found}
    assert len(got[20]) == 14


def test_top_k_of_repeated_ids(llm_spark):
    df = llm_spark.createDataFrame([(20, [1.0]), (1, [2.0]), (1, [3.0]), (2, [0.5])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, ball_tree.top_k(df, F.col("id") % 20 == 0).collect()))
    assert got == [(20, 1, 1, 64 * 192), (20, 2, 1, 64 * 128), (20, 3, 2, 64 * 32)]


def test_top_k_of_no_rows(llm_spark):
    df = llm_spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ball_tree.top_k(df, F.col("id") % 20 == 0).count() == 0


# Pipeline


def test_pipeline_stage_by_stage(llm_spark, documents):
    docs = llm_spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, out = docs.collect(), stage(llm_spark, docs, SMALL)
        after = out.collect()
        texts = {r.doc_id: r.text for r in before}
        ids = Counter(r.doc_id for r in after)
        if name != "encode_bpe":
            assert out.columns == docs.columns
            docs = llm_spark.createDataFrame(after, out.schema)
        if name == "quality_rules":
            assert len(after) < len(before) and all(r.text == texts[r.doc_id] for r in after)
        if name == "line_dedup":
            want = lines_by_force(texts)
            assert {r.doc_id: r.text for r in after if r.text.split()} == {d: "\n".join(x) for d, x in want.items() if "\n".join(x).split()}
        if name == "near_dedup":
            assert set(ids) == kept_by_force(texts) and max(ids.values()) == 1 and all(r.text == texts[r.doc_id] for r in after)
        if name == "mix_sources":
            assert max(ids.values()) == 2
            words = sum(len(re.findall(WORD, r.text)) for r in before)
            assert abs(sum(len(re.findall(WORD, r.text)) for r in after) / (1.5 * words) - 1) < 0.02
        if name == "encode_bpe":
            assert len(after) == len(before) and all(r.decodes and len(r.ids) == 4 * r.n_tokens for r in after)
