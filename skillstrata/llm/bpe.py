"""Byte-level BPE with a pair occurrence index (operator 7).

The distinct words of a stretch of a partition are laid out as one array of symbols. An index
maps each adjacent pair that has a merge rule, by the rule's rank, to all places where it
stands. Active ranks are taken in ascending order: all places of a pair are merged at once, and
the pairs they form with their neighbours enter the lists of their own ranks. A word's symbols
end as they would if it were encoded alone, as each word always sees its lowest rank first.

Texts are cut into words as the tokenizer file asks (the byte-level pattern), each distinct
word is encoded once for a stretch and kept while memory allows.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from skillstrata.llm.common import pieces, texts_of, without

# The word pattern of byte-level tokenizers.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

STRETCH_BYTES = 4 << 20
KEPT_CHUNKS = 1 << 18  # chunks a worker remembers before it starts anew; memory only, never results

_words = regex.compile(WORD_PATTERN)
_inner_blank = re.compile(r"\s \s")
_cut = re.compile(r"(?<=\S)(?= \S)")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, and its byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """Ids, bytes of each id, and merges of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, byte_of = spec["model"], byte_symbols()
        ids: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*ids.values(), *self.special.values()])
        texts = [b""] * self.size
        for token, at in ids.items():
            texts[at] = bytes(byte_of[c] for c in token)
        for token, at in self.special.items():
            texts[at] = token.encode()
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.first = np.zeros(256, np.int32)
        for symbol, byte in byte_of.items():
            self.first[byte] = ids[symbol]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        self.left, self.right = left, right
        self.merged = np.array([ids[a + b] for a, b in merges], np.int32)
        key = left * self.size + right
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]
        # Special tokens' strings are taken out of a text before anything else.
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge rule of each pair, -1 where there is none."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_words(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after another, and the number of ids of each."""
    sizes = np.array([len(w) for w in words], np.int64)
    symbol = v.first[np.frombuffer(b"".join(words), np.uint8)]
    n = len(symbol)
    if not n:
        return symbol, sizes
    word = np.repeat(np.arange(len(words)), sizes)
    after = np.arange(1, n + 1)
    before = np.arange(-1, n - 1)
    last = np.r_[word[1:] != word[:-1], True]
    after[last] = n  # n: none
    before[np.r_[True, last[:-1]]] = -1
    alive = np.ones(n + 1, bool)
    alive[n] = False
    new = np.zeros(n, bool)
    symbol = np.r_[symbol, -1].astype(np.int32)
    before = np.r_[before, -1]

    index: defaultdict[int, list[np.ndarray]] = defaultdict(list)
    active: list[int] = []

    def enter(place: np.ndarray) -> None:
        """Files the pairs that start at these places under their ranks."""
        rank = v.ranks(symbol[place], symbol[after[place]])
        known = rank >= 0
        rank, place = rank[known], place[known]
        if not len(rank):
            return
        if len(rank) > 1:
            order = np.argsort(rank, kind="stable")
            rank, place = rank[order], place[order]
        starts = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
        for r, a, b in zip(rank[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(rank)], strict=True):
            if r not in index:
                heapq.heappush(active, r)
            index[r].append(place[a:b])

    enter(np.flatnonzero(~last))
    while active:
        rank = heapq.heappop(active)
        place = np.concatenate(index.pop(rank))
        a, b = v.left[rank], v.right[rank]
        # Only places where the pair still stands.
        place = place[alive[place] & (symbol[place] == a) & (symbol[after[place]] == b)]
        if a == b and len(place) > 1:
            place = _leftmost(np.sort(place), after)
        if not len(place):
            continue
        gone = after[place]
        rest = after[gone]
        symbol[place] = v.merged[rank]
        alive[gone] = False
        after[place] = rest
        inside = rest < n
        before[rest[inside]] = place[inside]
        # A neighbour on the left that is itself new stands among the places already.
        left = before[place]
        left = left[left >= 0]
        new[place] = True
        left = left[~new[left]]
        new[place] = False
        enter(np.concatenate([left, place[inside]]))
    keep = alive[:n]
    return symbol[:n][keep], np.bincount(word[keep], minlength=len(words))


def _leftmost(place: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of places of a pair of equal symbols, those merged when runs are merged from the left."""
    joined = np.r_[False, after[place[:-1]] == place[1:]]
    run = np.maximum.accumulate(np.where(joined, 0, np.arange(len(place))))
    return place[(np.arange(len(place)) - run) % 2 == 0]


class Encoder:
    """Encodes texts of a partition; remembers the ids of chunks already met."""

    def __init__(self, path: str) -> None:
        self.v = vocabulary(path)
        self._forget()

    def _forget(self) -> None:
        self.number: defaultdict[str | tuple[str], int] = defaultdict(count().__next__)
        self.ids = np.zeros(0, np.int32)
        self.sizes = np.zeros(0, np.int64)

    def _chunks(self, text: str) -> np.ndarray:
        """Numbers of the chunks of a text, which is cut before blanks where words always end."""
        if _inner_blank.search(text):
            first, *parts = _cut.split(text)  # blanks in a run belong together: only between two other characters
            parts = [part[1:] for part in parts]
        else:
            first, *parts = text.split(" ")
        # All chunks but a text's first begin with a blank, which their keys leave out.
        parts = [(first,), *parts] if first else parts
        return np.fromiter(map(self.number.__getitem__, parts), np.int64, len(parts))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each."""
        if len(self.number) > KEPT_CHUNKS:
            self._forget()
        known = len(self.sizes)
        plans: list[np.ndarray] = []
        for text in texts:
            plan = []
            at = 0
            for found in self.v.specials.finditer(text) if self.v.specials else ():
                plan += [self._chunks(text[at : found.start()]), np.array([-1 - self.v.special[found[0]]])]
                at = found.end()
            plans.append(np.concatenate([*plan, self._chunks(text[at:])]))
        self._learn(known)
        chunk = np.concatenate(plans)
        lengths = np.array([len(p) for p in plans])
        # Special tokens stand behind the chunks' ids, one id each.
        table = np.r_[self.ids, np.arange(self.v.size, dtype=np.int32)]
        sizes = np.r_[self.sizes, np.ones(self.v.size, np.int64)]
        starts = np.cumsum(sizes) - sizes
        chunk = np.where(chunk < 0, len(self.sizes) - 1 - chunk, chunk)
        ids = gather(table, starts[chunk], sizes[chunk])
        ends = np.r_[0, np.cumsum(sizes[chunk])]
        bounds = np.r_[0, np.cumsum(lengths)]
        return ids, ends[bounds[1:]] - ends[bounds[:-1]]

    def _learn(self, known: int) -> None:
        """Encodes the chunks numbered from ``known`` on: their distinct words all at once."""
        keys = list(islice(self.number, known, None))
        if not keys:
            return
        chunks = [key[0] if type(key) is tuple else " " + key for key in keys]
        number: defaultdict[str, int] = defaultdict(count().__next__)
        words = [list(map(number.__getitem__, _words.findall(c))) for c in chunks]
        per_chunk = np.array([len(w) for w in words], np.int64)
        flat = np.fromiter(chain.from_iterable(words), np.int64, int(per_chunk.sum()))
        ids, sizes = merge_words([w.encode("utf-8", "surrogatepass") for w in number], self.v)
        starts = np.cumsum(sizes) - sizes
        self.ids = np.r_[self.ids, gather(ids, starts[flat], sizes[flat])]
        ends = np.r_[0, np.cumsum(sizes[flat])]
        bounds = np.r_[0, np.cumsum(per_chunk)]
        self.sizes = np.r_[self.sizes, ends[bounds[1:]] - ends[bounds[:-1]]]


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``starts``, one after another."""
    total = int(sizes.sum())
    jump = starts - (np.cumsum(sizes) - sizes)
    return values[np.arange(total) + np.repeat(jump, sizes)]


def packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values of ``sizes`` items each, cut from one array without copying it again."""
    offsets = np.r_[0, np.cumsum(sizes * values.itemsize)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _encoded(batches: Iterator[pa.RecordBatch], tokenizer: str, text_col: str) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(tokenizer)
    for piece in pieces(batches, text_col, STRETCH_BYTES):
        ids, sizes = encoder.encode(texts_of(piece, text_col))
        columns = dict(zip(piece.schema.names, piece.columns, strict=True))
        columns.pop(text_col)
        yield pa.RecordBatch.from_pydict({**columns, "n_tokens": pa.array(sizes), "ids": packed(ids.astype("<u4"), sizes)})


def _decoded(batches: Iterator[pa.RecordBatch], tokenizer: str, text_col: str) -> Iterator[pa.RecordBatch]:
    v = vocabulary(tokenizer)
    for piece in pieces(batches, "ids", STRETCH_BYTES):
        texts = []
        for value in piece.column(piece.schema.get_field_index("ids")):
            ids = np.frombuffer(value.as_buffer(), "<u4") if value.is_valid else np.zeros(0, "<u4")
            texts.append(gather(v.bytes, v.starts[ids], v.lengths[ids]).tobytes().decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(texts, pa.string())], [*piece.schema.names, text_col])


def _fields(df: DataFrame, *left_out: str) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name not in left_out)


def encode(df: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """Every row without its text, with ``n_tokens long`` and ``ids binary``.

    ``tokenizer`` is the path of a byte-level BPE file that all workers can open. ``ids`` are
    little-endian unsigned 32-bit integers, as the tokenizer gives them without added
    special tokens; a special token's own string in a text becomes its id. NULL and empty
    texts have no ids. Input columns named ``n_tokens`` or ``ids`` are replaced.
    """
    df = without(df, "n_tokens", "ids")
    return df.mapInArrow(lambda batches: _encoded(batches, tokenizer, text_col), f"{_fields(df, text_col)}n_tokens long, ids binary")


def decode(df: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """Every row of ``encode`` with the text of its ids, special tokens included; bytes that
    are no UTF-8 become the replacement character. NULL ids give an empty text. An input
    column named as the text column is replaced."""
    df = without(df, text_col)
    return df.mapInArrow(lambda batches: _decoded(batches, tokenizer, text_col), f"{_fields(df)}`{text_col}` string")


def encode_and_decode(df: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """``decode`` of ``encode`` in one pass: ids, and the text they decode to in place of the text."""
    df = without(df, "n_tokens", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decoded(_encoded(batches, tokenizer, text_col), tokenizer, text_col)

    return df.mapInArrow(run, f"{_fields(df, text_col)}n_tokens long, ids binary, `{text_col}` string")
