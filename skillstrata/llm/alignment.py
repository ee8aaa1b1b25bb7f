"""Alignment of two tokenizers' ids over the same texts (operator 13).

Both tokenizers cut the same bytes. The cumulative byte ends of a text's tokens are keys of two
dictionaries, end to place; the intersection of their key sets, sorted, cuts both id lists into
groups, and the tokens that end a group together are linked. Corpus-wide counts of linked id
pairs then tell which link is usual for an id.

Of two tokens that end at the same byte of a text, one's bytes are a suffix of the other's. The
pairs that can be linked at all therefore follow from the two vocabularies alone (`LinkTable`):
counts of links are an array of that size, whatever the corpus.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skillstrata.llm.bpe import WORD_PATTERN, vocabulary
from skillstrata.llm.common import pieces, texts_of, without

PIECE_BYTES = 1 << 20
LONG_BLANKS = re.compile(r"\s{1000}")  # beyond the recursion the faster library bears
BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")

ADDED = "n_a long, n_b long, n_groups long, groups string, links binary"


class ByteLevel:
    """Byte-level BPE of a tokenizer file; strings of special tokens are plain text."""

    def __init__(self, path: str) -> None:
        v = vocabulary(path)
        self.tokens = [v.bytes[a : a + n].tobytes() for a, n in zip(v.starts.tolist(), v.lengths.tolist(), strict=True)]
        self.path, self.library, self.fast = path, None, None
        if bool(np.all(np.diff(v.merged) > 0)):  # ids in the order of the merges serve as ranks
            special = set(v.special.values())
            ranks = {token: at for at, token in enumerate(self.tokens) if at not in special}
            self.fast = tiktoken.Encoding("file", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """Ids whose bytes are the text's: each byte has an id, so none is lost."""
        if self.fast and not LONG_BLANKS.search(text):
            return np.array(self.fast.encode_ordinary(text), np.int64)
        if not self.library:
            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
            self.library.encode_special_tokens = True
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int64)


class Pieces:
    """A sentencepiece model, which puts a space before each text."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.tokens = []
        for at in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(at)
            byte = BYTE_PIECE.fullmatch(piece)
            self.tokens.append(bytes.fromhex(byte[1]) if byte else piece.replace("▁", " ").encode())

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


class LinkTable:
    """The id pairs that can end together, each with a number: those of which one is a suffix of the other."""

    def __init__(self, a: list[bytes], b: list[bytes]) -> None:
        if not all(a) or not all(b):
            raise ValueError("a vocabulary holds a token without bytes")
        self.n_b = len(b)
        keys: set[int] = set()
        for shorter, longer, swapped in ((b, a, False), (a, b, True)):
            ids_of: defaultdict[bytes, list[int]] = defaultdict(list)
            for at, token in enumerate(shorter):
                ids_of[token].append(at)
            for at, token in enumerate(longer):
                for cut in range(len(token)):
                    for other in ids_of.get(token[cut:], ()):
                        keys.add(other * self.n_b + at if swapped else at * self.n_b + other)
        self.keys = np.array(sorted(keys), np.int64)

    def numbers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of some pairs, ascending."""
        return np.searchsorted(self.keys, np.sort(a * self.n_b + b)).astype("<u4")


class Aligner:
    """Both tokenizers and what follows from their vocabularies."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in x.tokens], np.int64) for x in (self.a, self.b))
        self.links = LinkTable(self.a.tokens, self.b.tokens)
        # Decimal ids as eight characters, zero bytes behind; a mark fits behind the digits.
        decimals = [str(at).encode() for at in range(max(len(self.a.tokens), len(self.b.tokens)))]
        self.decimal = np.frombuffer(b"".join(d.ljust(8, b"\0") for d in decimals), "<u8")
        self.shift = np.array([8 * len(d) for d in decimals], np.uint64)

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both, or none where a tokenizer does not keep the bytes of the text."""
        none = np.zeros(0, np.int64)
        if not text:
            return none, none
        spaced = f" {text}"
        b, whole = self.b.encode(text), spaced.encode()
        if b"".join(map(self.b.tokens.__getitem__, b)) != whole:
            return none, none
        a = self.a.encode(spaced)
        return (a, np.array(b, np.int64)) if int(self.a_sizes[a].sum()) == len(whole) else (none, none)

    def align(self, text: str) -> tuple[int, int, int, bytes, bytes]:
        """Values of ADDED for a text."""
        a, b = self.tokens(text)
        if not len(a):
            return 0, 0, 0, b"", b""
        place_a = dict(zip(np.cumsum(self.a_sizes[a]).tolist(), range(len(a)), strict=True))
        place_b = dict(zip(np.cumsum(self.b_sizes[b]).tolist(), range(len(b)), strict=True))
        # Both dictionaries hold their ends in ascending order, so the common ones come sorted.
        last_a = np.array([at for end, at in place_a.items() if end in place_b], np.int64)
        last_b = np.array([at for end, at in place_b.items() if end in place_a], np.int64)
        return len(a), len(b), len(last_a), self.written(a, b, last_a, last_b), self.links.numbers(a[last_a], b[last_b]).tobytes()

    def written(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> bytes:
        """Groups as ``a1,a2|b1;a3|b2,b3``, given each group's last place in both lists."""
        at_a = np.arange(len(a)) + np.repeat(np.r_[0, last_b[:-1] + 1], np.diff(last_a, prepend=-1))
        at_b = np.arange(len(b)) + np.repeat(last_a + 1, np.diff(last_b, prepend=-1))
        ids = np.empty(len(a) + len(b), np.int64)
        ids[at_a], ids[at_b] = a, b
        mark = np.full(len(ids), ord(","), np.uint64)
        mark[at_a[last_a]], mark[at_b[last_b]] = ord("|"), ord(";")
        letters = (self.decimal[ids] | mark << self.shift[ids]).view(np.uint8)
        return letters[letters != 0][:-1].tobytes()


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each process."""
    return Aligner(a_path, b_path)


def align(df: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """Every row with the columns of ADDED.

    Tokenizer A is a byte-level file and sees a space before the text; B is a sentencepiece
    model, which adds it. ``groups`` lists both sides' ids by group; ``links`` are the numbers in
    the LinkTable of a text's links, ascending, as little-endian unsigned 32-bit integers.

    NULL and empty texts, and texts of which a tokenizer does not give back the bytes, have no
    tokens: counts of 0, empty groups and links. Repeated rows are aligned alike; a text of any
    length is aligned whole. An input column named like an added one is replaced; the text
    column itself must not bear such a name.
    """
    df = without(df, *[field.split()[0] for field in ADDED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = aligner(a_path, b_path)
        for piece in pieces(batches, text_col, PIECE_BYTES):
            n_a, n_b, n_groups, groups, links = zip(*map(two.align, texts_of(piece, text_col)), strict=True)
            added = [pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(n_groups, pa.int64())]
            added += [pa.array(groups, pa.binary()).cast(pa.string()), pa.array(links, pa.binary())]
            yield pa.RecordBatch.from_arrays([*piece.columns, *added], [*piece.schema.names, *[f.split()[0] for f in ADDED.split(", ")]])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, {ADDED}")


def link_counts(aligned: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``(link, count)``: how many links of the corpus each number of the LinkTable stands for.

    A task sends one row for a link at most, so the shuffle is bounded by the vocabularies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(aligner(a_path, b_path).links.keys), np.int64)
        for batch in batches:
            for links in batch.column(0).to_pylist():
                np.add.at(total, np.frombuffer(links, "<u4"), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"link": some, "count": total[some]})

    return aligned.select("links").mapInArrow(run, "link long, count long").groupBy("link").agg(F.sum("count").alias("count"))


def scored(aligned: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The rows of ``align`` with ``n_links``, ``n_best`` and ``count_sum`` in place of ``links``.

    A link's count is how often its id pair is linked in all rows; ``n_best`` counts links whose
    count is the highest of their B id, ties included. ``aligned`` is read twice: give a written
    table. The counts sent to all tasks have one entry for a row of the LinkTable at most.
    """
    table = aligner(a_path, b_path).links
    found = link_counts(aligned, a_path, b_path).toArrow()
    counts = np.zeros(len(table.keys), np.int64)
    counts[found["link"].to_numpy()] = found["count"].to_numpy()
    highest = np.zeros(table.n_b, np.int64)
    np.maximum.at(highest, table.keys % table.n_b, counts)
    best = counts == highest[table.keys % table.n_b]
    added = ("n_links", "n_best", "count_sum")
    aligned = without(aligned, *added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("links")
            links = [np.frombuffer(x, "<u4") for x in batch.column(at).to_pylist()]
            values = [[len(x) for x in links], [int(best[x].sum()) for x in links], [int(counts[x].sum()) for x in links]]
            rest = batch.remove_column(at)
            yield pa.RecordBatch.from_arrays([*rest.columns, *(pa.array(v, pa.int64()) for v in values)], [*rest.schema.names, *added])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema if f.name != "links")
    return aligned.mapInArrow(run, f"{fields}, " + ", ".join(f"{name} long" for name in added))
