"""Quality rules with repetition measured on a suffix array (operator 9).

The words of a text are suffix-sorted by prefix doubling; neighbours' longest common prefixes
bound the maximal repeated word sequences. The spans of all repeats are united, and a text is
rejected where they cover too much of it or where one of them is too long.

Many texts are sorted together: a word counts as another one in another text, so no repeat
crosses texts, and only suffixes that still share a prefix are sorted again.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skillstrata.llm.common import BLANKS, pieces, texts_of, without

SYMBOLS = "#*$%&|<>"
BASE_WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
BLOCK_BYTES = 2 << 20

ADDED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long, covered_words long, base_failed boolean, kept boolean"


@dataclass(frozen=True)
class Limits:
    """A repeat counts from ``min_repeat`` words on; more than ``max_percent`` of the words
    covered by such repeats, or one of more than ``max_longest`` words, rejects the text."""

    min_repeat: int = 10
    max_percent: int = 15
    max_longest: int = 50


def repeat_lengths(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each place, the length of the longest sequence from there that its text holds elsewhere too.

    ``words`` are numbers of words, ``doc`` the ascending number of each one's text. Lengths
    below BASE_WINDOW may be given as 0.
    """
    n = len(words)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    ends = np.searchsorted(doc, doc, side="right")
    key = doc * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    # rank: equal for suffixes not yet told apart, else the suffix's place; levels: rank by prefix length.
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels: list[np.ndarray] = []
    split_at: list[tuple[int, np.ndarray, np.ndarray]] = []
    slots = _shared(new)
    k = 1
    while len(slots):
        levels.append(rank.astype(np.int32))
        at = order[slots]
        after = at + k
        follower = np.where(after < ends[at], rank[np.minimum(after, n - 1)], -1)
        head = rank[at]
        again = np.lexsort((follower, head))
        at, follower, head = at[again], follower[again], head[again]
        order[slots] = at
        same_head = np.r_[False, head[1:] == head[:-1]]
        new = ~same_head | np.r_[True, follower[1:] != follower[:-1]]
        # Neighbours told apart here share at least k words and fewer than 2k.
        parted = np.flatnonzero(new & same_head)
        if k >= BASE_WINDOW // 2 + 2:
            split_at.append((k, at[parted - 1], at[parted]))
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        slots = slots[_shared(new)]
        k *= 2
    for k, left, right in split_at:
        level = k.bit_length() - 1
        common = np.full(len(left), k, np.int64)
        for step in range(level - 1, -1, -1):
            i, j = left + common, right + common
            inside = (i < ends[left]) & (j < ends[right])
            i, j = np.minimum(i, n - 1), np.minimum(j, n - 1)
            # A level holds prefixes of 2**step words, all of them inside the text where ranks are equal.
            common += np.where(inside & (levels[step][i] == levels[step][j]), 1 << step, 0)
        np.maximum.at(longest, left, common)
        np.maximum.at(longest, right, common)
    return longest


def _shared(new: np.ndarray) -> np.ndarray:
    """Places in groups of two or more, where ``new`` marks the first of each group."""
    alone = new & np.r_[new[1:], True]
    return np.flatnonzero(~alone)


def covered(longest: np.ndarray, least: int, bounds: np.ndarray) -> np.ndarray:
    """Words of each text inside the united spans of repeats of at least ``least`` words."""
    start = np.flatnonzero(longest >= least)
    n = len(longest)
    depth = np.bincount(start, minlength=n + 1) - np.bincount(start + longest[start], minlength=n + 1)
    inside = np.r_[0, np.cumsum(np.cumsum(depth[:n]) > 0)]
    return inside[bounds[1:]] - inside[bounds[:-1]]


def measure(texts: list[str], limits: Limits) -> dict[str, np.ndarray]:
    """The columns of ADDED for some texts."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    sizes, ids = [], []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").split()
        sizes.append(len(words))
        ids.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
    n_words = np.array(sizes, np.int64)
    bounds = np.r_[0, np.cumsum(n_words)]
    longest = repeat_lengths(np.concatenate(ids), np.repeat(np.arange(len(texts)), n_words))
    spans = covered(longest, limits.min_repeat, bounds)
    repeated = covered(longest, BASE_WINDOW, bounds)
    top = np.array([longest[a:b].max(initial=0) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], np.int64)
    top[top < BASE_WINDOW] = 0
    base_failed = (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n_words)
    rejected = (100 * spans > limits.max_percent * n_words) | (top > limits.max_longest)
    return {
        "n_words": n_words,
        "word_chars": np.array([len(t) - sum(map(t.count, BLANKS)) for t in texts], np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([_repeated_lines(t) for t in texts], np.int64),
        "n_repeat_words": repeated,
        "longest_repeat": top,
        "covered_words": spans,
        "base_failed": base_failed,
        "kept": ~base_failed & ~rejected,
    }


def _repeated_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return len(lines) - len(set(lines))


def quality(df: DataFrame, text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """Every row with the columns of ADDED.

    NULL and empty texts have no words and fail the base rules. Repeated rows are judged
    alike. A text of any length is sorted whole. An input column named like an added one is
    replaced; the text column itself must not bear such a name.
    """
    df = without(df, *[field.split()[0] for field in ADDED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text_col, BLOCK_BYTES):
            found = measure(texts_of(piece, text_col), limits)
            yield pa.RecordBatch.from_arrays(
                [*piece.columns, *map(pa.array, found.values())], [*piece.schema.names, *found]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, {ADDED}")
