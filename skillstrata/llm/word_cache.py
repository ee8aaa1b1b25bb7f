"""Encoding with the tokenizers library, word by word, each distinct word of a batch once."""

from __future__ import annotations

from collections import defaultdict
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from skillstrata.llm.bpe import gather

KEPT_UNITS = 1 << 19  # remembered before starting anew; memory only, never results
# Letters that have one lower-case letter each, and punctuation behind them.
PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<rest>[.,;:!?|#*$%&()]*)$"


class WordCache:
    """Ids of texts for tokenizers that drop white space and cut words at it.

    Such a tokenizer gives a text the ids of its words between blanks and line feeds, one
    after another. One that lower-cases and cuts between letters and punctuation as well gives
    a plain word the ids of its lower-case letters and those of its punctuation. Both are probed
    on the tokenizer itself; where it is not so, words or whole texts go through the library.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.by_word, self.by_unit = self._splits_at_blanks(), self._splits_punctuation()
        self._forget()

    def _forget(self) -> None:
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.ids, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _splits_at_blanks(self) -> bool:
        words = ["a", "Ab", "it's", "12", "é", "é", "́", "-", "'s", "<|x|>", "ß", "中"]
        alone = [i for w in words for i in self._encode([w])[0]]
        return all(self._encode([blank.join(words)])[0] == alone for blank in (" ", "\n", "  \n "))

    def _splits_punctuation(self) -> bool:
        samples = ("a.", "Word,", "ÉTÉ;:", "Straße!?", "ÿ|", "iN#*", "s$%", "T&", "re(", "ll)", "D", "ÀÿÖ...")
        units = _units(pa.array(samples)).to_pylist()
        cut = zip(units[: len(samples)], units[len(samples) :], strict=True)
        return all(self._encode([w])[0] == self._encode([a])[0] + self._encode([b])[0] for w, (a, b) in zip(samples, cut, strict=True))

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each. NULL counts as empty."""
        texts = (pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string())).fill_null("")
        if not self.by_word:
            return _flat(self._encode(texts.to_pylist()))
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        met = split.flatten().dictionary_encode()
        return _joined(*self._words(met.dictionary), met.indices.to_numpy(), split.value_lengths().to_numpy())

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after another, and the number of ids of each."""
        if len(self.number) > KEPT_UNITS:
            self._forget()
        met = (_units(words) if self.by_unit else words).dictionary_encode()
        number = np.fromiter(map(self.number.__getitem__, met.dictionary.to_pylist()), np.int64, len(met.dictionary))
        if new := list(islice(self.number, len(self.sizes), None)):
            ids, sizes = _flat(self._encode(new))
            self.ids, self.sizes = np.r_[self.ids, ids], np.r_[self.sizes, sizes]
        parts = number[met.indices.to_numpy()].reshape(-1, len(words)).T  # of each word, one or two units
        return _joined(self.ids, self.sizes, parts.ravel(), np.full(len(words), parts.shape[1]))


def _units(words: pa.Array) -> pa.Array:
    """First the lower-case letters of each plain word and other words whole, then the punctuation behind each."""
    cut = pc.extract_regex(words, PLAIN)
    whole = pc.is_null(cut)
    letters, rest = pc.struct_field(cut, "letters"), pc.struct_field(cut, "rest")
    return pa.concat_arrays([pc.if_else(whole, words, pc.utf8_lower(letters)), pc.if_else(whole, "", rest)])


def _joined(ids: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of runs of numbered strings: all ids, and how many each run has. ``lengths`` are the strings of each run."""
    starts, sizes = (np.cumsum(sizes) - sizes)[numbers], sizes[numbers]
    ends, bounds = np.r_[0, np.cumsum(sizes)], np.r_[0, np.cumsum(lengths)]
    return gather(ids, starts, sizes), ends[bounds[1:]] - ends[bounds[:-1]]


def _flat(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(ids) for ids in found], np.int64)
    return np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes
