"""License scans by conditional compression (operator 3).

A block of text that repeats a license template compresses far better when the template is
given as a zstandard raw dictionary. Candidate blocks are cut around marker words, as long as
the template would be there; each is compressed with every template, and templates are ranked
by how much they save. A winner is confirmed by the words in which block and template differ.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from skillstrata.llm.common import pieces, texts_of

# Wording of common license notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
)

PIECE_BYTES = 8 << 20
LEVEL = 3
_word = re.compile(r"[^\x20\x09-\x0D]+")
_edge = re.compile(r"^\W+|\W+$")


@dataclass(frozen=True)
class Rules:
    """A word is a marker if it begins with one of ``markers``. The winner must save ``min_saving``
    percent of a block's compressed size, and ``max_differ`` percent of the template's words may differ."""

    markers: tuple[str, ...] = ("licen", "copyright", "reserved", "permission", "redistribut", "unencumbered")
    min_saving: int = 20
    max_differ: int = 20
    exact_below: int = 8  # a shorter template must stand there word for word


@dataclass(frozen=True)
class Hit:
    license: str
    start: int
    end: int
    saving: int
    missing: tuple[str, ...]
    added: tuple[str, ...]


def plain(word: str) -> str:
    """A word without case and without punctuation at its edges."""
    return _edge.sub("", word).casefold()


class Template:
    def __init__(self, name: str, text: str, rules: Rules) -> None:
        self.name = name
        self.words = [plain(w) for w in _word.findall(text)]
        self.markers = [(w, k) for k, w in enumerate(self.words) if w.startswith(rules.markers)]
        raw = zstandard.ZstdCompressionDict(" ".join(self.words).encode().rjust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...], rules: Rules) -> None:
        self.rules = rules
        self.templates = [Template(name, text, rules) for name, text in templates]
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
        self.marked = re.compile("|".join(map(re.escape, rules.markers)), re.IGNORECASE)

    def hits(self, text: str) -> list[Hit]:
        """Confirmed licenses of a text, by place; where blocks overlap, the one that saves most."""
        if not self.marked.search(text):
            return []
        words = [plain(w) for w in _word.findall(text)]
        found = []
        for at, word in enumerate(words):
            if word.startswith(self.rules.markers):
                found += self._at(words, at, word)
        taken: list[Hit] = []
        for hit in sorted(set(found), key=lambda h: (len(h.missing) + len(h.added) > 0, h.start - h.end, -h.saving, h.license)):
            if all(hit.end <= other.start or other.end <= hit.start for other in taken):
                taken.append(hit)
        return sorted(taken, key=lambda h: h.start)

    def _at(self, words: list[str], at: int, word: str) -> list[Hit]:
        """The best confirmed template around the marker at a place."""
        blocks = {
            (max(0, at - k), min(len(words), at - k + len(t.words))) for t in self.templates for marker, k in t.markers if marker == word
        }
        ranked = []
        for start, end in blocks:
            block = " ".join(words[start:end]).encode()
            alone = len(self.plain.compress(block))
            for t in self.templates:
                saving = 100 * (alone - len(t.compressor.compress(block))) // alone
                if saving >= self.rules.min_saving:
                    ranked.append((saving, end - start, t.name, t, start, end))
        for saving, _, _, t, start, end in sorted(ranked, key=lambda r: (-r[0], -r[1], r[2])):
            if hit := self._confirmed(t, words, start, end, saving):
                return [hit]
        return []

    def _confirmed(self, t: Template, words: list[str], start: int, end: int, saving: int) -> Hit | None:
        """The exact differences of wording, if they are few: words of the template that are missing, words added."""
        spare = len(t.words) * self.rules.max_differ // 100
        block = words[start : min(len(words), end + spare)]
        steps = SequenceMatcher(None, t.words, block, autojunk=False).get_opcodes()
        same = [s for s in steps if s[0] == "equal"]
        if not same:
            return None
        first, last = same[0][3], same[-1][4]
        missing = [w for tag, a, b, _, _ in steps if tag != "equal" for w in t.words[a:b]]
        added = [w for tag, _, _, a, b in steps if tag != "equal" for w in block[max(a, first) : min(b, last)]]
        allowed = 0 if len(t.words) < self.rules.exact_below else spare
        if max(len(missing), len(added)) > allowed:
            return None
        return Hit(t.name, start + first, start + last, saving, tuple(missing), tuple(added))


FIELDS = "license string, start long, end long, saving long, missing array<string>, added array<string>"


def scan(df: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each license found: id, ``license``, words ``start`` to ``end`` of the whole text, percent saved, differing words.

    NULL and empty texts have none. Repeated rows give repeated results. Of a text only the
    blocks around markers are compressed, however long it is. Only the two columns named are
    read. Templates without a marker word are never found.
    """
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, rules)
        for piece in pieces(batches, text_col, PIECE_BYTES):
            found = [(row, hit) for row, text in enumerate(texts_of(piece, text_col)) for hit in scanner.hits(text)]
            column = lambda name, kind: pa.array([getattr(h, name) for _, h in found], kind)
            words = pa.list_(pa.string())
            yield pa.RecordBatch.from_pydict(
                {
                    id_col: piece.column(0).take(pa.array([row for row, _ in found], pa.int64())),
                    "license": column("license", pa.string()),
                    **{name: column(name, pa.int64()) for name in ("start", "end", "saving")},
                    **{name: column(name, words) for name in ("missing", "added")},
                }
            )

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {FIELDS}")
