"""Line dedup with a log-template tree (operator 5).

Lines are parsed by a tree of fixed depth: the number of tokens, then the LEADING first tokens.
Tokens that hold a digit are variable fields from the start (``<*>``) in lines that are words for
at least half; rows of numbers recur only as they are. In a leaf, lines that are
much alike fall under one template: places that hold many different tokens are variable fields
as well, in a large corpus as in a small one. Lines that do not fit go ROUNDS - 1 levels further
down, where the leaf is cut by the tokens of its most even place. A template found in enough
documents recurs, and its lines are dropped from all documents but the first.

Lines below ``min_tokens`` tokens have no template but themselves and recur as they are.

The tree is a set of keys, not a structure in memory: tokens are counted by group and place,
and each group's template, one row, is joined to its lines, one row for a line. A leaf with a
third of all lines is no more work for one task than others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillstrata.llm.common import forget, give_back, pieces, stored, texts_of, without
from skillstrata.llm.membership import bit_table, may_hold

FIELD = b"<*>"
LEADING = 3
ROUNDS = 3
PIECE_BYTES = 1 << 20  # of text at once: its tokens are many times as large in memory
_digit = re.compile(rb"\d")
_letter = re.compile(rb"[A-Za-z\x80-\xff]")
# Scripts written without blanks: Thai, Lao, Tibetan, Burmese, Khmer, Japanese, Chinese.
_scripts = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_unspaced = re.compile(f"[{_scripts}]")
_unspaced_tokens = re.compile(rf"[{_scripts}]|[^\x20\x09-\x0D{_scripts}]+")


@dataclass(frozen=True)
class Rules:
    """Lines under ``min_tokens`` tokens recur only as they are. A template with variable words needs
    ``min_fixed`` fixed tokens, ``min_fixed_percent`` of its tokens fixed, and, as sentences of one
    build are no boilerplate yet, a document more than ``min_docs`` for the square of its variable words."""

    min_docs: int = 3
    min_tokens: int = 3
    min_fixed: int = 5
    min_fixed_percent: int = 70


def masked(line: bytes) -> list[bytes]:
    """Tokens of a line, each character one in scripts without blanks, those with a digit as FIELD; where under half of them are words without a
    digit, as in rows of numbers, the tokens as they are."""
    tokens = line.split()
    if not line.isascii() and _unspaced.search(text := line.decode("utf-8", "surrogatepass")):
        tokens = [t.encode("utf-8", "surrogatepass") for t in _unspaced_tokens.findall(text)]
    if not _digit.search(line):
        return tokens
    fields = [FIELD if _digit.search(t) else t for t in tokens]
    return fields if 2 * sum(1 for t in fields if _letter.search(t)) >= len(fields) else tokens


def shape(line: bytes, rules: Rules) -> list[bytes]:
    """What a line recurs as: its masked tokens, or the plain ones of a short line."""
    tokens = masked(line)
    return tokens if len(tokens) >= rules.min_tokens else line.split()


def line_id(tokens: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(tokens))


def leaf_id(tokens: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join([b"%d" % len(tokens), *tokens[:LEADING]])) - (1 << 63)


def token_id(token: bytes) -> int:
    """A number for a token, odd for words that can be a template's fixed part."""
    number = xxhash.xxh3_64_intdigest(token) >> 2 << 1
    return number if token == FIELD or _digit.search(token) else number | 1


def _lines(docs: DataFrame, rules: Rules) -> DataFrame:
    """``(doc, digest, line, leaf)`` for each different line of a row; a short line has no leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", PIECE_BYTES):
            rows, ids, at = [], [], []
            for row, text in enumerate(texts_of(piece, "text")):
                seen = set()
                for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
                    tokens = shape(line, rules)
                    if tokens and (name := line_id(tokens)) not in seen:
                        seen.add(name)
                        rows.append(row)
                        ids.append(name)
                        at.append(leaf_id(tokens) if len(tokens) >= rules.min_tokens else None)
            taken = pa.array(rows, pa.int64())
            columns = {"doc": piece.column(0).take(taken), "digest": piece.column(1).take(taken)}
            yield pa.RecordBatch.from_pydict(columns | {"line": pa.array(ids, pa.binary()), "leaf": pa.array(at, pa.int64())})

    return docs.mapInArrow(run, f"doc {dict(docs.dtypes)['doc']}, digest long, line binary, leaf long")


def _tokens(docs: DataFrame, rules: Rules, leaves: Broadcast) -> DataFrame:
    """``(line, tokens)`` of lines whose leaf the bit table holds, each at least once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", PIECE_BYTES):
            lines: dict[bytes, list[bytes]] = {}
            for text in texts_of(piece, "text"):
                for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
                    tokens = masked(line)
                    if len(tokens) >= rules.min_tokens:
                        lines[line_id(tokens)] = tokens
            held = may_hold(leaves.value, np.fromiter(map(leaf_id, lines.values()), np.int64, len(lines)))
            names = [name for name, ok in zip(lines, held, strict=True) if ok]
            found = [list(map(token_id, lines[name])) for name in names]
            yield pa.RecordBatch.from_pydict({"line": pa.array(names, pa.binary()), "tokens": pa.array(found, pa.list_(pa.int64()))})

    return docs.select("text").mapInArrow(run, "line binary, tokens array<long>").groupBy("line").agg(F.first("tokens").alias("tokens"))


def recurring(docs: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """All lines ``(doc, digest, line, leaf)``, and ``(line, first)`` for those of recurring templates."""
    lines = stored(_lines(docs, rules), "lines")
    kinds = stored(lines.groupBy("line", "leaf").agg(F.count_distinct("doc").alias("n"), F.min("doc").alias("first")), "kinds")
    alone = kinds.where(F.col("n") >= rules.min_docs).select("line", "first")

    # Leaves in which several lines may have one template; all their lines, one row each.
    leaves = kinds.where("leaf is not null").groupBy("leaf").agg(F.sum("n").alias("docs"), F.count("*").alias("kinds"))
    leaves = stored(leaves.where((F.col("docs") > rules.min_docs) & (F.col("kinds") > 1)).select("leaf"), "leaves")
    table = docs.sparkSession.sparkContext.broadcast(bit_table(leaves, F.col("leaf")))
    several = kinds.join(leaves, "leaf", "left_semi").select("line", F.col("leaf").alias("group"), "n")
    shapes = _shapes(several.join(_tokens(docs, rules, table), "line"), rules)
    found = lines.join(shapes, "line").groupBy("template", "n_variable").agg(F.count_distinct("doc").alias("n"), F.min("doc").alias("first"))
    enough = F.col("n") >= rules.min_docs + F.col("n_variable") * F.col("n_variable")
    general = shapes.join(stored(found.where(enough).select("template", "first"), "templates"), "template").select("line", "first")
    known = stored(alone.unionByName(general).groupBy("line").agg(F.min("first").alias("first")), "recurring")
    forget(kinds, leaves, shapes)
    return lines, known


def _shapes(lines: DataFrame, rules: Rules) -> DataFrame:
    """``(line, template, n_variable)`` for the lines that have a template.

    A group begins as a leaf. Of each place its prevailing token is fixed, if at least half and
    ``min_docs`` have it; places without one, or with ``min_docs`` or more different tokens, are
    variable, however common each token is.
    Lines that differ from the fixed tokens in variable places alone, and in few enough, are the
    group's template. The rest is searched again; a group without such lines is first cut by the
    tokens of its most even place.
    """
    found, left = [], stored(lines, "group")
    for depth in range(ROUNDS):
        values = left.select("group", "n", F.posexplode("tokens").alias("at", "token")).groupBy("group", "at", "token").agg(F.sum("n").alias("docs"))
        docs = F.col("docs").cast("double")
        places = values.groupBy("group", "at").agg(
            F.count("*").alias("values"), F.sum("docs").alias("total"), F.max(F.struct("docs", "token")).alias("top"), F.sum(docs * docs).alias("even")
        )
        prevailing = F.when((F.col("top.docs") >= rules.min_docs) & (2 * F.col("top.docs") >= F.col("total")), F.col("top.token"))
        place = F.struct("at", prevailing.alias("fixed"), (prevailing.isNotNull() & (F.col("values") < rules.min_docs)).alias("closed"))
        even = F.max(F.when(F.col("values") > 1, F.struct("even", (-F.col("at")).alias("back"))))
        templates = places.groupBy("group").agg(F.sort_array(F.collect_list(place)).alias("places"), (-even["back"]).alias("cut_at"))
        same = F.zip_with("tokens", "places", lambda t, p: F.struct(t.alias("token"), F.coalesce(t == p["fixed"], F.lit(False)).alias("same"), p["closed"].alias("closed")))
        judged = left.join(templates, "group").withColumn("same", same)
        n_fixed = F.size(F.filter("same", lambda x: x["same"] & (x["token"].bitwiseAND(1) == 1)))
        n_other = F.size(F.filter("same", lambda x: ~x["same"] & x["closed"]))
        # Variable words of the template: places that are not fixed, but for those that are fields already.
        n_variable = F.size(F.filter("same", lambda x: ~x["same"] & (x["token"].bitwiseAND(1) == 1)))
        fits = (n_other == 0) & (n_fixed >= rules.min_fixed) & (100 * n_fixed >= rules.min_fixed_percent * F.size("tokens"))
        judged = stored(judged.select("line", "n", "tokens", "group", "cut_at", n_variable.alias("n_variable"), fits.alias("fits")), "judged")
        forget(left)
        served = judged.where("fits").groupBy("group").agg(F.max("n_variable").alias("n_variable"))
        own = judged.where("fits").select("line", "group").join(served, "group")
        found.append(stored(own.select("line", F.col("group").alias("template"), "n_variable"), "shapes"))
        if depth < ROUNDS - 1:
            rest = judged.where("not fits").join(served.select("group", F.lit(True).alias("served")), "group", "left")
            cut = F.when(F.col("served"), F.xxhash64("group", F.lit("rest"))).otherwise(F.xxhash64("group", F.get("tokens", "cut_at"), "cut_at"))
            rest = rest.select("line", "n", "tokens", cut.alias("group"))
            sizes = rest.groupBy("group").agg(F.sum("n").alias("docs"), F.count("*").alias("kinds"))
            open_ = sizes.where((F.col("docs") > rules.min_docs) & (F.col("kinds") > 1)).select("group")
            left = stored(rest.join(open_, "group", "left_semi"), "group")
        forget(judged)
    return stored(reduce(DataFrame.unionByName, found), "shapes")


def drop_templates(df: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with ``text_col`` less its lines of recurring templates, and ``n_lines``, ``n_dropped``.

    The document with the smallest id keeps a template's lines; rows with one id count as one
    document, and rows without an id count for no template but lose recurring lines. Kept
    lines stay as they were, in order. NULL texts stay NULL with no lines; an empty text has
    one empty line, and lines without a word never go. Input columns named ``n_lines``,
    ``n_dropped``, ``_doc``, ``_digest`` or ``_gone`` are replaced. An empty table gives an empty one.
    """
    df = without(df, "n_lines", "n_dropped", "_doc", "_digest", "_gone")
    docs = df.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    lines, known = recurring(docs, rules)
    gone = lines.join(known, "line").where(~F.col("doc").eqNullSafe(F.col("first")))
    # A row's own lines alone: rows that share an id, or have none, are told apart by their texts.
    gone = gone.groupBy(F.col("doc").alias("_doc"), F.col("digest").alias("_digest"))
    gone = stored(gone.agg(F.collect_set("line").alias("_gone")), "gone")
    forget(lines, known)
    # Only rows that may lose lines move to meet the list of them.
    table = df.sparkSession.sparkContext.broadcast(bit_table(gone, F.xxhash64("_doc", "_digest")))
    key = F.xxhash64(F.col(id_col), F.xxhash64(text_col))
    same = F.col(id_col).eqNullSafe(F.col("_doc")) & (F.xxhash64(text_col) == F.col("_digest"))
    losing = _filtered(df, key, table, True).join(gone, same, "left").drop("_doc", "_digest")
    breaks = F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit("")))
    whole = _filtered(df, key, table, False).withColumns(
        {"n_lines": F.coalesce(breaks + 1, F.lit(0)).cast("long"), "n_dropped": F.lit(0).cast("long")}
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text_col, PIECE_BYTES):
            texts, n_lines, n_dropped = [], [], []
            given = piece.column(piece.schema.get_field_index(text_col))
            for text, drop in zip(given.to_pylist(), piece.column(piece.schema.get_field_index("_gone")).to_pylist(), strict=True):
                all_lines = [] if text is None else text.split("\n")
                kept, drop = all_lines, set(drop or ())
                if drop:
                    kept = [line for line in all_lines if not (tokens := shape(line.encode("utf-8", "surrogatepass"), rules)) or line_id(tokens) not in drop]
                texts.append(None if text is None else "\n".join(kept))
                n_lines.append(len(all_lines))
                n_dropped.append(len(all_lines) - len(kept))
            columns = dict(zip(piece.schema.names, piece.columns, strict=True))
            columns.pop("_gone")
            columns |= {text_col: pa.array(texts, pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
            yield pa.RecordBatch.from_pydict(columns)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return losing.mapInArrow(run, f"{kinds}, n_lines long, n_dropped long").unionByName(whole)


def _filtered(df: DataFrame, key: Column, table: Broadcast, held: bool) -> DataFrame:
    """Rows whose hashed key the bit table holds, or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("_gone")
            kept = batch.filter(pa.array(may_hold(table.value, batch.column(at).to_numpy()) == held))
            yield kept.drop_columns(["_gone"])
            give_back()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.withColumn("_gone", key).mapInArrow(run, kinds)


def has_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
