"""Text normalisation and fingerprints as built-in column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The printable ASCII block sits at a fixed offset in the full-width forms block; the
# ideographic space is the full-width form of the blank.
HALF_WIDTH = " " + "".join(chr(c) for c in range(0x21, 0x7F))
FULL_WIDTH = "\u3000" + "".join(chr(ord(c) + 0xFEE0) for c in HALF_WIDTH[1:])
ANY_FULL_WIDTH = f"[{FULL_WIDTH[0]}{FULL_WIDTH[1]}-{FULL_WIDTH[-1]}]"

# Control characters, no-break space and the blank itself, one by one: the regular
# expression engine keeps such a class as a bit set.
BLANKS = "".join(f"\\x{c:02x}" for c in range(0x20)) + r"\xa0 "

# Runs of blanks other than a single plain blank, which is left alone.
UNEVEN_BLANKS = f"[{BLANKS}](?:(?<! )[{BLANKS}]*|[{BLANKS}]+)"
NOT_BLANK = f"[^{BLANKS}{FULL_WIDTH[0]}]"

# Below any blank, so it cannot occur in normalised text.
FIELD_SEPARATOR = "\u001f"


def squeeze(text: Column) -> Column:
    """Half-width characters, single blanks, no outer blanks; letter case is kept.

    ``translate`` looks up character by character, so text without full-width forms skips it.
    """
    half = F.when(text.rlike(ANY_FULL_WIDTH), F.translate(text, FULL_WIDTH, HALF_WIDTH)).otherwise(text)
    return F.trim(F.regexp_replace(half, UNEVEN_BLANKS, " "))


def normalize(text: Column) -> Column:
    """``squeeze`` in lower case: the form all matching is done on."""
    return F.lower(squeeze(text))


def is_filled(text: Column) -> Column:
    """True where the text has something other than blanks; never NULL."""
    return F.coalesce(text.rlike(NOT_BLANK), F.lit(False))


def fingerprint(columns: Iterable[Column]) -> Column:
    """md5 over the normalised columns.

    NULL counts as blank text: ``concat_ws`` drops NULLs, which would let values move
    between fields unnoticed.
    """
    parts = [F.coalesce(normalize(c.cast("string")), F.lit("")) for c in columns]
    return F.md5(F.concat_ws(FIELD_SEPARATOR, *parts))
