"""Column helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# everything that is neither an ASCII letter or digit nor a character beyond ASCII; upper case is gone by then
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z in lower case and all else as it was; null becomes empty.

    A text with as many bytes as characters is plain ASCII, where the fast ``lower`` does the same.
    """
    known = F.coalesce(text, F.lit(""))
    return F.when(F.length(known) == F.octet_length(known), F.lower(known)).otherwise(
        F.translate(known, _UPPER, _UPPER.lower())
    )


def plain_words(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and characters beyond ASCII, as an array."""
    return F.array_remove(F.split(lower_ascii(text), BETWEEN_WORDS), "")


def text_key(text: Column) -> Column:
    """A hash that tells the texts of rows with the same id apart; null and empty differ."""
    return F.xxhash64(F.isnull(text), text)


def held_out(doc_id: Column) -> Column:
    """Rows no model may learn from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
