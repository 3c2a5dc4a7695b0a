"""Types and lengths of PICTURE strings as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The picture forms that have a type. Digits are a run of nines or 9(n).
DIGITS = r"(9+|9\([0-9]+\))"
NUMERIC = rf"^(S?){DIGITS}(?:V{DIGITS})?$"
POINTED = r"^(9+)[^V](9+)$"
TEXT = r"^(X+|A+|[XA]\([0-9]+\))$"


def _part(pic: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(pic, pattern, group)


def _size(part: Column) -> Column:
    """Places of `9(n)`, `X(n)` or of a run of the letter."""
    return F.when(F.endswith(part, F.lit(")")), F.regexp_extract(part, r"\(([0-9]+)\)", 1).try_cast("int")).otherwise(
        F.length(part)
    )


def _shape(pic: Column) -> Column:
    """Form of a picture: WHOLE, DECIMAL, POINTED or TEXT."""
    return (
        F.when(pic.rlike(NUMERIC), F.when(F.contains(pic, F.lit("V")), "DECIMAL").otherwise("WHOLE"))
        .when(pic.rlike(POINTED), "POINTED")
        .when(pic.rlike(TEXT), "TEXT")
    )


def pic_type(pic: Column) -> Column:
    """INTEGER, FLOAT, STRING or null for forms without a type."""
    shape = _shape(pic)
    return F.when(shape == "WHOLE", "INTEGER").when(shape == "TEXT", "STRING").when(shape.isNotNull(), "FLOAT")


def pic_integer_len(pic: Column, compat: bool = True) -> Column:
    """Digits ahead of the decimal point.

    With ``compat`` the sign of ``S99`` counts as a digit and signed decimals have no
    length; without it only digits count and signed decimals are measured too.
    """
    shape, signed = _shape(pic), F.startswith(pic, F.lit("S"))
    size = _size(_part(pic, NUMERIC, 2))
    if compat:
        whole = size + F.when(signed & ~F.endswith(pic, F.lit(")")), 1).otherwise(0)
        decimal = F.when(~signed, size)
    else:
        whole = decimal = size
    return (
        F.when(shape == "WHOLE", whole).when(shape == "DECIMAL", decimal)
        .when(shape == "POINTED", F.length(_part(pic, POINTED, 1)))
    )


def pic_fraction_len(pic: Column, compat: bool = True) -> Column:
    """Digits behind the decimal point, 0 for whole numbers."""
    shape, size = _shape(pic), _size(_part(pic, NUMERIC, 3))
    decimal = F.when(~F.startswith(pic, F.lit("S")), size) if compat else size
    return (
        F.when(shape == "WHOLE", 0).when(shape == "DECIMAL", decimal)
        .when(shape == "POINTED", F.length(_part(pic, POINTED, 2)))
    )


def pic_string_len(pic: Column) -> Column:
    """Characters of an alphabetic or alphanumeric picture."""
    return F.when(pic.rlike(TEXT), _size(pic))


def pic_length(pic: Column) -> Column:
    """Total length: sign and point count one each, except in the 9(n)V9(m) form."""
    shape = _shape(pic)
    both_counted = pic.rlike(r"^9\([0-9]+\)V9\([0-9]+\)$")
    return (
        F.when(shape == "WHOLE", pic_integer_len(pic) + F.when(F.startswith(pic, F.lit("S")), 1).otherwise(0))
        .when(shape == "TEXT", pic_string_len(pic))
        .when(both_counted, pic_integer_len(pic) + pic_fraction_len(pic))
        .otherwise(pic_integer_len(pic) + 1 + pic_fraction_len(pic))
    )


def max_occurs(occurs_from: Column, occurs_to: Column) -> Column:
    """Largest repetition of an item, at least 1."""
    return F.greatest(F.lit(1), F.coalesce(occurs_from, F.lit(0)), F.coalesce(occurs_to, F.lit(0)))
