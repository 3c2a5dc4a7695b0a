"""Values, comparisons and arithmetic with the rules of the source language, as columns.

A value is a struct ``kind, b, d, s`` with kind BOOLEAN, DECIMAL, STRING, HIGH or LOW.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from copperline import schemas
from copperline.functions import pictures
from copperline.functions.arrays import let

DEC = "decimal(38,10)"


def _value(kind: str, b: Column | None = None, d: Column | None = None, s: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(kind).alias("kind"),
        (none if b is None else b).cast("boolean").alias("b"),
        (none if d is None else d).cast(DEC).alias("d"),
        (none if s is None else s).cast("string").alias("s"),
    ).cast(schemas.VALUE)


def boolean_value(col: Column) -> Column:
    return F.when(col.isNotNull(), _value("BOOLEAN", b=col))


def decimal_value(col: Column) -> Column:
    return F.when(col.isNotNull(), _value("DECIMAL", d=col))


def string_value(col: Column) -> Column:
    return F.when(col.isNotNull(), _value("STRING", s=col))


def high_value() -> Column:
    return _value("HIGH")


def low_value() -> Column:
    return _value("LOW")


# Literals. The first literal of a VALUE clause counts; a THRU range has no single value.
_QUOTED = r"""^[XxNnGgBbZz]?("(?:[^"]|"")*"|'(?:[^']|'')*')"""
_NUMBER = r"^[+-]?[0-9]*[.,]?[0-9]+$"


def first_literal(raw: Column) -> Column:
    """First literal or word of a VALUE clause."""
    quoted = F.regexp_extract(raw, _QUOTED, 0)
    return F.when(quoted != "", quoted).otherwise(F.nullif(F.regexp_extract(raw, r"^([^\s]+)", 1), F.lit("")))


def literal_type(raw: Column) -> Column:
    """BOOLEAN, INTEGER, FLOAT or STRING; null for HIGH/LOW-VALUES, NULL, QUOTE and ALL."""
    up = F.upper(raw)
    return (
        F.when(raw.rlike(_QUOTED), "STRING")
        .when(up.isin("TRUE", "FALSE"), "BOOLEAN")
        .when(up.isin("SPACE", "SPACES"), "STRING")
        .when(up.isin("ZERO", "ZEROS", "ZEROES"), "INTEGER")
        .when(raw.rlike(r"^[+-]?[0-9]+$"), "INTEGER")
        .when(raw.rlike(_NUMBER), "FLOAT")
    )


def literal_value(raw: Column) -> Column:
    """The literal as a value; null where it has none."""
    up = F.upper(raw)
    body = F.regexp_extract(raw, r"""^[XxNnGgBbZz]?(["'])([\s\S]*)\1""", 2)
    number = F.replace(raw, F.lit(","), F.lit(".")).try_cast(DEC)
    return (
        F.when(raw.rlike(_QUOTED), string_value(body))
        .when(up == "TRUE", boolean_value(F.lit(True)))
        .when(up == "FALSE", boolean_value(F.lit(False)))
        .when(up.isin("SPACE", "SPACES"), string_value(F.lit(" ")))
        .when(up.isin("ZERO", "ZEROS", "ZEROES"), decimal_value(F.lit(0)))
        .when(up.isin("HIGH-VALUE", "HIGH-VALUES"), high_value())
        .when(up.isin("LOW-VALUE", "LOW-VALUES"), low_value())
        .when(raw.rlike(_NUMBER), decimal_value(number))
    )


def value_clause(raw: Column) -> Column:
    """Value of a VALUE clause: its first literal, null for a THRU range in first place."""
    def of(first: Column) -> Column:
        rest = F.ltrim(F.substr(raw, F.length(first) + 1))
        return F.when(~rest.rlike(r"(?i)^(THRU|THROUGH)\b"), literal_value(first))

    return let(first_literal(raw), of)


def item_type(pic: Column, value_raw: Column, has_children: Column) -> Column:
    """Type of a data item: its picture decides, then its VALUE, then its children."""
    return (
        F.when(pic.isNotNull(), pictures.pic_type(pic))
        .when(value_raw.isNotNull(), literal_type(first_literal(value_raw)))
        .when(has_children, "GROUP")
    )


def initial_value(pic: Column, value_raw: Column, has_children: Column) -> Column:
    """Value at program start: VALUE, else false, 0 or blanks; strings fill the picture."""
    def of_kind(kind: Column) -> Column:
        return (
            F.when(kind == "BOOLEAN", F.coalesce(value_clause(value_raw), boolean_value(F.lit(False))))
            .when(kind.isin("INTEGER", "FLOAT"), F.coalesce(value_clause(value_raw), decimal_value(F.lit(0))))
            .when(kind == "STRING", string_value(let(value_clause(value_raw), padded)))
        )

    def padded(given: Column) -> Column:
        # only a string literal has text of its own; a longer one keeps its length
        text = F.when(given["kind"] == "STRING", given["s"]).otherwise("")
        width = F.coalesce(pictures.pic_string_len(pic), F.lit(0))
        return F.concat(text, F.repeat(F.lit(" "), F.greatest(width - F.length(text), F.lit(0))))

    return let(item_type(pic, value_raw, has_children), of_kind)


def plain_decimal(d: Column) -> Column:
    """Decimal text without exponent and without closing zeros."""
    text = d.cast("string")
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def as_string(value: Column, comma: bool | Column = False) -> Column:
    """Text of a value; "1"/"0" for booleans, empty for null, HIGH and LOW. ``comma`` writes a decimal comma."""
    number = plain_decimal(value["d"])
    with_comma = F.replace(number, F.lit("."), F.lit(","))
    number = F.when(comma, with_comma).otherwise(number) if isinstance(comma, Column) else with_comma if comma else number
    return (
        F.when(value["kind"] == "STRING", value["s"])
        .when(value["kind"] == "DECIMAL", number)
        .when(value["kind"] == "BOOLEAN", F.when(value["b"], "1").otherwise("0"))
        .otherwise("")
    )


def as_decimal(value: Column) -> Column:
    """Number of a value: a string is parsed, anything else counts as 0. Text that is no number gives null."""
    return (
        F.when(value["kind"] == "DECIMAL", value["d"])
        .when(value["kind"] == "STRING", F.trim(value["s"]).try_cast(DEC))
        .otherwise(F.lit(0).cast(DEC))
    )


# Comparisons.

def cobol_compare(left: Column, right: Column) -> Column:
    """-1, 0 or 1: booleans and decimals among themselves, all else as text without closing blanks."""
    def order(a: Column, b: Column) -> Column:
        return F.when(a < b, -1).when(a > b, 1).otherwise(0)

    both = lambda kind: (left["kind"] == kind) & (right["kind"] == kind)
    text = [F.rtrim(as_string(v), F.lit(" \t\n\r\f\x0b")) for v in (left, right)]
    return (
        F.when(both("BOOLEAN"), order(left["b"], right["b"]))
        .when(both("DECIMAL"), order(left["d"], right["d"]))
        .otherwise(order(*text))
    )


def relations(df: DataFrame, left: Column, right: Column) -> DataFrame:
    """Add eq, ne, gt, ge, lt and le of two values, comparing them once per row."""
    bound = df.withColumn("_l", left).withColumn("_r", right)
    l, r = F.col("_l"), F.col("_r")
    compared = bound.withColumn("_c", F.when(l.isNotNull() & r.isNotNull(), cobol_compare(l, r)))
    c = F.col("_c")
    marks = F.col("_l.kind").isin("HIGH", "LOW"), F.col("_r.kind").isin("HIGH", "LOW")
    same_kind = F.col("_l.kind") == F.col("_r.kind")
    return compared.withColumns({
        "eq": F.when(marks[0] & marks[1] & c.isNotNull(), same_kind).otherwise(c == 0),
        "ne": F.when((marks[0] | marks[1]) & c.isNotNull(), ~same_kind).otherwise(c != 0),
        "gt": c > 0, "ge": c >= 0, "lt": c < 0, "le": c <= 0,
    }).drop("_l", "_r", "_c")


def equal(left: Column, right: Column) -> Column:
    l_mark, r_mark = left["kind"].isin("HIGH", "LOW"), right["kind"].isin("HIGH", "LOW")
    known = left.isNotNull() & right.isNotNull()
    return F.when(known & l_mark & r_mark, left["kind"] == right["kind"]).when(known, cobol_compare(left, right) == 0)


def not_equal(left: Column, right: Column) -> Column:
    l_mark, r_mark = left["kind"].isin("HIGH", "LOW"), right["kind"].isin("HIGH", "LOW")
    known = left.isNotNull() & right.isNotNull()
    return F.when(known & (l_mark | r_mark), left["kind"] != right["kind"]).when(known, cobol_compare(left, right) != 0)


def _ordered(test: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    def compare(left: Column, right: Column) -> Column:
        return F.when(left.isNotNull() & right.isNotNull(), test(cobol_compare(left, right)))

    return compare


greater = _ordered(lambda c: c > 0)
greater_or_equal = _ordered(lambda c: c >= 0)
less = _ordered(lambda c: c < 0)
less_or_equal = _ordered(lambda c: c <= 0)

RELATIONS: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
}


def sign_condition(col: Column, sign: str, not_: bool = False) -> Column:
    """Test for POSITIVE, NEGATIVE or ZERO; a null number gives null."""
    s = F.signum(col)
    held = {"POSITIVE": s > 0, "NEGATIVE": s < 0, "ZERO": s == 0}[sign]
    return ~held if not_ else held


def combined_comparison(col: Column, op: str, values: Column, how: str, not_: bool = False) -> Column:
    """``col op (v1 AND v2 ...)`` or with OR; unknown when the number or any value is unknown."""
    relation = RELATIONS[op]
    unknown = col.isNull() | values.isNull() | (F.size(values) == 0) | F.exists(values, lambda v: v.isNull())

    def test(v: Column) -> Column:
        held = F.coalesce(relation(col, v), F.lit(False))
        return ~held if not_ else held

    folded = F.forall(values, test) if how == "AND" else F.exists(values, test)
    return F.when(~unknown, folded)


def condition_chain(first: Column, rest: Column | list[tuple[str, Column]], first_not: bool = False) -> Column:
    """Left-to-right AND/OR without precedence.

    ``rest`` is a list of ``(op, operand)``, or for chains that differ by row an array column of
    structs ``op`` and ``v``. One unknown operand makes the whole chain unknown, also where the
    rest would decide it.
    """
    start = ~first if first_not else first
    if isinstance(rest, list):
        held, known = start, start.isNotNull()
        for op, operand in rest:
            held = (held & operand) if op == "AND" else (held | operand)
            known = known & operand.isNotNull()
        return F.when(known, held)
    folded = F.aggregate(
        rest, F.struct(start.alias("v"), start.isNotNull().alias("known")),
        lambda acc, x: F.struct(
            F.when(x["op"] == "AND", acc["v"] & x["v"]).otherwise(acc["v"] | x["v"]).alias("v"),
            (acc["known"] & x["v"].isNotNull()).alias("known"),
        ),
    )
    return let(folded, lambda f: F.when(f["known"], f["v"]))


def is_blank(text: Column) -> Column:
    return F.trim(text) == ""


def group_is_blank(leaves: list[Column]) -> Column:
    """A group compares equal to SPACES when all its leaves are blank."""
    return F.forall(F.array(*[leaf.cast("string") for leaf in leaves]), is_blank)


# Arithmetic. Results are DECIMAL(38,10), exact to the last place; a result that does not fit is
# unknown, and so is every result of an unknown operand. The types of the intermediate steps are
# chosen so that Spark's rule for decimal types keeps all ten places.

_TERM, _FACTOR = "decimal(37,10)", "decimal(28,10)"


def number(col: Column) -> Column:
    return col.cast(DEC)


def add(a: Column, b: Column) -> Column:
    return F.try_add(a.try_cast(_TERM), b.try_cast(_TERM)).try_cast(DEC)


def subtract(a: Column, b: Column) -> Column:
    return F.try_subtract(a.try_cast(_TERM), b.try_cast(_TERM)).try_cast(DEC)


def multiply(a: Column, b: Column) -> Column:
    """Operands keep the precision of their own types, as their pictures give them."""
    return F.try_multiply(a, b).try_cast(DEC)


def divide(a: Column, b: Column) -> Column:
    """Division by zero leaves the dividend as it is."""
    divisor = b.try_cast(_FACTOR)
    quotient = F.try_divide(a.try_cast(_FACTOR), divisor).try_cast(DEC)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast(DEC)).when(divisor == 0, a.try_cast(DEC)).otherwise(quotient)


def power(base: Column, exponent: Column) -> Column:
    """Power through double precision. A unary minus belongs to the base: -2 ** 2 is 4."""
    return F.pow(base.cast("double"), exponent.cast("double")).try_cast(DEC)


def condition_name_holds(parent_value: Column, value_raw: Column) -> Column:
    """A level 88 name holds when its item has the first VALUE; ranges are unknown."""
    def same(wanted: Column) -> Column:
        equal_parts = (
            (parent_value["kind"] == wanted["kind"])
            & (parent_value["b"].eqNullSafe(wanted["b"]))
            & (parent_value["d"].eqNullSafe(wanted["d"]))
            & (F.rtrim(F.coalesce(parent_value["s"], F.lit(""))) == F.rtrim(F.coalesce(wanted["s"], F.lit(""))))
        )
        return F.when(parent_value.isNotNull() & wanted.isNotNull(), equal_parts)

    return let(value_clause(value_raw), same)


# Special registers and the relation words that make an expression a condition.
INTEGER_REGISTERS = r"(?i)^(LENGTH\s+OF\b.*|ADDRESS\s+OF\b.*|LINAGE-COUNTER|LINE-COUNTER|PAGE-COUNTER|SORT-FILE-SIZE)"
CONDITION_WORDS = (
    r"(?i)(^|\s)(=|<>|>=|<=|>|<|EQUAL|EQUALS|GREATER|LESS|NOT|AND|OR|POSITIVE|NEGATIVE|NUMERIC|ALPHABETIC)(\s|$)"
)


def expression_type(text: Column, first_operand_type: Column | None = None) -> Column:
    """Type of an expression: conditions are BOOLEAN, else its first operand decides.

    ``first_operand_type`` is the type of the data item named first, from a join with the items.
    """
    bare = F.regexp_replace(text, r"""(["'])[^"']*\1""", "''")
    word = F.regexp_extract(F.trim(text), r"""^(-?\(*)?("[^"]*"|'[^']*'|[^\s()]+)""", 2)
    base = (
        F.when(bare.rlike(CONDITION_WORDS), "BOOLEAN")
        .when(F.trim(text).rlike(INTEGER_REGISTERS), "INTEGER")
        .otherwise(literal_type(word))
    )
    return base if first_operand_type is None else F.coalesce(base, first_operand_type)
