"""Column expressions from raw source text to lines, code text and sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Line terminators and the reference-format patterns.
LINE_BREAK = r"\r\n|[\n\r\u2028\u2029\u0085]"
FORMAT_INDICATOR = r"[ABCdD\t\-/*# ]"
COPYBOOK_INDICATOR = r"[ABCdD\t\-# ]"
FIXED_LINE = r"^.{6}([ABCdD\t\-/*# ].{65}.{8})?$"

# `\s` inside one line, spelled out so that a multi-line match cannot run into the next line
_BLANK = r"[ \t\x0B\f]*"


def _identification_lines(indicator: str) -> str:
    return rf"(?im)^(?:.{{6}}{indicator}{_BLANK}identification.*|{indicator}{_BLANK}identification.*)$"


def split_lines(text: Column) -> Column:
    """Array of lines; a closing line break does not open another line."""
    parts = F.split(text, LINE_BREAK)
    whole = F.size(parts)
    return F.when(
        F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(whole - 1, F.lit(0)))
    ).otherwise(parts)


def line_format(text: Column) -> Column:
    """FIXED, VARIABLE or TANDEM: the last line that decides wins, FIXED without one."""
    deciding = F.try_element_at(
        F.regexp_extract_all(text, F.lit(_identification_lines(FORMAT_INDICATOR)), F.lit(0)), F.lit(-1)
    )
    is_variable = deciding.rlike(rf"(?i)^.{{6}}{FORMAT_INDICATOR}\s*identification")
    return (
        F.when(is_variable & deciding.rlike(f"(?i){FIXED_LINE}"), "FIXED")
        .when(is_variable, "VARIABLE")
        .when(deciding.isNotNull(), "TANDEM")
        .otherwise("FIXED")
    )


def is_copybook(text: Column) -> Column:
    """True when no line is an identification header."""
    return ~text.rlike(_identification_lines(COPYBOOK_INDICATOR))


def normalize_line(raw: Column, fmt: Column) -> Column:
    """Split one raw line into its reference-format areas."""
    tandem = fmt == "TANDEM"
    fixed = fmt == "FIXED"
    indicator = F.when(tandem, F.substring(raw, 1, 1)).otherwise(F.substring(raw, 7, 1))
    code = (
        F.when(tandem, F.substring(raw, 2, 2**31 - 1))
        .when(fixed, F.substring(raw, 8, 65))
        .otherwise(F.substring(raw, 8, 2**31 - 1))
    )
    seq = F.when(tandem, F.lit("")).otherwise(F.substring(raw, 1, 6))
    return F.struct(
        seq.alias("seq"),
        indicator.alias("indicator"),
        code.alias("code"),
        indicator.isin("*", "/").alias("is_comment"),
    )


def with_code_text(df: DataFrame, text: str = "content", fmt: str = "fmt", out: str = "code") -> DataFrame:
    """Add program text without sequence area, tag area, comment lines and continuation marks.

    One column per step, so that each step's text is computed once.
    """
    tandem, fixed = F.col(fmt) == "TANDEM", F.col(fmt) == "FIXED"
    t = F.col(out)
    steps = [
        F.when(F.col(text).isNotNull(), F.regexp_replace(text, LINE_BREAK, "\n")),
        F.when(tandem, F.regexp_replace(t, r"(?m)^[*/].*\n?", "")).otherwise(
            F.regexp_replace(t, r"(?m)^.{6}[*/].*\n?", "")
        ),
        # a literal continued on the next line reaches to the end of the code area
        F.when(fixed & t.rlike(r"(?m)^.{6}-"), F.regexp_replace(t, r"(?m)$", " " * 65)).otherwise(t),
        F.when(tandem, t)
        .when(fixed, F.regexp_replace(t, r"(?m)^.{0,6}+(?:(.)(.{0,65}).*)?$", "$1$2"))
        .otherwise(F.regexp_replace(t, r"(?m)^.{0,6}+", "")),
        F.when(
            t.rlike(r"(?m)^-"), F.regexp_replace(F.regexp_replace(t, r"\n- *+[\"']", ""), r" *+\n- *+", "")
        ).otherwise(t),
        F.when(t.isNotNull(), F.regexp_replace(t, r"(?m)^[^\n]", " ")),
        F.when(F.contains(t, F.lit("*>")), F.regexp_replace(
            t, r"(?m)^((?:[^\"'*\n]|\"[^\"\n]*\"|'[^'\n]*'|\*(?!>))*+)\*>.*$", "$1"
        )).otherwise(t),
    ]
    for step in steps:
        df = df.withColumn(out, step)
    return df


# Runs of text up to a period that is followed by white space, with quoted text kept whole.
# The closing period is not part of the pattern on purpose: requiring it makes matching quadratic.
SENTENCE = r"""(?:[^.'"]++|"[^"\n]*+"|'[^'\n]*+'|\.(?!\s|$)|['"])++"""
TOKEN = r"""[XxNnGgBbZz]?"(?:[^"\n]|"")*+"|[XxNnGgBbZz]?'(?:[^'\n]|'')*+'|[^\s"']++|["']"""


def sentence_array(code: Column) -> Column:
    pieces = F.when(code != "", F.regexp_extract_all(code, F.lit(SENTENCE), F.lit(0)))
    # separators other than blanks at the ends carry no meaning
    return F.filter(F.transform(pieces, lambda s: F.regexp_replace(s, r"^[\s,;]+|[\s,;]+$", "")), lambda s: s != "")


def tokens(sentence: Column) -> Column:
    """Words and literals of a sentence; list commas and semicolons are dropped."""
    raw = F.regexp_extract_all(sentence, F.lit(TOKEN), F.lit(0))
    return F.filter(
        F.transform(raw, lambda t: F.when(t.endswith(",") | t.endswith(";"), F.regexp_replace(t, r"[,;]+$", "")).otherwise(t)),
        lambda t: t != "",
    )


def squeeze(sentence: Column) -> Column:
    """Sentence text with single blanks between words; literals keep theirs."""
    return F.array_join(tokens(sentence), " ")


def unquote(literal: Column) -> Column:
    """Content of a quoted literal; other text is returned as it is."""
    return F.coalesce(F.nullif(F.regexp_extract(literal, r"""^[XxNnGgBbZz]?(["'])(.*)\1$""", 2), F.lit("")), literal)
