"""CALL and COPY edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from copperline.functions import source_text as st
from copperline.operators import statements as stmts

_CALL_TARGET = r"""(?i)^CALL\s+("[^"]*"|'[^']*'|\S+)"""


def called_program(text: Column) -> Column:
    """Target of a CALL: the literal's content, or the identifier of a dynamic call."""
    target = F.regexp_extract(text, _CALL_TARGET, 1)
    return F.nullif(st.unquote(target), F.lit(""))


def is_dynamic_call(text: Column) -> Column:
    return ~F.regexp_extract(text, _CALL_TARGET, 1).rlike("^[\"']")


def call_statements(section_rows: DataFrame, scope: str = "all") -> DataFrame:
    """CALL statements with ``target`` and ``is_dynamic``.

    ``scope='flat'`` keeps those directly in the division or in a paragraph of a section.
    Only sentences with the word CALL reach the statement fold.
    """
    rows = stmts.statements(section_rows, r"(?i)(^|\s)CALL\s").where(F.col("verb") == "CALL")
    if scope == "flat":
        rows = rows.where((F.col("depth") == 0) & (
            (F.col("scope") == "division") | ((F.col("scope") == "paragraph") & F.col("section").isNotNull())
        ))
    return rows.select(
        "path", "program", "section", "paragraph", "sent_no", "stmt_no", "depth", "scope",
        called_program(F.col("text")).alias("target"), is_dynamic_call(F.col("text")).alias("is_dynamic"),
    )


def extract_calls(section_rows: DataFrame, scope: str = "all") -> DataFrame:
    """Distinct (source, target, rel_type) edges."""
    return call_statements(section_rows, scope).where(F.col("target").isNotNull()).select(
        F.col("program").alias("source"), "target", F.lit("CALLS").alias("rel_type")
    ).distinct()


COPY = r"""(?i)(?:^|\s)COPY\s+["']?([A-Z0-9][A-Z0-9_.#$@-]*?)["']?(?=\s|\.?$)"""


def extract_copies(sentence_rows: DataFrame) -> DataFrame:
    """Distinct COPY edges, one per program and copybook."""
    found = F.regexp_extract_all(
        F.regexp_replace("text", r"""(["'])[^"'\n]*\1(?!\s*$)""", "''"), F.lit(COPY), F.lit(1)
    )
    return sentence_rows.select(F.col("program").alias("source"), F.explode(found).alias("name")).select(
        "source", F.upper("name").alias("target"), F.lit("COPIES").alias("rel_type")
    ).distinct()
