"""From sources to units, divisions, sections, paragraphs and sentences.

Everything here is row-local: a file's sentences are an array, and each level cuts that
array at its headers. No window and no shuffle is needed to carry the enclosing
division, section and paragraph down to a sentence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from copperline.functions import naming, source_text as st
from copperline.functions.arrays import built_once, explode_slices, let, slice_array

# Division names and the one-word imperatives that are no paragraph headers.
DIVISION_HEADER = r"(?i)^(IDENTIFICATION|ID|ENVIRONMENT|DATA|PROCEDURE)\s+DIVISION\b"
UNIT_HEADER = r"(?i)^(IDENTIFICATION|ID)\s+DIVISION$"
SECTION_HEADER = r"(?i)^([A-Z0-9][A-Z0-9_-]*)\s+SECTION(\s+\d+)?$"
ONE_WORD_IMPERATIVES = r"(?i)^(EXIT|GOBACK|CONTINUE|DECLARATIVES|SUPPRESS|EJECT|SKIP[123]|ELSE|OTHER|END-[A-Z]+)$"
ONE_WORD = r"(?i)^[A-Z0-9][A-Z0-9_-]*$"
ITEM = (
    r"(?i)^(0?[1-9]|[1-4][0-9]|66|77|88)(\s+[A-Z0-9][A-Z0-9_#$@-]*)?"
    r"(\s+(PIC|PICTURE|VALUE|VALUES|OCCURS|REDEFINES|RENAMES|USAGE|COMP|COMP-[1-6X]|COMPUTATIONAL\S*|BINARY"
    r"|PACKED-DECIMAL|DISPLAY|SIGN|SYNC|SYNCHRONIZED|JUST|JUSTIFIED|BLANK|INDEX|POINTER|IS|GLOBAL|EXTERNAL"
    r"|LEADING|TRAILING)\b[\s\S]*)?$"
)
PROGRAM_ID = r"(?i)^PROGRAM-ID\b"
DECIMAL_COMMA = r"(?i)\bDECIMAL-POINT\s+(IS\s+)?COMMA\b"


def with_code(sources: DataFrame, fmt: str | Column | None = None) -> DataFrame:
    """Add ``fmt`` (given, or detected per file) and ``code``."""
    chosen = st.line_format(F.col("content")) if fmt is None else (F.lit(fmt) if isinstance(fmt, str) else fmt)
    return st.with_code_text(sources.withColumn("fmt", chosen))


@built_once
def _sentences(code: str) -> Column:
    return st.sentence_array(F.col(code))


def with_sentences(sources: DataFrame, fmt: str | Column | None = None) -> DataFrame:
    """Add ``sents``, the sentence array of each file."""
    return with_code(sources, fmt).withColumn("sents", _sentences("code")).drop("content", "code")


def is_unit_header(sentence: Column) -> Column:
    return sentence.rlike(UNIT_HEADER)


def is_division_header(sentence: Column) -> Column:
    return sentence.rlike(DIVISION_HEADER)


def is_section_header(sentence: Column) -> Column:
    return sentence.rlike(SECTION_HEADER)


@built_once
def _program_id(sents_name: str) -> Column:
    """Name after PROGRAM-ID, in the same or the next sentence."""
    sents = F.col(sents_name)

    def name(at: Column) -> Column:
        own = F.regexp_extract(F.get(sents, at - 1), r"(?i)^PROGRAM-ID\s*\.?\s*(\S+)", 1)
        following = F.regexp_extract(F.get(sents, at), r"^(\S+)", 1)
        return F.when(at > 0, st.unquote(F.coalesce(F.nullif(own, F.lit("")), F.nullif(following, F.lit("")))))

    found = F.array_position(F.transform(sents, lambda s: F.upper(F.substring(s, 1, 10)) == "PROGRAM-ID"), True)
    return let(found.cast("int"), name)


def units(sources: DataFrame, fmt: str | Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per program unit: path, file_name, ``keep``, base, unit_sents, program_id, unit_name, decimal_comma, program."""
    return units_of(with_sentences(sources, fmt), keep)


def units_of(parsed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``units`` of rows that have their ``sents`` already."""
    cut = explode_slices(
        parsed, "sents", is_unit_header, ["path", "file_name", *keep], absorb_lead=True, part="unit_sents",
    )
    named = cut.withColumn("program_id", _program_id("unit_sents")).withColumn(
        "unit_name", naming.unit_name(F.col("file_name"))
    ).withColumn("decimal_comma", F.coalesce(F.exists("unit_sents", lambda s: s.rlike(DECIMAL_COMMA)), F.lit(False)))
    return named.withColumn("program", naming.program_name(F.col("program_id"), F.col("unit_name")))


def divisions(unit_rows: DataFrame) -> DataFrame:
    """One row per division: path, program, unit_base, decimal_comma, division, base, sents."""
    cut = explode_slices(
        unit_rows.withColumn("unit_base", F.col("base")), "unit_sents",
        is_division_header, ["path", "program", "unit_base", "decimal_comma"], F.col("base"), part="div_sents",
    )
    name = F.upper(F.nullif(F.regexp_extract(F.get("div_sents", F.lit(0)), DIVISION_HEADER, 1), F.lit("")))
    return cut.withColumn("division", F.when(name == "ID", "IDENTIFICATION").otherwise(name))


def sections(division_rows: DataFrame) -> DataFrame:
    """One row per section (and one for what precedes the first): adds section, base, sents."""
    cut = explode_slices(
        division_rows, "div_sents", is_section_header,
        ["path", "program", "unit_base", "division"], F.col("base"), part="sec_sents",
    )
    return cut.withColumn(
        "section", F.nullif(F.regexp_extract(F.get("sec_sents", F.lit(0)), SECTION_HEADER, 1), F.lit(""))
    )


# Paragraphs of the identification and environment divisions.
NAMED_PARAGRAPHS = (
    r"(?i)^(PROGRAM-ID|AUTHOR|INSTALLATION|DATE-WRITTEN|DATE-COMPILED|SECURITY|REMARKS|SOURCE-COMPUTER"
    r"|OBJECT-COMPUTER|SPECIAL-NAMES|REPOSITORY|FILE-CONTROL|I-O-CONTROL)$"
)


def is_paragraph_header(sentence: Column) -> Column:
    in_procedure = F.coalesce(F.col("division") == "PROCEDURE", F.lit(False))
    free_name = sentence.rlike(ONE_WORD) & ~sentence.rlike(ONE_WORD_IMPERATIVES)
    return F.when(in_procedure, free_name).otherwise(sentence.rlike(NAMED_PARAGRAPHS))


def paragraphs_of(section_rows: DataFrame) -> DataFrame:
    """One row per paragraph of the procedure division: adds paragraph, base, par_sents."""
    cut = explode_slices(
        section_rows, "sec_sents", is_paragraph_header,
        ["path", "program", "unit_base", "division", "section"], F.col("base"), part="par_sents",
    )
    first = F.get("par_sents", F.lit(0))
    return cut.withColumn("paragraph", F.when(is_paragraph_header(first), first))


def sentences(sources: DataFrame, fmt: str | Column | None = None) -> DataFrame:
    """The sentence table of the sources, headers included.

    Columns: path, program, division, section, paragraph, sent_no, kind, text. ``kind`` is
    DIVISION, SECTION, PARAGRAPH, FD, ITEM or SENTENCE.
    """
    return sentences_of(sections(divisions(units(sources, fmt))))


def sentences_of(section_rows: DataFrame) -> DataFrame:
    flat = paragraphs_of(section_rows).select(
        "path", "program", "unit_base", "division", "section", "paragraph", "base",
        F.posexplode_outer("par_sents").alias("_i", "raw"),
    )
    text = F.col("raw")
    in_data = F.col("division").isNull() | (F.col("division") == "DATA")
    kind = (
        F.when(text.rlike(DIVISION_HEADER), "DIVISION")
        .when(text.rlike(SECTION_HEADER), "SECTION")
        .when(in_data & text.rlike(r"(?i)^[FS]D\s+\S"), "FD")
        .when(in_data & text.rlike(ITEM), "ITEM")
        .when((F.col("_i") == 0) & F.col("paragraph").isNotNull(), "PARAGRAPH")
        .otherwise("SENTENCE")
    )
    return flat.select(
        "path", "program", "division", "section", "paragraph",
        (F.col("base") + F.col("_i")).alias("sent_no"), kind.alias("kind"), text.alias("text"),
    )


def headers(sentence_rows: DataFrame, kind: str | None = None) -> DataFrame:
    """Division, section and paragraph header rows, or those of one kind."""
    wanted = [kind] if kind else ["DIVISION", "SECTION", "PARAGRAPH"]
    return sentence_rows.where(F.col("kind").isin(wanted))


def decimal_comma_programs(sentence_rows: DataFrame) -> DataFrame:
    """Programs whose numbers are written with a decimal comma."""
    return sentence_rows.where(
        (F.col("division") == "ENVIRONMENT") & F.col("text").rlike(DECIMAL_COMMA)
    ).select("path", "program").distinct()


def programs(unit_rows: DataFrame) -> DataFrame:
    """path, program_id, unit_name and name of each unit."""
    return unit_rows.select("path", "file_name", "unit_name", "program_id", F.col("program").alias("name"))


# The identification paragraphs that carry comment entries.
IDENTIFICATION_PARAGRAPHS = ["AUTHOR", "INSTALLATION", "DATE-WRITTEN", "DATE-COMPILED", "SECURITY", "REMARKS"]


_FACT_NAMES = "|".join([*IDENTIFICATION_PARAGRAPHS, "PROGRAM-ID"])


def _starts_fact(sentence: Column) -> Column:
    return sentence.rlike(rf"(?i)^({_FACT_NAMES})\b")


def identification_facts(division_rows: DataFrame) -> DataFrame:
    """Comment entries of the identification division, one column each; all from the division's own row.

    The entry of a paragraph is all text up to the next identification paragraph; of two entries of
    one name the greater counts.
    """
    cut = division_rows.where(F.col("division") == "IDENTIFICATION").select(
        "path", "program", slice_array(F.col("div_sents"), _starts_fact).alias("_facts")
    )
    head = rf"(?i)^({_FACT_NAMES})\b"
    named = cut.select("path", "program", F.transform("_facts", lambda f: F.struct(
        F.upper(F.regexp_extract(F.get(f["part"], F.lit(0)), head, 1)).alias("name"),
        F.trim(F.regexp_replace(F.array_join(f["part"], ". "), rf"{head}\s*\.?\s*", "")).alias("entry"),
    )).alias("_named"))

    def entry(fact: str) -> Column:
        return F.array_max(F.transform(F.filter("_named", lambda f: f["name"] == fact), lambda f: f["entry"]))

    return named.select("path", "program", *[entry(n).alias(n.lower().replace("-", "_")) for n in IDENTIFICATION_PARAGRAPHS])
