"""Data description entries as rows, with parents found by a row-local running fold."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from copperline.functions import naming, source_text as st
from copperline.functions.arrays import built_once, let, scan_states
from copperline.operators import structure

_STACK = "ARRAY<STRUCT<no: INT, level: INT, path: STRING>>"
_STATE = (
    f"STRUCT<stack: {_STACK}, fillers: INT, section: STRING, fd: STRING, record_no: INT, parent_no: INT, filler_no: INT, qpath: STRING>"
)

_FD = r"(?i)^[FS]D\s+(\S+)"
_LEVEL = r"^(\d{1,2})(?=\s|$)"
# Words that open a clause, so they are no data name.
_CLAUSE_WORDS = (
    r"(?i)^(PIC|PICTURE|VALUE|VALUES|OCCURS|REDEFINES|RENAMES|USAGE|COMP\S*|BINARY|PACKED-DECIMAL|DISPLAY"
    r"|SIGN|SYNC|SYNCHRONIZED|JUST|JUSTIFIED|BLANK|INDEX|POINTER|IS|GLOBAL|EXTERNAL|LEADING|TRAILING)$"
)


@built_once
def data_events(sents_name: str, base_name: str) -> Column:
    """Section headers, FD entries and items of a data division; the rest is dropped."""
    sents, base = F.col(sents_name), F.col(base_name)

    def classify(s: Column, i: Column) -> Column:
        kind = (
            F.when(s.rlike(structure.ITEM), "I")
            .when(s.rlike(structure.SECTION_HEADER), "S")
            .when(s.rlike(_FD), "F")
        )
        return F.struct((base + i).cast("int").alias("no"), kind.alias("kind"), s.alias("text"))

    def detail(e: Column) -> Column:
        s, kind = e["text"], e["kind"]
        word = F.regexp_extract(s, r"^\d{1,2}\s+(\S+)", 1)
        item_name = let(word, lambda w: F.when((w == "") | w.rlike(_CLAUSE_WORDS), "FILLER").otherwise(w))
        name = (
            F.when(kind == "I", item_name)
            .when(kind == "S", F.upper(F.regexp_extract(s, structure.SECTION_HEADER, 1)))
            .otherwise(F.regexp_extract(s, _FD, 1))
        )
        return F.struct(
            e["no"].alias("no"), kind.alias("kind"), name.alias("name"),
            F.when(kind == "I", F.regexp_extract(s, _LEVEL, 1)).cast("int").alias("level"), s.alias("text"),
        )

    return F.transform(F.filter(F.transform(sents, classify), lambda e: e["kind"].isNotNull()), detail)


def _step(prev: Column, e: Column) -> Column:
    """State after one event: the open ancestors, the current file and record, the item."""
    is_item = e["kind"] == "I"
    level = e["level"]
    opens_record = level.isin(1, 77)
    is_filler = F.upper(e["name"]) == "FILLER"
    # ancestors still open for this item: conditions hang below the latest item, renames below the record
    keep = (
        F.when(~is_item | opens_record, F.lit(0))
        .when(level == 88, F.lit(100))
        .when(level == 66, F.lit(2))
        .otherwise(level)
    )
    fd = F.when(e["kind"] == "F", e["name"]).when(e["kind"] == "S", F.lit(None)).otherwise(prev["fd"])
    counts = is_item & is_filler & ~level.isin(66, 88)
    own = F.when(is_filler, F.concat(F.lit("filler"), prev["fillers"].cast("string"))).otherwise(
        naming.column_name(e["name"])
    )

    def with_stack(stack: Column) -> Column:
        parent = F.try_element_at(stack, F.lit(-1))
        above = F.coalesce(parent["path"], naming.column_name(fd))
        return let(F.concat_ws(".", above, own), lambda qpath: with_path(stack, parent, qpath))

    def with_path(stack: Column, parent: Column, qpath: Column) -> Column:
        pushed = F.array_append(stack, F.struct(
            e["no"].alias("no"), F.when(level == 77, 1).otherwise(level).alias("level"), qpath.alias("path")
        ))
        return F.struct(
            F.when(is_item & ~level.isin(66, 88), pushed).when(is_item, prev["stack"]).otherwise(stack).alias("stack"),
            (prev["fillers"] + F.when(counts, 1).otherwise(0)).alias("fillers"),
            F.when(e["kind"] == "S", e["name"]).otherwise(prev["section"]).alias("section"),
            fd.alias("fd"),
            F.when(is_item, F.when(opens_record, e["no"]).otherwise(prev["record_no"])).alias("record_no"),
            F.when(is_item & ~opens_record, parent["no"]).alias("parent_no"),
            F.when(counts, prev["fillers"]).alias("filler_no"),
            qpath.alias("qpath"),
        )

    return let(F.filter(prev["stack"], lambda p: p["level"] < keep), with_stack)


@built_once
def scan_entries(events: str) -> Column:
    """Data entries with their context from the event array of a data division.

    The fold carries the context only; what an event says itself is put beside it afterwards.
    """
    empty = F.struct(
        F.array().cast(_STACK).alias("stack"), F.lit(0).alias("fillers"),
        *[F.lit(None).alias(c) for c in ("section", "fd", "record_no", "parent_no", "filler_no", "qpath")],
    ).cast(_STATE)

    def entry(s: Column, i: Column) -> Column:
        e = F.get(F.col(events), i)
        return F.struct(
            *[s[c].alias(c) for c in ("section", "fd", "record_no")], e["no"].alias("no"), s["parent_no"].alias("parent_no"),
            e["level"].alias("level"), e["name"].alias("name"), s["filler_no"].alias("filler_no"), s["qpath"].alias("qpath"),
            e["text"].alias("text"),
        )

    return F.transform(scan_states(F.col(events), _STATE, empty, _step, long=True), entry)


def item_arrays(division_rows: DataFrame) -> DataFrame:
    """path, program, decimal_comma and ``entries``: the data entries of each unit in source order, with their context.

    Copybooks have no division header; their items are taken too.
    """
    data = division_rows.where(F.col("division").isNull() | (F.col("division") == "DATA"))
    events = data.select("path", "program", "decimal_comma", data_events("div_sents", "base").alias("events"))
    return events.select("path", "program", "decimal_comma", scan_entries("events").alias("entries"))


# the rest of a VALUE clause: literals and words up to the next clause
_VALUE = (
    r"""(?i)\s(?:VALUES?)(?:\s+(?:IS|ARE))?\s+((?:(?:[A-Z]?"[^"]*"|[A-Z]?'[^']*'|(?!(?:PIC|PICTURE|OCCURS|USAGE|COMP\S*|"""
    r"""BINARY|SIGN|SYNC\S*|JUST\S*|BLANK|REDEFINES|DISPLAY)(?:\s|$))[^\s"']+)(?:\s+|,\s*|$))+)"""
)


def parse_items(entries: DataFrame) -> DataFrame:
    """Data item rows from ``entries`` arrays."""
    rows = entries.select("path", "program", "decimal_comma", F.inline_outer("entries")).where(F.col("level").isNotNull())
    # clause keywords are looked for outside the quoted text, and clauses only where their word is
    text, bare = F.col("text"), F.col("_bare")
    quoted = F.contains(text, F.lit("'")) | F.contains(text, F.lit('"'))
    rows = rows.withColumn("_bare", F.when(quoted, F.regexp_replace(text, r"""(["'])[^"']*\1""", "''")).otherwise(text)).withColumn(
        "_upper", F.upper("_bare")
    )

    def says(word: str) -> Column:
        return F.contains("_upper", F.lit(word))

    def clause(pattern: str, group: int = 1, *words: str) -> Column:
        found = F.nullif(F.regexp_extract(bare, pattern, group), F.lit(""))
        return F.when(reduce(or_, map(says, words)), found) if words else found

    occurs = r"(?i)\sOCCURS\s+(\d+)(?:\s+TO\s+(\d+))?"
    value_raw = F.when(F.contains(F.upper(text), F.lit("VALUE")), F.nullif(F.trim(F.regexp_extract(text, _VALUE, 1)), F.lit("")))
    level = F.col("level")
    pic = clause(r"(?i)\s(?:PICTURE|PIC)(?:\s+IS)?\s+(\S+)", 1, "PIC")
    kind = (
        F.when(level == 88, "CONDITION").when(level == 66, "RENAME")
        .when(F.col("has_children"), "GROUP").otherwise("SCALAR")
    )
    return rows.select(
        "path", "program", F.col("no").alias("item_no"), "section", F.col("fd").alias("fd_name"), "record_no",
        "level", "name", "filler_no", pic.alias("pic"), value_raw.alias("value_raw"),
        clause(occurs, 1, "OCCURS").cast("int").alias("occurs_from"), clause(occurs, 2, "OCCURS").cast("int").alias("occurs_to"),
        clause(r"(?i)\sREDEFINES\s+(\S+)", 1, "REDEFINES").alias("redefines"),
        clause(r"(?i)\sRENAMES\s+(\S+)", 1, "RENAMES").alias("renames_from"),
        F.filter(
            F.split(F.trim(F.regexp_replace(F.regexp_extract(bare, r"(?i)\sRENAMES\s+\S+((?:\s+(?:OF|IN)\s+\S+)*)", 1), r"(?i)(?:^|\s+)(?:OF|IN)\s+", " ")), r"\s+"),
            lambda w: w != "",
        ).alias("renames_of"),
        clause(r"(?i)\s(?:THRU|THROUGH)\s+(\S+)", 1, "THR").alias("renames_thru_any"),
        clause(r"(?i)\b(COMP(?:UTATIONAL)?(?:-[1-6X])?|BINARY|PACKED-DECIMAL)\b", 1, "COMP", "BINARY", "PACKED").alias("usage"),
        "parent_no", "qpath", kind.alias("kind"), "has_children", "decimal_comma",
    ).withColumn("renames_thru", F.when(F.col("kind") == "RENAME", F.col("renames_thru_any"))).drop("renames_thru_any")


def with_child_marks(entries: DataFrame) -> DataFrame:
    """Mark entries that have a child other than a condition.

    Items come in tree order, so an item has a child exactly when the next one below
    level 66 names it as parent.
    """
    def structural(e: Column) -> Column:
        return e["level"].between(1, 49) | (e["level"] == 77)

    split = entries.withColumn("_tree", F.filter("entries", structural)).withColumn(
        "_rest", F.filter("entries", lambda e: ~F.coalesce(structural(e), F.lit(False)))
    )
    tree = F.transform(F.col("_tree"), lambda e, i: e.withField(
        "has_children", F.coalesce(F.get(F.col("_tree"), i + 1)["parent_no"] == e["no"], F.lit(False))
    ))
    rest = F.transform(F.col("_rest"), lambda e: e.withField("has_children", F.lit(False)))
    return split.select("path", "program", "decimal_comma", F.concat(tree, rest).alias("entries"))


def data_items(division_rows: DataFrame) -> DataFrame:
    """Data items of all sections in source order, without a shuffle."""
    return parse_items(with_child_marks(item_arrays(division_rows)))


def data_items_in(items: DataFrame, section: str) -> DataFrame:
    """Items of one section: WORKING-STORAGE, LOCAL-STORAGE, LINKAGE or FILE."""
    return items.where(F.col("section") == section)


def all_data_items(items: DataFrame) -> DataFrame:
    """Local, file, working-storage and linkage items together, as a bag."""
    return items.where(F.col("section").isin("LOCAL-STORAGE", "FILE", "WORKING-STORAGE", "LINKAGE"))


def file_descriptions(division_rows: DataFrame) -> DataFrame:
    """path, program, fd_name and sent_no of each file description."""
    entries = item_arrays(division_rows).select("path", "program", F.inline_outer("entries"))
    return entries.where(F.col("level").isNull() & F.col("fd").isNotNull()).select(
        "path", "program", F.col("fd").alias("fd_name"), F.col("no").alias("sent_no")
    )


def file_records(items: DataFrame) -> DataFrame:
    """Records (level 1) below a file description."""
    return items.where(F.col("fd_name").isNotNull() & (F.col("level") == 1))
