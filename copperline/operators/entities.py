"""Program entities, flat-mapped in one pass over the divisions of each unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from copperline.functions import naming
from copperline.functions.arrays import built_once, let, slice_array
from copperline.operators import data_items as di, structure

COLUMNS = ["path", "seq", "id", "program", "name", "type", "section", "description"]
_ENTITY = "STRUCT<seq: LONG, name: STRING, type: STRING, section: STRING, description: STRING>"
# entities of one program follow each other as working storage, files, procedure
_FILE_RANK = 1 << 40
_PROCEDURE_RANK = 2 << 40


def _entity(seq: Column, name: Column, type_: Column | str, section: str, description: Column | str) -> Column:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(
        seq.cast("long").alias("seq"), name.alias("name"), lit(type_).alias("type"),
        F.lit(section).alias("section"), lit(description).alias("description"),
    ).cast(_ENTITY)


def _data_entity(e: Column) -> Column:
    """Entity of one data division entry; null where it has none."""
    pic = r"(?i)\s(?:PICTURE|PIC)(?:\s+IS)?\s+(\S+)"
    bare = F.regexp_replace(e["text"], r"""(["'])[^"']*\1""", "''")
    is_item = e["level"].isNotNull()
    section_row = ~is_item & e["fd"].isNull()
    working = e["section"] == "WORKING-STORAGE"
    in_file = e["section"] == "FILE"
    description = naming.data_description(e["level"], F.nullif(F.regexp_extract(bare, pic, 1), F.lit("")))
    no = e["no"].cast("long")
    return (
        F.when(working & section_row, _entity(
            no, F.lit("WORKING-STORAGE SECTION"), "SECTION", "DATA_DIVISION", "Variables section"))
        .when(working & is_item, _entity(no, e["name"], "VARIABLE", "WORKING_STORAGE", description))
        .when(in_file & section_row, _entity(
            no + _FILE_RANK, F.lit("FILE SECTION"), "SECTION", "DATA_DIVISION", "File storage definition section"))
        .when(in_file & ~is_item, _entity(no + _FILE_RANK, e["fd"], "FILE", "FILE_SECTION", "File Description"))
        .when(in_file & e["fd"].isNotNull(), _entity(
            no + _FILE_RANK, e["name"], naming.record_or_field(e["level"]), "FILE_SECTION", description))
    )


@built_once
def _data_entities(events: str) -> Column:
    """Entities of one data division; fillers have no name of their own and become none."""
    named = F.filter(di.scan_entries(events), lambda e: F.upper(e["name"]) != "FILLER")
    return F.filter(F.transform(named, _data_entity), lambda x: x.isNotNull())


@built_once
def _procedure_entities(sents_name: str, base_name: str, program_name: str, scope: str) -> Column:
    """Sections and paragraphs of one procedure division."""
    sents, base, program = F.col(sents_name), F.col(base_name), F.col(program_name)

    def of_section(sec: Column) -> Column:
        part = sec["part"]
        head = F.regexp_extract(F.get(part, F.lit(0)), structure.SECTION_HEADER, 1)
        return let(F.nullif(head, F.lit("")), lambda section: rows(sec, part, section))

    def rows(sec: Column, part: Column, section: Column) -> Column:
        where = F.when(section.isNotNull(), F.concat(F.lit("Paragraph in section "), section)).otherwise(
            F.concat(F.lit("Paragraph in "), program)
        )

        def row(s: Column, i: Column) -> Column:
            no = (base + sec["at"] + i).cast("long") + _PROCEDURE_RANK
            header = structure.is_paragraph_header(s)
            wanted = header if scope == "all" else header & section.isNotNull()
            return F.when((i == 0) & section.isNotNull(), _entity(
                no, section, "SECTION", "PROCEDURE_DIVISION", F.concat(F.lit("Section in "), program))
            ).when(wanted, _entity(no, s, "PARAGRAPH", "PROCEDURE_DIVISION", where))

        return F.filter(F.transform(part, row), lambda x: x.isNotNull())

    return F.flatten(F.transform(slice_array(sents, structure.is_section_header), of_section))


def extract_entities(division_rows: DataFrame, scope: str = "all") -> DataFrame:
    """Entities in emission order (``seq``); ``scope='flat'`` leaves out paragraphs without a section.

    One pass: each division row yields its own entities, so sources are parsed once.
    """
    is_data = F.col("division").isNull() | (F.col("division") == "DATA")
    rows = division_rows.where(is_data | (F.col("division") == "PROCEDURE")).withColumn(
        "_events", F.when(is_data, di.data_events("div_sents", "base"))
    )
    found = rows.select("path", "program", F.inline_outer(
        F.when(is_data, _data_entities("_events")).otherwise(_procedure_entities("div_sents", "base", "program", scope))
    ))
    return found.where(F.col("seq").isNotNull()).withColumn(
        "id", naming.entity_id(F.col("program"), F.col("name"))
    ).select(*COLUMNS)


def entity_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("program").agg(F.count(F.lit(1)).alias("n_entities"))
