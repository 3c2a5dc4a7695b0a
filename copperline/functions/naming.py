"""Names, keys and labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def unit_name(path: Column) -> Column:
    """File stem with a capital first letter."""
    stem = F.regexp_extract(path, r"([^/\\]*?)(?:\.[^./\\]*)?$", 1)
    return F.concat(F.upper(F.substring(stem, 1, 1)), F.substring(stem, 2, 2**31 - 1))


def program_name(program_id: Column, unit: Column) -> Column:
    """PROGRAM-ID, else the unit name."""
    return F.coalesce(program_id, unit)


def entity_id(program: Column, name: Column) -> Column:
    return F.concat_ws(":", program, name)


def doc_id(program: Column, file_name: Column) -> Column:
    return F.concat_ws("_", program, file_name)


def record_or_field(level: Column) -> Column:
    return F.when(level == 1, "RECORD").otherwise("FIELD")


def data_description(level: Column, type_text: Column) -> Column:
    """`Level: n, Type: t`, without the second part when there is no type text."""
    with_type = F.concat(F.lit("Level: "), level.cast("string"), F.lit(", Type: "), type_text)
    no_type = F.concat(F.lit("Level: "), level.cast("string"))
    return F.when(type_text.isNotNull() & (type_text != ""), with_type).otherwise(
        F.coalesce(no_type, F.lit("Data field"))
    )


def column_name(name: Column) -> Column:
    """A COBOL name as a column name: lower case, `-` to `_`, `#` to `$`."""
    return F.translate(F.lower(name), "-#", "_$")


def source_metadata(program: Column, file_path: Column, file_name: Column) -> Column:
    """Metadata map stored beside a vector."""
    return F.create_map(
        F.lit("program"), program,
        F.lit("file_path"), file_path,
        F.lit("file_name"), file_name,
        F.lit("language"), F.lit("COBOL"),
    )


def metadata_source(metadata: Column) -> Column:
    return F.coalesce(metadata["source"], metadata["file_name"], F.lit("unknown"))
