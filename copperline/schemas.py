"""Column layouts of the tables that operators exchange, as DDL strings."""

SOURCES = "path STRING, file_name STRING, content STRING"
COPYBOOKS = "name STRING, path STRING, content STRING"
VALUE = "STRUCT<kind: STRING, b: BOOLEAN, d: DECIMAL(38,10), s: STRING>"
PROGRAMS = "name STRING, file_path STRING, last_updated TIMESTAMP"
ENTITIES = (
    "id STRING, program STRING, name STRING, type STRING, section STRING, "
    "description STRING, last_updated TIMESTAMP"
)
CONTAINS = "program STRING, entity_id STRING"
CALLS = "source STRING, target STRING, rel_type STRING, last_updated TIMESTAMP"
VECTORS = (
    "collection STRING, id STRING, document STRING, embedding ARRAY<DOUBLE>, "
    "metadata MAP<STRING, STRING>"
)
