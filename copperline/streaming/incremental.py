"""Incremental ingest: new files only, into the same tables as a full run, vectors and rejects included."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from copperline.operators import structure
from copperline.plans import ask, ingest as plan
from copperline.session import materialize
from copperline.sources import files
from copperline.streaming import delta_log

#: A stub never replaces a program: it has no stamp, and nulls order first. Vectors and rejects have no stamp: the later batch wins.
TABLES = {
    "programs": delta_log.Keyed(["name"], ["last_updated", "file_path"]),
    "entities": delta_log.Keyed(["id"], ["last_updated"]),
    "contains": delta_log.Keyed(["program", "entity_id"], []),
    "calls": delta_log.Keyed(["source", "target", "rel_type"], ["last_updated"]),
    "vectors": delta_log.Keyed(["id"], []),
    "rejects": delta_log.Keyed(["path"], []),
}
# Fixed value: the schema of Spark's binary file source.
_BINARY_FILE = "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY"


def merge_batch(
    spark: SparkSession, sources: DataFrame, out_dir: str, batch_id: int, fmt: str | None = None, rejects: DataFrame | None = None,
    stream: str = "batch",
) -> int:
    """Add one batch of sources, and of ``rejects`` (path, reason), to the tables; returns the version it is in.

    The batch's rows are appended and nothing stored is rewritten but buckets due for compaction. A batch of a
    ``stream`` whose id is in already is skipped, before anything of it is parsed. A stream that starts anew under another name brings its files
    again: rows replace their equals, so nothing is lost or doubled.
    """
    known = delta_log.taken(spark, out_dir, stream, batch_id)
    return _merge_parsed(spark, plan.stored_sentences(sources, fmt), out_dir, batch_id, rejects, stream) if known is None else known


def _merge_parsed(
    spark: SparkSession, parsed: DataFrame, out_dir: str, batch_id: int, rejects: DataFrame | None, stream: str
) -> int:
    """``merge_batch`` of a table of sources with their ``sents``."""
    rows = plan.graph_of_units(structure.units_of(parsed))
    rows["vectors"] = ask.doc_vectors(plan.main_programs(parsed))
    rows["rejects"] = spark.createDataFrame([], "path string, reason string") if rejects is None else rejects
    return delta_log.append(spark, out_dir, rows, TABLES, stream, batch_id)


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the stream of this checkpoint folder; a lost folder means another stream."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0])["id"]


def incremental_ingest(
    spark: SparkSession, directory: str, out_dir: str, checkpoint: str, fmt: str | None = None,
    exts: tuple[str, ...] = files.EXTENSIONS,
) -> None:
    """Take in the files that arrived since the last run, then stop."""
    stream = (
        spark.readStream.format("binaryFile").schema(_BINARY_FILE).option("recursiveFileLookup", True)
        .option("pathGlobFilter", files.any_case_glob(exts)).load(directory)
    )

    def take(batch: DataFrame, batch_id: int) -> None:
        stream_id = _stream_id(spark, checkpoint)
        if delta_log.taken(spark, out_dir, stream_id, batch_id) is not None:
            return
        named = batch.select("path", F.regexp_extract("path", r"([^/\\]+)$", 1).alias("file_name"), "content")
        decoded, undecodable = files.decode_sources(named)
        parsed, unparsable = files.split_marked(materialize(files.mark_usable(decoded, fmt)), [*decoded.columns, "sents"])
        _merge_parsed(spark, parsed, out_dir, batch_id, undecodable.unionByName(unparsable), stream_id)

    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def current_tables(spark: SparkSession, out_dir: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables as they are now, or as of a version: every batch taken in makes one."""
    return {name: delta_log.current(spark, out_dir, name, table, version) for name, table in TABLES.items()}
