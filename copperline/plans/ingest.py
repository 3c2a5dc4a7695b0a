"""From a scan of sources to graph tables and vectors."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from copperline.operators import calls, copybooks, entities, graph, structure
from copperline.plans import ask
from copperline.session import materialize
from copperline.sources import files


def graph_tables(
    sources: DataFrame, fmt: str | None = None, scope: str = "all", as_of: Column | None = None
) -> dict[str, DataFrame]:
    """programs, entities, contains and calls of the sources."""
    return graph_of_units(structure.units(sources, fmt), scope, as_of)


def graph_of_units(units: DataFrame, scope: str = "all", as_of: Column | None = None) -> dict[str, DataFrame]:
    """programs, entities, contains and calls of program units.

    The code is parsed once, into a table of divisions that all outputs read. Entities and edges are tables too: what
    they contain or call is read from them and not extracted again.
    """
    # one literal: all tables of a run carry the same stamp, however often a plan runs
    stamp = F.lit(datetime.now(timezone.utc)) if as_of is None else as_of
    divisions = materialize(structure.divisions(units))
    named = divisions.select("path", F.col("program").alias("name")).distinct()
    programs = graph.upsert_programs(named, stamp)
    ents = materialize(graph.upsert_entities(entities.extract_entities(divisions, scope), stamp))
    edges = materialize(graph.upsert_edges(calls.extract_calls(structure.sections(divisions), scope), stamp))
    kept, with_stubs = graph.build_edges(edges, programs)
    return {
        "programs": with_stubs,
        "entities": ents,
        "contains": graph.containment(ents, programs),
        "calls": kept,
    }


def stored_sentences(sources: DataFrame, fmt: str | None = None) -> DataFrame:
    """path, file_name, content and ``sents`` of the sources, as a table for jobs that read the sentences more than once."""
    carried = sources.withColumn("_content", F.col("content"))
    return materialize(structure.with_sentences(carried, fmt).select("path", "file_name", F.col("_content").alias("content"), "sents"))


def main_programs(parsed: DataFrame) -> DataFrame:
    """path, file_name, content and ``program``, the name of a file's first program: the same as in the graph."""
    return structure.units_of(parsed, keep=("content",)).where(F.col("base") == 0).select("path", "file_name", "content", "program")


def ingest(
    spark: SparkSession, directory: str, out_dir: str, copybook_files: list[str] | None = None,
    fmt: str | None = None, scope: str = "all", exts: tuple[str, ...] = files.EXTENSIONS,
) -> dict[str, DataFrame]:
    """Scan a directory and write graph tables, vectors and rejects below ``out_dir``.

    Rejects name the sources and copybooks left out: not decodable, or without a program and data items.
    Texts are parsed once, to tell programs from others; only what copybooks are put into is parsed again.
    """
    decoded, rejects = files.decode_sources(files.scan_sources(spark, directory, exts))
    usable, unparsable = files.split_marked(materialize(files.mark_usable(decoded, fmt)), [*decoded.columns, "sents"])
    rejects = rejects.unionByName(unparsable)
    units = structure.units_of(usable)
    if copybook_files:
        rejects = rejects.unionByName(files.copybook_rejects(spark, copybook_files))
        units = structure.units(copybooks.expand_copybooks(usable.drop("sents"), files.scan_copybooks(spark, copybook_files)), fmt)
    tables = graph_of_units(units, scope)
    tables["vectors"] = ask.doc_vectors(main_programs(usable))
    tables["rejects"] = rejects
    graph.write_graph(tables, out_dir)
    return graph.read_graph(spark, out_dir, ["programs", "entities", "contains", "calls", "vectors", "rejects"])
