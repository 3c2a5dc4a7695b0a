"""Physical plans: what must and must not be in them."""

import io
import tempfile
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from copperline.operators import entities, graph, statements as stm, structure, topk
from copperline.plans import case_queries
from copperline.plans.corpus_queries import part_edges
from copperline.sources import files

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_parsing_has_no_shuffle_and_no_python(spark):
    docs = files.sources_from_table(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text")
    divisions = structure.divisions(structure.units(docs))
    for df in (stm.statements(structure.sections(divisions)), entities.extract_entities(divisions)):
        text = plan(df)
        assert "Exchange" not in text and "Python" not in text and "ArrowEval" not in text
        assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_upsert_combines_before_the_shuffle(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id", "ts")
    text = plan(graph.latest(events, ["user_id"], ["ts"]))
    assert "partial_max_by" in text and "Window" not in text and text.count("Exchange hashpartitioning") <= 1


def test_topk_is_cut_before_the_shuffle(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    queries = vectors.select(F.col("label").cast("string").alias("query_id"), "embedding").limit(3)
    text = plan(topk.vector_topk_batch(vectors, queries, 5))
    assert "WindowGroupLimit" in text and "CartesianProduct" not in text and "NestedLoop" not in text
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in text


def test_lookup_filter_reaches_the_scan(spark, tmp_path):
    part_edges(spark, SF).write.parquet(str(tmp_path / "calls"))
    text = plan(graph.callees(spark.read.parquet(str(tmp_path / "calls")), "P6"))
    assert "EqualTo(source,P6)" in text and "EqualTo(rel_type,CALLS)" in text


@pytest.mark.parametrize("name", ["case_expression_types", "case_references", "form_references", "case_nesting"])
def test_parsed_rows_are_never_broadcast(spark, name):
    """Their estimate follows the sources, or a well compressed file, and not the rows."""
    parts = spark.range(3).select(F.col("id").alias("p_partkey"), F.lit(5).alias("p_size"), F.lit("B").alias("p_brand"))
    folder = f"{tempfile.mkdtemp()}/sf"
    parts.write.parquet(f"{folder}/part.parquet")
    text = plan(case_queries.QUERIES[name](spark, folder))
    assert "SortMergeJoin" in text and "Broadcast" not in text
