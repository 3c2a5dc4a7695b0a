"""From questions to retrieved, enriched context and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from copperline.functions import naming, prompts, vectors as vec
from copperline.operators import graph, topk


def doc_vectors(sources: DataFrame, fn=None) -> DataFrame:
    """Vector rows of program sources: path, file_name, content and program in, id to metadata out."""
    rows = sources.select(
        naming.doc_id(F.col("program"), F.col("file_name")).alias("id"),
        F.col("content").alias("document"),
        naming.source_metadata(F.col("program"), F.col("path"), F.col("file_name")).alias("metadata"),
    )
    return vec.embed(rows, "document", fn)


def retrieve(vectors: DataFrame, edges: DataFrame, questions: DataFrame, k: int = 5, fn=None) -> DataFrame:
    """Per question the k nearest documents with the callees of their programs.

    Columns: query_id, rank, id, program, source, document, dependencies, segment. The vectors
    are scanned for ids first; only the few retrieved documents are read in full and joined.
    """
    asked = vec.embed(questions.where(prompts.is_valid_question(F.col("question"))), "question", fn)
    hits = topk.vector_topk_batch(vectors, asked.select("query_id", "embedding"), k, "id")
    docs = vectors.select("id", "document", "metadata").join(hits, "id").select(
        "query_id", "rank", "id", "document",
        F.col("metadata")["program"].alias("program"), naming.metadata_source(F.col("metadata")).alias("source"),
    )
    wanted = docs.select(F.col("program").alias("source")).distinct()
    deps = graph.callee_lists(edges.join(wanted, "source", "left_semi")).select(
        F.col("source").alias("program"), "deps"
    )
    joined = docs.join(deps, "program", "left")
    text = prompts.dependency_text(F.col("program"), F.col("deps"))
    return joined.select(
        "query_id", "rank", "id", "program", "source", "document", text.alias("dependencies"),
        prompts.context_segment(F.col("source"), F.col("document"), text).alias("segment"),
    )


def dependency_context(retrieved: DataFrame) -> DataFrame:
    """Per question the dependency text of its distinct programs, in order of first rank."""
    first = retrieved.where(F.col("program").isNotNull()).groupBy("query_id", "program").agg(
        F.min("rank").alias("rank"), F.min("dependencies").alias("dependencies")
    )
    # at most k rows per question
    return first.groupBy("query_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "dependencies"))), lambda r: r["dependencies"]
    ), "\n").alias("dependencies"))


def build_prompts(questions: DataFrame, retrieved: DataFrame) -> DataFrame:
    """query_id and prompt; a blank question gets the fixed hint instead of a prompt."""
    context = retrieved.groupBy("query_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "segment"))), lambda r: r["segment"]
    ), "\n\n").alias("context"))
    filled = questions.join(context, "query_id", "left").join(dependency_context(retrieved), "query_id", "left")
    blank = F.lit("")
    prompt = prompts.prompt(
        F.coalesce("context", blank), F.coalesce("dependencies", blank), F.col("question")
    )
    return filled.select("query_id", F.when(
        prompts.is_valid_question(F.col("question")), prompt
    ).otherwise(prompts.EMPTY_QUESTION_HINT).alias("prompt"))


