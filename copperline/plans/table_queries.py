"""Registered queries that apply the operators to the given tables directly."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from copperline.functions import naming, pictures as pic, prompts, source_text as st, values as val, vectors as vec
from copperline.operators import graph, layout, topk
from copperline.operators.skew import spread
from copperline.plans import ask
from copperline.plans.corpus_queries import part_edges
from copperline.session import materialize
from copperline.sources import collections as coll, files

QUESTIONS = [
    ("1", "How does the customer data processing work?"),
    ("2", "Which record holds the price and the quantity of a part?"),
    ("3", "   "),
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Upserts and keys.

def program_upsert(spark, sf):
    rows = table(spark, sf, "events").select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("name"), "event_id", "ts", "event_type"
    )
    return graph.latest(rows, ["name"], ["ts", "event_id"]).select("name", "event_id", "event_type")


def entity_upsert(spark, sf):
    user = F.concat(F.lit("U"), F.col("user_id").cast("string"))
    rows = table(spark, sf, "events").select(
        naming.entity_id(user, F.col("event_type")).alias("id"), user.alias("program"), F.col("event_type").alias("name"),
        F.lit("VARIABLE").alias("type"), F.lit("WORKING_STORAGE").alias("section"), F.col("event_id").cast("string").alias("description"),
        F.col("ts"), F.lit("/e").alias("path"), F.col("event_id").alias("seq"),
    )
    return graph.upsert_entities(rows, F.col("ts")).select("id", "program", "name", "description")


def edge_upsert(spark, sf):
    rows = table(spark, sf, "events").select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("source"), F.col("event_type").alias("target"),
        F.lit("CALLS").alias("rel_type"), F.col("ts"),
    )
    edges = graph.upsert_edges(rows, F.col("ts"))
    return edges.select("source", "target", "rel_type", F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss").alias("updated"))


def merge_versions(spark, sf):
    """Orders as two versions of one table: later deliveries of an urgent order win."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    stored, new = orders.where(~urgent), orders.where(urgent)
    ranked = lambda df, r: df.withColumn("ver", F.lit(r))
    return graph.merge_tables(ranked(stored, 1), ranked(new, 2), ["o_custkey"], ["ver", "o_orderkey"]).select(
        "o_custkey", "o_orderkey", "ver"
    )


def duplicate_keys(spark, sf):
    return graph.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


# Vectors and retrieval.

def _mean_vectors(spark, sf, by_label: bool):
    """Mean vector of the collection, or one per label."""
    rows = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    keys = ["label"] if by_label else []
    means = rows.groupBy(*keys, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(*keys).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]
    ).alias("embedding"))


def vector_topk(spark, sf):
    query = _mean_vectors(spark, sf, False).first()["embedding"]
    best = topk.vector_topk(table(spark, sf, "embeddings"), list(query), 10)
    return best.select("vec_id", "label", F.round("score", 6).alias("score"))


def vector_topk_batch(spark, sf):
    queries = _mean_vectors(spark, sf, True).select(F.col("label").cast("string").alias("query_id"), "embedding")
    best = topk.vector_topk_batch(table(spark, sf, "embeddings"), queries, 5)
    return best.select("query_id", F.col("id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


def vector_topk_fiftieth(spark, sf):
    """Every fiftieth vector as a query against all."""
    vectors = table(spark, sf, "embeddings")
    queries = vectors.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    best = topk.vector_topk_batch(vectors, queries, 5)
    return best.select("query_id", F.col("id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


def embed_documents(spark, sf):
    rows = vec.embed(spread(table(spark, sf, "documents").select("doc_id", "text")), "text")
    scaled = F.array_join(F.transform("embedding", lambda x: F.round(x * 1000000).cast("long").cast("string")), ",")
    return rows.select("doc_id", scaled.alias("vector"))


def _document_vectors(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text", "source"))
    rows = docs.select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("document"),
        F.create_map(
            F.lit("program"), F.concat(F.lit("P"), F.col("doc_id").cast("string")), F.lit("source"), F.col("source")
        ).alias("metadata"),
    )
    return vec.embed(rows, "document")


def _questions(spark):
    return spark.createDataFrame(QUESTIONS, "query_id string, question string")


def doc_topk(spark, sf):
    best = topk.vector_topk(_document_vectors(spark, sf), vec.embed_question(QUESTIONS[0][1]), 5, "id")
    return best.select("id", F.round("score", 6).alias("score"), F.length("document").alias("n"))


def collection_query(spark, sf):
    """The five rows of a collection of all documents that are nearest to a question; the collection embeds both."""
    name = f"c{uuid.uuid4().hex}"
    docs = table(spark, sf, "documents")
    coll.create_collection(spark, name)
    coll.add_embeddings(spark, name, docs.select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("document"), F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"),
    ))
    found = coll.query_embeddings(spark, name, QUESTIONS[0][1], 5)
    rows = materialize(found.select("id", F.round("score", 6).alias("score"), F.length("document").alias("n")))
    coll.drop_collection(spark, name)
    return rows


def _retrieved(spark, sf):
    return ask.retrieve(_document_vectors(spark, sf), part_edges(spark, sf), _questions(spark))


def context_segments(spark, sf):
    return _retrieved(spark, sf).select("query_id", "rank", "segment")


def dependency_context(spark, sf):
    return ask.dependency_context(_retrieved(spark, sf))


def filled_prompts(spark, sf):
    return ask.build_prompts(_questions(spark), _retrieved(spark, sf))


def markdown_segments(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", prompts.code_segment(F.col("source"), F.lit(None).cast("string"), F.col("text")).alias("segment")
    )


def question_guard(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", prompts.question_or_hint(F.col("text")).alias("question"))


def list_rows(spark, sf):
    """Parallel lists of lines, line numbers and metadata per document, as rows."""
    lines = st.split_lines(F.col("text"))
    lists = table(spark, sf, "documents").select(
        lines.alias("documents"),
        F.transform(lines, lambda l, i: F.create_map(F.lit("line"), (i + 1).cast("string"))).alias("metadatas"),
        F.transform(lines, lambda l, i: F.concat_ws("_", F.col("doc_id").cast("string"), (i + 1).cast("string"))).alias("ids"),
    )
    return coll.rows_from_lists(lists).select("id", "document", F.col("metadata")["line"].alias("line"))


# Text.

def split_lines(spark, sf):
    docs = files.sources_from_table(table(spark, sf, "documents"), "doc_id", "text")
    return files.lines(docs, "FIXED").select("path", "line_no", "raw")


def normalized_lines(spark, sf):
    docs = files.sources_from_table(table(spark, sf, "documents"), "doc_id", "text")
    return files.lines(docs, "FIXED").select("path", "line_no", "seq", "indicator", "code", "is_comment")


# Pictures.

def _pictures(spark, sf):
    """A picture per part: its form from the key, its length from the size."""
    n = F.col("p_size").cast("string")
    nines = F.repeat(F.lit("9"), F.col("p_size"))
    forms = [
        nines, F.concat(F.lit("9("), n, F.lit(")")), F.concat(nines, F.lit("V99")), F.concat(nines, F.lit(".9")),
        F.concat(F.lit("9("), n, F.lit(")V9")), F.concat(nines, F.lit("V9("), n, F.lit(")")),
        F.concat(F.lit("9("), n, F.lit(")V9(3)")), F.concat(F.lit("S"), nines), F.concat(F.lit("S9("), n, F.lit(")")),
        F.concat(F.lit("S"), nines, F.lit("V9")), F.concat(F.lit("S9("), n, F.lit(")V99")),
        F.concat(F.lit("S"), nines, F.lit("V9("), n, F.lit(")")), F.concat(F.lit("S9("), n, F.lit(")V9(2)")),
        F.repeat(F.lit("X"), F.col("p_size")), F.concat(F.lit("X("), n, F.lit(")")),
        F.repeat(F.lit("A"), F.col("p_size")), F.concat(F.lit("A("), n, F.lit(")")),
        F.concat(F.lit("ZZ"), nines), F.concat(F.lit("-9("), n, F.lit(").99")),
    ]
    chosen = F.get(F.array(*forms), (F.col("p_partkey") % len(forms)).cast("int"))
    return table(spark, sf, "part").select("p_partkey", chosen.alias("pic"))


def pic_types(spark, sf):
    return _pictures(spark, sf).select("p_partkey", "pic", pic.pic_type(F.col("pic")).alias("type"))


def pic_lengths(spark, sf):
    p = F.col("pic")
    return _pictures(spark, sf).select(
        "p_partkey", pic.pic_integer_len(p).alias("integer_len"), pic.pic_fraction_len(p).alias("fraction_len"),
        pic.pic_string_len(p).alias("string_len"), pic.pic_length(p).alias("length"),
        pic.pic_integer_len(p, compat=False).alias("digits"), pic.pic_fraction_len(p, compat=False).alias("decimals"),
    )


def occurs_max(spark, sf):
    """Largest repetition over the line numbers of each order as OCCURS clauses."""
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_orderkey").agg(F.max(pic.max_occurs(
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber")), F.col("l_quantity").cast("int")
    )).alias("max_occurs"))


def column_names(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", naming.column_name(F.regexp_replace("c_name", "#", "-#")).alias("name"))


def name_labels(spark, sf):
    p = table(spark, sf, "part")
    level = (F.col("p_size") % 5 + 1).cast("int")
    return p.select(
        "p_partkey", naming.record_or_field(level).alias("label"),
        naming.data_description(level, F.when(F.col("p_partkey") % 2 == 0, F.col("p_type"))).alias("description"),
        naming.unit_name(F.concat(F.lit("/src/"), F.lower("p_name"), F.lit(".cbl"))).alias("unit_name"),
    )


# Values and conditions.

def sign_rows(spark, sf):
    c, bal = table(spark, sf, "customer"), F.col("c_acctbal")
    tests = {f"{'not_' if n else ''}{s.lower()}": val.sign_condition(bal, s, n) for s in ("POSITIVE", "NEGATIVE", "ZERO") for n in (False, True)}
    return c.select("c_custkey", *[t.alias(n) for n, t in tests.items()])


def combined_rows(spark, sf):
    li = table(spark, sf, "lineitem")
    q = F.col("l_quantity")
    values = F.array(F.lit(10.0), F.col("l_linenumber").cast("double") * 5, F.when(F.col("l_tax") > 0.01, F.lit(20.0)))
    return li.select(
        "l_orderkey", "l_linenumber",
        val.combined_comparison(q, ">", values, "AND").alias("gt_and"), val.combined_comparison(q, "<=", values, "OR").alias("le_or"),
        val.combined_comparison(q, ">", values, "OR", not_=True).alias("not_gt_or"), val.combined_comparison(q, "=", values, "OR").alias("eq_or"),
    )


def _mixed_values(line: str = "l_linenumber"):
    """A value whose kind depends on the line number."""
    n = F.col(line)
    left = (
        F.when(n == 1, val.decimal_value(F.col("l_quantity"))).when(n == 2, val.string_value(F.concat(F.col("l_returnflag"), F.lit("  "))))
        .when(n == 3, val.boolean_value(F.col("l_discount") > 0.05)).when(n == 4, val.high_value()).when(n == 5, val.low_value())
        .when(n == 6, val.decimal_value(F.col("l_tax").cast("decimal(12,2)")))
    )
    right = (
        F.when(n.isin(1, 6), val.decimal_value(F.lit(25))).when(n == 2, val.string_value(F.lit("N")))
        .when(n == 3, val.boolean_value(F.lit(True)))
        .when(n == 4, F.when(F.col("l_linestatus") == "O", val.high_value()).otherwise(val.low_value()))
        .when(n == 5, val.string_value(F.col("l_linestatus"))).otherwise(val.string_value(F.lit("x")))
    )
    return left, right


def compare_rows(spark, sf):
    left, right = _mixed_values()
    return val.relations(table(spark, sf, "lineitem"), left, right).select(
        "l_orderkey", "l_linenumber", "eq", "ne", "gt", "ge", "lt", "le"
    )


def value_texts(spark, sf):
    left, _ = _mixed_values()
    rows = table(spark, sf, "lineitem").withColumn("_l", left)
    text_number = val.string_value(F.concat(F.lit(" "), F.col("l_discount").cast("decimal(12,2)").cast("string"), F.lit(" ")))
    return rows.select(
        "l_orderkey", "l_linenumber", val.as_string(F.col("_l")).alias("text"), val.as_string(F.col("_l"), comma=True).alias("comma_text"),
        val.as_decimal(text_number).cast("double").alias("parsed"),
        F.when(F.col("l_linenumber").isin(1, 3, 4), val.as_decimal(F.col("_l")).cast("double")).alias("number"),
    )


def _chain_operands():
    return [
        ("OR", F.col("l_discount") > 0.05), ("AND", F.when(F.col("l_linenumber") != 3, F.col("l_returnflag") == "N")),
        ("OR", F.col("l_tax") >= 0.08),
    ]


def condition_chain(spark, sf):
    rest = _chain_operands()
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", val.condition_chain(F.col("l_quantity") > 25, rest).alias("holds"),
        val.condition_chain(F.col("l_quantity") > 25, rest, first_not=True).alias("not_holds"),
    )


def condition_chain_rows(spark, sf):
    """The same chain with its operators as data."""
    rest = F.array(*[F.struct(F.lit(op).alias("op"), v.alias("v")) for op, v in _chain_operands()])
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", val.condition_chain(F.col("l_quantity") > 25, rest).alias("holds")
    )


def blank_rows(spark, sf):
    """Strings and groups of strings compared with SPACES."""
    n = table(spark, sf, "customer")
    pad = F.when(F.col("c_nationkey") % 2 == 0, F.lit("   ")).otherwise(F.col("c_mktsegment"))
    other = F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.lit("x"))
    return n.select("c_custkey", val.is_blank(pad).alias("blank"), val.group_is_blank([pad, other]).alias("group_blank"))


def literal_rows(spark, sf):
    """Types and values of VALUE clauses built from the parts."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    forms = [
        F.concat(F.lit("'it no. "), n, F.lit("'")), n, F.concat(n, F.lit(".50")), F.concat(F.lit("-"), n), F.lit("SPACES"), F.lit("ZEROES"),
        F.lit("HIGH-VALUES"), F.lit("low-value"), F.lit("TRUE"), F.lit("QUOTE"), F.concat(F.lit("1 THRU "), n), F.concat(n, F.lit(" 99")),
    ]
    raw = F.get(F.array(*forms), (k % len(forms)).cast("int"))
    rows = table(spark, sf, "part").select("p_partkey", raw.alias("raw"))
    value = val.value_clause(F.col("raw"))
    return rows.withColumn("_v", value).select(
        "p_partkey", "raw", val.literal_type(val.first_literal(F.col("raw"))).alias("type"), F.col("_v.kind").alias("kind"),
        F.when(F.col("_v").isNotNull(), val.as_string(F.col("_v"))).alias("text"),
    )


def arith_rows(spark, sf):
    li = table(spark, sf, "lineitem")
    q = F.col("l_quantity").cast("decimal(12,2)")
    zero_or = (F.col("l_linenumber") % 4).cast("decimal(12,2)")
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    unknown = F.when(F.col("l_linenumber") != 5, q)
    tiny = (F.col("l_linenumber").cast("decimal(2,0)") * F.lit("0.0000000001").cast("decimal(11,10)")).cast("decimal(13,10)")
    large = F.col("l_orderkey").cast("decimal(16,0)") + F.lit("1000000000000000").cast("decimal(16,0)")
    text = lambda c: c.cast("string")
    return li.select(
        "l_orderkey", "l_linenumber", text(val.add(price, tiny)).alias("total"), text(val.subtract(price, unknown)).alias("net"),
        text(val.multiply(large, q)).alias("product"), text(val.divide(price, zero_or)).alias("quotient"),
        text(val.multiply(tiny, F.lit(1).cast("decimal(1,0)"))).alias("kept"), text(val.power(-zero_or, F.lit(2))).alias("square"),
    )


def expression_types(spark, sf):
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    forms = [
        F.concat(F.lit("WS-A > "), n), F.concat(n, F.lit(" + 1")), F.concat(n, F.lit(".5 * 2")), F.lit("'abc'"), F.lit("LENGTH OF WS-A"),
        F.lit("LINE-COUNTER"), F.lit("WS-A"), F.lit("WS-A IS POSITIVE"), F.lit("ADDRESS OF WS-A"), F.lit("SPACES"),
    ]
    text = F.get(F.array(*forms), (k % len(forms)).cast("int"))
    rows = table(spark, sf, "part").select("p_partkey", text.alias("text"))
    operand = F.when(F.col("text") == "WS-A", F.lit("FLOAT"))
    return rows.select("p_partkey", val.expression_type(F.col("text"), operand).alias("type"))


def constraint_violations(spark, sf):
    record = layout.pic_layout(spark, {
        "c_name": "X(18)", "c_acctbal": "S9(3)", "c_custkey": "9(3)", "c_nationkey": "9", "c_mktsegment": "A(9)",
    })
    return layout.constraint_violations(table(spark, sf, "customer"), record, "c_custkey")


QUERIES = {f.__name__: f for f in (
    program_upsert, entity_upsert, edge_upsert, merge_versions, duplicate_keys, vector_topk, vector_topk_batch, vector_topk_fiftieth, embed_documents,
    doc_topk, collection_query, context_segments, dependency_context, filled_prompts, markdown_segments, question_guard, list_rows, split_lines,
    normalized_lines, pic_types, pic_lengths, occurs_max, column_names, name_labels, sign_rows, combined_rows, compare_rows,
    value_texts, condition_chain, condition_chain_rows, blank_rows, literal_rows, arith_rows, expression_types, constraint_violations,
)}
