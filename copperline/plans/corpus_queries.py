"""Registered queries over the program corpus that Spark derives from ``part``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from copperline.functions import naming, source_text as st, values as val
from copperline.operators import (
    calls, copybooks, data_items as di, entities, facts, graph, layout, lineage, paths, statements as stm, structure,
)
from copperline.operators.skew import spread
from copperline.plans import ingest as plan
from copperline.sources import collections, files, snapshots
from copperline.session import materialize, scratch_dir
from copperline.sources.synthetic import corpus_from_parts
from copperline.streaming import incremental


def parts(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/part.parquet")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_from_parts(spread(parts(spark, sf).select("p_partkey", "p_size", "p_brand")))


def _divisions(spark, sf):
    return structure.divisions(structure.units(corpus(spark, sf)))


def _sections(spark, sf):
    return structure.sections(_divisions(spark, sf))


def _statements(spark, sf, pattern=None):
    return stm.statements(_sections(spark, sf), pattern)


def _items(spark, sf):
    return di.data_items(_divisions(spark, sf))


def _parsed(spark, sf):
    """The divisions as a table, for queries that read them more than once."""
    return materialize(_divisions(spark, sf))


def _stored_items(spark, sf):
    """The items as a table, for queries that join them with themselves."""
    return materialize(_items(spark, sf))


def part_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus's CALL edges straight from the part keys."""
    k = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("P"), c.cast("string"))
    targets = F.array_compact(F.array(
        F.when(k > 0, F.floor(k / 2)), F.when(k % 3 == 0, F.floor(k / 3))
    ))
    return parts(spark, sf).select(
        name(k).alias("source"), F.explode(F.array_distinct(targets)).alias("t")
    ).select("source", name(F.col("t")).alias("target"), F.lit("CALLS").alias("rel_type"))


def call_edges_all(spark, sf):
    return calls.extract_calls(_sections(spark, sf))


def call_edges_flat(spark, sf):
    return calls.extract_calls(_sections(spark, sf), scope="flat")


def call_statements(spark, sf):
    return calls.call_statements(_sections(spark, sf)).select(
        "program", "target", "is_dynamic", "depth", "scope", "stmt_no", F.col("paragraph")
    )


def programs(spark, sf):
    return structure.programs(structure.units(corpus(spark, sf)))


def entity_rows(spark, sf):
    return entities.extract_entities(_divisions(spark, sf)).select(
        "id", "program", "name", "type", "section", "description"
    )


def entity_rows_flat(spark, sf):
    return entities.extract_entities(_divisions(spark, sf), scope="flat").select("id", "type", "section", "description")


def entity_counts(spark, sf):
    return entities.entity_counts(entities.extract_entities(_divisions(spark, sf)))


def containment(spark, sf):
    div = _parsed(spark, sf)
    known = div.select("path", F.col("program").alias("name")).distinct()
    return graph.containment(entities.extract_entities(div), known)


def statement_census(spark, sf):
    return stm.statement_census(_statements(spark, sf))


def statement_census_flat(spark, sf):
    return stm.statement_census(_statements(spark, sf), nested=False)


def statement_nesting(spark, sf):
    return _statements(spark, sf).groupBy("program", "verb", "depth").agg(F.count(F.lit(1)).alias("n"))


def statement_scopes(spark, sf):
    rows = _statements(spark, sf)
    return rows.groupBy("scope", "section", "paragraph", "depth").agg(F.count(F.lit(1)).alias("n"))


def sentence_kinds(spark, sf):
    rows = structure.sentences_of(_sections(spark, sf))
    return rows.groupBy("program", "division", "kind").agg(F.count(F.lit(1)).alias("n"))


def section_headers(spark, sf):
    rows = structure.headers(structure.sentences_of(_sections(spark, sf)), "SECTION")
    return rows.select("program", "division", F.col("section").alias("name"))


def identification(spark, sf):
    return structure.identification_facts(_divisions(spark, sf)).drop("path")


def layout_paths(spark, sf):
    return layout.layout_table(_items(spark, sf)).select(
        "program", "qpath", "level", "kind", "pic", "type", "integer_len", "fraction_len", "string_len", "length",
        "max_occurs", "default_text",
    )


def qualified_paths(spark, sf):
    return layout.qualified_paths(_stored_items(spark, sf)).select("program", "qualified_path")


def layout_ddl(spark, sf):
    return layout.record_ddl(_divisions(spark, sf)).select("program", "name", "ddl")


def fd_layouts(spark, sf):
    return layout.fd_layouts(_items(spark, sf)).select("program", "fd_name", "qpath", "type", "length")


def item_sections(spark, sf):
    return di.all_data_items(_items(spark, sf)).groupBy("program", "section").agg(F.count(F.lit(1)).alias("n"))


def working_storage(spark, sf):
    return di.data_items_in(_items(spark, sf), "WORKING-STORAGE").select("program", "level", "name")


def file_descriptions(spark, sf):
    return di.file_descriptions(_divisions(spark, sf)).select("program", "fd_name")


def file_records(spark, sf):
    return di.file_records(_items(spark, sf)).select("program", "fd_name", "name")


def groups_with_children(spark, sf):
    return layout.has_children(_items(spark, sf)).select("program", "name")


def renames(spark, sf):
    return layout.renames_alias(_stored_items(spark, sf)).select("program", "name", "renames_from", "source_path")


def references(spark, sf):
    div = _parsed(spark, sf)
    items = materialize(di.data_items(div))
    moved = facts.extract_moves(stm.statements(structure.sections(div), r"(?i)(^|\s)MOVE\s"))
    aliases = items.where(F.col("kind").isin("RENAME", "CONDITION")).select("path", "program", "name")
    refs = moved.select("path", "program", F.col("receiver").alias("name")).unionByName(aliases)
    found = layout.resolve_references(refs, items)
    names = items.select("path", "program", "item_no", F.col("name").alias("resolved"))
    parents = items.select("path", "program", F.col("item_no").alias("parent_no"), F.col("name").alias("parent"))
    return found.join(names, ["path", "program", "item_no"]).join(parents, ["path", "program", "parent_no"], "left").select(
        "program", "name", "via_rename", "resolved", "kind", "parent"
    )


def initial_values(spark, sf):
    rows = layout.current_values(_items(spark, sf))
    text = F.when(F.col("value").isNotNull(), val.as_string(F.col("value")))
    return rows.select("program", "name", F.col("value.kind").alias("value_kind"), text.alias("value"))


def condition_names(spark, sf):
    """Level 88 names against the initial values of their items."""
    return layout.condition_names(_stored_items(spark, sf)).select("program", "name", "holds")


def condition_names_provided(spark, sf):
    """The same with values the caller provides."""
    given = parts(spark, sf).select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("program"), F.lit("WS-FLAG").alias("name"),
        val.string_value(F.when(F.col("p_size") > 30, "Y").when(F.col("p_size") > 10, "y")).alias("value"),
    )
    return layout.condition_names(_stored_items(spark, sf), given).select("program", "name", "holds")


def file_usage(spark, sf):
    used = facts.extract_file_usage(_statements(spark, sf, r"(?i)(^|\s)(OPEN|CLOSE|READ|WRITE|REWRITE)\s"))
    return used.select("program", "verb", "mode", "file_name")


def file_control(spark, sf):
    return facts.extract_file_control(structure.sentences_of(_sections(spark, sf))).select("program", "file_name", "external_name")


def control_flow(spark, sf):
    div = _parsed(spark, sf)
    stmts = stm.statements(structure.sections(div), r"(?i)(^|\s)(PERFORM|GO)\s")
    flow = facts.extract_control_flow(stmts, facts.paragraph_order(div))
    return flow.select("program", "paragraph", "verb", "mode", "position", "target", "self_loop")


def moves(spark, sf):
    div = _parsed(spark, sf)
    moved = facts.extract_moves(stm.statements(structure.sections(div), r"(?i)(^|\s)MOVE\s"), di.data_items(div))
    return moved.select("program", "sending", "position", "receiver", "corresponding", "to_group")


def exec_sql(spark, sf):
    return facts.extract_exec_sql(_statements(spark, sf, r"(?i)(^|\s)EXEC\s")).select("program", "sql_text")


def file_lineage(spark, sf):
    div = _parsed(spark, sf)
    sec = structure.sections(div)
    usage = facts.extract_file_usage(stm.statements(sec, r"(?i)(^|\s)(OPEN|CLOSE|READ|WRITE|REWRITE)\s"))
    control = facts.extract_file_control(structure.sentences_of(sec))
    return lineage.file_lineage(usage, di.file_records(di.data_items(div)), control).select(
        "program", "verb", "mode", "file_name", "fd_name", "external_name"
    )


def _supported(spark):
    return spark.createDataFrame([(v,) for v in ("MOVE", "CALL", "IF", "DISPLAY", "PERFORM", "GO", "OPEN", "WRITE")], "verb string")


def uncovered_verbs(spark, sf):
    return lineage.uncovered_verbs(_statements(spark, sf), _supported(spark))


def rule_choice(spark, sf):
    rules = spark.createDataFrame([
        ("CALL", r"\sUSING\s", "call with arguments", 256), ("CALL", None, "call", 0),
        ("DISPLAY", r"'", "display literal", 128), ("DISPLAY", None, "display", 0), ("GO", None, "jump", 0),
    ], "verb string, pattern string, rule string, priority int")
    chosen = lineage.first_rule(_statements(spark, sf), rules, ["program"])
    return chosen.groupBy("program", "verb", "rule").agg(F.count(F.lit(1)).alias("n"))


def line_format(spark, sf):
    docs = files.sources_from_table(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")
    both = corpus(spark, sf).unionByName(docs)
    return both.select("file_name", st.line_format(F.col("content")).alias("fmt"))


def copybook_flag(spark, sf):
    docs = files.sources_from_table(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")
    both = corpus(spark, sf).unionByName(docs)
    return both.select("file_name", st.is_copybook(F.col("content")).alias("is_copybook"))


def rejects(spark, sf):
    docs = files.sources_from_table(spread(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")), "doc_id", "text")
    _, bad = files.split_rejects(corpus(spark, sf).unionByName(docs))
    return bad


def code_lines(spark, sf):
    rows = files.lines(corpus(spark, sf))
    return rows.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "line_no", "seq", "indicator",
        F.rtrim("code").alias("code"), "is_comment",
    )


def _suppliers_as_copybooks(spark, sf):
    k = F.col("s_suppkey").cast("string")
    return spark.read.parquet(f"{sf}/supplier.parquet").select(
        F.concat(F.lit("CB"), k).alias("name"), F.concat(F.lit("/copy/cb"), k, F.lit(".cpy")).alias("path"),
        F.concat(
            F.lit("000100 01  REC-"), k, F.lit(".\n000200     05 CODE-"), k, F.lit(" PIC 9(5)."),
            # three of four copybooks name the next one: up to four are nested
            F.when(F.col("s_suppkey") % 4 < 3, F.concat(F.lit("\n000300 COPY CB"), (F.col("s_suppkey") + 1).cast("string"), F.lit(".")))
            .otherwise(F.lit("")),
        ).alias("content"),
    )


def _customers_as_programs(spark, sf):
    c = F.col("c_custkey")
    k = c.cast("string")
    # a third of all programs name one copybook, the others share all of them evenly
    book = F.when(c % 3 == 0, F.lit("0")).otherwise(F.floor(c / 15).cast("string"))
    text = F.concat(
        F.lit("000100 IDENTIFICATION DIVISION.\n000200 PROGRAM-ID. C"), k,
        F.lit(".\n000300 DATA DIVISION.\n000400 WORKING-STORAGE SECTION.\n000500 COPY CB"), book,
        F.lit(".\n000600 01 LAST-ITEM PIC X.\n000650 COPY UNKNOWN-BOOK.\n000700 PROCEDURE DIVISION.\n000800     GOBACK.\n"),
    )
    name = F.concat(F.lit("c"), k, F.lit(".cbl"))
    rows = spread(spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey"))
    return rows.select(F.concat(F.lit("/cust/"), name).alias("path"), name.alias("file_name"), text.alias("content"))


def copybook_expansion(spark, sf):
    full = copybooks.expand_copybooks(_customers_as_programs(spark, sf), _suppliers_as_copybooks(spark, sf))
    items = di.data_items(structure.divisions(structure.units(full, "VARIABLE")))
    return items.select("program", "level", "name", "pic")


def copy_edges(spark, sf):
    rows = structure.sentences(_customers_as_programs(spark, sf), "VARIABLE")
    return calls.extract_copies(rows)


def edge_build(spark, sf):
    edges, _ = graph.build_edges(part_edges(spark, sf), _known_programs(spark, sf))
    return edges


def program_stubs(spark, sf):
    _, nodes = graph.build_edges(part_edges(spark, sf), _known_programs(spark, sf))
    return nodes.select("name", "file_path")


def _known_programs(spark, sf):
    """Programs already in the graph: those of the larger parts."""
    k = F.col("p_partkey")
    return parts(spark, sf).where(F.col("p_size") >= 20).select(
        F.concat(F.lit("P"), k.cast("string")).alias("name"), F.concat(F.lit("/corpus/p"), k.cast("string"), F.lit(".cbl")).alias("file_path")
    )


def callees(spark, sf):
    lists = graph.callee_lists(call_edges_all(spark, sf))
    return lists.select(F.col("source").alias("program"), F.array_join("deps", ",").alias("deps"))


def relationship_counts(spark, sf):
    return graph.relationship_counts(call_edges_all(spark, sf))


def ordered_programs(spark, sf):
    return graph.ordered_programs(structure.programs(structure.units(corpus(spark, sf))))


def first_edge(spark, sf):
    return graph.first_edge(call_edges_all(spark, sf), "P6")


def call_paths(spark, sf):
    """All paths along all CALL edges, one row each."""
    return paths.reachable_paths(part_edges(spark, sf))


def long_paths(spark, sf):
    """All paths in chains of 16 programs: up to 15 edges, without a limit of their own."""
    k = F.col("p_partkey")
    chain = parts(spark, sf).where((k + 1) % 16 != 0).select(
        F.concat(F.lit("P"), k.cast("string")).alias("source"), F.concat(F.lit("P"), (k + 1).cast("string")).alias("target")
    )
    return paths.reachable_paths(chain)


def cycle_paths(spark, sf):
    """Paths on rings of seven programs each, which end because no edge repeats."""
    k = F.col("p_partkey")
    following = F.when(k % 7 == 6, k - 6).otherwise(k + 1)
    rings = parts(spark, sf).select(
        F.concat(F.lit("R"), k.cast("string")).alias("source"), F.concat(F.lit("R"), following.cast("string")).alias("target")
    )
    return paths.reachable_paths(rings)


def paths_between(spark, sf):
    """Paths between pairs of programs: from each one to the program of an eighth of its number and to that of a ninth."""
    k = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("P"), c.cast("string"))
    pairs = parts(spark, sf).where(k > 0).select(name(k).alias("source"), F.explode(F.array(F.floor(k / 8), F.floor(k / 9))).alias("_t")).select(
        "source", name(F.col("_t")).alias("target")
    )
    return paths.paths_between(part_edges(spark, sf), pairs)


def reachable(spark, sf):
    """Programs reachable over all CALL edges, with the shortest length."""
    return paths.reachability(part_edges(spark, sf))


def param_query(spark, sf):
    name = F.concat(F.lit("P"), F.col("p_partkey").cast("string"))
    path = F.concat(F.lit("/corpus/p"), F.col("p_partkey").cast("string"), F.lit(".cbl"))
    programs = parts(spark, sf).select(name.alias("name"), path.alias("file_path"))
    tables = {"calls": part_edges(spark, sf), "programs": programs}
    text = (
        "SELECT p.name, c.target FROM programs p JOIN calls c ON c.source = p.name "
        "WHERE p.file_path LIKE :pattern AND c.rel_type = :kind"
    )
    return graph.run_query(spark, tables, text, {"pattern": "%1.cbl", "kind": "CALLS"})


def doc_meta(spark, sf):
    rows = corpus(spark, sf)
    program = F.concat(F.lit("P"), F.regexp_extract("file_name", r"p(\d+)", 1))
    meta = naming.source_metadata(program, F.col("path"), F.col("file_name"))
    return rows.select(naming.doc_id(program, F.col("file_name")).alias("id"), meta.alias("m")).select(
        "id", F.col("m")["program"].alias("program"), F.col("m")["file_path"].alias("file_path"),
        F.col("m")["file_name"].alias("file_name"), F.col("m")["language"].alias("language"),
        naming.metadata_source(F.col("m")).alias("source"),
    )


def stream_calls(spark, sf):
    """CALL edges of a stream of programs, taken in by micro-batches and merged by key."""
    root = f"{scratch_dir(spark)}/copperline-stream-{uuid.uuid4().hex}"
    schema = parts(spark, sf).schema
    rows = spark.readStream.schema(schema).parquet(f"{sf}/part[.]parquet")  # a stream wants a pattern or a folder

    def take(batch, batch_id):
        found = calls.extract_calls(structure.sections(structure.divisions(structure.units(corpus_from_parts(spread(batch))))))
        found.write.mode("overwrite").parquet(f"{root}/edges/batch={batch_id}")

    rows.writeStream.foreachBatch(take).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/edges").groupBy("source", "target", "rel_type").agg(F.count(F.lit(1)).alias("n")).drop("n")


def _write_sources(spark, sf, root, formats):
    """The corpus as source files of up to 200 programs each, one folder per line format."""
    fmt = F.regexp_extract("file_name", r"(\d+)", 1).cast("long") % 3
    rows = corpus(spark, sf).select(fmt.alias("fmt"), "content").where(F.col("fmt").isin(formats))
    rows.write.mode("append").option("maxRecordsPerFile", 200).partitionBy("fmt").text(f"{root}/sources")


def _ingested(spark, sf):
    root = f"{scratch_dir(spark)}/copperline-job-{uuid.uuid4().hex}"
    _write_sources(spark, sf, root, [0, 1, 2])
    return plan.ingest(spark, f"{root}/sources", f"{root}/tables", exts=("txt",))


def ingest_calls(spark, sf):
    """CALL edges after the whole job: files scanned, decoded, parsed, upserted, written, read back."""
    return _ingested(spark, sf)["calls"].select("source", "target", "rel_type")


def ingest_entities(spark, sf):
    """Entities after the whole job."""
    return _ingested(spark, sf)["entities"].select("id", "program", "name", "type", "section", "description")


def ingest_copybooks(spark, sf):
    """Entities after the whole job with copybooks: eight files of items, each program copying one by its file's name."""
    root = f"{scratch_dir(spark)}/copperline-job-{uuid.uuid4().hex}"
    paths = [f"{root}/books/PBOOK{i}.cpy" for i in range(8)]
    for i, path in enumerate(paths):
        fs, target = files._hadoop_path(spark, path)
        out = fs.create(target)
        out.write(bytearray(f"       01  BOOK-{i}.\n           05 CODE-{i} PIC 9(5).\n".encode()))
        out.close()
    k = F.col("p_partkey")
    rows = parts(spark, sf)
    program = F.concat(
        F.lit("       IDENTIFICATION DIVISION.\n       PROGRAM-ID. Q"), k.cast("string"),
        F.lit(".\n       DATA DIVISION.\n       WORKING-STORAGE SECTION.\n       COPY PBOOK"), (k % 8).cast("string"),
        F.lit(".\n       01  OWN-ITEM PIC X.\n       PROCEDURE DIVISION.\n       ONLY.\n           GOBACK."),
    )
    rows.select(program).write.option("maxRecordsPerFile", 200).text(f"{root}/sources")
    done = plan.ingest(spark, f"{root}/sources", f"{root}/tables", copybook_files=paths, fmt="VARIABLE", exts=("txt",))
    return done["entities"].select("id", "program", "name", "type")


def publish_audit(spark, sf):
    """Programs of a published graph. A first write with a repeated key is refused, and readers see nothing of it."""
    root = f"{scratch_dir(spark)}/copperline-job-{uuid.uuid4().hex}"
    good = _known_programs(spark, sf)
    try:
        graph.write_graph({"programs": good.unionByName(good.orderBy("name").limit(1))}, root)
        refused = False
    except ValueError:
        refused = True
    before = len(snapshots.versions(spark, root))
    graph.write_graph({"programs": good}, root)
    return graph.read_graph(spark, root, ["programs"])["programs"].select("name", F.lit(refused).alias("refused"), F.lit(before).alias("seen_before"))


def incremental_calls(spark, sf):
    """CALL edges after two runs of the incremental job, with new files in between."""
    root = f"{scratch_dir(spark)}/copperline-job-{uuid.uuid4().hex}"
    for formats in ([0, 1], [2]):
        _write_sources(spark, sf, root, formats)
        incremental.incremental_ingest(spark, f"{root}/sources", f"{root}/tables", f"{root}/state", exts=("txt",))
    return incremental.current_tables(spark, f"{root}/tables")["calls"].select("source", "target", "rel_type")


def incremental_tables(spark, sf):
    """All six tables after three batches: the last brings some programs again, and other reasons for some rejects."""
    root = f"{scratch_dir(spark)}/copperline-job-{uuid.uuid4().hex}"
    sources = materialize(corpus(spark, sf).withColumn("k", F.regexp_extract("file_name", r"(\d+)", 1).cast("long")))
    bad = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), (F.col("doc_id") % 3).alias("k"))
    k = F.col("k")
    for batch, (mine, left_out) in enumerate(((k % 3 == 0, k == 0), (k % 3 == 1, k == 1), ((k % 3 == 2) | (k % 6 == 0), k != 1))):
        rejects = bad.where(left_out).select("path", F.lit(f"batch {batch}").alias("reason"))
        incremental.merge_batch(spark, sources.where(mine).drop("k"), root, batch, rejects=rejects)
    # a batch that comes again is not taken twice
    incremental.merge_batch(spark, sources.drop("k"), root, 2, rejects=bad.select("path", F.lit("again").alias("reason")))
    now = incremental.current_tables(spark, root)
    text = {
        "programs": ("name", ["file_path"]), "entities": ("id", ["program", "name", "type", "section", "description"]),
        "contains": ("entity_id", ["program"]), "calls": ("source", ["target", "rel_type"]), "vectors": ("id", [F.col("metadata")["program"]]),
        "rejects": ("path", ["reason"]),
    }
    return graph.union_all([
        now[name].select(F.lit(name).alias("tab"), F.col(key).alias("key"), F.concat_ws("|", *rest).alias("rest"))
        for name, (key, rest) in text.items()
    ])


def collection_upsert(spark, sf):
    """A collection after a first load and a second one with new texts for half of its ids."""
    name = f"c{uuid.uuid4().hex}"
    first = parts(spark, sf).select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("document"),
        F.create_map(F.lit("load"), F.lit("1")).alias("metadata"), "p_size",
    )
    again = first.where(F.col("p_size") % 2 == 0).select(
        "id", F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("document"),
        F.create_map(F.lit("load"), F.lit("2")).alias("metadata"),
    )
    collections.create_collection(spark, name)
    collections.add_embeddings(spark, name, first.drop("p_size"))
    collections.add_embeddings(spark, name, again)
    rows = materialize(collections.stored(spark, name).select("id", "document", F.col("metadata")["load"].alias("load")))
    collections.drop_collection(spark, name)
    return rows


QUERIES = {f.__name__: f for f in (
    call_edges_all, call_edges_flat, call_statements, programs, entity_rows, entity_rows_flat, entity_counts, containment,
    statement_census, statement_census_flat, statement_nesting, statement_scopes, sentence_kinds, section_headers,
    identification, layout_paths, qualified_paths, layout_ddl, fd_layouts, item_sections, working_storage,
    file_descriptions, file_records, groups_with_children, renames, references, initial_values, condition_names, condition_names_provided,
    file_usage, file_control, control_flow, moves, exec_sql, file_lineage, uncovered_verbs, rule_choice, line_format,
    copybook_flag, rejects, code_lines, copybook_expansion, copy_edges, edge_build, program_stubs, callees,
    relationship_counts, ordered_programs, first_edge, call_paths, long_paths, cycle_paths, paths_between, reachable, param_query, doc_meta,
    stream_calls, ingest_calls, ingest_entities, ingest_copybooks, publish_audit, incremental_calls, incremental_tables, collection_upsert,
)}
