import os

import pytest

from copperline import schemas
from copperline.operators import graph, structure
from copperline.plans import ingest
from copperline.sources import collections as coll, files, snapshots
from copperline.streaming import delta_log, incremental
from tests import programs as P
from tests.conftest import fixed


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_scan(spark, tmp_path):
    for name in ("a.cbl", "b.COB", "sub/deep/c.cobol", "d.txt", "e.java"):
        put(tmp_path, name, P.SIMPLE)
    assert sorted(r["file_name"] for r in files.scan_sources(spark, str(tmp_path)).collect()) == ["a.cbl", "b.COB", "c.cobol"]


def test_scan_of_empty_and_missing_folders(spark, tmp_path):
    assert files.scan_sources(spark, str(tmp_path)).isEmpty()
    with pytest.raises(ValueError):
        files.scan_sources(spark, str(tmp_path / "none"))


def test_rejects(spark, tmp_path):
    put(tmp_path, "ok.cbl", P.SIMPLE)
    put(tmp_path, "bytes.cbl", b"\xff\xfe\x00bad\xc3")
    put(tmp_path, "prose.cbl", P.PROSE)
    put(tmp_path, "book.cbl", fixed("01 REC.", "   05 A PIC X."))
    decoded, undecodable = files.decode_sources(files.scan_sources(spark, str(tmp_path)))
    good, bad = files.split_rejects(decoded, "FIXED")
    name = lambda df: sorted(os.path.basename(r["path"]) for r in df.collect())
    assert (name(undecodable), name(bad), name(good)) == (["bytes.cbl"], ["prose.cbl"], ["book.cbl", "ok.cbl"])


def test_copybook_scan_and_tables(spark, tmp_path):
    put(tmp_path, "cust.cpy", fixed("01 X PIC 9."))
    assert files.scan_copybooks(spark, [str(tmp_path / "cust.cpy")]).first()["name"] == "CUST"
    put(tmp_path, "bad.cpy", b"\xff\xfe\xc3")
    both = [str(tmp_path / n) for n in ("cust.cpy", "bad.cpy")]
    assert [r["name"] for r in files.scan_copybooks(spark, both).collect()] == ["CUST"]
    assert [os.path.basename(r["path"]) for r in files.copybook_rejects(spark, both).collect()] == ["bad.cpy"]
    df = spark.createDataFrame([("u1", "text")], "unit string, code string")
    assert tuple(files.sources_from_table(df, "unit", "code").first()) == ("u1", "u1", "text")


def test_lines(spark):
    df = spark.createDataFrame([("p", "p", "000100 MOVE".ljust(72) + "TAG\n000200*NOTE\n")], "path string, file_name string, content string")
    rows = files.lines(df, "FIXED").orderBy("line_no").collect()
    assert [(r["seq"], r["indicator"], r["code"].strip(), r["is_comment"]) for r in rows] == [("000100", " ", "MOVE", False), ("000200", "*", "NOTE", True)]
    assert files.lines(df, "TANDEM").where("line_no = 1").first()["code"].startswith("00100 MOVE")


def test_ingest_directory(spark, tmp_path):
    src = tmp_path / "src"
    put(src, "m.cbl", P.CALLS)
    put(src, "f.cbl", P.FILES)
    put(src, "x.cbl", P.PROSE)
    tables = ingest.ingest(spark, str(src), str(tmp_path / "out"), fmt="FIXED")
    assert {r["name"] for r in tables["programs"].where("file_path is not null").collect()} == {"MASTER", "FILER"}
    doc = tables["vectors"].where("metadata.program = 'FILER'").first()
    assert doc["id"] == "FILER_f.cbl" and doc["document"] == P.FILES and doc["metadata"]["language"] == "COBOL"
    assert [os.path.basename(r["path"]) for r in tables["rejects"].collect()] == ["x.cbl"]


def test_collection(spark, tmp_path):
    name = "sources-test"
    coll.drop_collection(spark, name)
    coll.create_collection(spark, name)
    with pytest.raises(Exception):
        coll.create_collection(spark, name)
    lists = spark.createDataFrame([(["customer data", "stock list"], [{"source": "a.cbl", "line": "42"}, {"source": "b.cbl", "line": "7"}], ["doc-1", "doc-2"])],
                                  "documents array<string>, metadatas array<map<string,string>>, ids array<string>")
    coll.add_embeddings(spark, name, coll.rows_from_lists(lists))
    best = coll.query_embeddings(spark, name, "which customer data?", 1).collect()
    assert [(r["id"], r["metadata"]["line"]) for r in best] == [("doc-1", "42")]
    # the same ids again: new texts replace the old ones, and two rows are two different ids
    again = spark.createDataFrame([(["stock list", "stock total"], [{"source": "a.cbl", "line": "1"}, {"source": "c.cbl", "line": "2"}], ["doc-1", "doc-3"])],
                                  lists.schema)
    for _ in range(2):
        coll.add_embeddings(spark, name, coll.rows_from_lists(again))
    found = coll.query_embeddings(spark, name, "stock list", 2).collect()
    assert {r["id"] for r in found} == {"doc-1", "doc-2"} and {r["document"] for r in found} == {"stock list"}
    assert spark.table("`sources_mtest`").count() == 3
    coll.drop_collection(spark, name)
    with pytest.raises(ValueError):
        coll.create_collection(spark, "x; drop")


def test_incremental_equals_full_run(spark, tmp_path):
    src, out, state = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "state")
    put(src, "m.cbl", P.CALLS)
    put(src, "bytes.COB", b"\xff\xfe\x00bad\xc3")
    put(src, "notes.txt", P.PROSE)
    incremental.incremental_ingest(spark, str(src), out, state, "FIXED")
    put(src, "n.cbl", P.NESTED)
    put(src, "x.cbl", P.PROSE)
    put(src, "h.cbl", P.program("HELPER-A", procedure=["    CALL 'MASTER'.", "    GOBACK."]))
    incremental.incremental_ingest(spark, str(src), out, state, "FIXED")
    incremental.incremental_ingest(spark, str(src), out, state, "FIXED")
    parts = incremental.current_tables(spark, out)
    full = ingest.ingest(spark, str(src), str(tmp_path / "full"), fmt="FIXED")
    names = lambda df: sorted(os.path.basename(r["path"]) for r in df.collect())
    assert names(parts["rejects"]) == names(full["rejects"]) == ["bytes.COB", "x.cbl"]
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(parts["vectors"]) == ids(full["vectors"]) and len(ids(parts["vectors"])) == 3
    for name, key in (("programs", "name"), ("entities", "id"), ("contains", "entity_id")):
        cols = [c for c in full[name].columns if c != "last_updated"]
        assert sorted(map(str, parts[name].select(cols).collect())) == sorted(map(str, full[name].select(cols).collect())), name
    pair = lambda df: sorted((r["source"], r["target"]) for r in df.collect())
    assert pair(parts["calls"]) == pair(full["calls"])
    # the state folder is lost: all files come again under a new stream, and nothing is lost or doubled
    before = {n: df.count() for n, df in parts.items()}
    incremental.incremental_ingest(spark, str(src), out, str(tmp_path / "state2"), "FIXED")
    assert {n: df.count() for n, df in incremental.current_tables(spark, out).items()} == before
    assert {n: df.count() for n, df in incremental.current_tables(spark, out, 2).items()} == before


def data_files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_delta_log_costs_what_a_batch_brings(spark, tmp_path):
    root = str(tmp_path / "log")
    table = {"t": delta_log.Keyed(["id"], ["stamp"])}

    def rows(ids, stamp, value):
        return {"t": spark.createDataFrame([(i, stamp, value) for i in ids], "id long, stamp long, value string")}

    def now(version=None):
        return {r["id"]: r["value"] for r in delta_log.current(spark, root, "t", table["t"], version).collect()}

    delta_log.append(spark, root, rows(range(400), 1, "old"), table, "s", 0, buckets=8, max_deltas=3)
    first = data_files(root)
    assert 0 < len(first) <= 8
    for batch in range(1, 4):
        before = data_files(root)
        delta_log.append(spark, root, rows([batch], 1 + batch, "new"), table, "s", batch, max_deltas=3)
        # one row: one file, whatever the table holds; nothing stored is touched
        assert before < data_files(root) and len(data_files(root) - before) <= 2
    expected = {i: "new" if i in (1, 2, 3) else "old" for i in range(400)}
    assert now() == expected
    # an older row does not replace a newer one, an equal one does
    delta_log.append(spark, root, rows([1, 5], 1, "late"), table, "s", 4, max_deltas=3)
    assert now() == expected | {5: "late"} and now(4) == expected
    # a batch that is in already changes nothing
    before = data_files(root)
    assert delta_log.append(spark, root, rows(range(400), 9, "again"), table, "s", 4) == 5
    assert data_files(root) == before and now() == expected | {5: "late"}
    # deltas pile up on one bucket only: that one is compacted
    for batch in range(5, 12):
        before = data_files(root)
        delta_log.append(spark, root, rows([7], 20 + batch, f"v{batch}"), table, "s", batch, max_deltas=3)
        assert len(data_files(root) - before) <= 2
    assert now() == expected | {5: "late", 7: "v11"}
    state = snapshots.read(spark, root)
    assert max(delta_log._held(state["tables"]["t"]).values()) <= 3
    left = snapshots.vacuum(spark, root)
    assert left and now() == expected | {5: "late", 7: "v11"} and snapshots.unreferenced(spark, root) == []


def test_two_writers_of_one_version(spark, tmp_path):
    root = str(tmp_path / "w")
    snapshots.publish(spark, root, {"version": 1, "tables": {}})
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(spark, root, {"version": 1, "tables": {"x": []}})
    assert snapshots.read(spark, root) == {"version": 1, "tables": {}} and snapshots.versions(spark, root) == [1]


def test_nothing_is_published_with_repeated_keys(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            runs.add(len(pdf))
            yield pdf

    root = str(tmp_path / "g")
    rows = spark.createDataFrame([(f"P{i}", None, None) for i in range(50)], schemas.PROGRAMS)
    twice = rows.unionByName(rows.limit(1)).mapInPandas(counted, schemas.PROGRAMS)
    with pytest.raises(ValueError):
        graph.write_graph({"programs": twice}, root)
    # one computation for the audit and the write, and a reader sees nothing
    assert runs.value == 51 and snapshots.versions(spark, root) == []
    with pytest.raises(ValueError):
        graph.read_graph(spark, root, ["programs"])
    graph.write_graph({"programs": rows}, root)
    assert graph.read_graph(spark, root, ["programs"])["programs"].count() == 50
    with pytest.raises(ValueError):
        graph.write_graph({"programs": rows}, root)


def test_texts_of_a_job_are_parsed_once(spark, tmp_path, monkeypatch):
    """One parse per text, and what is contained or called is read from tables; a batch that comes again is not parsed at all."""
    parsed, with_sentences = [], structure.with_sentences

    def counted(*args):
        parsed.append(args)
        return with_sentences(*args)

    monkeypatch.setattr(structure, "with_sentences", counted)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.cbl").write_text(P.CALLS)
    ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert len(parsed) == 1
    sources = spark.createDataFrame([("/p/a.cbl", "a.cbl", P.CALLS)], "path string, file_name string, content string")
    tables = ingest.graph_tables(sources)
    for name in ("entities", "contains", "calls", "programs"):
        assert "Generate" not in tables[name]._jdf.queryExecution().optimizedPlan().toString(), name
    parsed.clear()
    root = str(tmp_path / "log")
    assert incremental.merge_batch(spark, sources, root, 0) == 1 and len(parsed) == 1
    before = {n: df.count() for n, df in incremental.current_tables(spark, root).items()}
    assert incremental.merge_batch(spark, sources, root, 0) == 1 and len(parsed) == 1
    assert {n: df.count() for n, df in incremental.current_tables(spark, root).items()} == before
    for batch in (1, 2):
        incremental.incremental_ingest(spark, str(tmp_path / "in"), str(tmp_path / "live"), str(tmp_path / f"state{batch}"))
    assert len(parsed) == 3
    # columns that nobody reads stay in their files, also where the newest row of a key has to be found
    ids = incremental.current_tables(spark, str(tmp_path / "live"))["vectors"].select("id")
    read = [part.split("\n")[0] for part in ids._jdf.queryExecution().executedPlan().toString().split("ReadSchema:")[1:]]
    assert ids.count() == 1 and read and not any("embedding" in columns for columns in read)
