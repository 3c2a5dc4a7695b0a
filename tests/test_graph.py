import datetime as dt

import pytest
from pyspark.sql import functions as F

from copperline.operators import calls, copybooks, data_items as di, facts, graph, layout, lineage, paths, statements as stm, structure, topk
from copperline.operators.skew import hot_keys, hot_shares, salted_join
from copperline.session import materialize
from copperline.plans import ask, ingest
from tests import programs as P
from tests.conftest import fixed

def stamp():
    return F.lit(dt.datetime(2024, 1, 1)).cast("timestamp")



def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, "CALLS") for a, b in pairs], "source string, target string, rel_type string")


def test_graph_tables(make):
    helper = P.program("HELPER-A", procedure=["    CALL 'LIBRARY'.", "    GOBACK."])
    tables = ingest.graph_tables(make(m=P.CALLS, h=helper, e=P.EMPTY), "FIXED", as_of=stamp())
    nodes = {r["name"]: r["file_path"] for r in tables["programs"].collect()}
    assert nodes["MASTER"] == "/src/m.cbl" and nodes["NOTHING"] == "/src/e.cbl"
    assert nodes["LIBRARY"] is None and nodes["HIDDEN"] is None and len(nodes) == 7
    assert {(r["source"], r["target"]) for r in tables["calls"].collect()} == {
        ("MASTER", "HELPER-A"), ("MASTER", "HELPER-B"), ("MASTER", "MOD-NAME"), ("MASTER", "HIDDEN"), ("HELPER-A", "LIBRARY")}
    assert {r["entity_id"] for r in tables["contains"].collect()} == {
        "MASTER:WORKING-STORAGE SECTION", "MASTER:ARG", "MASTER:MOD-NAME"}
    assert graph.duplicate_keys(tables["programs"], ["name"]).isEmpty()


def test_unknown_sources_get_no_edge(spark):
    kept, nodes = graph.build_edges(edges(spark, ("A", "B"), ("Z", "A")), spark.createDataFrame([("A",)], "name string"))
    assert [(r["source"], r["target"]) for r in kept.collect()] == [("A", "B")]
    assert {r["name"] for r in nodes.collect()} == {"A", "B"}


def test_last_write_wins(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 3, "c"), ("k", 2, "b"), ("j", 1, None)], "key string, ts int, v string")
    assert sorted(map(tuple, graph.latest(rows, ["key"], ["ts"]).collect())) == [("j", 1, None), ("k", 3, "c")]


def test_merge_and_prune(spark):
    old = spark.createDataFrame([("A:x", "A", 1), ("A:y", "A", 1), ("B:z", "B", 1)], "id string, program string, ver int")
    new = spark.createDataFrame([("A:x", "A", 2)], "id string, program string, ver int")
    kept = {(r["id"], r["ver"]) for r in graph.merge_tables(old, new, ["id"], ["ver"]).collect()}
    assert kept == {("A:x", 2), ("A:y", 1), ("B:z", 1)}
    pruned = {r["id"] for r in graph.merge_tables(old, new, ["id"], ["ver"], prune_on="program").collect()}
    assert pruned == {"A:x", "B:z"}


def test_paths_of_two_lengths(spark):
    e = edges(spark, ("UTILITY", "LIBRARY"), ("APPLICATION", "UTILITY"), ("APPLICATION", "LIBRARY"))
    found = paths.reachable_paths(e, "APPLICATION", "LIBRARY", 5).collect()
    assert sorted(r["length"] for r in found) == [1, 2]


def brute_paths(pairs, depth):
    out, frontier = [], [((a, b),) for a, b in set(pairs)]
    for _ in range(depth):
        out += [(p[0][0], p[-1][1], len(p)) for p in frontier]
        frontier = [p + ((a, b),) for p in frontier for a, b in set(pairs) if a == p[-1][1] and (a, b) not in p]
    return sorted(out)


@pytest.mark.parametrize("pairs", [
    [("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("d", "d"), ("c", "d")],
    [("x", "hub")] + [(f"n{i}", "hub") for i in range(40)] + [("hub", "y"), ("y", "z"), ("hub", "z"), ("z", "hub")],
])
def test_paths_against_brute_force(spark, pairs):
    got = sorted(map(tuple, paths.reachable_paths(edges(spark, *pairs), max_depth=6).collect()))
    assert got == brute_paths(pairs, 6)
    shortest = {}
    for s, t, n in brute_paths(pairs, 12):
        shortest[s, t] = min(n, shortest.get((s, t), n))
    reach = {(r["source"], r["target"]): r["length"] for r in paths.reachability(edges(spark, *pairs)).collect()}
    assert reach == shortest


def test_paths_between_named_ends(spark, monkeypatch):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("d", "e"), ("e", "d"), ("a", "x1"), ("x1", "x2"), ("x2", "x1"), ("c", "e")]
    pairs += [(f"n{i}", "a") for i in range(30)] + [("e", f"leaf{i}") for i in range(30)]
    every = brute_paths(pairs, 12)
    wanted = [("a", "d"), ("n1", "c"), ("n2", "e"), ("a", "a"), ("x1", "a"), ("a", "nowhere"), ("a", "d")]
    made = []

    def seen(df):
        out = materialize(df)
        if "goal" in out.columns and "used" in out.columns:
            made.append(out)
        return out

    monkeypatch.setattr(paths, "materialize", seen)
    got = sorted(map(tuple, paths.paths_between(edges(spark, *pairs), spark.createDataFrame(wanted, "source string, target string")).collect()))
    assert got == sorted(p for p in every if p[:2] in set(wanted)) and {p[:2] for p in got} == {("a", "d"), ("n1", "c"), ("n2", "e"), ("a", "a")}
    # no round holds a path that cannot arrive
    arrives = {(s, t) for s, t, _ in every}
    rows = [r for df in made for r in df.collect()]
    assert rows and all(r["at"] == r["goal"] or (r["at"], r["goal"]) in arrives for r in rows)
    assert sorted(map(tuple, paths.reachable_paths(edges(spark, *pairs), "a", "e").collect())) == sorted(p for p in every if p[:2] == ("a", "e"))
    assert sorted(map(tuple, paths.reachable_paths(edges(spark, *pairs), dst="c", max_depth=3).collect())) == sorted(
        p for p in every if p[1] == "c" and p[2] <= 3)
    assert paths.paths_between(edges(spark, *pairs), spark.createDataFrame([("x1", "a")], "source string, target string")).isEmpty()


def test_paths_between_do_not_pay_for_all_that_leads_to_a_target(spark, monkeypatch):
    """Targets near their sources on a deep graph: what is made follows the paths, not the hundreds that lead to each target."""
    monkeypatch.setattr(paths, "LEAST_SHARE", 0)
    pairs = [(f"p{k}", f"p{t}") for k in range(1, 600) for t in {k // 2, *([k // 3] if k % 3 == 0 else [])}] + [("p0", "p0")]
    wanted = [(f"p{k}", f"p{t}") for k in range(1, 600) for t in (k // 8, k // 9)]
    made = []

    def seen(df):
        made.append(materialize(df))
        return made[-1]

    monkeypatch.setattr(paths, "materialize", seen)
    got = sorted(map(tuple, paths.paths_between(edges(spark, *pairs), spark.createDataFrame(wanted, "source string, target string")).collect()))
    assert got == sorted(p for p in brute_paths(pairs, 12) if p[:2] in set(wanted))
    # all that leads to the targets makes it 16 for each pair
    assert sum(df.count() for df in made) < 14 * len(wanted)


def test_ranks_are_longer_than_those_of_all_that_leads_there(spark, monkeypatch):
    links = edges(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("x", "c"))
    known = {"b": 2, "c": 3, "d": None, "e": None, "f": None}
    assert dict(map(tuple, paths._ranks(links.select("source", "target")).collect())) == known
    monkeypatch.setattr(paths, "_PEEL", 0)
    assert dict(map(tuple, paths._ranks(links.select("source", "target")).collect())) == {**known, "c": None}


def test_hot_shares_follow_the_counts(spark):
    many = spark.range(1000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key"), "id")
    assert hot_shares(many, "key") == {}
    hot = hot_shares(many, "key", least=1)
    assert list(hot) == ["hot"] and hot["hot"] >= 2
    one = spark.createDataFrame([("hot", 1), ("k1", 2)], "key string, v int")
    for how in ("inner", "left"):
        a = sorted(map(str, salted_join(many, one, "key", F.col("id"), hot, how).select("key", "id", "v").collect()))
        assert a == sorted(map(str, many.join(one, "key", how).select("key", "id", "v").collect()))


def test_salted_join_keeps_everything(spark):
    many = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50))).alias("key"), "id")
    one = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3)], "key string, v int")
    hot = hot_keys(many, "key", 0.1)
    assert hot == ["hot"]
    for how in ("inner", "left"):
        a = sorted(map(str, salted_join(many, one, "key", F.col("id"), hot, how).select("key", "id", "v").collect()))
        assert a == sorted(map(str, many.join(one, "key", how).select("key", "id", "v").collect()))


def test_lookups(spark):
    e = edges(spark, ("A", "C"), ("A", "B"), ("B", "C"))
    assert {r["source"]: r["deps"] for r in graph.callee_lists(e).collect()} == {"A": ["B", "C"], "B": ["C"]}
    assert graph.first_edge(e, "A").first()["target"] == "B"
    assert graph.callees(e, "nobody").isEmpty()
    got = graph.run_query(spark, {"calls": e}, "SELECT :param AS v, count(*) AS n FROM calls WHERE source = :s", {"param": "test_value", "s": "A"}).first()
    assert (got["v"], got["n"]) == ("test_value", 2)


def test_write_and_read_graph(spark, tmp_path, make):
    tables = ingest.graph_tables(make(m=P.CALLS), "FIXED", as_of=stamp())
    graph.write_graph(tables, str(tmp_path / "g"))
    back = graph.read_graph(spark, str(tmp_path / "g"), list(tables))
    assert all(sorted(map(str, back[n].collect())) == sorted(map(str, tables[n].collect())) for n in tables)
    twice = {"programs": tables["programs"].unionByName(tables["programs"])}
    with pytest.raises(ValueError):
        graph.write_graph(twice, str(tmp_path / "h"))


def test_copybooks(spark, make):
    books = spark.createDataFrame([
        ("CUSTREC", "/c/1", fixed("01 CUST-RECORD.", "   05 CUST-NO PIC 9(5).", "COPY INNER.") + "\n"), ("INNER", "/c/2", fixed("   05 DEEP PIC X.")),
    ], "name string, path string, content string")
    text = P.program("USER1", ["WORKING-STORAGE SECTION.", "COPY custrec.", "01 LAST-ONE PIC X.", "COPY 'ABSENT'."], ["    DISPLAY 'COPY CUSTREC.'.", "    GOBACK."])
    full = copybooks.expand_copybooks(make(u=text, plain=P.SIMPLE), books)
    div = structure.divisions(structure.units(full, "FIXED"))
    assert [r["qpath"] for r in di.data_items(div).where("program = 'USER1'").orderBy("item_no").collect()] == [
        "cust_record", "cust_record.cust_no", "cust_record.deep", "last_one"]
    assert full.where("file_name = 'plain.cbl'").first()["content"] == P.SIMPLE
    assert {r["target"] for r in calls.extract_copies(structure.sentences(make(u=text), "FIXED")).collect()} == {"CUSTREC", "ABSENT"}


def test_copybook_circle_is_an_error(spark, make):
    books = spark.createDataFrame([("A", "1", fixed("COPY B.")), ("B", "2", fixed("COPY A."))], "name string, path string, content string")
    with pytest.raises(ValueError):
        copybooks.expand_copybooks(make(u=P.SIMPLE), books)


def procedure(make, *lines, data=(), env=()):
    text = P.program("PX", list(data), list(lines), list(env))
    div = structure.divisions(structure.units(make(px=text), "FIXED"))
    sec = structure.sections(div)
    return div, structure.sentences_of(sec), stm.statements(sec)


def test_open_modes_and_close(make):
    _, _, st = procedure(
        make, "    OPEN INPUT F1 WITH NO REWIND F2 REVERSED", "      OUTPUT F3 WITH NO REWIND I-O F4 F5", "      EXTEND F4 F5.",
        "    CLOSE F1 UNIT FOR REMOVAL WITH LOCK F2 REEL.", "    CLOSE F5 WITH NO WAIT USING DISP-X ORDERLY.", "    READ F1 NEXT RECORD INTO REC-A.")
    rows = facts.extract_file_usage(st).orderBy("sent_no", "position").collect()
    assert [(r["verb"], r["mode"], r["file_name"]) for r in rows] == [
        ("OPEN", "INPUT", "F1"), ("OPEN", "INPUT", "F2"), ("OPEN", "OUTPUT", "F3"), ("OPEN", "I-O", "F4"), ("OPEN", "I-O", "F5"),
        ("OPEN", "EXTEND", "F4"), ("OPEN", "EXTEND", "F5"), ("CLOSE", None, "F1"), ("CLOSE", None, "F2"), ("CLOSE", None, "F5"), ("READ", None, "F1")]
    assert rows[-1]["into_name"] == "REC-A"


def test_many_copy_lines_and_a_circle_of_several_lines(spark, make):
    import time

    books = spark.createDataFrame([(f"B{i}", f"/b{i}", f"000100 01 ITEM-{i} PIC X.") for i in range(50)], "name string, path string, content string")
    text = "\n".join(f"000100 COPY B{i % 50}." for i in range(1000)) + "\n000200 COPY NOBODY."
    start = time.time()
    got = copybooks.expand_copybooks(make(big=text), books).first()["content"]
    assert got.count("ITEM-7 ") == 20 and "COPY B" not in got and got.endswith("COPY NOBODY.") and time.time() - start < 60
    ring = spark.createDataFrame([("A", "/a", "000100 COPY B.\n000200 COPY B."), ("B", "/b", "000100 COPY A.\n000200 COPY A.")],
                                 "name string, path string, content string")
    with pytest.raises(ValueError):
        copybooks.expand_copybooks(make(u=text), ring)


def test_perform_thru_sections_and_unknown_ends(make):
    div, _, st = procedure(
        make, "MAIN SECTION.", "BEGIN-IT.", "    PERFORM S-ONE THRU S-TWO.", "    PERFORM S-ONE THRU NOWHERE.", "    PERFORM P-TWO THRU P-ONE.", "    STOP RUN.",
        "S-ONE SECTION.", "P-ONE.", "    EXIT.", "S-TWO SECTION.", "P-TWO.", "    EXIT.")
    rows = facts.extract_control_flow(st, facts.paragraph_order(div)).orderBy("sent_no", "position").collect()
    assert [r["target"] for r in rows if r["verb"] == "PERFORM"] == ["S-ONE", "S-TWO", "S-ONE", "NOWHERE", "P-TWO", "P-ONE"]


def test_control_flow(make):
    div, _, st = procedure(
        make, "BEGIN-IT.", "    PERFORM PROC2 THROUGH PROC4.", "    PERFORM PROC3 2 TIMES.", "    PERFORM PROC1 WITH TEST AFTER UNTIL A = 1.",
        "    PERFORM 2 TIMES DISPLAY 'x' END-PERFORM.", "PROC1.", "    GO TO PROC2 PROC3 PROC4 DEPENDING ON N.", "PROC2.", "    GO TO PROC2.", "PROC3.", "    GO PROC1.", "PROC4.", "    EXIT.")
    rows = facts.extract_control_flow(st, facts.paragraph_order(div)).orderBy("sent_no", "position").collect()
    assert [(r["paragraph"], r["verb"], r["mode"], r["position"], r["target"], r["self_loop"]) for r in rows] == [
        ("BEGIN-IT", "PERFORM", "ONCE", 1, "PROC2", False), ("BEGIN-IT", "PERFORM", "ONCE", 2, "PROC3", False), ("BEGIN-IT", "PERFORM", "ONCE", 3, "PROC4", False),
        ("BEGIN-IT", "PERFORM", "TIMES", 1, "PROC3", False), ("BEGIN-IT", "PERFORM", "UNTIL AFTER", 1, "PROC1", False),
        ("PROC1", "GO TO", "DEPENDING", 1, "PROC2", False), ("PROC1", "GO TO", "DEPENDING", 2, "PROC3", False), ("PROC1", "GO TO", "DEPENDING", 3, "PROC4", False),
        ("PROC2", "GO TO", "SIMPLE", 1, "PROC2", True), ("PROC3", "GO TO", "SIMPLE", 1, "PROC1", False)]


def test_moves_and_sql(make):
    div, _, st = procedure(
        make, "    MOVE \"a TO b\" TO T1, T2.", "    MOVE G1 TO G2 (1).", "    MOVE CORRESPONDING G1 TO G2.", "    EXEC SQL SELECT * FROM clients END-EXEC.",
        data=["WORKING-STORAGE SECTION.", "01 G1.", "   05 T1 PIC X.", "01 G2.", "   05 T2 PIC X."])
    rows = facts.extract_moves(st, di.data_items(div)).orderBy("sent_no", "position").collect()
    assert [(r["sending"], r["receiver"], r["corresponding"], r["to_group"]) for r in rows] == [
        ('"a TO b"', "T1", False, False), ('"a TO b"', "T2", False, False), ("G1", "G2", False, True), ("G1", "G2", True, True)]
    assert facts.extract_exec_sql(st).first()["sql_text"] == "SELECT * FROM clients"


def test_file_lineage(make):
    div, sents, st = procedure(
        make, "    WRITE ITEMS FROM X BEFORE ADVANCING 3 LINES.", "    OPEN OUTPUT FILE1.", "    WRITE LOOSE.",
        data=["FILE SECTION.", "FD FILE1.", "   01 ITEMS."], env=["INPUT-OUTPUT SECTION.", "FILE-CONTROL.", "    SELECT FILE1 ASSIGN TO 'file1.txt'.", "    SELECT OTHER."])
    got = lineage.file_lineage(facts.extract_file_usage(st), di.file_records(di.data_items(div)), facts.extract_file_control(sents)).collect()
    assert {(r["file_name"], r["fd_name"], r["external_name"]) for r in got} == {("ITEMS", "FILE1", "file1.txt"), ("FILE1", "FILE1", "file1.txt"), ("LOOSE", "LOOSE", None)}
    assert {(r["file_name"], r["external_name"]) for r in facts.extract_file_control(sents).collect()} == {("FILE1", "file1.txt"), ("OTHER", None)}


def test_rules(spark, make):
    _, _, st = procedure(make, "    GO TO A.", "    DISPLAY 'x'.", "    STOP RUN.")
    rules = spark.createDataFrame([("GO", None, "goto", 0), ("GO", "TO A", "loop", 256)], "verb string, pattern string, rule string, priority int")
    got = {r["verb"]: r["rule"] for r in lineage.first_rule(st, rules, ["program"]).collect()}
    assert got == {"GO": "loop", "DISPLAY": None, "STOP": None}
    assert {r["verb"] for r in lineage.uncovered_verbs(st, rules).collect()} == {"DISPLAY", "STOP"}


def test_schema_of_records(make):
    div, _, _ = procedure(make, "    STOP RUN.", data=[
        "WORKING-STORAGE SECTION.", "01 ITEMS OCCURS 2 TIMES.", "   02 ITEM1 PIC X(10).", "   02 ITEM2 PIC 99 COMP.", "01 PERSON.", "   05 BORN PIC X(8).",
        "   05 PARTS REDEFINES BORN.", "      07 YY PIC 9(4).", "      07 MM PIC S9(2)V9.", "   05 CITY VALUE \"Arlington\".", "77 AMOUNT PIC 999V99.", "66 ALIAS-1 RENAMES ITEMS."])
    ddl = layout.record_ddl(div)
    assert layout.spark_schema(ddl, "PX", "ITEMS").simpleString() == "struct<item1:string,item2:decimal(2,0)>"
    assert layout.spark_schema(ddl, "PX", "PERSON").simpleString() == "struct<born:string,parts:struct<yy:decimal(4,0),mm:decimal(3,1)>,city:string>"
    assert layout.spark_schema(ddl, "PX", "AMOUNT").simpleString() == "struct<amount:decimal(5,2)>"
    assert {r["ddl"][:6] for r in ddl.where("name = 'items'").collect()} == {"ARRAY<"}
    alias = layout.renames_alias(di.data_items(div)).collect()
    assert [(r["name"], r["source_path"]) for r in alias] == [("ALIAS-1", "items")]
    with pytest.raises(KeyError):
        layout.spark_schema(ddl, "PX", "NONE")


def test_constraints(spark):
    record = layout.pic_layout(spark, {"name": "X(3)", "amount": "9(2)V9", "n": "9(2)"})
    df = spark.createDataFrame([(1, "abc", 12.5, 99), (2, "abcd", 123.0, 100), (3, None, 1.25, -5), (4, "", -99.9, None)], "id int, name string, amount double, n int")
    got = {(r["id"], r["column"]) for r in layout.constraint_violations(df, record, "id").collect()}
    assert got == {(2, "name"), (2, "amount"), (2, "n"), (3, "amount")}


def test_topk_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    data = rng.integers(-3, 4, size=(300, 5)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)] + [(999, None)], "vec_id long, embedding array<double>").repartition(5)
    queries = [("a", [1.0, 2.0, 0.0, 0.0, 1.0]), ("b", [0.0, 0.0, -1.0, 1.0, 0.0]), ("z", [0.0] * 5)]
    qdf = spark.createDataFrame(queries, "query_id string, embedding array<double>")

    def brute(q, n):
        q = np.array(q)
        if not q.any():
            return []
        norms = np.linalg.norm(data, axis=1)
        sims = [(-round(float(v @ q / norms[i] / np.linalg.norm(q)), 12), i) for i, v in enumerate(data) if norms[i]]
        return [i for _, i in sorted(sims)[:n]]

    got = {}
    for r in topk.vector_topk_batch(df, qdf, 7).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == {q: brute(v, 7) for q, v in queries if brute(v, 7)}
    assert [r["vec_id"] for r in topk.vector_topk(df, queries[0][1], 4).orderBy(F.desc("score"), "vec_id").collect()] == brute(queries[0][1], 4)
    # one query at a time or all at once: the same scores and ranks
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(topk.vector_topk_batch(df, qdf, 7, block_bytes=1)) == rows(topk.vector_topk_batch(df, qdf, 7))


def test_unknown_numbers_are_never_near(spark):
    df = spark.createDataFrame([(1, [float("nan"), 1.0]), (2, [1.0, 0.1]), (3, [1.0, 0.2])], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [float("nan"), 0.0]), ("c", None)], "query_id string, embedding array<double>")
    for size in (1, 1 << 20):
        got = topk.vector_topk_batch(df, queries, 2, block_bytes=size).orderBy("rank").collect()
        assert [(r["query_id"], r["id"]) for r in got] == [("a", 2), ("a", 3)]


def test_paths_have_no_depth_of_their_own(spark):
    chain = [(f"A{i}", f"A{i + 1}") for i in range(14)]
    found = paths.reachable_paths(edges(spark, *chain), "A0")
    assert sorted(r["length"] for r in found.collect()) == list(range(1, 15))


def test_retrieval(spark):
    docs = spark.createDataFrame([
        ("C_c.cbl", "customer processing code", {"program": "C", "file_name": "c.cbl"}), ("S_s.cbl", "stock code", {"program": "S", "source": "s-src"}),
        ("N", None, {"program": ""}),
    ], "id string, document string, metadata map<string,string>")
    from copperline.functions import vectors as vec

    vectors = vec.embed(docs, "document")
    asked = spark.createDataFrame([("1", "customer code?"), ("2", " "), ("3", None)], "query_id string, question string")
    found = ask.retrieve(vectors, edges(spark, ("C", "X"), ("C", "B")), asked, k=2)
    rows = {r["rank"]: r for r in found.collect()}
    assert rows[1]["segment"] == 'Code from c.cbl:\ncustomer processing code\nDependencies:\n["B", "X"]'
    assert rows[2]["segment"] == "Code from s-src:\nstock code\nDependencies:\n[]"
    text = {r["query_id"]: r["prompt"] for r in ask.build_prompts(asked, found).collect()}
    assert '["B", "X"]\n[]\n\nQuestion: customer code?' in text["1"]
    assert text["2"] == text["3"] == "Please provide a valid query about the COBOL codebase."


def test_equal_paths_are_counted(spark, monkeypatch):
    pairs = [p for i in range(5) for p in ((f"a{i}", f"b{i}"), (f"a{i}", f"c{i}"), (f"b{i}", f"a{i + 1}"), (f"c{i}", f"a{i + 1}"))]
    made = []

    def seen(df):
        made.append(materialize(df))
        return made[-1]

    monkeypatch.setattr(paths, "materialize", seen)
    got = sorted(map(tuple, paths.reachable_paths(edges(spark, *pairs), "a0").collect()))
    assert got == sorted(p for p in brute_paths(pairs, 10) if p[0] == "a0") and len(got) > 90
    assert sum(df.count() for df in made if "used" in df.columns) == 15


def test_seen_pairs_are_not_read_in_every_round(spark, monkeypatch):
    pairs = [(f"p{k}", f"p{k // 2}") for k in range(2, 48)] + [("p1", "u"), ("u", "v"), ("v", "u")]
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return materialize(df)

    monkeypatch.setattr(paths, "materialize", seen)
    monkeypatch.setattr(paths, "LEAST_SHARE", 0, raising=False)
    reach = {(r["source"], r["target"]): r["length"] for r in paths.reachability(edges(spark, *pairs)).collect()}
    shortest = {}
    for s, t, n in brute_paths(pairs, 12):
        shortest[s, t] = min(n, shortest.get((s, t), n))
    assert reach == shortest
    # between the lookups in all of them, only pairs that may lie on a cycle are compared
    assert any("AND again#" in p for p in plans if "LeftAnti" in p)
