import pytest
from pyspark.sql import functions as F

from copperline.functions import source_text as st
from copperline.operators import calls, data_items as di, entities, statements as stm, structure
from tests.conftest import fixed
from tests import programs as P


def parsed(src):
    divisions = structure.divisions(structure.units(src, "FIXED"))
    return divisions, structure.sections(divisions)


def test_names(make):
    got = {r["file_name"]: r for r in structure.programs(structure.units(make(one=P.SIMPLE, copy=fixed("01 X PIC 9."), none=P.PROSE), "FIXED")).collect()}
    assert got["one.cbl"]["name"] == "ONLYONE" and got["one.cbl"]["unit_name"] == "One"
    assert got["copy.cbl"]["program_id"] is None and got["copy.cbl"]["name"] == "Copy"


def test_calls_all_and_flat(make):
    _, sec = parsed(make(m=P.CALLS))
    rows = calls.call_statements(sec).collect()
    assert {(r["target"], r["is_dynamic"], r["depth"]) for r in rows} == {
        ("HELPER-A", False, 0), ("HELPER-B", False, 0), ("MOD-NAME", True, 0), ("HIDDEN", False, 1)
    }
    every = {r["target"] for r in calls.extract_calls(sec).collect()}
    flat = {r["target"] for r in calls.extract_calls(sec, "flat").collect()}
    assert every - flat == {"HIDDEN"}
    assert calls.extract_calls(sec).count() == 4


def test_flat_scope_leaves_out_paragraphs_without_section(make):
    loose = P.program("LOOSE", procedure=["PARA-1.", "    CALL 'A'."])
    inside = P.program("INSIDE", procedure=["S1 SECTION.", "    CALL 'IN-SECTION'.", "PARA-1.", "    CALL 'B'."])
    div, sec = parsed(make(loose=loose, inside=inside))
    assert {r["target"] for r in calls.extract_calls(sec, "flat").collect()} == {"B"}
    assert {r["target"] for r in calls.extract_calls(sec).collect()} == {"A", "B", "IN-SECTION"}
    flat = {(r["program"], r["name"]) for r in entities.extract_entities(div, "flat").collect()}
    assert ("LOOSE", "PARA-1") not in flat and ("INSIDE", "PARA-1") in flat


def test_entities(make):
    div, _ = parsed(make(f=P.FILES))
    got = [(r["name"], r["type"], r["section"], r["description"]) for r in entities.extract_entities(div).orderBy("seq").collect()]
    assert got == [
        ("WORKING-STORAGE SECTION", "SECTION", "DATA_DIVISION", "Variables section"),
        ("EOF-FLAG", "VARIABLE", "WORKING_STORAGE", "Level: 1, Type: X"),
        ("AT-EOF", "VARIABLE", "WORKING_STORAGE", "Level: 88"),
        ("FILE SECTION", "SECTION", "DATA_DIVISION", "File storage definition section"),
        ("STOCK-FILE", "FILE", "FILE_SECTION", "File Description"),
        ("STOCK-REC", "RECORD", "FILE_SECTION", "Level: 1"),
        ("STOCK-ID", "FIELD", "FILE_SECTION", "Level: 5, Type: 9(5)"),
        ("STOCK-TEXT", "FIELD", "FILE_SECTION", "Level: 5, Type: X(30)"),
        ("MAIN-LINE", "PARAGRAPH", "PROCEDURE_DIVISION", "Paragraph in FILER"),
        ("SHOW-ONE", "PARAGRAPH", "PROCEDURE_DIVISION", "Paragraph in FILER"),
    ]


def test_program_without_entities(make):
    div, sec = parsed(make(e=P.EMPTY))
    assert entities.extract_entities(div).count() == 0
    assert calls.extract_calls(sec).count() == 0


def test_nested_items_and_statements(make):
    div, sec = parsed(make(n=P.NESTED))
    paths = {r["name"]: (r["qpath"], r["kind"]) for r in di.data_items(div).collect()}
    assert paths["ZIP"] == ("client.home.zip", "SCALAR")
    assert paths["HOME"] == ("client.home", "GROUP")
    assert paths["NOTE"] == ("client.note", "SCALAR")
    rows = stm.statements(sec).orderBy("sent_no", "stmt_no").collect()
    assert [(r["verb"], r["depth"], r["parent_no"], r["paragraph"]) for r in rows] == [
        ("PERFORM", 0, None, "START-IT"), ("PERFORM", 1, 0, "START-IT"), ("STOP", 0, None, "START-IT"), ("DISPLAY", 0, None, "STEP-100"),
    ]


def tree(make, *procedure):
    _, sec = parsed(make(t=P.program("T", procedure=list(procedure))))
    return [(r["verb"], r["depth"], r["parent_no"]) for r in stm.statements(sec).orderBy("sent_no", "stmt_no").collect()]


def test_read_clauses_nest(make):
    assert tree(
        make, "    READ F NEXT RECORD INTO R", "       INVALID KEY DISPLAY 'a'", "       NOT INVALID KEY DISPLAY 'b'",
        "       AT END DISPLAY 'c'", "       NOT AT END DISPLAY 'd'.",
    ) == [("READ", 0, None)] + [("DISPLAY", 1, 0)] * 4


def test_end_word_closes_inner_statements(make):
    got = tree(
        make, "    IF A > 1", "       READ F AT END DISPLAY 'x'", "    END-IF", "    DISPLAY 'after'.", "    DISPLAY 'next'."
    )
    assert got == [("IF", 0, None), ("READ", 1, 0), ("DISPLAY", 2, 1), ("DISPLAY", 0, None), ("DISPLAY", 0, None)]


def test_else_evaluate_and_size_error(make):
    got = tree(
        make, "    IF A = 1 IF B = 2 MOVE 1 TO C ELSE MOVE 2 TO C END-IF", "    ELSE EVALUATE TRUE", "      WHEN X = 1 ADD 1 TO X ON SIZE ERROR STOP RUN",
        "      WHEN OTHER CALL 'Z' ON EXCEPTION DISPLAY 'no'", "      END-CALL END-EVALUATE DISPLAY 'e' END-IF DISPLAY 'f'.",
    )
    assert got == [
        ("IF", 0, None), ("IF", 1, 0), ("MOVE", 2, 1), ("MOVE", 2, 1), ("EVALUATE", 1, 0), ("ADD", 2, 4), ("STOP", 3, 5),
        ("CALL", 2, 4), ("DISPLAY", 3, 7), ("DISPLAY", 1, 0), ("DISPLAY", 0, None),
    ]


def test_embedded_sql_is_one_statement(make):
    assert tree(make, "    EXEC SQL SELECT A FROM B WHERE SET = 1 OPEN X END-EXEC.", "    CLOSE F.") == [("EXEC", 0, None), ("CLOSE", 0, None)]


def test_many_statements_in_one_sentence_stay_linear(make):
    body = ["    IF A > 1"] + ["      MOVE 1 TO B", "      ADD 1 TO C"] * 1500 + ["    END-IF", "    STOP RUN."]
    got = tree(make, *body)
    assert len(got) == 3002 and got[1500] [1:] == (1, 0) and got[-1] == ("STOP", 0, None)


def test_continued_literals_comments_and_tags(make):
    text = "\n".join([
        "000100 IDENTIFICATION DIVISION.".ljust(72) + "TAG00001",
        "000200 PROGRAM-ID.".ljust(72) + "TAG00001",
        "000300     CONT1.".ljust(72) + "TAG00001",
        "000400* it's a comment. 01 NOT-HERE PIC X.",
        "000500/ page break",
        "000600 DATA DIVISION.".ljust(72) + "TAG00001",
        "000700 WORKING-STORAGE SECTION.",
        ("000800 01 T PIC X(90) VALUE " + '"' + "ABC").ljust(72) + "TAG00001",
        '000900-    "DEF. GHI".',
        "001000 01 U PIC 9(3)",
        "001100-                V99 VALUE 1.5.",
        "001200 01 V PIC X. *> 01 W PIC X.",
        "001300 PROCEDURE DIVISION.",
        "001400     STOP RUN.",
    ])
    div, _ = parsed(make(c=text))
    items = {r["name"]: r for r in di.data_items(div).collect()}
    assert set(items) == {"T", "U", "V"}
    pad = 72 - len("000800 01 T PIC X(90) VALUE " + '"' + "ABC")
    assert items["T"]["value_raw"] == '"ABC' + " " * pad + 'DEF. GHI"'
    assert (items["U"]["pic"], items["U"]["value_raw"]) == ("9(3)V99", "1.5")


def test_clauses(make):
    text = P.program("CL", [
        "WORKING-STORAGE SECTION.", "77 A PICTURE IS X(9).", "77 B PIC 99 COMP.", "01 FILLER.", "   05 FILLER PIC X(20) VALUE 'V. W'.",
        "   05 C OCCURS 2 TO 7 TIMES DEPENDING ON B", "      PIC S9(4)V9(2) COMP-3 VALUE -1.5.", "   05 D REDEFINES C.", "      07 E PIC 9(4).",
        "66 R RENAMES C THRU D.", "01 F PIC Z(3).99 VALUE ZERO.", "   88 F-OK VALUES 1 THRU 5, 9.",
    ], ["    STOP RUN."])
    div, _ = parsed(make(c=text))
    rows = {(r["name"], r["filler_no"]): r for r in di.data_items(div).collect()}
    assert rows[("A", None)]["pic"] == "X(9)" and rows[("B", None)]["usage"] == "COMP"
    c = rows[("C", None)]
    assert (c["occurs_from"], c["occurs_to"], c["pic"], c["usage"], c["value_raw"]) == (2, 7, "S9(4)V9(2)", "COMP-3", "-1.5")
    assert rows[("FILLER", 0)]["level"] == 1 and rows[("FILLER", 1)]["qpath"] == "filler0.filler1"
    assert rows[("D", None)]["redefines"] == "C" and rows[("E", None)]["qpath"] == "filler0.d.e"
    assert (rows[("R", None)]["renames_from"], rows[("R", None)]["renames_thru"], rows[("R", None)]["kind"]) == ("C", "D", "RENAME")
    assert rows[("F-OK", None)]["parent_no"] == rows[("F", None)]["item_no"]
    assert rows[("F", None)]["pic"] == "Z(3).99"


def test_two_units_in_one_file(make):
    div, sec = parsed(make(two=P.CALLS + "\n" + P.program("SECOND", procedure=["    CALL 'OTHER'.", "    GOBACK."])))
    got = {(r["source"], r["target"]) for r in calls.extract_calls(sec).collect()}
    assert ("SECOND", "OTHER") in got and ("MASTER", "HELPER-A") in got and ("MASTER", "OTHER") not in got


def test_headers_and_identification(make):
    text = fixed(
        "IDENTIFICATION DIVISION.", "PROGRAM-ID. 'QUOTED'.", "AUTHOR. J. O'BRIEN.", "INSTALLATION. PLANT 7.", "REMARKS. FIRST. SECOND.",
        "ENVIRONMENT DIVISION.", "CONFIGURATION SECTION.", "SOURCE-COMPUTER. BIG.", "PROCEDURE DIVISION.", "P-1.", "    EXIT.",
    )
    div, sec = parsed(make(q=text))
    fact = structure.identification_facts(div).first()
    assert (fact["program"], fact["author"], fact["installation"], fact["remarks"]) == ("QUOTED", "J. O'BRIEN", "PLANT 7", "FIRST. SECOND")
    rows = structure.sentences_of(sec)
    assert [r["text"] for r in structure.headers(rows, "DIVISION").orderBy("sent_no").collect()] == [
        "IDENTIFICATION DIVISION", "ENVIRONMENT DIVISION", "PROCEDURE DIVISION"]
    assert {r["paragraph"] for r in structure.headers(rows, "PARAGRAPH").collect()} >= {"SOURCE-COMPUTER", "P-1", "AUTHOR"}


@pytest.mark.parametrize("text,fmt,copybook", [
    ("000100* note".ljust(72) + "12345678\n" + "000200 IDENTIFICATION DIVISION.".ljust(72) + "12345678\n", "FIXED", False),
    ("000100* note\n000200 Identification Division.\n000300 Program-Id. X.", "VARIABLE", False),
    ("* note\n IDENTification Division.\n\n Program-Id. X.", "TANDEM", False),
    ("000100 01 REC.\n000200    05 A PIC X.", "FIXED", True),
    ("", "FIXED", True),
    (" identification division.\n" + "000200 identification division.".ljust(72) + "ABCDEFGH", "FIXED", False),
])
def test_line_format_and_copybook(spark, text, fmt, copybook):
    row = spark.createDataFrame([(text,)], "t string").select(
        st.line_format(F.col("t")).alias("f"), st.is_copybook(F.col("t")).alias("c")).first()
    assert (row["f"], row["c"]) == (fmt, copybook)


def test_partitioning_does_not_change_results(make):
    src = make(a=P.CALLS, b=P.FILES, c=P.NESTED, d=P.SIMPLE)
    def rows(df):
        div, sec = parsed(df)
        return sorted(map(str, entities.extract_entities(div).collect())), sorted(map(str, stm.statements(sec).collect()))
    assert rows(src.repartition(1)) == rows(src.repartition(7))
