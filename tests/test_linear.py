"""Row-local steps whose cost follows the size of a row, and control flow on hand-made programs."""

import time

import pytest
from pyspark.sql import functions as F

from copperline.functions import vectors as vec
from copperline.operators import data_items as di, flow, layout, structure
from tests.conftest import fixed


def seconds(df):
    best = float("inf")
    for _ in range(2):
        start = time.perf_counter()
        rows = df.collect()
        best = min(best, time.perf_counter() - start)
    return best, rows


def test_a_long_record_takes_linear_time(spark, make):
    def record(n):
        code = [" IDENTIFICATION DIVISION.", " PROGRAM-ID. A.", " DATA DIVISION.", " WORKING-STORAGE SECTION.", " 01 REC."]
        code += [f"   05 F-{i} PIC 9(3)." if i % 10 else f"   05 G-{i} OCCURS 2." for i in range(1, n)]
        code += ["     10 LAST-ONE PIC X." if (n - 1) % 10 == 0 else "   05 LAST-ONE PIC X."]
        return layout.record_ddl(structure.divisions(structure.units(make(a=fixed(*code)), "FIXED")))

    seconds(record(200))
    few, _ = seconds(record(1250))
    many, rows = seconds(record(5000))
    assert rows[0]["ddl"].count("DECIMAL(3,0)") == 4500 and many < 8 * few + 0.5


def test_nested_groups_and_odd_levels(spark, make):
    code = [" IDENTIFICATION DIVISION.", " PROGRAM-ID. A.", " DATA DIVISION.", " WORKING-STORAGE SECTION.",
            " 01 A.", "   05 B OCCURS 2.", "     10 C PIC X.", "     10 D OCCURS 3.", "       15 E PIC 9(2) OCCURS 4.", "   03 F PIC 9V9.", " 77 G PIC X(2).",
            " 01 H OCCURS 2.", "   02 I PIC 9.", " 01 J PIC X OCCURS 5."]
    rows = layout.record_ddl(structure.divisions(structure.units(make(a=fixed(*code)), "FIXED"))).orderBy("record_no").collect()
    assert [(r["name"], r["ddl"]) for r in rows] == [
        ("a", "STRUCT<`b`: ARRAY<STRUCT<`c`: STRING, `d`: ARRAY<STRUCT<`e`: ARRAY<DECIMAL(2,0)>>>>>, `f`: DECIMAL(2,1)>"), ("g", "STRING"),
        ("h", "ARRAY<STRUCT<`i`: DECIMAL(1,0)>>"), ("j", "ARRAY<STRING>"),
    ]


def test_embedding_counts_take_linear_time(spark):
    def embedded(n):
        return vec.embed(spark.createDataFrame([(" ".join(f"w{i % 977}" for i in range(n)),)], "text string"), "text")

    seconds(embedded(100))
    few, _ = seconds(embedded(20_000))
    many, rows = seconds(embedded(160_000))
    assert many < 16 * few + 0.5
    assert rows[0]["embedding"] == pytest.approx(vec.embed_question(" ".join(f"w{i % 977}" for i in range(160_000))))


def test_texts_carry_the_programs_decimal_sign(spark, make):
    def program(*special):
        return fixed(" IDENTIFICATION DIVISION.", " PROGRAM-ID. A.", " ENVIRONMENT DIVISION.", " CONFIGURATION SECTION.", *special,
                     " DATA DIVISION.", " WORKING-STORAGE SECTION.", " 77 N PIC 9V9 VALUE 1.5.", " 77 M PIC 9V99 VALUE 2,25.", " 77 S PIC X(3) VALUE 'a.b'.")

    texts = {}
    for name, code in {"point": program(), "comma": program(" SPECIAL-NAMES. DECIMAL-POINT IS COMMA.")}.items():
        items = di.data_items(structure.divisions(structure.units(make(a=code), "FIXED")))
        texts[name] = {r["name"]: r["text"] for r in layout.item_texts(items).collect()}
        assert {r["name"]: r["default_text"] for r in layout.layout_table(items).collect()} == texts[name]
    assert texts == {"point": {"N": "1.5", "M": "2.25", "S": "a.b"}, "comma": {"N": "1,5", "M": "2,25", "S": "a.b"}}


def reached(make, *code):
    div = structure.divisions(structure.units(make(a=fixed(" IDENTIFICATION DIVISION.", " PROGRAM-ID. A.", " PROCEDURE DIVISION.", *code)), "FIXED"))
    plan = flow.program_flow(div)
    return {r["name"]: r["reached"] for r in flow.paragraph_reach(plan).collect()}, sorted(
        (r["from_no"], r["verb"], r["first_no"], r["last_no"]) for r in flow.flow_edges(plan).collect())


def test_what_can_run(spark, make):
    # a performed interval returns at its end; sections are intervals; a conditional jump leaves the rest reachable
    found, edges = reached(
        make, " MAIN-SECTION SECTION.", " A.", "   PERFORM SUB-SECTION.", "   PERFORM D THRU E 3 TIMES.", "   STOP RUN.", "   PERFORM DEAD.",
        " B.", "   DISPLAY 'only by falling, and A leaves'.", " SUB-SECTION SECTION.", " C.", "   IF X = 1 GO TO C-EXIT END-IF.", "   DISPLAY 'GO TO DEAD'.",
        " C-EXIT.", "   EXIT.", " OTHER SECTION.", " D.", "   GO TO F G DEPENDING ON X.", " E.", "   CONTINUE.", " AFTER-E.", "   CONTINUE.",
        " F.", "   GOBACK.", " G.", "   GO TO D.", " DEAD.", "   CONTINUE.",
    )
    assert found == {"MAIN-SECTION": True, "A": True, "B": False, "SUB-SECTION": True, "C": True, "C-EXIT": True, "OTHER": False, "D": True, "E": True,
                     "AFTER-E": False, "F": True, "G": True, "DEAD": False}
    assert (2, "PERFORM", 4, 6) in edges and (2, "PERFORM", 8, 9) in edges and (8, "GO TO", 11, 11) in edges and (8, "FALL", 9, 9) in edges
    assert not [e for e in edges if e[0] in (2, 11, 12) and e[1] == "FALL"]
    # without a first paragraph the code ahead of all runs; circles end
    assert reached(make, "   PERFORM X.", " X.", "   PERFORM X.", "   GO TO X.", " Y.", "   STOP RUN.")[0] == {"X": True, "Y": False}
    assert reached(make, "   DISPLAY 'x'.", " X.", "   GO TO Y.", " Y.", "   GO TO X.")[0] == {"X": True, "Y": True}
