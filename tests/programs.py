"""Programs for the tests, one feature each."""

from tests.conftest import fixed

HEAD = ("IDENTIFICATION DIVISION.", "PROGRAM-ID. {}.")


def program(name: str, data: list[str] = (), procedure: list[str] = (), env: list[str] = ()) -> str:
    lines = ["IDENTIFICATION DIVISION.", f"PROGRAM-ID. {name}."]
    if env:
        lines += ["ENVIRONMENT DIVISION.", *env]
    if data:
        lines += ["DATA DIVISION.", *data]
    lines += ["PROCEDURE DIVISION.", *procedure]
    return fixed(*lines)


SIMPLE = program("ONLYONE", ["WORKING-STORAGE SECTION.", "01 N PIC 9(3)."], ["    DISPLAY 'Hi'.", "    STOP RUN."])
CALLS = program(
    "MASTER", ["WORKING-STORAGE SECTION.", "01 ARG PIC 9(3).", "01 MOD-NAME PIC X(8) VALUE 'LATER'."],
    ["    CALL 'HELPER-A' USING ARG.", '    CALL "HELPER-B".', "    CALL 'HELPER-A'.", "    CALL MOD-NAME USING BY CONTENT 100.",
     "    IF ARG > 1 CALL 'HIDDEN' END-IF.", "    DISPLAY 'no CALL ''FAKE'' here. CALL X'.", "    STOP RUN."],
)
FILES = program(
    "FILER",
    ["FILE SECTION.", "FD  STOCK-FILE.", "01  STOCK-REC.", "    05 STOCK-ID PIC 9(5).", "    05 FILLER PIC X(3).", "    05 STOCK-TEXT PIC X(30).",
     "WORKING-STORAGE SECTION.", "01  EOF-FLAG PIC X VALUE 'N'.", "    88 AT-EOF VALUE 'Y'."],
    ["MAIN-LINE.", "    OPEN INPUT STOCK-FILE", "    READ STOCK-FILE NEXT RECORD", "        AT END SET AT-EOF TO TRUE", "    END-READ.",
     "    PERFORM SHOW-ONE UNTIL AT-EOF.", "    CLOSE STOCK-FILE.", "    GOBACK.", "SHOW-ONE.", "    DISPLAY STOCK-TEXT."],
    ["INPUT-OUTPUT SECTION.", "FILE-CONTROL.", "    SELECT STOCK-FILE ASSIGN TO 'STOCK.DAT'", "        ORGANIZATION IS INDEXED", "        RECORD KEY IS STOCK-ID."],
)
NESTED = program(
    "NESTER",
    ["WORKING-STORAGE SECTION.", "01 CLIENT.", "   05 CLIENT-ID PIC 9(5).", "   05 HOME.", "      10 STREET PIC X(40).", "      10 ZIP PIC 9(5).",
     "   05 NOTE PIC X(9).", "01 COUNTER PIC 9(3) VALUE 0."],
    ["MAIN-PART SECTION.", "START-IT.", "    PERFORM VARYING COUNTER FROM 1 BY 1 UNTIL COUNTER > 10", "        PERFORM STEP-100", "    END-PERFORM.",
     "    STOP RUN.", "STEP-100.", "    DISPLAY 'Step ' COUNTER."],
)
EMPTY = program("NOTHING", procedure=["    STOP RUN."])
PROSE = "These lines are a letter and no program at all. They end here."
