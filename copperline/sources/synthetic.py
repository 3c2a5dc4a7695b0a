"""A corpus of programs derived from the ``part`` table, for checks and benches.

Every fact of a program follows from its part key and size by arithmetic, so expected
entities, edges and layouts are known without parsing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def corpus_from_parts(parts: DataFrame) -> DataFrame:
    """One program per part: path, file_name, content.

    Programs come in three line formats: key mod 3 = 0 in 80-column lines with a tag, 1 in
    plain numbered lines, 2 without the sequence area.
    """
    k = F.col("p_partkey")
    ks = k.cast("string")
    size = F.col("p_size")
    with_file = k % 5 == 0
    in_section = k % 2 == 0

    def line(text: Column | str, when: Column | None = None) -> Column:
        col = F.lit(text) if isinstance(text, str) else text
        return col if when is None else F.when(when, col)

    body = F.array(
        line("IDENTIFICATION DIVISION."),
        line(F.concat(F.lit("PROGRAM-ID. P"), ks, F.lit("."))),
        line(F.concat(F.lit("AUTHOR. "), F.col("p_brand"), F.lit("."))),
        line("ENVIRONMENT DIVISION.", with_file),
        line("INPUT-OUTPUT SECTION.", with_file),
        line("FILE-CONTROL.", with_file),
        line(F.concat(F.lit("    SELECT F"), ks, F.lit(" ASSIGN TO 'f"), ks, F.lit(".dat'.")), with_file),
        line("DATA DIVISION."),
        line("FILE SECTION.", with_file),
        line(F.concat(F.lit("FD  F"), ks, F.lit(".")), with_file),
        line(F.concat(F.lit("01  R"), ks, F.lit(".")), with_file),
        line("    05 R-ID PIC 9(6).", with_file),
        line(F.concat(F.lit("    05 R-TEXT PIC X("), size.cast("string"), F.lit(").")), with_file),
        line("WORKING-STORAGE SECTION."),
        line(F.concat(F.lit("01  WS-QTY PIC 9("), size.cast("string"), F.lit(") VALUE "), (k % 10).cast("string"), F.lit("."))),
        line(F.concat(F.lit("01  WS-NAME PIC X(20) VALUE 'Part no. "), ks, F.lit("'."))),
        line("01  WS-GROUP."),
        line("    05 WS-PRICE PIC 9(5)V99."),
        line(F.concat(F.lit("    05 WS-TAB OCCURS "), (size % 4 + 2).cast("string"), F.lit(" TIMES."))),
        line("       10 WS-CELL PIC S9(3) COMP-3."),
        line("       10 FILLER PIC X(2) VALUE SPACES."),
        line("    05 WS-FLAG PIC X VALUE 'N'."),
        line("       88 WS-ON VALUE 'Y'."),
        line("66  WS-ALIAS RENAMES WS-GROUP.", k % 4 == 0),
        line("PROCEDURE DIVISION."),
        line("MAIN-LOGIC SECTION.", in_section),
        line("START-UP."),
        line(F.concat(F.lit("    MOVE "), (k % 100).cast("string"), F.lit(" TO WS-QTY WS-PRICE."))),
        line(F.concat(F.lit("    OPEN INPUT F"), ks, F.lit(".")), with_file),
        line(F.concat(F.lit("    CALL 'P"), F.floor(k / 2).cast("string"), F.lit("' USING WS-GROUP.")), k > 0),
        line(F.concat(F.lit("    IF WS-QTY > "), (k % 7).cast("string"))),
        line(F.concat(F.lit("       CALL 'P"), F.floor(k / 3).cast("string"), F.lit("'")), k % 3 == 0),
        line("       DISPLAY 'Call P1. CALL PX' WS-NAME"),
        line("    ELSE ADD 1 TO WS-QTY"),
        line("         ON SIZE ERROR DISPLAY 'full'"),
        line("    END-IF."),
        line(F.concat(F.lit('    CALL "P'), F.floor(k / 2).cast("string"), F.lit('".')), (k % 7 == 0) & (k > 0)),
        line("    PERFORM FIRST-STEP THRU LAST-STEP."),
        line("    STOP RUN."),
        line("FIRST-STEP."),
        line("    EXEC SQL SELECT QTY FROM PARTS END-EXEC.", k % 6 == 0),
        line("    DISPLAY WS-NAME."),
        line("LAST-STEP."),
        line(F.concat(F.lit("    WRITE R"), ks, F.lit(".")), with_file),
        line(F.concat(F.lit("    CLOSE F"), ks, F.lit(".")), with_file),
        line("    GO TO LAST-STEP."),
    )
    kept = F.filter(body, lambda x: x.isNotNull())
    shaped = F.transform(kept, lambda x, i: (
        F.when(k % 3 == 0, F.concat(F.lpad((i * 10 + 10).cast("string"), 6, "0"), F.lit(" "), F.rpad(x, 65, " "), F.lit("TAG00001")))
        .when(k % 3 == 1, F.concat(F.lpad((i * 10 + 10).cast("string"), 6, "0"), F.lit(" "), x))
        .otherwise(F.concat(F.lit(" "), x))
    ))
    name = F.concat(F.lit("p"), ks, F.lit(".cbl"))
    return parts.select(
        F.concat(F.lit("/corpus/"), name).alias("path"), name.alias("file_name"),
        F.array_join(shaped, "\n").alias("content"),
    )


def forms_from_parts(parts: DataFrame) -> DataFrame:
    """A second program per part, of the forms that the first corpus lacks: path, file_name, content.

    All storage sections, levels 77 and 88 with ranges, REDEFINES, all identification facts, the decimal
    comma, statements outside of paragraphs, EVALUATE, dynamic calls, all modes of OPEN and PERFORM,
    jumps by number, CORRESPONDING, qualified names and a continued literal.
    """
    k = F.col("p_partkey")
    ks = k.cast("string")
    size = F.col("p_size").cast("string")

    def line(*text: Column | str) -> Column:
        return F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text])

    # the first character of a line is its indicator
    body = F.array(
        line(" IDENTIFICATION DIVISION."), line(" PROGRAM-ID. W", ks, "."), line(" AUTHOR. ", F.col("p_brand"), "."),
        line(" INSTALLATION. Plant ", size, "."), line(" DATE-WRITTEN. 2001-01-", (k % 28 + 1).cast("string"), "."),
        line(" DATE-COMPILED. Day ", (k % 365).cast("string"), "."), line(" SECURITY. Level ", (k % 4).cast("string"), "."),
        line(" REMARKS. Part ", ks, " of all forms."),
        line(" ENVIRONMENT DIVISION."), line(" CONFIGURATION SECTION."), line(" SOURCE-COMPUTER. BOX-", size, "."),
        F.when(k % 3 == 0, line(" SPECIAL-NAMES. DECIMAL-POINT IS COMMA.")),
        line(" INPUT-OUTPUT SECTION."), line(" FILE-CONTROL."), line("     SELECT F", ks, " ASSIGN TO 'f", ks, ".dat'."),
        line(" DATA DIVISION."), line(" FILE SECTION."), line(" FD  F", ks, "."), line(" 01  R", ks, "."),
        line("     05 R-KEY PIC 9(4)."),
        line(" WORKING-STORAGE SECTION."), line(" 77  WS-COUNT PIC 9(3) VALUE ", (k % 50).cast("string"), "."),
        line("     88 WS-LOW VALUE 0 THRU 9."), line("     88 WS-MID VALUES 7 12 THRU 29."),
        line(" 01  WS-NUM PIC 9(6)."), line(" 01  WS-TEXT REDEFINES WS-NUM PIC X(6)."),
        line(" 01  WS-PROG PIC X(8) VALUE 'W", F.floor(k / 2).cast("string"), "'."),
        line(" 01  WS-FROM."), line("     05 WS-A PIC X."), line(" 01  WS-TO."), line("     05 WS-A PIC X."),
        line(" LOCAL-STORAGE SECTION."), line(" 01  LS-WORK PIC 9(5)."),
        line(" LINKAGE SECTION."), line(" 01  LK-AREA PIC X(", size, ")."),
        line(" PROCEDURE DIVISION."), line(" FIRST-PART SECTION."),
        line("     OPEN I-O F", ks, "."), line("     MOVE CORRESPONDING WS-FROM TO WS-TO."),
        line(" STEP-A."), line("     READ F", ks, " INTO LK-AREA."),
        line("     EVALUATE WS-COUNT"), line("        WHEN 1 CALL WS-PROG"), line("        WHEN OTHER DISPLAY 'none'"),
        line("     END-EVALUATE."),
        line("     PERFORM STEP-B 3 TIMES."), line("     PERFORM STEP-B UNTIL WS-COUNT > 5."),
        line("     PERFORM STEP-B VARYING WS-NUM FROM 1 BY 1 UNTIL WS-NUM > 9."),
        line("     PERFORM STEP-B WITH TEST AFTER UNTIL WS-COUNT > 5."),
        line("     PERFORM FIRST-PART THRU LAST-PART."),
        line("     GO TO STEP-A STEP-B DEPENDING ON WS-COUNT."),
        line(" STEP-B."), line("     MOVE WS-A OF WS-FROM TO WS-A OF WS-TO."),
        line("     MOVE 'abc"), line("-    'def' TO WS-TEXT."),
        line("     REWRITE R", ks, "."), line("     CALL 'W", F.floor(k / 3).cast("string"), "'."), line("     CLOSE F", ks, "."),
        line(" LAST-PART SECTION."), line("     OPEN EXTEND F", ks, "."), line("     DISPLAY 'end'."),
        line(" STEP-C."), line("     STOP RUN."),
    )
    numbered = F.transform(F.array_compact(body), lambda x, i: F.concat(F.lpad((i * 10 + 10).cast("string"), 6, "0"), x))
    name = F.concat(F.lit("w"), ks, F.lit(".cbl"))
    return parts.select(
        F.concat(F.lit("/forms/"), name).alias("path"), name.alias("file_name"), F.array_join(numbered, "\n").alias("content")
    )


def cases_from_parts(parts: DataFrame) -> DataFrame:
    """A third program per part: path, file_name, content.

    Names that occur more than once and their qualified references (levels skipped, subscripts, conditions, a renamed
    group, ambiguous and unknown ones), all clauses that open a nested statement, numbers in both notations, and paragraphs
    that only a PERFORM, a jump or falling through can reach, or nothing.
    """
    k = F.col("p_partkey")
    ks = k.cast("string")
    size = F.col("p_size").cast("string")
    comma = k % 3 == 0

    def line(*text: Column | str) -> Column:
        return F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text])

    body = F.array(
        line(" IDENTIFICATION DIVISION."), line(" PROGRAM-ID. X", ks, "."),
        line(" ENVIRONMENT DIVISION."), F.when(comma, line(" CONFIGURATION SECTION.")),
        F.when(comma, line(" SPECIAL-NAMES. DECIMAL-POINT IS COMMA.")),
        line(" DATA DIVISION."), line(" FILE SECTION."), line(" FD  M", ks, "."), line(" 01  M-REC."),
        line("     05 M-KEY PIC 9(4)."), line("     05 M-TEXT PIC X(", size, ")."),
        line(" WORKING-STORAGE SECTION."),
        line(" 01  ORDER-IN."), line("     05 HEAD."), line("        10 ITEM-CODE PIC X(3)."), line("        10 AMOUNT PIC 9(5)V99."),
        line("     05 BODY."), line("        10 ITEM-CODE PIC X(4)."), line("        10 M-KEY PIC 9(", size, ")."),
        line(" 66  HEAD-ALIAS RENAMES HEAD OF ORDER-IN."),
        line(" 01  ORDER-OUT."), line("     05 HEAD."), line("        10 ITEM-CODE PIC X(3)."),
        line("     05 LINES OCCURS ", (F.col("p_size") % 4 + 2).cast("string"), " TIMES."),
        line("        10 LINE-QTY PIC 9(3)."), line("        10 LINE-COST PIC 9(3)V99."),
        line(" 77  IX PIC 9(3) VALUE ", (k % 7).cast("string"), "."),
        line(" 77  RATE PIC 9V9 VALUE ", (k % 9).cast("string"), F.when(comma, ",").otherwise("."), "5."),
        line(" 77  STATE-FLAG PIC X VALUE 'A'."), line("     88 IS-OPEN VALUE 'A'."), line("     88 IS-DONE VALUE 'B'."),
        line(" PROCEDURE DIVISION."), line(" MAIN-PART."),
        line("     MOVE ITEM-CODE OF HEAD OF ORDER-IN TO ITEM-CODE IN ORDER-OUT."),
        line("     MOVE ITEM-CODE OF ORDER-IN TO M-TEXT."),
        line("     MOVE LINE-QTY OF LINES (IX) TO M-KEY OF M-REC OF M", ks, "."),
        line("     MOVE M-KEY TO IX."), line("     MOVE NO-SUCH-", ks, " TO RATE."),
        line("     IF IS-OPEN OF STATE-FLAG AND LINE-COST (IX) > RATE"), line("        DISPLAY HEAD-ALIAS"), line("     END-IF."),
        line("     COMPUTE AMOUNT = LENGTH OF BODY + IX * 2."), line("     COMPUTE RATE = LINE-COST (1) / ", size, "."),
        line("     COMPUTE IX = ", size, " + RATE."),
        line("     READ M", ks, " AT END MOVE 1 TO IX"), line("       NOT AT END ADD 1 TO IX END-READ."),
        line("     REWRITE M-REC INVALID KEY DISPLAY 'bad' END-REWRITE."),
        line("     SEARCH LINES AT END DISPLAY 'none'"), line("       WHEN LINE-QTY (IX) = 3 MOVE 2 TO IX END-SEARCH."),
        line("     STRING STATE-FLAG DELIMITED BY SIZE INTO M-TEXT"), line("       ON OVERFLOW DISPLAY 'long' END-STRING."),
        line("     PERFORM UNTIL IX > 9 ADD 1 TO IX END-PERFORM."),
        line("     CALL 'X", F.floor(k / 2).cast("string"), "' ON EXCEPTION DISPLAY 'no call' END-CALL."),
        line("     PERFORM WORK-A THRU WORK-B."), F.when(k % 2 == 0, line("     PERFORM SIDE-STEP.")),
        line("     GO TO WRAP-UP."),
        line(" WORK-A."), line("     DISPLAY 'a'."), line(" WORK-B."), line("     IF IX > 5 GO TO EARLY-OUT."), line("     DISPLAY 'b'."),
        line(" SIDE-STEP."), line("     DISPLAY 's'."), line(" NEVER-RUN."), line("     PERFORM ONLY-FROM-NEVER."),
        line(" ONLY-FROM-NEVER."), line("     DISPLAY 'n'."),
        line(" EARLY-OUT."), line("     DISPLAY 'early'."), line(" WRAP-UP."), F.when(k % 5 == 0, line("     PERFORM CLOSING.")),
        line("     STOP RUN."), line(" CLOSING."), line("     DISPLAY 'closing'."),
    )
    numbered = F.transform(F.array_compact(body), lambda x, i: F.concat(F.lpad((i * 10 + 10).cast("string"), 6, "0"), x))
    name = F.concat(F.lit("x"), ks, F.lit(".cbl"))
    return parts.select(
        F.concat(F.lit("/cases/"), name).alias("path"), name.alias("file_name"), F.array_join(numbered, "\n").alias("content")
    )
