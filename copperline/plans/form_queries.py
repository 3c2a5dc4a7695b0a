"""Registered queries over the second corpus, whose programs hold the rarer forms, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from copperline.operators import calls, data_items as di, facts, layout, statements as stm, structure
from copperline.operators.skew import spread
from copperline.session import materialize
from copperline.sources.synthetic import forms_from_parts


def divisions(spark: SparkSession, sf: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_size", "p_brand")
    return structure.divisions(structure.units(forms_from_parts(spread(parts))))


def _sections(spark, sf):
    return structure.sections(divisions(spark, sf))


def _statements(spark, sf, pattern=None):
    return stm.statements(_sections(spark, sf), pattern)


def form_identification(spark, sf):
    """All six facts of the identification division."""
    return structure.identification_facts(divisions(spark, sf)).drop("path")


def form_headers(spark, sf):
    return structure.headers(structure.sentences_of(_sections(spark, sf))).select("program", "division", "kind", "text")


def form_decimal_comma(spark, sf):
    return structure.decimal_comma_programs(structure.sentences_of(_sections(spark, sf))).select("program")


def form_items(spark, sf):
    """Items of all four sections."""
    return di.all_data_items(di.data_items(divisions(spark, sf))).select(
        "program", "section", "level", "name", "qpath", "kind", "redefines"
    )


def form_conditions(spark, sf):
    """Condition names against the initial values: the first value counts, a range in its place is unknown."""
    return layout.condition_names(materialize(di.data_items(divisions(spark, sf)))).select("program", "name", "holds")


def form_scopes(spark, sf):
    """Statements by scope, and how deep they are nested."""
    return _statements(spark, sf).groupBy("program", "scope", "section", "paragraph", "verb", "depth").agg(F.count(F.lit(1)).alias("n"))


def form_calls(spark, sf):
    return calls.call_statements(_sections(spark, sf)).select("program", "section", "paragraph", "depth", "target", "is_dynamic")


def form_file_usage(spark, sf):
    used = facts.extract_file_usage(_statements(spark, sf, r"(?i)(^|\s)(OPEN|CLOSE|READ|WRITE|REWRITE)\s"))
    return used.select("program", "verb", "mode", "file_name", "into_name")


def form_control_flow(spark, sf):
    div = materialize(divisions(spark, sf))
    stmts = stm.statements(structure.sections(div), r"(?i)(^|\s)(PERFORM|GO)\s")
    flow = facts.extract_control_flow(stmts, facts.paragraph_order(div))
    return flow.select("program", "paragraph", "verb", "mode", "position", "target", "self_loop")


def form_moves(spark, sf):
    div = materialize(divisions(spark, sf))
    moved = facts.extract_moves(stm.statements(structure.sections(div), r"(?i)(^|\s)MOVE\s"), di.data_items(div))
    return moved.select("program", "sending", "position", "receiver", "corresponding", "to_group")


QUERIES = {f.__name__: f for f in (
    form_identification, form_headers, form_decimal_comma, form_items, form_conditions, form_scopes, form_calls, form_file_usage,
    form_control_flow, form_moves,
)}

PROGRAMS = "w AS (SELECT p_partkey AS k, p_size AS s, p_brand AS b, 'W' || p_partkey AS program FROM part)"


def _rows(columns: str, *rows: str) -> str:
    """One row per program and line of values; the values may use k, s and b."""
    return f"WITH {PROGRAMS} " + " UNION ALL ".join(f"SELECT * FROM (SELECT program, {r} FROM w) t(program, {columns})" for r in rows)


_NO = "CAST(NULL AS VARCHAR)"
_ID, _ENV, _DATA, _PROC = "'IDENTIFICATION'", "'ENVIRONMENT'", "'DATA'", "'PROCEDURE'"

SQL = {
    "form_identification": f"""WITH {PROGRAMS} SELECT program, b AS author, 'Plant ' || s AS installation, '2001-01-' || (k % 28 + 1) AS date_written,
      'Day ' || (k % 365) AS date_compiled, 'Level ' || (k % 4) AS security, 'Part ' || k || ' of all forms' AS remarks FROM w""",
    "form_headers": _rows(
        "division, kind, text",
        *[f"{d}, 'DIVISION', {d} || ' DIVISION'" for d in (_ID, _ENV, _DATA, _PROC)],
        *[f"{_ENV}, 'SECTION', '{n} SECTION'" for n in ("CONFIGURATION", "INPUT-OUTPUT")],
        *[f"{_DATA}, 'SECTION', '{n} SECTION'" for n in ("FILE", "WORKING-STORAGE", "LOCAL-STORAGE", "LINKAGE")],
        *[f"{_PROC}, 'SECTION', '{n} SECTION'" for n in ("FIRST-PART", "LAST-PART")],
        *[f"{_ID}, 'PARAGRAPH', '{n}'" for n in ("PROGRAM-ID", *structure.IDENTIFICATION_PARAGRAPHS)],
        *[f"{_ENV}, 'PARAGRAPH', '{n}'" for n in ("SOURCE-COMPUTER", "FILE-CONTROL")],
        *[f"{_PROC}, 'PARAGRAPH', '{n}'" for n in ("STEP-A", "STEP-B", "STEP-C")],
    ) + f" UNION ALL SELECT program, {_ENV}, 'PARAGRAPH', 'SPECIAL-NAMES' FROM w WHERE k % 3 = 0",
    "form_decimal_comma": f"WITH {PROGRAMS} SELECT program FROM w WHERE k % 3 = 0",
    "form_items": _rows(
        "section, level, name, qpath, kind, redefines",
        f"'FILE', 1, 'R' || k, 'f' || k || '.r' || k, 'GROUP', {_NO}",
        f"'FILE', 5, 'R-KEY', 'f' || k || '.r' || k || '.r_key', 'SCALAR', {_NO}",
        *[f"'WORKING-STORAGE', {lvl}, '{n}', '{q}', '{kind}', {red}" for lvl, n, q, kind, red in (
            (77, "WS-COUNT", "ws_count", "SCALAR", _NO), (88, "WS-LOW", "ws_count.ws_low", "CONDITION", _NO),
            (88, "WS-MID", "ws_count.ws_mid", "CONDITION", _NO), (1, "WS-NUM", "ws_num", "SCALAR", _NO),
            (1, "WS-TEXT", "ws_text", "SCALAR", "'WS-NUM'"), (1, "WS-PROG", "ws_prog", "SCALAR", _NO),
            (1, "WS-FROM", "ws_from", "GROUP", _NO), (5, "WS-A", "ws_from.ws_a", "SCALAR", _NO),
            (1, "WS-TO", "ws_to", "GROUP", _NO), (5, "WS-A", "ws_to.ws_a", "SCALAR", _NO),
        )],
        f"'LOCAL-STORAGE', 1, 'LS-WORK', 'ls_work', 'SCALAR', {_NO}", f"'LINKAGE', 1, 'LK-AREA', 'lk_area', 'SCALAR', {_NO}",
    ),
    "form_conditions": _rows("name, holds", "'WS-LOW', CAST(NULL AS BOOLEAN)", "'WS-MID', k % 50 = 7"),
    "form_scopes": _rows(
        "scope, section, paragraph, verb, depth, n",
        *[f"'section', '{sec}', {_NO}, '{verb}', 0, CAST(1 AS BIGINT)" for sec, verb in (
            ("FIRST-PART", "OPEN"), ("FIRST-PART", "MOVE"), ("LAST-PART", "OPEN"), ("LAST-PART", "DISPLAY"))],
        *[f"'paragraph', '{sec}', '{par}', '{verb}', {depth}, CAST({n} AS BIGINT)" for sec, par, verb, depth, n in (
            ("FIRST-PART", "STEP-A", "READ", 0, 1), ("FIRST-PART", "STEP-A", "EVALUATE", 0, 1), ("FIRST-PART", "STEP-A", "CALL", 1, 1),
            ("FIRST-PART", "STEP-A", "DISPLAY", 1, 1), ("FIRST-PART", "STEP-A", "PERFORM", 0, 5), ("FIRST-PART", "STEP-A", "GO", 0, 1),
            ("FIRST-PART", "STEP-B", "MOVE", 0, 2), ("FIRST-PART", "STEP-B", "REWRITE", 0, 1), ("FIRST-PART", "STEP-B", "CALL", 0, 1),
            ("FIRST-PART", "STEP-B", "CLOSE", 0, 1), ("LAST-PART", "STEP-C", "STOP", 0, 1))],
    ),
    "form_calls": _rows(
        "section, paragraph, depth, target, is_dynamic",
        "'FIRST-PART', 'STEP-A', 1, 'WS-PROG', true", "'FIRST-PART', 'STEP-B', 0, 'W' || (k // 3), false",
    ),
    "form_file_usage": _rows(
        "verb, mode, file_name, into_name",
        f"'OPEN', 'I-O', 'F' || k, {_NO}", f"'OPEN', 'EXTEND', 'F' || k, {_NO}", f"'READ', {_NO}, 'F' || k, 'LK-AREA'",
        f"'REWRITE', {_NO}, 'R' || k, {_NO}", f"'CLOSE', {_NO}, 'F' || k, {_NO}",
    ),
    "form_control_flow": _rows(
        "paragraph, verb, mode, position, target, self_loop",
        *[f"'STEP-A', 'PERFORM', '{mode}', 1, 'STEP-B', false" for mode in ("TIMES", "UNTIL BEFORE", "VARYING", "UNTIL AFTER")],
        "'STEP-A', 'PERFORM', 'ONCE', 1, 'FIRST-PART', false", "'STEP-A', 'PERFORM', 'ONCE', 2, 'LAST-PART', false",
        "'STEP-A', 'GO TO', 'DEPENDING', 1, 'STEP-A', true", "'STEP-A', 'GO TO', 'DEPENDING', 2, 'STEP-B', false",
    ),
    "form_moves": _rows(
        "sending, position, receiver, corresponding, to_group",
        "'WS-FROM', 0, 'WS-TO', true, true", "'WS-A OF WS-FROM', 0, 'WS-A', false, false",
        "'''abcdef''', 0, 'WS-TEXT', false, false",
    ),
}
