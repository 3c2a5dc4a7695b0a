"""SQL that gives the registered queries' results from the tables alone, without parsing any code."""

from __future__ import annotations

from copperline.functions import prompts

# every corpus program by key: k, size s, brand b, name p
_P = "corpus AS (SELECT p_partkey AS k, p_size AS s, p_brand AS b, 'P' || p_partkey AS p, 'p' || p_partkey || '.cbl' AS f FROM part)"
_EDGES = f"""{_P}, edges AS (
  SELECT p AS source, 'P' || (k // 2) AS target, 'CALLS' AS rel_type FROM corpus WHERE k > 0
  UNION SELECT p, 'P' || (k // 3), 'CALLS' FROM corpus WHERE k % 3 = 0)"""

# all paths along CALL edges; P0 calling itself is the only circle
_WALK = """e AS (SELECT p_partkey AS s, p_partkey // 2 AS t FROM part WHERE p_partkey > 0
        UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey % 3 = 0),
      walk(s, t, n, looped) AS (SELECT s, t, 1, s = t FROM e UNION ALL SELECT walk.s, e.t, n + 1, looped OR e.s = e.t
        FROM walk JOIN e ON e.s = walk.t WHERE NOT (looped AND e.s = e.t))"""

# data items of one program: name, level, path below the program, picture, VALUE, order, condition on k
_ITEMS = f"""{_P}, items AS (
  SELECT p, k, 'FILE' AS sec, 'R' || k AS name, 1 AS lvl, 'f' || k || '.r' || k AS q, NULL AS pic, 'GROUP' AS kind FROM corpus WHERE k % 5 = 0
  UNION ALL SELECT p, k, 'FILE', 'R-ID', 5, 'f' || k || '.r' || k || '.r_id', '9(6)', 'SCALAR' FROM corpus WHERE k % 5 = 0
  UNION ALL SELECT p, k, 'FILE', 'R-TEXT', 5, 'f' || k || '.r' || k || '.r_text', 'X(' || s || ')', 'SCALAR' FROM corpus WHERE k % 5 = 0
  UNION ALL SELECT p, k, 'WORKING-STORAGE', 'WS-QTY', 1, 'ws_qty', '9(' || s || ')', 'SCALAR' FROM corpus
  UNION ALL SELECT p, k, 'WORKING-STORAGE', 'WS-NAME', 1, 'ws_name', 'X(20)', 'SCALAR' FROM corpus
  UNION ALL SELECT p, k, 'WORKING-STORAGE', 'WS-GROUP', 1, 'ws_group', NULL, 'GROUP' FROM corpus
  UNION ALL SELECT p, k, 'WORKING-STORAGE', 'WS-PRICE', 5, 'ws_group.ws_price', '9(5)V99', 'SCALAR' FROM corpus
  UNION ALL SELECT p, k, 'WORKING-STORAGE', 'WS-TAB', 5, 'ws_group.ws_tab', NULL, 'GROUP' FROM corpus
  UNION ALL SELECT p, k, 'WORKING-STORAGE', 'WS-CELL', 10, 'ws_group.ws_tab.ws_cell', 'S9(3)', 'SCALAR' FROM corpus
  UNION ALL SELECT p, k, 'WORKING-STORAGE', 'FILLER', 10, 'ws_group.ws_tab.filler0', 'X(2)', 'SCALAR' FROM corpus
  UNION ALL SELECT p, k, 'WORKING-STORAGE', 'WS-FLAG', 5, 'ws_group.ws_flag', 'X', 'SCALAR' FROM corpus
  UNION ALL SELECT p, k, 'WORKING-STORAGE', 'WS-ON', 88, 'ws_group.ws_flag.ws_on', NULL, 'CONDITION' FROM corpus
  UNION ALL SELECT p, k, 'WORKING-STORAGE', 'WS-ALIAS', 66, 'ws_group.ws_alias', NULL, 'RENAME' FROM corpus WHERE k % 4 = 0)"""

_DESCR = "'Level: ' || lvl || coalesce(', Type: ' || pic, '')"


def _entities(flat: bool) -> str:
    paragraphs = "" if not flat else " WHERE k % 2 = 0"
    return f"""{_ITEMS}, ents AS (
  SELECT p, k, 'WORKING-STORAGE SECTION' AS name, 'SECTION' AS type, 'DATA_DIVISION' AS section, 'Variables section' AS description FROM corpus
  UNION ALL SELECT p, k, name, 'VARIABLE', 'WORKING_STORAGE', {_DESCR} FROM items WHERE sec = 'WORKING-STORAGE' AND name <> 'FILLER'
  UNION ALL SELECT p, k, 'FILE SECTION', 'SECTION', 'DATA_DIVISION', 'File storage definition section' FROM corpus WHERE k % 5 = 0
  UNION ALL SELECT p, k, 'F' || k, 'FILE', 'FILE_SECTION', 'File Description' FROM corpus WHERE k % 5 = 0
  UNION ALL SELECT p, k, name, CASE WHEN lvl = 1 THEN 'RECORD' ELSE 'FIELD' END, 'FILE_SECTION', {_DESCR} FROM items WHERE sec = 'FILE'
  UNION ALL SELECT p, k, 'MAIN-LOGIC', 'SECTION', 'PROCEDURE_DIVISION', 'Section in ' || p FROM corpus WHERE k % 2 = 0
  UNION ALL SELECT p, k, x, 'PARAGRAPH', 'PROCEDURE_DIVISION',
    CASE WHEN k % 2 = 0 THEN 'Paragraph in section MAIN-LOGIC' ELSE 'Paragraph in ' || p END
    FROM corpus, (VALUES ('START-UP'), ('FIRST-STEP'), ('LAST-STEP')) v(x){paragraphs})"""


# statements of one program: verb, nesting depth, paragraph, how many
_STMTS = f"""{_P}, stmts AS (
  SELECT k, p, 'MOVE' AS verb, 0 AS depth, 'START-UP' AS par, 1 AS c FROM corpus
  UNION ALL SELECT k, p, 'OPEN', 0, 'START-UP', 1 FROM corpus WHERE k % 5 = 0
  UNION ALL SELECT k, p, 'CALL', 0, 'START-UP', 1 FROM corpus WHERE k > 0
  UNION ALL SELECT k, p, 'IF', 0, 'START-UP', 1 FROM corpus
  UNION ALL SELECT k, p, 'CALL', 1, 'START-UP', 1 FROM corpus WHERE k % 3 = 0
  UNION ALL SELECT k, p, 'DISPLAY', 1, 'START-UP', 1 FROM corpus
  UNION ALL SELECT k, p, 'ADD', 1, 'START-UP', 1 FROM corpus
  UNION ALL SELECT k, p, 'DISPLAY', 2, 'START-UP', 1 FROM corpus
  UNION ALL SELECT k, p, 'CALL', 0, 'START-UP', 1 FROM corpus WHERE k % 7 = 0 AND k > 0
  UNION ALL SELECT k, p, 'PERFORM', 0, 'START-UP', 1 FROM corpus
  UNION ALL SELECT k, p, 'STOP', 0, 'START-UP', 1 FROM corpus
  UNION ALL SELECT k, p, 'EXEC', 0, 'FIRST-STEP', 1 FROM corpus WHERE k % 6 = 0
  UNION ALL SELECT k, p, 'DISPLAY', 0, 'FIRST-STEP', 1 FROM corpus
  UNION ALL SELECT k, p, 'WRITE', 0, 'LAST-STEP', 1 FROM corpus WHERE k % 5 = 0
  UNION ALL SELECT k, p, 'CLOSE', 0, 'LAST-STEP', 1 FROM corpus WHERE k % 5 = 0
  UNION ALL SELECT k, p, 'GO', 0, 'LAST-STEP', 1 FROM corpus)"""

_TYPE = """CASE WHEN regexp_full_match(pic, 'S?9+|S?9[(][0-9]+[)]') THEN 'INTEGER'
  WHEN regexp_full_match(pic, 'S?(9+|9[(][0-9]+[)])V(9+|9[(][0-9]+[)])|9+.9+') THEN 'FLOAT'
  WHEN regexp_full_match(pic, 'X+|A+|[XA][(][0-9]+[)]') THEN 'STRING' END"""


def _digits(part: str) -> str:
    """Digits of `9(n)` or of a run of nines."""
    return f"CASE WHEN {part} LIKE '%(%' THEN CAST(regexp_extract({part}, '[(]([0-9]+)[)]', 1) AS INT) ELSE length({part}) END"


_SIGNED_DECIMAL = "regexp_full_match(pic, 'S.*V.*')"
_PARTS = "regexp_extract(pic, '^S?(9[(][0-9]+[)]|9+)', 1) AS w, regexp_extract(pic, '[V.](9[(][0-9]+[)]|9+)$', 1) AS fr"
_ILEN = f"""CASE WHEN type IN ('INTEGER', 'FLOAT') AND NOT {_SIGNED_DECIMAL}
  THEN ({_digits('w')}) + CASE WHEN regexp_full_match(pic, 'S9+') THEN 1 ELSE 0 END END"""
_FLEN = f"CASE WHEN type = 'INTEGER' THEN 0 WHEN type = 'FLOAT' AND NOT {_SIGNED_DECIMAL} THEN {_digits('fr')} END"
_SLEN = "CASE WHEN type = 'STRING' THEN CASE WHEN pic LIKE '%(%' THEN CAST(regexp_extract(pic, '[(]([0-9]+)[)]', 1) AS INT) ELSE length(pic) END END"
_LEN = f"""CASE WHEN type = 'INTEGER' THEN ilen + CASE WHEN pic LIKE 'S%' THEN 1 ELSE 0 END
  WHEN type = 'FLOAT' AND NOT {_SIGNED_DECIMAL} THEN ilen + flen + CASE WHEN regexp_full_match(pic, '9[(][0-9]+[)]V9[(][0-9]+[)]') THEN 0 ELSE 1 END
  WHEN type = 'STRING' THEN slen END"""

_PICS = """pics AS (SELECT p_partkey, CASE p_partkey % 19
  WHEN 0 THEN n9 WHEN 1 THEN '9(' || s || ')' WHEN 2 THEN n9 || 'V99' WHEN 3 THEN n9 || '.9' WHEN 4 THEN '9(' || s || ')V9'
  WHEN 5 THEN n9 || 'V9(' || s || ')' WHEN 6 THEN '9(' || s || ')V9(3)' WHEN 7 THEN 'S' || n9 WHEN 8 THEN 'S9(' || s || ')'
  WHEN 9 THEN 'S' || n9 || 'V9' WHEN 10 THEN 'S9(' || s || ')V99' WHEN 11 THEN 'S' || n9 || 'V9(' || s || ')'
  WHEN 12 THEN 'S9(' || s || ')V9(2)' WHEN 13 THEN repeat('X', s) WHEN 14 THEN 'X(' || s || ')' WHEN 15 THEN repeat('A', s)
  WHEN 16 THEN 'A(' || s || ')' WHEN 17 THEN 'ZZ' || n9 ELSE '-9(' || s || ').99' END AS pic
  FROM (SELECT p_partkey, p_size AS s, repeat('9', p_size) AS n9 FROM part))"""

# lines of a document; a closing break opens no line
_BREAK = r"'\r\n|[\n\r\x{2028}\x{2029}\x{0085}]'"
_LINES = f"""lines AS (SELECT doc_id, unnest(ls) AS raw, unnest(range(1, len(ls) + 1)) AS line_no FROM (
  SELECT doc_id, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS ls FROM (
    SELECT doc_id, regexp_split_to_array(text, {_BREAK}) AS parts FROM documents)))"""
_DECIDING = r"""deciding AS (SELECT doc_id, line_no, raw,
  regexp_full_match(raw, '(?i).{6}[ABCdD\t\-/*# ]\s*identification.*') AS is_var,
  regexp_full_match(raw, '(?i)[ABCdD\t\-/*# ]\s*identification.*') AS is_tan,
  regexp_full_match(raw, '(?i).{6}([ABCdD\t\-/*# ].{65}.{8})?') AS is_fix FROM lines WHERE raw ILIKE '%identification%')"""


def _bag(table: str, key: str, text: str) -> str:
    """Hashed bag-of-words vectors: key, list of 64 doubles."""
    return f"""SELECT {key}, list_transform(cnt, lambda x: CASE WHEN norm = 0 THEN 0.0 ELSE x / norm END) AS v FROM (
  SELECT {key}, cnt, sqrt(list_sum(list_transform(cnt, lambda x: x * x))) AS norm FROM (
    SELECT {key}, list_transform(range(0, 64), lambda d: CAST(len(list_filter(bs, lambda b: b = d)) AS DOUBLE)) AS cnt FROM (
      SELECT {key}, list_transform(regexp_extract_all(lower({text}), '[a-z0-9]+'),
        lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64) AS bs FROM {table})))"""


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_Q = """questions(query_id, question) AS (VALUES ('1', 'How does the customer data processing work?'),
  ('2', 'Which record holds the price and the quantity of a part?'))"""
_RETRIEVED = f"""{_EDGES}, {_Q},
 dv AS ({_bag('documents', 'doc_id', 'text')}),
 qv AS ({_bag('questions', 'query_id', 'question')}),
 scored AS (SELECT query_id, CAST(doc_id AS VARCHAR) AS id, round(list_cosine_similarity(dv.v, qv.v), 12) AS score
   FROM dv, qv WHERE list_sum(dv.v) > 0),
 ranked AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored),
 deps AS (SELECT source AS program, '["' || string_agg(target, '", "' ORDER BY target) || '"]' AS deps FROM edges GROUP BY source),
 retrieved AS (SELECT r.query_id, r.rank, 'P' || r.id AS program, d.source, d.text AS document, coalesce(x.deps, '[]') AS deps
   FROM ranked r JOIN documents d ON CAST(d.doc_id AS VARCHAR) = r.id LEFT JOIN deps x ON x.program = 'P' || r.id WHERE r.rank <= 5),
 segments AS (SELECT query_id, rank, 'Code from ' || source || chr(58) || chr(10) || document || chr(10) || 'Dependencies:' || chr(10) || deps AS segment, deps, program FROM retrieved)"""


def _means(by: str) -> str:
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {key} list(m ORDER BY i) AS v FROM (
  SELECT {key} i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
  GROUP BY {key} i) {group}"""


_HEAD, _REST = prompts.PROMPT.split("{context}")
_MIDDLE, _REST = _REST.split("{dependencies}")
_BEFORE, _TAIL = _REST.split("{question}")

_DDL_DIGITS = "CASE WHEN s <= 38 THEN 'DECIMAL(' || s || ',0)' ELSE 'STRING' END"

_MIXED = """mixed AS (SELECT *,
  CASE l_linenumber WHEN 1 THEN 'D' WHEN 6 THEN 'D' WHEN 2 THEN 'S' WHEN 3 THEN 'B' WHEN 4 THEN 'H' WHEN 5 THEN 'L' END AS lk,
  CASE l_linenumber WHEN 1 THEN CAST(l_quantity AS DECIMAL(18,2)) WHEN 6 THEN CAST(l_tax AS DECIMAL(18,2)) END AS ld,
  CASE WHEN l_linenumber IN (1, 6) THEN 'D' WHEN l_linenumber = 3 THEN 'B' WHEN l_linenumber = 4 THEN CASE WHEN l_linestatus = 'O' THEN 'H' ELSE 'L' END ELSE 'S' END AS rk
  FROM lineitem),
 cmp AS (SELECT *, CASE WHEN lk IS NULL THEN NULL
  WHEN l_linenumber IN (1, 6) THEN sign(ld - 25)
  WHEN l_linenumber = 2 THEN CASE WHEN l_returnflag < 'N' THEN -1 WHEN l_returnflag > 'N' THEN 1 ELSE 0 END
  WHEN l_linenumber = 3 THEN CASE WHEN l_discount > 0.05 THEN 0 ELSE -1 END
  WHEN l_linenumber = 4 THEN 0 WHEN l_linenumber = 5 THEN -1 END AS c FROM mixed)"""
_NUM = "CASE WHEN CAST({0} AS VARCHAR) LIKE '%.%' THEN regexp_replace(CAST({0} AS VARCHAR), '[.]?0+$', '') ELSE CAST({0} AS VARCHAR) END"
_TEXT = f"CASE lk WHEN 'D' THEN {_NUM.format('ld')} WHEN 'S' THEN l_returnflag || '  ' WHEN 'B' THEN CASE WHEN l_discount > 0.05 THEN '1' ELSE '0' END ELSE '' END"

_CODE_LINES = f"""{_P}, bodies AS (SELECT k, f, list_filter([
  'IDENTIFICATION DIVISION.', 'PROGRAM-ID. ' || p || '.', 'AUTHOR. ' || b || '.',
  CASE WHEN k % 5 = 0 THEN 'ENVIRONMENT DIVISION.' END, CASE WHEN k % 5 = 0 THEN 'INPUT-OUTPUT SECTION.' END, CASE WHEN k % 5 = 0 THEN 'FILE-CONTROL.' END,
  CASE WHEN k % 5 = 0 THEN '    SELECT F' || k || ' ASSIGN TO ''f' || k || '.dat''.' END, 'DATA DIVISION.',
  CASE WHEN k % 5 = 0 THEN 'FILE SECTION.' END, CASE WHEN k % 5 = 0 THEN 'FD  F' || k || '.' END, CASE WHEN k % 5 = 0 THEN '01  R' || k || '.' END,
  CASE WHEN k % 5 = 0 THEN '    05 R-ID PIC 9(6).' END, CASE WHEN k % 5 = 0 THEN '    05 R-TEXT PIC X(' || s || ').' END,
  'WORKING-STORAGE SECTION.', '01  WS-QTY PIC 9(' || s || ') VALUE ' || (k % 10) || '.', '01  WS-NAME PIC X(20) VALUE ''Part no. ' || k || '''.',
  '01  WS-GROUP.', '    05 WS-PRICE PIC 9(5)V99.', '    05 WS-TAB OCCURS ' || (s % 4 + 2) || ' TIMES.', '       10 WS-CELL PIC S9(3) COMP-3.',
  '       10 FILLER PIC X(2) VALUE SPACES.', '    05 WS-FLAG PIC X VALUE ''N''.', '       88 WS-ON VALUE ''Y''.',
  CASE WHEN k % 4 = 0 THEN '66  WS-ALIAS RENAMES WS-GROUP.' END, 'PROCEDURE DIVISION.', CASE WHEN k % 2 = 0 THEN 'MAIN-LOGIC SECTION.' END, 'START-UP.',
  '    MOVE ' || (k % 100) || ' TO WS-QTY WS-PRICE.', CASE WHEN k % 5 = 0 THEN '    OPEN INPUT F' || k || '.' END,
  CASE WHEN k > 0 THEN '    CALL ''P' || (k // 2) || ''' USING WS-GROUP.' END, '    IF WS-QTY > ' || (k % 7),
  CASE WHEN k % 3 = 0 THEN '       CALL ''P' || (k // 3) || '''' END, '       DISPLAY ''Call P1. CALL PX'' WS-NAME', '    ELSE ADD 1 TO WS-QTY',
  '         ON SIZE ERROR DISPLAY ''full''', '    END-IF.', CASE WHEN k % 7 = 0 AND k > 0 THEN '    CALL "P' || (k // 2) || '".' END,
  '    PERFORM FIRST-STEP THRU LAST-STEP.', '    STOP RUN.', 'FIRST-STEP.', CASE WHEN k % 6 = 0 THEN '    EXEC SQL SELECT QTY FROM PARTS END-EXEC.' END,
  '    DISPLAY WS-NAME.', 'LAST-STEP.', CASE WHEN k % 5 = 0 THEN '    WRITE R' || k || '.' END, CASE WHEN k % 5 = 0 THEN '    CLOSE F' || k || '.' END,
  '    GO TO LAST-STEP.'], lambda x: x IS NOT NULL) AS body FROM corpus),
 code_rows AS (SELECT k, f, unnest(body) AS code, unnest(range(1, len(body) + 1)) AS line_no FROM bodies)"""

SQL: dict[str, str] = {
    "code_lines": f"""WITH {_CODE_LINES} SELECT f AS file_name, CAST(line_no AS INT) AS line_no,
      CASE WHEN k % 3 = 2 THEN '' ELSE lpad(CAST(line_no * 10 AS VARCHAR), 6, '0') END AS seq, ' ' AS indicator, code, false AS is_comment FROM code_rows""",
    "call_edges_all": f"WITH {_EDGES} SELECT * FROM edges",
    "call_edges_flat": f"WITH {_P} SELECT p AS source, 'P' || (k // 2) AS target, 'CALLS' AS rel_type FROM corpus WHERE k > 0 AND k % 2 = 0",
    "call_statements": f"""WITH {_P}, c AS (
      SELECT p AS program, 'P' || (k // 2) AS target, 0 AS depth, 0 AS stmt_no FROM corpus WHERE k > 0
      UNION ALL SELECT p, 'P' || (k // 3), 1, 1 FROM corpus WHERE k % 3 = 0
      UNION ALL SELECT p, 'P' || (k // 2), 0, 0 FROM corpus WHERE k % 7 = 0 AND k > 0)
      SELECT program, target, false AS is_dynamic, depth, 'paragraph' AS scope, stmt_no, 'START-UP' AS paragraph FROM c""",
    "programs": f"WITH {_P} SELECT '/corpus/' || f AS path, f AS file_name, 'P' || k AS unit_name, p AS program_id, p AS name FROM corpus",
    "entity_rows": f"WITH {_entities(False)} SELECT p || ':' || name AS id, p AS program, name, type, section, description FROM ents",
    "entity_rows_flat": f"WITH {_entities(True)} SELECT p || ':' || name AS id, type, section, description FROM ents",
    "entity_counts": f"WITH {_entities(False)} SELECT p AS program, count(*) AS n_entities FROM ents GROUP BY p",
    "containment": f"WITH {_entities(False)} SELECT DISTINCT p AS program, p || ':' || name AS entity_id FROM ents",
    "statement_census": f"WITH {_STMTS} SELECT p AS program, verb, CAST(sum(c) AS BIGINT) AS n FROM stmts GROUP BY p, verb",
    "statement_census_flat": f"WITH {_STMTS} SELECT p AS program, verb, CAST(sum(c) AS BIGINT) AS n FROM stmts WHERE depth = 0 GROUP BY p, verb",
    "statement_nesting": f"WITH {_STMTS} SELECT p AS program, verb, depth, CAST(sum(c) AS BIGINT) AS n FROM stmts GROUP BY p, verb, depth",
    "statement_scopes": f"""WITH {_STMTS} SELECT 'paragraph' AS scope, CASE WHEN k % 2 = 0 THEN 'MAIN-LOGIC' END AS section, par AS paragraph, depth,
      CAST(sum(c) AS BIGINT) AS n FROM stmts GROUP BY ALL""",
    "sentence_kinds": f"""WITH {_P}, r AS (
      SELECT p AS program, 'IDENTIFICATION' AS division, 'DIVISION' AS kind, 1 AS n FROM corpus
      UNION ALL SELECT p, 'IDENTIFICATION', 'PARAGRAPH', 2 FROM corpus
      UNION ALL SELECT p, 'IDENTIFICATION', 'SENTENCE', 2 FROM corpus
      UNION ALL SELECT p, 'ENVIRONMENT', x, 1 FROM corpus, (VALUES ('DIVISION'), ('SECTION'), ('PARAGRAPH'), ('SENTENCE')) v(x) WHERE k % 5 = 0
      UNION ALL SELECT p, 'DATA', 'DIVISION', 1 FROM corpus
      UNION ALL SELECT p, 'DATA', 'SECTION', CASE WHEN k % 5 = 0 THEN 2 ELSE 1 END FROM corpus
      UNION ALL SELECT p, 'DATA', 'FD', 1 FROM corpus WHERE k % 5 = 0
      UNION ALL SELECT p, 'DATA', 'ITEM', 9 + CASE WHEN k % 5 = 0 THEN 3 ELSE 0 END + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END FROM corpus
      UNION ALL SELECT p, 'PROCEDURE', 'DIVISION', 1 FROM corpus
      UNION ALL SELECT p, 'PROCEDURE', 'SECTION', 1 FROM corpus WHERE k % 2 = 0
      UNION ALL SELECT p, 'PROCEDURE', 'PARAGRAPH', 3 FROM corpus
      UNION ALL SELECT p, 'PROCEDURE', 'SENTENCE', 6 + CASE WHEN k % 5 = 0 THEN 3 ELSE 0 END + CASE WHEN k > 0 THEN 1 ELSE 0 END
        + CASE WHEN k % 7 = 0 AND k > 0 THEN 1 ELSE 0 END + CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END FROM corpus)
      SELECT program, division, kind, CAST(n AS BIGINT) AS n FROM r""",
    "section_headers": f"""WITH {_P} SELECT p AS program, 'DATA' AS division, 'WORKING-STORAGE' AS name FROM corpus
      UNION ALL SELECT p, 'DATA', 'FILE' FROM corpus WHERE k % 5 = 0
      UNION ALL SELECT p, 'ENVIRONMENT', 'INPUT-OUTPUT' FROM corpus WHERE k % 5 = 0
      UNION ALL SELECT p, 'PROCEDURE', 'MAIN-LOGIC' FROM corpus WHERE k % 2 = 0""",
    "identification": f"WITH {_P} SELECT p AS program, b AS author, " + ", ".join(f"CAST(NULL AS VARCHAR) AS {n}" for n in (
        "installation", "date_written", "date_compiled", "security", "remarks")) + " FROM corpus",
    "layout_paths": f"""WITH {_ITEMS}, t AS (SELECT i.*, c.s, CASE WHEN pic IS NULL THEN CASE WHEN i.kind = 'GROUP' THEN 'GROUP' WHEN i.kind = 'CONDITION' THEN 'STRING' END
        ELSE {_TYPE} END AS type FROM items i JOIN corpus c USING (k)),
      w AS (SELECT *, {_PARTS} FROM t), l AS (SELECT *, {_ILEN} AS ilen, {_FLEN} AS flen, {_SLEN} AS slen FROM w)
      SELECT p AS program, q AS qpath, lvl AS level, kind, pic, type, ilen AS integer_len, flen AS fraction_len, slen AS string_len, {_LEN} AS length,
        CASE WHEN name = 'WS-TAB' THEN s % 4 + 2 ELSE 1 END AS max_occurs,
        CASE name WHEN 'WS-QTY' THEN CAST(k % 10 AS VARCHAR) WHEN 'WS-NAME' THEN 'Part no. ' || k WHEN 'FILLER' THEN ' ' WHEN 'WS-FLAG' THEN 'N' WHEN 'WS-ON' THEN 'Y' END AS default_text
      FROM l""",
    "qualified_paths": f"WITH {_ITEMS} SELECT p AS program, q AS qualified_path FROM items",
    "layout_ddl": f"""WITH {_P} SELECT p AS program, 'ws_qty' AS name, {_DDL_DIGITS} AS ddl FROM corpus
      UNION ALL SELECT p, 'ws_name', 'STRING' FROM corpus
      UNION ALL SELECT p, 'ws_group', 'STRUCT<`ws_price`: DECIMAL(7,2), `ws_tab`: ARRAY<STRUCT<`ws_cell`: DECIMAL(3,0), `filler0`: STRING>>, `ws_flag`: STRING>' FROM corpus
      UNION ALL SELECT p, 'r' || k, 'STRUCT<`r_id`: DECIMAL(6,0), `r_text`: STRING>' FROM corpus WHERE k % 5 = 0""",
    "fd_layouts": f"""WITH {_P} SELECT p AS program, 'F' || k AS fd_name, 'f' || k || '.r' || k AS qpath, 'GROUP' AS type, CAST(NULL AS INT) AS length FROM corpus WHERE k % 5 = 0
      UNION ALL SELECT p, 'F' || k, 'f' || k || '.r' || k || '.r_id', 'INTEGER', 6 FROM corpus WHERE k % 5 = 0
      UNION ALL SELECT p, 'F' || k, 'f' || k || '.r' || k || '.r_text', 'STRING', s FROM corpus WHERE k % 5 = 0""",
    "item_sections": f"WITH {_ITEMS} SELECT p AS program, sec AS section, count(*) AS n FROM items GROUP BY ALL",
    "working_storage": f"WITH {_ITEMS} SELECT p AS program, lvl AS level, name FROM items WHERE sec = 'WORKING-STORAGE'",
    "file_descriptions": f"WITH {_P} SELECT p AS program, 'F' || k AS fd_name FROM corpus WHERE k % 5 = 0",
    "file_records": f"WITH {_P} SELECT p AS program, 'F' || k AS fd_name, 'R' || k AS name FROM corpus WHERE k % 5 = 0",
    "groups_with_children": f"WITH {_ITEMS} SELECT p AS program, name FROM items WHERE kind = 'GROUP'",
    "renames": f"WITH {_P} SELECT p AS program, 'WS-ALIAS' AS name, 'WS-GROUP' AS renames_from, 'ws_group' AS source_path FROM corpus WHERE k % 4 = 0",
    "references": f"""WITH {_P} SELECT p AS program, 'WS-QTY' AS name, false AS via_rename, 'WS-QTY' AS resolved, 'SCALAR' AS kind, CAST(NULL AS VARCHAR) AS parent FROM corpus
      UNION ALL SELECT p, 'WS-PRICE', false, 'WS-PRICE', 'SCALAR', 'WS-GROUP' FROM corpus
      UNION ALL SELECT p, 'WS-ON', false, 'WS-ON', 'CONDITION', 'WS-FLAG' FROM corpus
      UNION ALL SELECT p, 'WS-ALIAS', true, 'WS-GROUP', 'GROUP', NULL FROM corpus WHERE k % 4 = 0""",
    "initial_values": f"""WITH {_ITEMS} SELECT p AS program, name,
      CASE WHEN kind = 'GROUP' THEN NULL WHEN name IN ('WS-QTY', 'WS-PRICE', 'WS-CELL', 'R-ID') THEN 'DECIMAL' ELSE 'STRING' END AS value_kind,
      CASE name WHEN 'WS-QTY' THEN CAST(k % 10 AS VARCHAR) WHEN 'WS-PRICE' THEN '0' WHEN 'WS-CELL' THEN '0' WHEN 'R-ID' THEN '0'
        WHEN 'WS-NAME' THEN rpad('Part no. ' || k, 20, ' ') WHEN 'FILLER' THEN '  ' WHEN 'WS-FLAG' THEN 'N'
        WHEN 'R-TEXT' THEN repeat(' ', CAST(regexp_extract(pic, '[0-9]+') AS INT)) END AS value
      FROM items WHERE kind NOT IN ('CONDITION', 'RENAME')""",
    "condition_names": f"WITH {_P} SELECT p AS program, 'WS-ON' AS name, false AS holds FROM corpus",
    "condition_names_provided": f"WITH {_P} SELECT p AS program, 'WS-ON' AS name, s > 30 AS holds FROM corpus",
    "file_usage": f"""WITH {_P} SELECT p AS program, 'OPEN' AS verb, 'INPUT' AS mode, 'F' || k AS file_name FROM corpus WHERE k % 5 = 0
      UNION ALL SELECT p, 'WRITE', NULL, 'R' || k FROM corpus WHERE k % 5 = 0 UNION ALL SELECT p, 'CLOSE', NULL, 'F' || k FROM corpus WHERE k % 5 = 0""",
    "file_control": f"WITH {_P} SELECT p AS program, 'F' || k AS file_name, 'f' || k || '.dat' AS external_name FROM corpus WHERE k % 5 = 0",
    "control_flow": f"""WITH {_P} SELECT p AS program, 'START-UP' AS paragraph, 'PERFORM' AS verb, 'ONCE' AS mode, 1 AS position, 'FIRST-STEP' AS target, false AS self_loop FROM corpus
      UNION ALL SELECT p, 'START-UP', 'PERFORM', 'ONCE', 2, 'LAST-STEP', false FROM corpus
      UNION ALL SELECT p, 'LAST-STEP', 'GO TO', 'SIMPLE', 1, 'LAST-STEP', true FROM corpus""",
    "moves": f"""WITH {_P} SELECT p AS program, CAST(k % 100 AS VARCHAR) AS sending, i AS position, x AS receiver, false AS corresponding, false AS to_group
      FROM corpus, (VALUES (0, 'WS-QTY'), (1, 'WS-PRICE')) v(i, x)""",
    "exec_sql": f"WITH {_P} SELECT p AS program, 'SELECT QTY FROM PARTS' AS sql_text FROM corpus WHERE k % 6 = 0",
    "file_lineage": f"""WITH {_P}, u(verb, mode, l) AS (VALUES ('OPEN', 'INPUT', 'F'), ('WRITE', NULL, 'R'), ('CLOSE', NULL, 'F'))
      SELECT p AS program, verb, mode, l || k AS file_name, 'F' || k AS fd_name, 'f' || k || '.dat' AS external_name FROM corpus, u WHERE k % 5 = 0""",
    "uncovered_verbs": f"""WITH {_STMTS} SELECT verb, CAST(sum(c) AS BIGINT) AS n FROM stmts
      WHERE verb NOT IN ('MOVE', 'CALL', 'IF', 'DISPLAY', 'PERFORM', 'GO', 'OPEN', 'WRITE') GROUP BY verb""",
    "rule_choice": f"""WITH {_STMTS}, r AS (SELECT k, p, verb, CASE WHEN verb = 'CALL' THEN 'call' WHEN verb = 'GO' THEN 'jump'
        WHEN verb = 'DISPLAY' AND par = 'FIRST-STEP' THEN 'display' WHEN verb = 'DISPLAY' THEN 'display literal' END AS rule FROM stmts
        WHERE NOT (verb = 'CALL' AND depth = 0)
      UNION ALL SELECT k, p, 'CALL', 'call with arguments' FROM corpus WHERE k > 0
      UNION ALL SELECT k, p, 'CALL', 'call' FROM corpus WHERE k % 7 = 0 AND k > 0)
      SELECT p AS program, verb, rule, count(*) AS n FROM r GROUP BY p, verb, rule""",
    "line_format": f"""WITH {_P}, {_LINES}, {_DECIDING}, d AS (SELECT doc_id, arg_max(CASE WHEN is_var AND is_fix THEN 'FIXED' WHEN is_var THEN 'VARIABLE' ELSE 'TANDEM' END, line_no) AS fmt
        FROM deciding WHERE is_var OR is_tan GROUP BY doc_id)
      SELECT f AS file_name, CASE k % 3 WHEN 0 THEN 'FIXED' WHEN 1 THEN 'VARIABLE' ELSE 'TANDEM' END AS fmt FROM corpus
      UNION ALL SELECT CAST(o.doc_id AS VARCHAR), coalesce(d.fmt, 'FIXED') FROM documents o LEFT JOIN d USING (doc_id)""",
    "copybook_flag": rf"""WITH {_P}, {_LINES}, d AS (SELECT DISTINCT doc_id FROM lines
        WHERE regexp_full_match(raw, '(?i)(.{{6}})?[ABCdD\t\-# ]\s*identification.*'))
      SELECT f AS file_name, false AS is_copybook FROM corpus
      UNION ALL SELECT CAST(o.doc_id AS VARCHAR), d.doc_id IS NULL FROM documents o LEFT JOIN d USING (doc_id)""",
    "rejects": "SELECT CAST(doc_id AS VARCHAR) AS path, 'no program and no data items' AS reason FROM documents",
    "copybook_expansion": """WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey // 15 END AS b FROM customer),
      known AS (SELECT s_suppkey AS b FROM supplier),
      books AS (SELECT x.b, y.b AS src FROM known x JOIN known y ON y.b // 4 = x.b // 4 AND y.b >= x.b
                WHERE (SELECT count(*) FROM known z WHERE z.b BETWEEN x.b AND y.b) = y.b - x.b + 1)
      SELECT 'C' || k AS program, 1 AS level, 'REC-' || src AS name, CAST(NULL AS VARCHAR) AS pic FROM c JOIN books USING (b)
      UNION ALL SELECT 'C' || k, 5, 'CODE-' || src, '9(5)' FROM c JOIN books USING (b)
      UNION ALL SELECT 'C' || k, 1, 'LAST-ITEM', 'X' FROM c""",
    "copy_edges": """WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey // 15 END AS b FROM customer)
      SELECT 'C' || k AS source, 'CB' || b AS target, 'COPIES' AS rel_type FROM c UNION ALL SELECT 'C' || k, 'UNKNOWN-BOOK', 'COPIES' FROM c""",
    "edge_build": f"WITH {_EDGES} SELECT edges.* FROM edges JOIN corpus ON p = source WHERE s >= 20",
    "program_stubs": f"""WITH {_EDGES}, known AS (SELECT p AS name, '/corpus/' || f AS file_path FROM corpus WHERE s >= 20)
      SELECT * FROM known UNION ALL SELECT DISTINCT target, NULL FROM edges WHERE source IN (SELECT name FROM known) AND target NOT IN (SELECT name FROM known)""",
    "callees": f"WITH {_EDGES} SELECT source AS program, string_agg(target, ',' ORDER BY target) AS deps FROM edges GROUP BY source",
    "relationship_counts": f"WITH {_EDGES} SELECT source, count(*) AS n_relationships FROM edges GROUP BY source",
    "ordered_programs": f"WITH {_P} SELECT p AS name FROM corpus ORDER BY p",
    "first_edge": f"WITH {_EDGES} SELECT source, target, rel_type FROM edges WHERE source = 'P6' ORDER BY target LIMIT 1",
    "call_paths": f"""WITH RECURSIVE {_WALK} SELECT 'P' || s AS source, 'P' || t AS target, n AS length FROM walk""",
    "paths_between": f"""WITH RECURSIVE {_WALK}, pairs AS (SELECT p_partkey AS a, p_partkey // 8 AS b FROM part WHERE p_partkey > 0
        UNION SELECT p_partkey, p_partkey // 9 FROM part WHERE p_partkey > 0)
      SELECT 'P' || s AS source, 'P' || t AS target, n AS length FROM walk JOIN pairs ON s = a AND t = b""",
    "long_paths": """WITH e AS (SELECT DISTINCT p_partkey AS k FROM part WHERE (p_partkey + 1) % 16 <> 0)
      SELECT 'P' || a.k AS source, 'P' || (b.k + 1) AS target, CAST(b.k - a.k + 1 AS INT) AS length
      FROM e a JOIN e b ON b.k // 16 = a.k // 16 AND b.k >= a.k
      WHERE (SELECT count(*) FROM e c WHERE c.k // 16 = a.k // 16 AND c.k BETWEEN a.k AND b.k) = b.k - a.k + 1""",
    "cycle_paths": """WITH RECURSIVE ring AS (SELECT DISTINCT p_partkey AS a, CASE WHEN p_partkey % 7 = 6 THEN p_partkey - 6 ELSE p_partkey + 1 END AS b FROM part),
      walk(s, t, n, used) AS (SELECT a, b, 1, [a] FROM ring UNION ALL SELECT s, b, n + 1, list_append(used, a) FROM walk JOIN ring ON a = t WHERE NOT list_contains(used, a))
      SELECT 'R' || s AS source, 'R' || t AS target, n AS length FROM walk""",
    "reachable": f"""WITH RECURSIVE {_EDGES}, walk(s, t, n) AS (SELECT source, target, 1 FROM edges
      UNION SELECT s, target, n + 1 FROM walk JOIN edges ON source = t WHERE t <> 'P0')
      SELECT s AS source, t AS target, min(n) AS length FROM walk GROUP BY s, t""",
    "param_query": f"""WITH {_EDGES} SELECT source AS name, target FROM edges JOIN corpus ON p = source WHERE f LIKE '%1.cbl'""",
    "doc_meta": f"WITH {_P} SELECT p || '_' || f AS id, p AS program, '/corpus/' || f AS file_path, f AS file_name, 'COBOL' AS language, f AS source FROM corpus",
    "ingest_entities": f"WITH {_entities(False)} SELECT p || ':' || name AS id, p AS program, name, type, section, description FROM ents",
    "stream_calls": f"WITH {_EDGES} SELECT * FROM edges",
    "collection_upsert": """SELECT 'P' || p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'size ' || p_size ELSE p_brand END AS document,
      CASE WHEN p_size % 2 = 0 THEN '2' ELSE '1' END AS load FROM part""",
    "publish_audit": "SELECT 'P' || p_partkey AS name, true AS refused, 0 AS seen_before FROM part WHERE p_size >= 20",
    "ingest_copybooks": """SELECT 'Q' || k || ':' || name AS id, 'Q' || k AS program, name, type FROM (SELECT p_partkey AS k, p_partkey % 8 AS b FROM part),
      LATERAL (VALUES ('BOOK-' || b, 'VARIABLE'), ('CODE-' || b, 'VARIABLE'), ('OWN-ITEM', 'VARIABLE'), ('WORKING-STORAGE SECTION', 'SECTION'), ('ONLY', 'PARAGRAPH')) AS t(name, type)""",
    "ingest_calls": f"WITH {_EDGES} SELECT * FROM edges",
    "incremental_calls": f"WITH {_EDGES} SELECT * FROM edges",
    "incremental_tables": f"""
      SELECT 'programs' AS tab, p AS key, '/corpus/' || f AS rest FROM (WITH {_EDGES} SELECT p, f FROM corpus)
      UNION ALL SELECT 'programs', target, '' FROM (WITH {_EDGES} SELECT DISTINCT target FROM edges WHERE target NOT IN (SELECT p FROM corpus))
      UNION ALL SELECT DISTINCT 'entities', p || ':' || name, concat_ws('|', p, name, type, section, description) FROM (WITH {_entities(False)} SELECT * FROM ents)
      UNION ALL SELECT DISTINCT 'contains', p || ':' || name, p FROM (WITH {_entities(False)} SELECT * FROM ents)
      UNION ALL SELECT 'calls', source, target || '|' || rel_type FROM (WITH {_EDGES} SELECT * FROM edges)
      UNION ALL SELECT 'vectors', p || '_' || f, p FROM (WITH {_P} SELECT * FROM corpus)
      UNION ALL SELECT 'rejects', CAST(doc_id AS VARCHAR), CASE WHEN doc_id % 3 = 1 THEN 'batch 1' ELSE 'batch 2' END FROM documents""",
    "program_upsert": """SELECT 'U' || user_id AS name, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""",
    "entity_upsert": """SELECT 'U' || user_id || ':' || event_type AS id, 'U' || user_id AS program, event_type AS name, CAST(event_id AS VARCHAR) AS description
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""",
    "edge_upsert": "SELECT 'U' || user_id AS source, event_type AS target, 'CALLS' AS rel_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated FROM events GROUP BY ALL",
    "merge_versions": """SELECT o_custkey, o_orderkey, ver FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY ver DESC, o_orderkey DESC) AS r FROM (
      SELECT *, CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 1 END AS ver FROM orders)) WHERE r = 1""",
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "vector_topk": f"""WITH q AS ({_means('')}) SELECT vec_id, label, round(round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q.v), 12), 6) AS score
      FROM embeddings, q ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q.v), 12) DESC, vec_id LIMIT 10""",
    "vector_topk_batch": f"""WITH q AS ({_means('label')}), s AS (SELECT CAST(q.label AS VARCHAR) AS query_id, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q.v), 12) AS score
      FROM embeddings, q), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
      SELECT query_id, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= 5""",
    "vector_topk_fiftieth": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
      s AS (SELECT CAST(q.vec_id AS VARCHAR) AS query_id, v.vec_id, round(list_cosine_similarity(v.e, q.e), 12) AS score FROM v, v q WHERE q.vec_id % 50 = 0),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
      SELECT query_id, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= 5""",
    "embed_documents": f"""WITH e AS ({_bag('documents', 'doc_id', 'text')})
      SELECT doc_id, array_to_string(list_transform(v, lambda x: CAST(CAST(round(x * 1000000) AS BIGINT) AS VARCHAR)), ',') AS vector FROM e""",
    "doc_topk": f"""WITH {_Q}, dv AS ({_bag('documents', 'doc_id', 'text')}), qv AS ({_bag('questions', 'query_id', 'question')}),
      s AS (SELECT doc_id, round(list_cosine_similarity(dv.v, qv.v), 12) AS score FROM dv, qv WHERE query_id = '1' AND list_sum(dv.v) > 0)
      SELECT CAST(doc_id AS VARCHAR) AS id, round(score, 6) AS score, length(text) AS n FROM s JOIN documents USING (doc_id) ORDER BY s.score DESC, id LIMIT 5""",
    "context_segments": f"WITH {_RETRIEVED} SELECT query_id, CAST(rank AS INT) AS rank, segment FROM segments",
    "dependency_context": f"WITH {_RETRIEVED} SELECT query_id, string_agg(deps, chr(10) ORDER BY rank) AS dependencies FROM segments GROUP BY query_id",
    "filled_prompts": f"""WITH {_RETRIEVED}, g AS (SELECT query_id, string_agg(segment, chr(10) || chr(10) ORDER BY rank) AS context, string_agg(deps, chr(10) ORDER BY rank) AS deps FROM segments GROUP BY query_id)
      SELECT query_id, {_quote(_HEAD)} || context || {_quote(_MIDDLE)} || deps || {_quote(_BEFORE)} || question || {_quote(_TAIL)} AS prompt FROM g JOIN questions USING (query_id)
      UNION ALL SELECT '3', {_quote(prompts.EMPTY_QUESTION_HINT)}""",
    "markdown_segments": """SELECT doc_id, '**Source**: ' || source || chr(10) || '**Type**: null' || chr(10) || '**Code**:' || chr(10) || '```' || chr(10) || text || chr(10) || '```' AS segment FROM documents""",
    "question_guard": rf"""SELECT conv_id, turn, CASE WHEN NOT regexp_full_match(text, '[\x00-\x20]*') THEN text ELSE {_quote(prompts.EMPTY_QUESTION_HINT)} END AS question FROM conversations""",
    "list_rows": f"WITH {_LINES} SELECT doc_id || '_' || line_no AS id, raw AS document, CAST(line_no AS VARCHAR) AS line FROM lines",
    "split_lines": f"WITH {_LINES} SELECT CAST(doc_id AS VARCHAR) AS path, CAST(line_no AS INT) AS line_no, raw FROM lines",
    "normalized_lines": f"""WITH {_LINES} SELECT CAST(doc_id AS VARCHAR) AS path, CAST(line_no AS INT) AS line_no, substr(raw, 1, 6) AS seq, substr(raw, 7, 1) AS indicator,
      substr(raw, 8, 65) AS code, substr(raw, 7, 1) IN ('*', '/') AS is_comment FROM lines""",
    "pic_types": f"WITH {_PICS} SELECT p_partkey, pic, {_TYPE} AS type FROM pics",
    "pic_lengths": f"""WITH {_PICS}, t AS (SELECT *, {_TYPE} AS type FROM pics), w AS (SELECT *, {_PARTS} FROM t),
      l AS (SELECT *, {_ILEN} AS ilen, {_FLEN} AS flen, {_SLEN} AS slen FROM w)
      SELECT p_partkey, ilen AS integer_len, flen AS fraction_len, slen AS string_len, {_LEN} AS length,
        CASE WHEN type IN ('INTEGER', 'FLOAT') THEN {_digits('w')} END AS digits,
        CASE WHEN type = 'INTEGER' THEN 0 WHEN type = 'FLOAT' THEN {_digits('fr')} END AS decimals FROM l""",
    "occurs_max": "SELECT l_orderkey, max(greatest(1, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber ELSE 0 END, CAST(trunc(l_quantity) AS INT))) AS max_occurs FROM lineitem GROUP BY 1",
    "column_names": "SELECT c_custkey, replace(replace(lower(replace(c_name, '#', '-#')), '-', '_'), '#', '$') AS name FROM customer",
    "name_labels": """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'RECORD' ELSE 'FIELD' END AS label,
      'Level: ' || (p_size % 5 + 1) || CASE WHEN p_partkey % 2 = 0 THEN ', Type: ' || p_type ELSE '' END AS description,
      upper(substr(p_name, 1, 1)) || substr(lower(p_name), 2) AS unit_name FROM part""",
    "sign_rows": """SELECT c_custkey, c_acctbal > 0 AS positive, NOT (c_acctbal > 0) AS not_positive, c_acctbal < 0 AS negative, NOT (c_acctbal < 0) AS not_negative,
      c_acctbal = 0 AS zero, c_acctbal <> 0 AS not_zero FROM customer""",
    "combined_rows": """SELECT l_orderkey, l_linenumber,
      CASE WHEN l_tax > 0.01 THEN l_quantity > 10 AND l_quantity > l_linenumber * 5 AND l_quantity > 20 END AS gt_and,
      CASE WHEN l_tax > 0.01 THEN l_quantity <= 10 OR l_quantity <= l_linenumber * 5 OR l_quantity <= 20 END AS le_or,
      CASE WHEN l_tax > 0.01 THEN NOT (l_quantity > 10) OR NOT (l_quantity > l_linenumber * 5) OR NOT (l_quantity > 20) END AS not_gt_or,
      CASE WHEN l_tax > 0.01 THEN l_quantity = 10 OR l_quantity = l_linenumber * 5 OR l_quantity = 20 END AS eq_or FROM lineitem""",
    "compare_rows": f"""WITH {_MIXED} SELECT l_orderkey, l_linenumber,
      CASE WHEN lk IS NULL THEN NULL WHEN lk IN ('H', 'L') AND rk IN ('H', 'L') THEN lk = rk ELSE c = 0 END AS eq,
      CASE WHEN lk IS NULL THEN NULL WHEN lk IN ('H', 'L') OR rk IN ('H', 'L') THEN lk <> rk ELSE c <> 0 END AS ne,
      c > 0 AS gt, c >= 0 AS ge, c < 0 AS lt, c <= 0 AS le FROM cmp""",
    "value_texts": f"""WITH {_MIXED} SELECT l_orderkey, l_linenumber, {_TEXT} AS text, CASE WHEN lk = 'D' THEN replace({_TEXT}, '.', ',') ELSE {_TEXT} END AS comma_text,
      CAST(CAST(l_discount AS DECIMAL(12,2)) AS DOUBLE) AS parsed,
      CASE l_linenumber WHEN 1 THEN CAST(ld AS DOUBLE) WHEN 3 THEN 0.0 WHEN 4 THEN 0.0 END AS number FROM cmp""",
    "condition_chain": """SELECT l_orderkey, l_linenumber,
      CASE WHEN l_linenumber <> 3 THEN (((l_quantity > 25) OR (l_discount > 0.05)) AND l_returnflag = 'N') OR l_tax >= 0.08 END AS holds,
      CASE WHEN l_linenumber <> 3 THEN ((NOT (l_quantity > 25) OR (l_discount > 0.05)) AND l_returnflag = 'N') OR l_tax >= 0.08 END AS not_holds FROM lineitem""",
    "condition_chain_rows": """SELECT l_orderkey, l_linenumber,
      CASE WHEN l_linenumber <> 3 THEN (((l_quantity > 25) OR (l_discount > 0.05)) AND l_returnflag = 'N') OR l_tax >= 0.08 END AS holds FROM lineitem""",
    "blank_rows": "SELECT c_custkey, c_nationkey % 2 = 0 AS blank, c_nationkey % 2 = 0 AND c_custkey % 3 = 0 AS group_blank FROM customer",
    "literal_rows": """WITH r AS (SELECT p_partkey, p_size AS s, p_partkey % 12 AS m FROM part)
      SELECT p_partkey, CASE m WHEN 0 THEN '''it no. ' || s || '''' WHEN 1 THEN CAST(s AS VARCHAR) WHEN 2 THEN s || '.50' WHEN 3 THEN '-' || s WHEN 4 THEN 'SPACES' WHEN 5 THEN 'ZEROES'
          WHEN 6 THEN 'HIGH-VALUES' WHEN 7 THEN 'low-value' WHEN 8 THEN 'TRUE' WHEN 9 THEN 'QUOTE' WHEN 10 THEN '1 THRU ' || s ELSE s || ' 99' END AS raw,
        CASE WHEN m IN (0, 4) THEN 'STRING' WHEN m IN (1, 3, 5, 10, 11) THEN 'INTEGER' WHEN m = 2 THEN 'FLOAT' WHEN m = 8 THEN 'BOOLEAN' END AS type,
        CASE WHEN m IN (0, 4) THEN 'STRING' WHEN m IN (1, 2, 3, 5, 11) THEN 'DECIMAL' WHEN m = 6 THEN 'HIGH' WHEN m = 7 THEN 'LOW' WHEN m = 8 THEN 'BOOLEAN' END AS kind,
        CASE m WHEN 0 THEN 'it no. ' || s WHEN 1 THEN CAST(s AS VARCHAR) WHEN 2 THEN s || '.5' WHEN 3 THEN '-' || s WHEN 4 THEN ' ' WHEN 5 THEN '0' WHEN 6 THEN '' WHEN 7 THEN ''
          WHEN 8 THEN '1' WHEN 11 THEN CAST(s AS VARCHAR) END AS text FROM r""",
    "arith_rows": """WITH l AS (SELECT *, CAST(l_extendedprice AS DECIMAL(12,2)) AS p, CAST(l_quantity AS DECIMAL(12,2)) AS q, l_linenumber % 4 AS d FROM lineitem),
      h AS (SELECT *, CAST(p * 100 AS HUGEINT) * 100000000 AS scaled FROM l),
      v AS (SELECT *, CASE WHEN d = 0 THEN scaled ELSE (2 * scaled + d) // (2 * d) END AS ratio FROM h)
      SELECT l_orderkey, l_linenumber, CAST(CAST(p AS DECIMAL(38,10)) + CAST('0.000000000' || l_linenumber AS DECIMAL(38,10)) AS VARCHAR) AS total,
      CASE WHEN l_linenumber <> 5 THEN CAST(CAST(p - q AS DECIMAL(38,10)) AS VARCHAR) END AS net,
      CAST((CAST(l_orderkey AS HUGEINT) + 1000000000000000) * CAST(q * 100 AS HUGEINT) // 100 AS VARCHAR) || '.'
        || lpad(CAST((CAST(l_orderkey AS HUGEINT) + 1000000000000000) * CAST(q * 100 AS HUGEINT) % 100 AS VARCHAR), 2, '0') || '00000000' AS product,
      CAST(ratio // 10000000000 AS VARCHAR) || '.' || lpad(CAST(ratio % 10000000000 AS VARCHAR), 10, '0') AS quotient,
      '0.000000000' || l_linenumber AS kept, CAST(CAST(d * d AS DECIMAL(38,10)) AS VARCHAR) AS square FROM v""",
    "expression_types": """SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN 'BOOLEAN' WHEN 1 THEN 'INTEGER' WHEN 2 THEN 'FLOAT' WHEN 3 THEN 'STRING' WHEN 4 THEN 'INTEGER'
      WHEN 5 THEN 'INTEGER' WHEN 6 THEN 'FLOAT' WHEN 7 THEN 'BOOLEAN' WHEN 8 THEN 'INTEGER' ELSE 'STRING' END AS type FROM part""",
    "constraint_violations": """WITH c AS (SELECT *, trunc(abs(CAST(c_acctbal AS DECIMAL(18,2)))) AS whole FROM customer)
      SELECT c_custkey, 'c_name' AS "column", 'size<=18' AS rule, c_name AS found FROM c WHERE length(c_name) > 18
      UNION ALL SELECT c_custkey, 'c_acctbal', 'digits<=3.0', CAST(c_acctbal AS VARCHAR) FROM c WHERE whole >= 1000 OR CAST(c_acctbal AS DECIMAL(18,2)) <> trunc(CAST(c_acctbal AS DECIMAL(18,2)))
      UNION ALL SELECT c_custkey, 'c_custkey', 'digits<=3.0', CAST(c_custkey AS VARCHAR) FROM c WHERE c_custkey >= 1000
      UNION ALL SELECT c_custkey, 'c_nationkey', 'digits<=1.0', CAST(c_nationkey AS VARCHAR) FROM c WHERE c_nationkey >= 10
      UNION ALL SELECT c_custkey, 'c_mktsegment', 'size<=9', c_mktsegment FROM c WHERE length(c_mktsegment) > 9""",
}

SQL["collection_query"] = SQL["doc_topk"]
