"""Statements of the procedure division with their nesting, one row-local fold per sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from copperline.functions import source_text as st
from copperline.functions.arrays import built_once, let, scan_states
from copperline.operators import structure

# Statement verbs.
VERBS = [
    "ACCEPT", "ADD", "ALTER", "CALL", "CANCEL", "CLOSE", "COMPUTE", "CONTINUE", "DELETE", "DISABLE", "DISPLAY",
    "DIVIDE", "ENABLE", "ENTRY", "EVALUATE", "EXEC", "EXHIBIT", "EXIT", "GENERATE", "GO", "GOBACK", "IF",
    "INITIALIZE", "INITIATE", "INSPECT", "MERGE", "MOVE", "MULTIPLY", "NEXT", "OPEN", "PERFORM", "PURGE", "READ",
    "RECEIVE", "RELEASE", "RETURN", "REWRITE", "SEARCH", "SEND", "SET", "SORT", "START", "STOP", "STRING",
    "SUBTRACT", "TERMINATE", "UNSTRING", "WRITE",
]
# Which statements a clause can belong to.
CLAUSE_OWNERS = {
    "ELSE": ["IF"],
    "WHEN": ["EVALUATE", "SEARCH"],
    "SIZE": ["ADD", "COMPUTE", "DIVIDE", "MULTIPLY", "SUBTRACT"],
    "EXCEPTION": ["ACCEPT", "CALL", "RECEIVE"],
    "OVERFLOW": ["CALL", "STRING", "UNSTRING"],
    "KEY": ["DELETE", "READ", "REWRITE", "START", "WRITE"],
    "END": ["READ", "RETURN", "SEARCH"],
    "PAGE": ["WRITE"],
    "DATA": ["RECEIVE"],
}
_BLOCK_VERBS = ["IF", "EVALUATE", "SEARCH"]
_STATE = (
    "STRUCT<stack: ARRAY<STRUCT<no: INT, verb: STRING, open: BOOLEAN>>, n: INT, no: INT, verb: STRING, "
    "depth: INT, parent_no: INT, text: STRING>"
)
_STACK = "ARRAY<STRUCT<no: INT, verb: STRING, open: BOOLEAN>>"
_EVENT = "STRUCT<at: INT, verb: STRING, opens: BOOLEAN, owners: ARRAY<STRING>, closes: BOOLEAN, text: STRING>"


def _owners(name: str) -> Column:
    return F.array(*[F.lit(v) for v in CLAUSE_OWNERS[name]])


@built_once
def _marks(words_name: str) -> Column:
    """Clauses, verbs and END- words among the upper-case tokens, with their positions."""
    words = F.col(words_name)

    def word(i: Column) -> Column:
        return F.get(words, i)

    def mark(w: Column, i: Column) -> Column:
        before, after, after2 = word(i - 1), word(i + 1), word(i + 2)
        inline_perform = (after2 == "TIMES") | after.rlike(rf"^(UNTIL|VARYING|WITH|TEST|{'|'.join(VERBS)})$")
        clause = (
            F.when(w == "ELSE", "ELSE")
            .when(w == "WHEN", "WHEN")
            .when((w == "ERROR") & (before == "SIZE"), "SIZE")
            .when((w == "EXCEPTION") & (before == "ON") | ((w == "EXCEPTION") & (before == "NOT")), "EXCEPTION")
            .when((w == "OVERFLOW") & before.isin("ON", "NOT"), "OVERFLOW")
            .when((w == "INVALID"), "KEY")
            .when((w == "END") & (before == "AT"), "END")
            .when(w.isin("END-OF-PAGE", "EOP"), "PAGE")
            .when((w == "DATA") & before.isin("NO", "WITH"), "DATA")
        )
        verb = F.when(w.isin(*VERBS) & ~((w == "NEXT") & (after != "SENTENCE")), w)
        return F.struct(
            i.cast("int").alias("at"),
            clause.alias("clause"),
            verb.alias("verb"),
            (verb.isin(*_BLOCK_VERBS) | ((verb == "PERFORM") & F.coalesce(inline_perform, F.lit(False)))).alias("opens"),
            F.when(w.startswith("END-") & (w != "END-OF-PAGE"), F.substring(w, 5, 100)).alias("closed"),
        )

    marks = F.transform(words, mark)
    return F.filter(
        marks, lambda m: m["clause"].isNotNull() | m["verb"].isNotNull() | m["closed"].isNotNull()
    )


@built_once
def _events(marks_name: str, toks_name: str) -> Column:
    """Marks as fold events; each verb gets its text up to the next mark."""
    marks, toks = F.col(marks_name), F.col(toks_name)
    owners_map = F.create_map(*[x for n in CLAUSE_OWNERS for x in (F.lit(n), _owners(n))])

    def event(m: Column, k: Column) -> Column:
        following = F.get(marks, k + 1)["at"]
        until = F.coalesce(following, F.size(toks))
        owners = F.when(m["closed"].isNotNull(), F.array(m["closed"])).when(
            m["clause"].isNotNull(), F.try_element_at(owners_map, m["clause"])
        )
        return F.struct(
            m["at"].alias("at"), m["verb"].alias("verb"), m["opens"].alias("opens"), owners.alias("owners"),
            m["closed"].isNotNull().alias("closes"),
            F.when(m["verb"].isNotNull(), F.array_join(F.slice(toks, m["at"] + 1, until - m["at"]), " ")).alias("text"),
        ).cast(_EVENT)

    return F.transform(marks, event)


def _step(prev: Column, e: Column) -> Column:
    """State after one event: statements that may still take nested ones, and the new statement."""
    stack = prev["stack"]

    def on_verb(parents: Column) -> Column:
        opened = F.struct(prev["n"].alias("no"), e["verb"].alias("verb"), e["opens"].alias("open"))
        return F.struct(
            F.array_append(parents, opened).alias("stack"),
            (prev["n"] + 1).alias("n"),
            prev["n"].alias("no"),
            e["verb"].alias("verb"),
            F.size(parents).alias("depth"),
            F.try_element_at(parents, F.lit(-1))["no"].alias("parent_no"),
            e["text"].alias("text"),
        )

    def on_clause(owner_at: Column) -> Column:
        # a clause reopens the nearest statement that can own it, an END- word closes it
        below = F.slice(stack, 1, owner_at - 1)
        owner = F.get(stack, owner_at - 1)
        reopened = F.struct(owner["no"].alias("no"), owner["verb"].alias("verb"), F.lit(True).alias("open"))
        rest = F.when(owner_at == 0, stack).when(e["closes"], below).otherwise(F.array_append(below, reopened))
        none = F.lit(None)
        return F.struct(
            rest.alias("stack"), prev["n"].alias("n"), none.cast("int").alias("no"), none.cast("string").alias("verb"),
            none.cast("int").alias("depth"), none.cast("int").alias("parent_no"), none.cast("string").alias("text"),
        )

    owner_at = F.coalesce(F.array_max(
        F.transform(stack, lambda s, i: F.when(F.array_contains(e["owners"], s["verb"]), i + 1))
    ), F.lit(0))
    return F.when(
        e["verb"].isNotNull(), let(F.filter(stack, lambda s: s["open"]), on_verb)
    ).otherwise(let(owner_at, on_clause))


@built_once
def _scan(events: str) -> Column:
    """Statements from the events of a sentence."""
    empty = F.struct(
        F.array().cast(_STACK).alias("stack"), F.lit(0).alias("n"),
        *[F.lit(None).alias(c) for c in ("no", "verb", "depth", "parent_no", "text")],
    ).cast(_STATE)
    states = scan_states(F.col(events), _STATE, empty, _step)
    return F.transform(F.filter(states, lambda s: s["no"].isNotNull()), lambda s: s.dropFields("stack", "n"))


def procedure_sentences(section_rows: DataFrame, pattern: str | None = None) -> DataFrame:
    """Procedure division sentences without headers: adds scope.

    ``pattern`` keeps only sentences that match it, ahead of the costly statement fold.
    """
    flat = structure.paragraphs_of(section_rows.where(F.col("division") == "PROCEDURE")).select(
        "path", "program", "unit_base", "section", "paragraph", "base", F.posexplode_outer("par_sents").alias("_i", "text")
    )
    scope = (
        F.when(F.col("paragraph").isNotNull(), "paragraph").when(F.col("section").isNotNull(), "section")
        .otherwise("division")
    )
    rows = flat.select(
        "path", "program", "unit_base", "section", "paragraph", scope.alias("scope"),
        (F.col("base") + F.col("_i")).alias("sent_no"), "text",
    )
    return rows.where(F.col("text").rlike(pattern)) if pattern else rows


def statement_tree(sentence_rows: DataFrame) -> DataFrame:
    """One row per statement: verb, text, depth and the number of its parent in the sentence.

    ``stmt_no`` counts within the sentence; (path, sent_no, stmt_no) orders a file. A period
    closes everything, so sentences are independent of each other.
    """
    # text between EXEC and END-EXEC is another language: keep it as one quoted-like token
    guarded = F.regexp_replace(F.col("text"), r"(?is)\bEXEC\s.*?\bEND-EXEC\b", "EXEC")
    toks = sentence_rows.withColumn("_toks", st.tokens(guarded)).withColumn(
        "_exec", F.regexp_extract_all(F.col("text"), F.lit(r"(?is)\bEXEC\s.*?\bEND-EXEC\b"), F.lit(0))
    )
    marked = toks.withColumn("_words", F.transform("_toks", F.upper)).withColumn("_marks", _marks("_words"))
    events = marked.withColumn("_events", _events("_marks", "_toks"))
    keep = ["path", "program", "unit_base", "section", "paragraph", "scope", "sent_no"]
    rows = events.select(*keep, "_exec", F.inline_outer(_scan("_events"))).where(F.col("no").isNotNull()).withColumn(
        "text", F.regexp_replace("text", r"(?i)(\s+(NOT|ON|AT|SIZE|WITH|NO))+$", "")
    )
    exec_text = F.when(
        F.col("verb") == "EXEC",
        F.coalesce(F.get("_exec", F.lit(0)), F.col("text")),
    )
    return rows.select(
        "path", "program", "unit_base", "section", "paragraph", "scope", "sent_no",
        F.col("no").alias("stmt_no"), "verb", F.coalesce(exec_text, F.col("text")).alias("text"),
        "depth", "parent_no",
    )


def statements(section_rows: DataFrame, pattern: str | None = None) -> DataFrame:
    """All statements, nested ones too."""
    return statement_tree(procedure_sentences(section_rows, pattern))


def flat_statements(stmts: DataFrame) -> DataFrame:
    """Statements of division, section and paragraph scope that are not nested in another."""
    return stmts.where(F.col("depth") == 0)


def statement_census(stmts: DataFrame, nested: bool = True) -> DataFrame:
    """Statements per program and verb."""
    rows = stmts if nested else flat_statements(stmts)
    return rows.groupBy("program", "verb").agg(F.count(F.lit(1)).alias("n"))
