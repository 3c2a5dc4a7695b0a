"""File usage, control flow, data movement and embedded SQL, read from statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from copperline.functions import source_text as st
from copperline.operators import references, structure

_KEY = ["path", "program", "section", "paragraph", "sent_no", "stmt_no"]
# Words of OPEN and CLOSE that are no file names.
_OPEN_MODES = ["INPUT", "OUTPUT", "I-O", "EXTEND"]
_OPTION_WORDS = ["WITH", "NO", "REWIND", "REVERSED", "LOCK", "REEL", "UNIT", "FOR", "REMOVAL", "WAIT"]


def extract_file_usage(stmts: DataFrame) -> DataFrame:
    """One row per file an OPEN, CLOSE, READ or WRITE names: verb, mode, file_name, into_name.

    A WRITE names a record; ``lineage.file_lineage`` finds the file behind it.
    """
    rows = stmts.where(F.col("verb").isin("OPEN", "CLOSE", "READ", "WRITE", "REWRITE"))
    # what follows USING in a CLOSE is no file
    words = st.tokens(F.regexp_replace("text", r"(?i)\sUSING\s.*$", ""))
    rest = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    up = lambda w: F.upper(w)
    # OPEN: cut at the mode words, each file takes the mode word before it
    groups = F.regexp_extract_all(
        F.array_join(rest, " "), F.lit(r"(?i)(?<!\S)((?:INPUT|OUTPUT|I-O|EXTEND)\s(?:(?!(?:INPUT|OUTPUT|I-O|EXTEND)(?:\s|$))\S+(?:\s+|$))+)"),
        F.lit(1),
    )
    opened = F.flatten(F.transform(groups, lambda g: F.transform(
        F.filter(F.split(F.trim(g), r"\s+"), lambda w: ~up(w).isin(_OPEN_MODES + _OPTION_WORDS)),
        lambda w: F.struct(F.upper(F.regexp_extract(g, r"^(\S+)", 1)).alias("mode"), w.alias("file_name")),
    )))
    named = F.transform(
        F.filter(rest, lambda w: ~up(w).isin(_OPTION_WORDS)),
        lambda w: F.struct(F.lit(None).cast("string").alias("mode"), w.alias("file_name")),
    )
    first = F.slice(named, 1, 1)
    uses = F.when(F.col("verb") == "OPEN", opened).when(F.col("verb") == "CLOSE", named).otherwise(first)
    into = F.nullif(F.regexp_extract("text", r"(?i)\sINTO\s+(\S+)", 1), F.lit(""))
    return rows.select(
        *_KEY, "verb", F.when(F.col("verb") == "READ", into).alias("into_name"), F.posexplode(uses).alias("position", "use")
    ).select(*_KEY, "verb", "position", "use.mode", "use.file_name", "into_name")


def extract_file_control(sentence_rows: DataFrame) -> DataFrame:
    """SELECT entries: file_name and, where given, the external name it is assigned to."""
    rows = sentence_rows.where((F.col("division") == "ENVIRONMENT") & F.col("text").rlike(r"(?i)^SELECT\s"))
    external = F.regexp_extract("text", r"""(?i)\sASSIGN(?:\s+TO)?\s+("[^"]*"|'[^']*'|\S+)""", 1)
    return rows.select(
        "path", "program",
        F.regexp_extract("text", r"(?i)^SELECT\s+(?:OPTIONAL\s+)?(\S+)", 1).alias("file_name"),
        F.nullif(st.unquote(external), F.lit("")).alias("external_name"),
    )


def _perform_mode(text: Column) -> Column:
    after = text.rlike(r"(?i)\sTEST\s+AFTER\b")
    return (
        F.when(text.rlike(r"(?i)\sTIMES\b"), "TIMES")
        .when(text.rlike(r"(?i)\sVARYING\b"), "VARYING")
        .when(text.rlike(r"(?i)\sUNTIL\b") & after, "UNTIL AFTER")
        .when(text.rlike(r"(?i)\sUNTIL\b"), "UNTIL BEFORE")
        .otherwise("ONCE")
    )


_NAME = r"([A-Za-z0-9][A-Za-z0-9_-]*)"
_PERFORM = rf"(?i)^PERFORM\s+{_NAME}"
_THROUGH = rf"(?i)^PERFORM\s+\S+\s+(?:THROUGH|THRU)\s+{_NAME}"
_INLINE_PERFORM = r"(?i)^PERFORM\s+(UNTIL|VARYING|WITH|TEST|\S+\s+TIMES)\b"


def paragraph_order(division_rows: DataFrame) -> DataFrame:
    """path, program and the paragraph and section names of its procedure division in order."""
    sections = F.filter("div_sents", structure.is_section_header)
    return division_rows.where(F.col("division") == "PROCEDURE").select(
        "path", "program", F.filter("div_sents", structure.is_paragraph_header).alias("paragraph_names"),
        F.transform(sections, lambda s: F.regexp_extract(s, r"^\s*(\S+)", 1)).alias("section_names"),
    )


def extract_control_flow(stmts: DataFrame, order: DataFrame) -> DataFrame:
    """PERFORM and GO TO targets: verb, mode, position, target, self_loop.

    PERFORM ... THROUGH names every paragraph from the first to the last: those are a slice of
    the program's paragraph names (``order``, one row per program), so no range join is needed.
    Sections count likewise. If an end is unknown, of the other kind or before the start, the two
    names themselves are the targets: the row stays.
    """
    text = F.col("text")
    is_go = F.col("verb") == "GO"
    wanted = is_go | ((F.col("verb") == "PERFORM") & text.rlike(_PERFORM) & ~text.rlike(_INLINE_PERFORM))
    body = F.regexp_replace(text, r"(?i)^GO(\s+TO)?\s+|\s+DEPENDING\b.*$", "")
    rows = stmts.where(wanted).select(
        *_KEY,
        F.when(is_go, "GO TO").otherwise("PERFORM").alias("verb"),
        F.when(~is_go, _perform_mode(text)).when(text.rlike(r"(?i)\sDEPENDING\b"), "DEPENDING").otherwise("SIMPLE").alias("mode"),
        F.when(is_go, F.split(F.trim(body), r"\s+")).otherwise(F.array(F.regexp_extract(text, _PERFORM, 1))).alias("_names"),
        F.when(~is_go, F.nullif(F.regexp_extract(text, _THROUGH, 1), F.lit(""))).alias("_last"),
    )
    upper = [F.transform(c, F.upper).alias(f"_upper_{c}") for c in ("paragraph_names", "section_names")]
    names = order.select("path", "program", "paragraph_names", "section_names", *upper)
    joined = rows.join(names, ["path", "program"], "left")

    def span_of(kind: str) -> Column:
        lo = F.array_position(f"_upper_{kind}", F.upper(F.get("_names", F.lit(0)))).cast("int")
        hi = F.array_position(f"_upper_{kind}", F.upper("_last")).cast("int")
        return F.when((lo > 0) & (hi >= lo), F.slice(kind, lo, hi - lo + 1))

    span = F.coalesce(span_of("paragraph_names"), span_of("section_names"), F.array(F.get("_names", F.lit(0)), "_last"))
    targets = F.when(F.col("_last").isNull(), F.col("_names")).otherwise(span)
    out = joined.select(*_KEY, "verb", "mode", F.posexplode(F.coalesce(targets, F.array().cast("array<string>"))).alias("_p", "target"))
    same = F.coalesce(F.upper("target") == F.upper("paragraph"), F.lit(False))
    return out.where(F.col("target") != "").select(
        *_KEY, "verb", "mode", (F.col("_p") + 1).alias("position"), "target", same.alias("self_loop")
    )


def extract_moves(stmts: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """One row per receiving item of a MOVE: sending, receiver, its qualifiers, corresponding.

    With ``items`` each row tells whether the receiver is a group of that program (unknown if no single item fits).
    """
    rows = stmts.where(F.col("verb") == "MOVE")
    words = st.tokens(F.col("text"))
    moved = rows.withColumn("_w", words).withColumn("_to", F.array_position(F.transform("_w", F.upper), "TO").cast("int"))
    corr = F.upper(F.get("_w", F.lit(1))).isin("CORRESPONDING", "CORR")
    start = F.when(corr, 3).otherwise(2)
    receivers = F.array_join(F.slice("_w", F.col("_to") + 1, F.size("_w")), " ")
    cleaned = moved.where(F.col("_to") > 1).select(
        *_KEY, corr.alias("corresponding"),
        F.array_join(F.slice("_w", start, F.col("_to") - start), " ").alias("sending"),
        # subscripts say nothing of the item; qualifiers belong to the name before them
        F.regexp_extract_all(
            F.regexp_replace(receivers, r"\s*\([^)]*\)", ""), F.lit(r"(?i)(?!(?:OF|IN)\s)\S+(?:\s+(?:OF|IN)\s+\S+)*"), F.lit(0)
        ).alias("_receivers"),
    )
    parts = references.split_reference(F.col("_r"))
    out = cleaned.select(*_KEY, "corresponding", "sending", F.posexplode("_receivers").alias("position", "_r")).select(
        *_KEY, "corresponding", "sending", "position", parts["name"].alias("receiver"), parts["qualifiers"].alias("qualifiers")
    )
    if items is None:
        return out
    real = items.where(~F.col("kind").isin("CONDITION", "RENAME"))
    found = references.look_up(out.withColumn("name", F.col("receiver")), references.item_index(real))
    group = F.when(F.size("candidates") == 1, F.get("candidates", F.lit(0))["kind"] == "GROUP")
    return found.withColumn("to_group", group).drop("name", "candidates")


def extract_exec_sql(stmts: DataFrame) -> DataFrame:
    """Embedded SQL: the text between EXEC SQL and END-EXEC."""
    found = F.regexp_extract("text", r"(?is)^EXEC\s+SQL\s+(.*?)\s*END-EXEC", 1)
    return stmts.where((F.col("verb") == "EXEC") & F.col("text").rlike(r"(?i)^EXEC\s+SQL\b")).select(
        *_KEY, found.alias("sql_text")
    )
