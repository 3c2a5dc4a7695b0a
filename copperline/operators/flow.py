"""Which paragraphs can run: control flow as intervals of ordinals, one row per program.

The paragraphs of a procedure division, and the code that stands directly below a section header or ahead of all, are
numbered in order. A PERFORM, with or without THRU, is an interval of numbers, a section is the interval of its
paragraphs, and falling through leads to the next number. All of this lies in the division's row: no join, no shuffle.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from copperline.functions.arrays import let, slice_array
from copperline.operators import structure

_NAME = r"[A-Za-z0-9][A-Za-z0-9_-]*"
_PERFORM = rf"(?i)(?<![\w-])PERFORM\s+({_NAME}(?:\s+(?:THRU|THROUGH)\s+{_NAME})?)"
_GO = rf"(?i)(?<![\w-])GO\s+(?:TO\s+)?({_NAME}(?:[\s,]+{_NAME})*)"
# What ends a run of a paragraph, and what makes a sentence conditional.
_LEAVES = r"(?i)(?<![\w-])(STOP\s+RUN|GOBACK|EXIT\s+PROGRAM|GO\s+(TO\s+)?[\w-]+(?!.*\sDEPENDING\s))(?![\w-])"
_CONDITIONAL = (
    r"(?i)(?<![\w-])(IF|EVALUATE|WHEN|SEARCH|DEPENDING|AT\s+END|END-OF-PAGE|EOP|INVALID|EXCEPTION|OVERFLOW|SIZE\s+ERROR|NO\s+DATA"
    r"|PERFORM\s+(UNTIL|VARYING|WITH|TEST|\S+\s+TIMES))(?![\w-])"
)
_INT = T.IntegerType()
_FLOW = T.StructType([
    T.StructField("edges", T.ArrayType(T.StructType([
        T.StructField("from", _INT), T.StructField("verb", T.StringType()), T.StructField("first", _INT), T.StructField("last", _INT),
    ]))),
    T.StructField("reached", T.ArrayType(T.BooleanType())),
])


def _is_header(sentence: Column) -> Column:
    return structure.is_section_header(sentence) | structure.is_paragraph_header(sentence)


def _sentence(text: Column) -> Column:
    """The jumps of a sentence, and whether control never gets past it."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?is)\bEXEC\s.*?\bEND-EXEC\b", "EXEC"), r"""(["'])[^"']*\1""", "''")
    return let(bare, lambda t: F.struct(
        F.regexp_extract_all(t, F.lit(_PERFORM), F.lit(1)).alias("performs"), F.regexp_extract_all(t, F.lit(_GO), F.lit(1)).alias("goes"),
        (t.rlike(_LEAVES) & ~t.rlike(_CONDITIONAL)).alias("leaves"),
    ))


def _node(part: Column) -> Column:
    """A numbered piece of the division: its name (null ahead of the first), whether it opens a section, its sentences."""
    head = F.get(part, F.lit(0))
    named = _is_header(head)
    section = F.nullif(F.regexp_extract(head, structure.SECTION_HEADER, 1), F.lit(""))
    opens = structure.is_section_header(head)
    return F.struct(
        F.when(opens, section).when(named, head).alias("name"), opens.alias("section"),
        F.transform(F.slice(part, 2, F.greatest(F.size(part) - 1, F.lit(0))), _sentence).alias("sentences"),
    )


class Program:
    """The numbered pieces of one procedure division; a small graph walk."""

    def __init__(self, nodes: list[dict]):
        self.nodes = nodes
        self.spans: dict[str, tuple[int, int]] = {}
        sections = [i for i, n in enumerate(nodes) if n.get("section")]
        for i, n in enumerate(nodes):
            if n.get("name") and not n.get("section"):
                self.spans.setdefault(n["name"].upper(), (i, i))
        for i, end in zip(sections, [*sections[1:], len(nodes)]):
            self.spans.setdefault(nodes[i]["name"].upper(), (i, end - 1))

    def performed(self, text: str) -> tuple[int, int] | None:
        words = text.upper().split()
        first, last = self.spans.get(words[0]), self.spans.get(words[-1])
        return (first[0], last[1]) if first and last and first[0] <= last[1] else first

    def targets(self, text: str) -> list[int]:
        """The pieces a GO TO names: words up to the first that is no name of one."""
        out = []
        for word in text.upper().replace(",", " ").split():
            if word not in self.spans:
                break
            out.append(self.spans[word][0])
        return out

    def edges(self) -> list[tuple[int, str, int, int]]:
        """(from, verb, first, last); FALL leads to the next piece, unless control never gets past this one."""
        out = []
        for i, node in enumerate(self.nodes):
            left = False
            for s in node["sentences"]:
                out += [(i, "PERFORM", *span) for p in s["performs"] if (span := self.performed(p))]
                out += [(i, "GO TO", t, t) for g in s["goes"] for t in self.targets(g)]
                left = left or s["leaves"]
            if not left and i + 1 < len(self.nodes):
                out.append((i, "FALL", i + 1, i + 1))
        return list(dict.fromkeys(out))

    def reached(self) -> list[bool]:
        """Pieces that control can reach from the start.

        What is performed returns after the last piece of its interval; a jump out of it takes the return
        along. So a state is a piece and the piece after which control returns.
        """
        waiting, seen = [(0, len(self.nodes))], set()
        while waiting:
            at, end = waiting.pop()
            while at < len(self.nodes) and (at, end) not in seen:
                seen.add((at, end))
                left = False
                for s in self.nodes[at]["sentences"]:
                    waiting += [span for p in s["performs"] if (span := self.performed(p))]
                    waiting += [(t, end) for g in s["goes"] for t in self.targets(g)]
                    if s["leaves"]:  # what stands behind it in this piece cannot run
                        left = True
                        break
                if left or at == end:
                    break
                at += 1
        found = {at for at, _ in seen}
        return [i in found for i in range(len(self.nodes))]


@F.pandas_udf(_FLOW)
def _flow(nodes: pd.Series) -> pd.DataFrame:
    programs = [Program(json.loads(n)) for n in nodes]
    return pd.DataFrame({"edges": [p.edges() for p in programs], "reached": [p.reached() for p in programs]})


def program_flow(division_rows: DataFrame) -> DataFrame:
    """path, program, ``names``, ``opens_section``, ``edges`` and ``reached`` per procedure division."""
    cut = division_rows.where(F.col("division") == "PROCEDURE").withColumn("_parts", slice_array(F.col("div_sents"), _is_header))
    nodes = cut.select("path", "program", F.transform("_parts", lambda p: _node(p["part"])).alias("_nodes"))
    flowed = nodes.withColumn("_flow", _flow(F.to_json("_nodes")))
    return flowed.select(
        "path", "program", F.transform("_nodes", lambda n: n["name"]).alias("names"),
        F.transform("_nodes", lambda n: n["section"]).alias("opens_section"), "_flow.edges", "_flow.reached",
    )


def flow_edges(flow: DataFrame) -> DataFrame:
    """path, program, from_no, from_name, verb, first_no, last_no, first_name, last_name: an interval per edge."""
    e = F.col("_e")
    return flow.select("path", "program", "names", F.explode_outer("edges").alias("_e")).where(F.col("_e").isNotNull()).select(
        "path", "program", e["from"].alias("from_no"), F.get("names", e["from"]).alias("from_name"), e["verb"].alias("verb"),
        e["first"].alias("first_no"), e["last"].alias("last_no"), F.get("names", e["first"]).alias("first_name"),
        F.get("names", e["last"]).alias("last_name"),
    )


def paragraph_reach(flow: DataFrame) -> DataFrame:
    """path, program, no, name, opens_section and whether the named piece can run."""
    zipped = F.arrays_zip(F.col("names").alias("name"), F.col("opens_section").alias("opens_section"), F.col("reached").alias("reached"))
    return flow.select("path", "program", F.posexplode_outer(zipped).alias("no", "_p")).select("path", "program", "no", "_p.*").where(
        F.col("name").isNotNull()
    )
