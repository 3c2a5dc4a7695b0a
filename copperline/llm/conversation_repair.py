"""Conversation structure repair: generalised LR parsing of the roles with weighted repairs.

The role grammar is ``conversation -> empty | pairs | system pairs``, ``pairs -> pair | pairs pair``,
``pair -> user assistant``. Once user and assistant are reduced to a pair and pairs to one, its LR stack
has one of four tops: nothing yet, a system turn, an open user turn, pairs. Each row may be kept, reroled
or deleted and turns may be inserted before it; every action moves a stack to a new top. The stacks
form a graph: a top is a node that points to the node below with the action in between. Stacks that meet
in an equal top are merged, and the one of the least (cost, audit) stays. Of two audits that end
in the same row none is the start of the other, so the better one stays better whatever follows; a
rank per top stands for the audit, and no audit is built before the end.

A conversation may be of any length. Rows are sorted by range, which cuts a long conversation over many tasks, and
the sorted rows of a conversation are cut into pieces of at most ``PIECE`` rows. A piece is parsed once
from each of the four tops, since what comes before is unknown; a second, narrow pass strings pieces
together and keeps four numbers and a back pointer per piece. Equal rows of a turn are one row with a count
from the start, and whether an equal row came earlier is a join on keys that are unique: no hot keys.

Defined cases: null roles and texts count as ``NULL_AS`` (one space); turns with no number come first, rows of one turn are
ordered by role and text; rows with a null conversation id form one conversation; very long texts are compared by a
digest and otherwise only carried; an empty table gives empty results; other columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from copperline.session import materialize

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5
NULL_AS = " "
PIECE = 256
#: Stack tops after reduction: nothing yet, a system turn, an open user turn, pairs.
EMPTY, SYSTEM, USER, PAIRS = range(4)
#: Shift of a role's initial on a top, with the reductions that follow.
SHIFT = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): PAIRS, (PAIRS, "u"): USER}
ACCEPTING = (EMPTY, PAIRS)
#: The role that an inserted or reroled turn gets on a top: there is only one that fits.
FREE_ROLE = {EMPTY: "user", SYSTEM: "user", USER: "assistant", PAIRS: "user"}
LEGAL_PAIRS = ("su", "ua", "au")
FAULTS = ("blank", "duplicate", "truncated")
_FREE = tuple(SHIFT[top, FREE_ROLE[top][0]] for top in range(4))
#: More inserts in a row than this lead to a top that fewer reach.
_MOST_INSERTS = 2


@dataclass(frozen=True)
class Step:
    """What happens to a row on a stack top: inserts before it, then its own edit."""

    top: int
    inserts: int
    edit: str

    @property
    def inserted(self) -> list[str]:
        top, roles = self.top, []
        for _ in range(self.inserts):
            roles.append(FREE_ROLE[top])
            top = _FREE[top]
        return roles

    @property
    def below(self) -> int:
        """The top on which the row's own edit happens."""
        top = self.top
        for _ in range(self.inserts):
            top = _FREE[top]
        return top

    @property
    def audit(self) -> str:
        return INSERT * self.inserts + self.edit


STEPS = [Step(top, n, edit) for top in range(4) for n in range(_MOST_INSERTS + 1) for edit in (KEEP, REROLE, DELETE)]
#: One character per step, so that the steps of a piece are a string.
CODES = [chr(ord("0") + i) for i in range(len(STEPS))]


@lru_cache(maxsize=10_000)
def moves(initial: str, fault: str | None, count: int) -> list[list[tuple[int, str, str] | None]]:
    """[from][to] -> (cost, audit, code) of the best step for a row; ``count`` equal rows, all but the first deleted."""
    best: list[list] = [[None] * 4 for _ in range(4)]
    for step, code in zip(STEPS, CODES):
        below = step.below
        if step.edit == DELETE:
            to = below
        elif fault in ("blank", "duplicate"):
            continue
        else:
            to = SHIFT.get((below, initial)) if step.edit == KEEP else _FREE[below]
            if to is None:
                continue
        cost = step.inserts * COSTS[INSERT] + COSTS[step.edit] + (count - 1) * COSTS[DELETE]
        cost += TRUNCATED_COST if fault == "truncated" and step.edit != DELETE else 0
        found = (cost, step.audit, code)
        if best[step.top][to] is None or found < best[step.top][to]:
            best[step.top][to] = found
    return best


def parse(rows: list[tuple[str, str | None, int]], start: int) -> list[tuple[int, int, str] | None]:
    """Per final top (cost, rank of its audit, step codes) of the best stack from ``start`` over rows (initial, fault, count)."""
    costs: list[int | None] = [0 if top == start else None for top in range(4)]
    ranks = [0] * 4
    links: list[list[tuple[int, str] | None]] = []  # the graph: per row and top the top below and the action
    for row in rows:
        table = moves(*row)
        merged: list[tuple | None] = [None] * 4
        for top in range(4):
            if costs[top] is None:
                continue
            for to, step in enumerate(table[top]):
                if step is not None:
                    node = (costs[top] + step[0], ranks[top], step[1], top, step[2])
                    if merged[to] is None or node < merged[to]:
                        merged[to] = node
        costs = [node and node[0] for node in merged]
        by_audit = sorted((node[1], node[2], to) for to, node in enumerate(merged) if node)
        for rank, (_, _, to) in enumerate(by_audit):
            ranks[to] = rank
        links.append([node and (node[3], node[4]) for node in merged])
    out: list[tuple[int, int, str] | None] = []
    for top in range(4):
        if costs[top] is None:
            out.append(None)
            continue
        codes, at = [], top
        for column in reversed(links):
            at, code = column[at]
            codes.append(code)
        out.append((costs[top], ranks[top], "".join(reversed(codes))))
    return out


@lru_cache(maxsize=10_000)
def parse_piece(rows: tuple[tuple[str, str | None, int], ...]) -> tuple[list[int], list[int], list[str | None]]:
    """Costs (-1: out of reach), ranks and step codes from each of the four tops to each."""
    ends = [end or (-1, 0, None) for start in range(4) for end in parse(list(rows), start)]
    return [e[0] for e in ends], [e[1] for e in ends], [e[2] for e in ends]


def closing(top: int) -> int:
    """Inserts that lead from a top to the end of a conversation."""
    n = 0
    while top not in ACCEPTING:
        top, n = _FREE[top], n + 1
    return n


def marked(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Distinct rows with ``n``, how often they occur, and ``fault``, the first fault of the row."""
    rows = turns.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(NULL_AS)).alias("role"), F.coalesce(F.col(text_col), F.lit(NULL_AS)).alias("text"),
    ).groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n")).withColumn("digest", F.unhex(F.md5("text")))
    rows = materialize(rows)
    # a row is the first with its role and text if its turn is the least: a join on keys of one row each
    turn = F.when(F.max(F.isnull("turn")), None).otherwise(F.min("turn"))
    first = rows.groupBy("conv_id", "role", "digest").agg(turn.alias("turn")).select(
        *[F.col(c).alias(f"first_{c}") for c in ("conv_id", "turn", "role", "digest")]
    )
    same = F.lit(True)
    for c in ("conv_id", "turn", "role", "digest"):
        same = same & F.col(c).eqNullSafe(F.col(f"first_{c}"))
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    fault = (
        F.when(last == "", "blank").when(F.isnull("first_digest"), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    )
    return rows.join(first, same, "left").select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))


def _known_id(df: DataFrame) -> list[Column]:
    """conv_id with a value where it is null, and a mark: numbers with nulls would travel as floating point."""
    zero = F.lit("0").cast(df.schema["conv_id"].dataType)
    return [F.coalesce("conv_id", zero).alias("conv_id"), F.isnull("conv_id").alias("no_id")]


_SUMMARY = (
    "first_turn long, last_turn long, n_turns long, first_initial string, last_initial string, illegal long, blank long, "
    "duplicate long, truncated long, costs array<long>, ranks array<int>, codes array<string>, counts array<long>"
)
_SUMMARY_NAMES = [part.split()[0] for part in _SUMMARY.split(", ")]


def summary(rows: list[tuple]) -> tuple:
    """What stringing together needs to know of a piece; rows are (turn, initial, count, fault)."""
    turns = [t for t, *_ in rows if t is not None]
    faults = dict.fromkeys(FAULTS, 0)
    illegal, before = 0, None
    for _, initial, n, fault in rows:
        # equal rows beside each other: the second and later are duplicates, unless they are blank
        if fault == "blank":
            faults["blank"] += n
        else:
            faults["duplicate"] += n - 1
            if fault:
                faults[fault] += 1
        illegal += (n - 1) * (initial * 2 not in LEGAL_PAIRS)
        if before is not None:
            illegal += before + initial not in LEGAL_PAIRS
        before = initial
    return (
        min(turns, default=None), max(turns, default=None), len(set(turns)), rows[0][1], before, illegal, *faults.values(),
        *parse_piece(tuple((initial, fault, n) for _, initial, n, fault in rows)), [n for _, _, n, _ in rows],
    )


def pieces(rows: DataFrame) -> DataFrame:
    """The rows in order, with ``piece``, ``place`` in it and, on the last row of each piece, its ``summary``.

    Pieces are numbered in the order of the whole table.
    """
    key = F.col("conv_id")
    in_order = rows.repartitionByRange(
        F.isnull(key).desc(), key, F.col("turn").asc_nulls_first(), "role", "text"
    ).sortWithinPartitions(F.isnull(key).desc(), key, F.col("turn").asc_nulls_first(), "role", "text")
    id_type = rows.schema["conv_id"].dataType.simpleString()
    fields = (
        f"conv_id {id_type}, turn long, role string, text string, n long, fault string, piece long, place int, "
        f"summary struct<{_SUMMARY.replace(' ', ':').replace(',:', ',')}>"
    )
    zero = F.lit(0).cast("long")
    lean = in_order.select(
        *_known_id(rows), F.coalesce("turn", zero).alias("turn"), F.isnull("turn").alias("no_turn"), "role", "text", "n", "fault"
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = (TaskContext.get().partitionId() << 33) - 1
        held: list[tuple] = []  # the open piece
        now = None

        def close() -> list[tuple]:
            if not held:
                return []
            done = summary([(r[1], r[2][:1], r[4], r[5]) for r in held])
            return [(*r, number, i, done if i == len(held) - 1 else None) for i, r in enumerate(held)]

        names = ["conv_id", "turn", "role", "text", "n", "fault", "piece", "place", "summary"]
        for pdf in batches:
            out: list[tuple] = []
            for conv, no_id, turn, no_turn, role, text, n, fault in pdf.itertuples(index=False):
                at = (no_id, None if no_id else conv)
                if at != now or len(held) == PIECE:
                    out += close()
                    held, now, number = [], at, number + 1
                held.append((at[1], None if no_turn else int(turn), role, text, int(n), fault if isinstance(fault, str) else None))
            if out:
                yield _frame(out, names)
        out = close()
        if out:
            yield _frame(out, names)

    return lean.mapInPandas(cut, fields)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    done = pd.DataFrame(rows, columns=names, dtype=object)
    done["summary"] = [dict(zip(_SUMMARY_NAMES, s)) if s is not None else None for s in done["summary"]]
    return done


_REPORT = (
    "n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, closing int"
)


def string_together(summaries: DataFrame) -> DataFrame:
    """Per piece the top it is entered with and left with; on the last piece of a conversation also its ``report``.

    ``summaries`` has conv_id, piece and the columns of a summary but the codes. Conversations are
    streams of pieces: four costs and ranks are carried, and four back pointers kept per piece.
    """
    id_type = summaries.schema["conv_id"].dataType.simpleString()
    lean = summaries.select(
        *_known_id(summaries), "piece", F.isnull("first_turn").alias("no_turn"),
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("first_turn", "last_turn")], "n_turns", "first_initial", "last_initial", "illegal", "blank", "duplicate", "truncated", "costs", "ranks",
        F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_rows"),
    ).repartition("no_id", "conv_id").sortWithinPartitions("no_id", "conv_id", "piece")
    report = _REPORT.replace(" ", ":").replace(",:", ",")
    names = ["conv_id", "piece", "entered", "left", "report"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, out = None, None, []
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                at = (r.no_id, None if r.no_id else r.conv_id)
                if at != now:
                    if state is not None:
                        out += state.close()
                    now, state = at, _Conversation(at[1])
                state.add(r)
            if out:
                yield pd.DataFrame(out, columns=names, dtype=object)
                out = []
        if state is not None:
            out = state.close()
            yield pd.DataFrame(out, columns=names, dtype=object)

    return lean.mapInPandas(fold, f"conv_id {id_type}, piece long, entered int, left int, report struct<{report}>")


class _Conversation:
    """Stacks over the pieces of one conversation, seen so far."""

    def __init__(self, conv):
        self.conv, self.costs, self.ranks = conv, [0, None, None, None], [0] * 4
        self.links: list[tuple] = []
        self.sums = dict.fromkeys(("illegal", *FAULTS), 0)
        self.n_rows = self.n_turns = 0
        self.least = self.most = self.before = None

    def add(self, piece) -> None:
        merged: list[tuple | None] = [None] * 4
        for top in range(4):
            if self.costs[top] is None:
                continue
            for to in range(4):
                cost = piece.costs[top * 4 + to]
                if cost >= 0:
                    node = (self.costs[top] + int(cost), self.ranks[top], int(piece.ranks[top * 4 + to]), to, top)
                    if merged[to] is None or node < merged[to]:
                        merged[to] = node
        self.costs = [node and node[0] for node in merged]
        for rank, node in enumerate(sorted(node[1:4] for node in merged if node)):
            self.ranks[node[2]] = rank
        self.links.append((piece.piece, bytes(node[4] if node else 0 for node in merged)))
        for name in self.sums:
            self.sums[name] += int(getattr(piece, name))
        if self.before is not None:
            self.sums["illegal"] += self.before + piece.first_initial not in LEGAL_PAIRS
        self.before = piece.last_initial
        self.n_rows += int(piece.n_rows)
        if not piece.no_turn:
            # pieces come by turn; a turn may go on in the next piece
            self.n_turns += int(piece.n_turns) - (self.most == int(piece.first_turn))
            self.least = int(piece.first_turn) if self.least is None else self.least
            self.most = int(piece.last_turn)

    def close(self) -> list[tuple]:
        ends = [
            (cost + closing(top) * COSTS[INSERT], self.ranks[top], closing(top), top) for top, cost in enumerate(self.costs) if cost is not None
        ]
        cost, _, inserts, top = min(ends)
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.n_turns
        report = {
            "n_rows": self.n_rows, "gaps": gaps, **{f: self.sums[f] for f in FAULTS}, "illegal": self.sums["illegal"],
            "cost": cost, "closing": inserts,
        }
        out = []
        for i, (piece, below) in enumerate(reversed(self.links)):
            out.append((self.conv, int(piece), below[top], top, report if i == 0 else None))
            top = below[top]
        return out


@dataclass
class Repaired:
    """``rows``: conv_id, piece, place, at, turn, role, text, inserted; sorted by (piece, place, at) a conversation is legal.

    ``reports``: per conversation n_rows, gaps, the counts of faults and illegal pairs, cost and audit.
    """

    rows: DataFrame
    reports: DataFrame


def repair(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> Repaired:
    """The cheapest repair of every conversation."""
    parsed = materialize(pieces(marked(turns, id_col, turn_col, role_col, text_col)))
    ends = parsed.where(F.col("summary").isNotNull()).select("conv_id", "piece", "summary.*")
    chosen = materialize(string_together(ends.drop("codes")))
    steps = ends.select("piece", "codes", "counts").join(chosen, "piece").select(
        "conv_id", "piece", F.get("codes", F.col("entered") * 4 + F.col("left")).alias("steps"), "counts", "left", "report"
    )
    audits = F.map_from_arrays(_strings(CODES), _strings([s.audit for s in STEPS]))
    # a row without steps is a top out of reach, which is never chosen
    audit = F.array_join(F.transform(
        F.filter(F.split("steps", ""), lambda c: c != ""),
        lambda c, i: F.concat(F.element_at(audits, c), F.repeat(F.lit(DELETE), (F.get("counts", i) - 1).cast("int"))),
    ), "")
    last = F.col("report").isNotNull()
    closed = F.when(last, F.repeat(F.lit(INSERT), F.col("report.closing"))).otherwise("")
    reports = steps.select("conv_id", "piece", F.concat(audit, closed).alias("audit"), "report").groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "audit"))), lambda p: p["audit"]), "").alias("audit"),
        F.max_by("report", F.when(F.col("report").isNotNull(), 1)).alias("report"),
    ).select("conv_id", "report.*", "audit").drop("closing")
    return Repaired(_repaired_rows(parsed, steps), reports)


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _repaired_rows(parsed: DataFrame, steps: DataFrame) -> DataFrame:
    inserted = F.map_from_arrays(_strings(CODES), F.array(*[_strings(s.inserted).cast("array<string>") for s in STEPS]))
    # null: the role stays; empty: the row goes
    role_of = {KEEP: None, DELETE: ""}
    given = F.map_from_arrays(_strings(CODES), F.array(*[
        F.lit(role_of.get(s.edit, FREE_ROLE[s.below])).cast("string") for s in STEPS
    ]))

    def turn(turn: Column, role: Column, text: Column, new: bool) -> Column:
        return F.struct(turn.alias("turn"), role.alias("role"), text.alias("text"), F.lit(new).alias("inserted"))

    def new_turns(roles: Column) -> Column:
        return F.transform(roles, lambda r: turn(F.lit(None).cast("long"), r, F.lit(""), True))

    rows = parsed.select("piece", "place", "turn", "role", "text").join(
        steps.select("conv_id", "piece", "steps"), "piece"
    ).withColumn("code", F.substring("steps", F.col("place") + 1, F.lit(1)))
    role = F.element_at(given, F.col("code"))
    own = F.when(F.coalesce(role != "", F.lit(True)), F.array(turn(
        F.col("turn"), F.coalesce(role, F.col("role")), F.col("text"), False
    ))).otherwise(F.array().cast("array<struct<turn:long,role:string,text:string,inserted:boolean>>"))
    edited = rows.select("conv_id", "piece", "place", F.posexplode(F.concat(
        new_turns(F.element_at(inserted, F.col("code"))), own
    )).alias("at", "t"))
    tails = F.array(*[_strings(Step(top, closing(top), KEEP).inserted).cast("array<string>") for top in range(4)])
    ending = steps.where(F.col("report").isNotNull()).select(
        "conv_id", "piece", F.lit(PIECE).alias("place"), F.posexplode(new_turns(F.get(tails, F.col("left")))).alias("at", "t")
    )
    return edited.unionByName(ending).select("conv_id", "piece", "place", "at", "t.*")


def digests(rows: DataFrame) -> DataFrame:
    """conv_id and ``sha256`` of the repaired ``role:text`` lines of each conversation, read as a stream in order."""
    id_type = rows.schema["conv_id"].dataType.simpleString()
    order = ["no_id", "conv_id", "piece", "place", "at"]
    lean = rows.select(*_known_id(rows), "piece", "place", "at", "role", "text").repartition("no_id", "conv_id").sortWithinPartitions(*order)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest = None, None
        for pdf in batches:
            out = []
            for conv, no_id, role, text in pdf.itertuples(index=False):
                at = (no_id, conv)
                if at == now:
                    digest.update(f"\n{role}:{text}".encode())
                    continue
                if now is not None:
                    out.append((None if now[0] else now[1], digest.hexdigest()))
                now, digest = at, hashlib.sha256(f"{role}:{text}".encode())
            if out:
                yield pd.DataFrame(out, columns=["conv_id", "sha256"], dtype=object)
        if now is not None:
            yield pd.DataFrame([(None if now[0] else now[1], digest.hexdigest())], columns=["conv_id", "sha256"], dtype=object)

    return lean.select("conv_id", "no_id", "role", "text").mapInPandas(read, f"conv_id {id_type}, sha256 string")
