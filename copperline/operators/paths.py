"""Variable-length paths over CALLS edges by iterated joins."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F, types as T

from copperline.operators.graph import union_all
from copperline.operators.skew import LEAST_SHARE, hot_shares, salted_join
from copperline.session import materialize

#: A round that leaves more than this share of the links is the last to look for those on no cycle; changes plans only.
LEAST_DROP = 0.9
#: Rounds that look for ranks read this many times the links at most; changes plans only.
_PEEL = 8
#: Copies of a row that are made at once.
_COPIES = 4096


def _step(frontier: DataFrame, edges: DataFrame, carry: list[str]) -> DataFrame:
    """Join the frontier's ends to outgoing edges; rows at a program where many paths end are spread.

    The frontier is a table, and its own counts say which programs those are.
    """
    return salted_join(
        frontier.withColumnRenamed("at", "source"), edges, "source", F.struct(*carry), hot_shares(frontier, "at")
    )


def _round_trips(links: DataFrame) -> DataFrame:
    """The links that may lie on a cycle: those whose source nothing leads to or whose target leads nowhere fall off, in rounds.

    Rounds end when one drops less than a tenth. What is left over holds all links on cycles, which is all that is needed.
    """
    left, n = links, links.count()
    while n:
        entered, left_again = left.select(F.col("target").alias("source")).distinct(), left.select(F.col("source").alias("target")).distinct()
        kept = materialize(left.join(entered, "source", "left_semi").join(left_again, "target", "left_semi").select("source", "target"))
        before, left, n = n, kept, kept.count()
        if n > before * LEAST_DROP:
            break
    return left


def _ranks(links: DataFrame) -> DataFrame:
    """(target, rank) of every program that is called: the length of the longest path to it, plus one; null where it is not known.

    Programs that nothing leads to fall off, in rounds, until the rounds have read ``_PEEL`` times the links or nothing falls off: those on a cycle
    and behind one never do. So all that leads to a program with a rank has a lesser rank itself.
    """
    left, n, fallen, read = links, links.count(), [], 0
    most = n * _PEEL
    while n and read <= most:
        entered = left.select(F.col("target").alias("source")).distinct().withColumn("_entered", F.lit(True))
        told = materialize(left.join(entered, "source", "left").select("source", "target", F.col("_entered").isNotNull().alias("_entered")))
        fallen.append(told.where(~F.col("_entered")).select("source", F.lit(len(fallen) + 1).alias("rank")))
        left, read, before = told.where("_entered").select("source", "target"), read + n, n
        n = left.count()
        if n == before:
            break
    if not fallen:
        return links.select("target", F.lit(None).cast("int").alias("rank")).distinct()
    came = links.join(union_all(fallen).distinct(), "source", "left").groupBy("target").agg(
        (F.max("rank") + 1).alias("rank"), F.max(F.col("rank").isNull()).alias("_unknown")
    )
    return materialize(came.select("target", F.when(~F.col("_unknown"), F.col("rank")).alias("rank")))


def _marked(links: DataFrame, trips: DataFrame) -> DataFrame:
    """``links`` with ``cyclic``: whether a path may come along the link twice."""
    return materialize(links.join(trips.withColumn("cyclic", F.lit(True)), ["source", "target"], "left").withColumn(
        "cyclic", F.coalesce("cyclic", F.lit(False))
    ))


class _Arrivals:
    """What leads to the goals, as (at, goal), found in rounds: each is made once the paths made so far weigh twice as much as the rounds before,
    so that the search never costs much more than the paths. ``found`` is the whole set, or null as long as it is not complete."""

    def __init__(self, links: DataFrame, goals: DataFrame) -> None:
        back = links.select(F.col("target").alias("source"), F.col("source").alias("target"))
        self.goals, self.made, self.rows, self.found = goals, [], 0, None
        self._rounds = _level_rounds(back, back.join(goals.select(F.col("goal").alias("source")), "source", "left_semi"), None)

    def grow(self, paths: int) -> None:
        while self.found is None and (self.rows <= LEAST_SHARE or self.rows * 2 <= paths):
            level = next(self._rounds, None)
            if level is None:
                ends = [r.select("at", F.col("start").alias("goal")) for r in self.made]
                self.found = union_all([*ends, self.goals.select(F.col("goal").alias("at"), "goal")])
            else:
                self.made.append(level[0])
                self.rows += level[1]


class _Due:
    """When to look rows up in a large table: once the rows since the last time weigh as much, so that all lookups together cost
    no more than the rows themselves. A table that is no load is looked up every time."""

    def __init__(self, share: int) -> None:
        self.share, self.since = share, 0

    def now(self, rows: int, table: int) -> bool:
        self.since += rows
        due = table <= LEAST_SHARE or self.since * self.share >= table
        if due:
            self.since = 0
        return due


def _walks(links: DataFrame, first: DataFrame, arrivals: _Arrivals | None, max_depth: int | None) -> Iterator[DataFrame]:
    """Rounds of paths (start, at, goal, used, length, n), each a table: ``first`` and what grows from it.

    Only links that may lie on a cycle are remembered in ``used``, and only until the path has left them for good: no other
    can be taken twice. Paths that differ in nothing else are one row with their number ``n``.

    ``links`` with a ``rank`` and ``first`` with ``until``, the rank of its goal, drop at once what is past its goal. ``arrivals`` names the programs
    from which a goal can be reached: a path that cannot arrive is dropped, at once where that set is small, else whenever
    the paths made since weigh as much as the set.
    """
    ranked = "rank" in links.columns
    edge_id = F.struct(F.col("source").alias("s"), F.col("target").alias("t"))
    carried = ["start", "goal", *(["until"] if ranked else [])]
    columns = ["start", "at", "goal", "used", "length", "n", *carried[2:]]
    none = F.array().cast(T.ArrayType(T.StructType([T.StructField("s", T.StringType()), T.StructField("t", T.StringType())])))
    due, total = _Due(1), 0
    # a program with no rank lies behind a cycle and leads to none with a rank
    in_time = F.col("until").isNull() | (F.col("target") == F.col("goal")) | F.coalesce(F.col("rank") < F.col("until"), F.lit(False))
    # a goal with a rank lies on no cycle: whoever has arrived does not come back
    goes_on = F.col("until").isNull() | (F.col("at") != F.col("goal"))

    def kept(paths: DataFrame, rows: int) -> DataFrame:
        nonlocal total
        total += rows
        if arrivals is not None:
            arrivals.grow(total)
            if arrivals.found is None:
                due.since += rows
            elif due.now(rows, arrivals.rows):
                paths = paths.join(arrivals.found, ["at", "goal"], "left_semi")
        return materialize(paths.select(*columns))

    depth = 1
    frontier = kept((first.where(in_time) if ranked else first).select(
        *carried, F.col("target").alias("at"), F.when(F.col("cyclic"), F.array(edge_id)).otherwise(none).alias("used"),
        F.lit(1).alias("length"), F.lit(1).cast("long").alias("n"),
    ), 0)
    while not frontier.isEmpty():
        yield frontier
        if max_depth is not None and depth >= max_depth:
            return
        depth += 1
        rows = frontier.count() if arrivals is not None else 0
        grown = _step(frontier.where(goes_on) if ranked else frontier, links, [*carried, "used"]).where(
            ~F.col("cyclic") | ~F.array_contains("used", edge_id)
        )
        frontier = kept((grown.where(in_time) if ranked else grown).select(
            *carried, F.col("target").alias("at"),
            F.when(F.col("cyclic"), F.array_append("used", edge_id)).otherwise(none).alias("used"), "n",
        ).groupBy(*carried, "at", "used").agg(F.sum("n").alias("n")).withColumn("length", F.lit(depth)), rows)


def paths_between(edges: DataFrame, pairs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """All paths in which no edge repeats for many (source, target) pairs: source, target, length. One row per path.

    Paths grow from the sources, and only as far as the target's rank allows: the rank of a program that lies behind no cycle is
    greater than that of all that leads to it. The search starts from the targets too: everything that leads to one is found, as a
    set, as far as that costs no more than the paths do, and paths that left the complete set are dropped.
    """
    links = materialize(edges.select("source", "target").distinct())
    wanted = materialize(pairs.select(F.col("source").alias("start"), F.col("target").alias("goal")).distinct())
    ranks = _ranks(links)
    marked = materialize(_marked(links, _round_trips(links)).join(ranks, "target", "left"))
    # what nothing leads to is no target of a path
    timed = materialize(wanted.join(ranks.select(F.col("target").alias("goal"), F.col("rank").alias("until")), "goal"))
    first = timed.join(marked, F.col("start") == F.col("source"))
    rounds = list(_walks(marked, first, _Arrivals(links, materialize(timed.select("goal").distinct())), max_depth))
    return _paths(edges, [r.where(F.col("at") == F.col("goal")) for r in rounds])


def _paths(edges: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """One row per path: each counted row as often as it says, which takes place where the result is read."""
    if not rounds:
        return edges.select("source", "target", F.lit(1).alias("length")).limit(0)
    found = union_all([r.select(F.col("start").alias("source"), F.col("at").alias("target"), "length", "n") for r in rounds])
    parts = found.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _COPIES))).alias("_part"))
    return parts.select("source", "target", "length", F.explode(
        F.sequence(F.lit(1).cast("long"), F.least(F.lit(_COPIES).cast("long"), F.col("n") - F.col("_part") * _COPIES))
    ).alias("_copy")).drop("_copy")


def reachable_paths(
    edges: DataFrame, src: str | None = None, dst: str | None = None, max_depth: int | None = None
) -> DataFrame:
    """All paths in which no edge repeats: source, target, length. One row per path.

    Without ``max_depth`` the walk ends when no path can grow; with it, paths of 1 to that many
    edges are what is asked for. The number of paths can grow exponentially on dense cyclic graphs:
    use ``reachability`` for the set of reachable pairs.
    """
    links = materialize(edges.select("source", "target").distinct())
    marked = _marked(links, _round_trips(links))
    seed = marked if src is None else marked.where(F.col("source") == src)
    first = seed.select(F.col("source").alias("start"), "source", "target", "cyclic", F.lit(dst).cast("string").alias("goal"))
    goals = None if dst is None else _Arrivals(links, edges.sparkSession.range(1).select(F.lit(dst).alias("goal")))
    rounds = list(_walks(marked, first, goals, max_depth))
    return _paths(edges, rounds if dst is None else [r.where(F.col("at") == dst) for r in rounds])


def reachability(
    edges: DataFrame, src: str | None = None, max_depth: int | None = None, starts: DataFrame | None = None
) -> DataFrame:
    """Distinct reachable pairs with the length of the shortest path, safe on any graph.

    From one program, from those of ``starts`` (source), or from all. Breadth first; the shortest of a pair's lengths is
    picked at the end, so only what could go on for ever is compared with the pairs seen in every round.
    """
    links = materialize(edges.select("source", "target").distinct())
    seed = links if src is None else links.where(F.col("source") == src)
    if starts is not None:
        seed = seed.join(starts.select("source").distinct(), "source", "left_semi")
    found = union_all(_levels(links, seed, max_depth)).groupBy("start", "at").agg(F.min("length").alias("length"))
    return found.select(F.col("start").alias("source"), F.col("at").alias("target"), "length")


def _levels(links: DataFrame, seed: DataFrame, max_depth: int | None) -> list[DataFrame]:
    return [pairs for pairs, _ in _level_rounds(links, seed, max_depth)]


def _level_rounds(links: DataFrame, seed: DataFrame, max_depth: int | None) -> Iterator[tuple[DataFrame, int]]:
    """Rounds of pairs (start, at, length, again), each a table, with their rows; a pair comes first in the round of its shortest path.

    ``again`` says that ``at`` may lie on a cycle. Such pairs leave the frontier once seen, so cycles end by themselves.
    All others end anyway: they are compared with what was seen only now and then, before repeated work could weigh more.
    """
    ends = _round_trips(links).select("target").distinct().withColumn("again", F.lit(True))
    to = materialize(links.join(ends, "target", "left").select("source", "target", F.coalesce("again", F.lit(False)).alias("again")))
    cycles = not to.where("again").isEmpty()
    frontier = materialize(seed.join(ends, "target", "left").select(
        F.col("source").alias("start"), F.col("target").alias("at"), F.lit(1).alias("length"), F.coalesce("again", F.lit(False)).alias("again")
    ))
    rounds, due, depth = [frontier], _Due(4), 1
    rows = frontier.count()
    total = rows
    yield frontier, rows
    while (max_depth is None or depth < max_depth) and rows:
        depth += 1
        step = _step(frontier, to.withColumnRenamed("again", "_again"), ["start"]).select(
            "start", F.col("target").alias("at"), F.col("_again").alias("again")
        ).distinct()
        # every round is a table of its own, so the union stays a plain list of scans
        seen = union_all(rounds)
        if due.now(rows, total):
            step = step.join(seen.select("start", "at"), ["start", "at"], "left_anti")
        elif cycles:
            step = step.join(seen.where("again").select("start", "at"), ["start", "at"], "left_anti")
        frontier = materialize(step.select("start", "at", F.lit(depth).alias("length"), "again"))
        rows = frontier.count()
        total += rows
        rounds.append(frontier)
        yield frontier, rows
