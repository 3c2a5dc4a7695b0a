"""Hard-negative mining by angular triangle filtering.

Each vector keeps its angles to a few reference directions. For an anchor a, a row x and a reference
r the angle between a and x lies between ``|angle(a, r) - angle(x, r)|`` and ``angle(a, r) + angle(x, r)``
(or 360 degrees less that). The tightest of these intervals over all references, as cosines times both
norms and widened by the rounding error, bounds the inner product. Rows lie in windows: runs of one
label, ordered by their angle to the nearest reference. A window is scored, in integers, only for the
anchors whose wanted score range its bounds overlap.

Components are integers ``floor(256 * x)``, so scores are exact: sums below 2^53 as products of doubles,
larger ones as Python integers, and what no 64-bit number holds as the nearest that does.

The anchors are a stated query set against all rows. Rows are packed into blocks and dealt to groups
of bounded size; every block of anchors visits every group, and a group keeps its best few for each
question. So a task holds one group and one block of anchors, and no row or anchor passes the driver.
Only the references (at most ``REFERENCES`` directions) and one count do.

Defined cases: rows whose id, label or vector is null, or with a null or non-finite component, take no part;
vectors of different lengths have no score with each other; ties go to the smaller id; "other rows"
are rows of another id, repeated rows are rows of their own, and a repeated anchor (equal id, label
and vector) asks once; zero vectors score 0; an empty table gives an empty result; other columns are not
carried: the result has six columns of its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from copperline.session import materialize

SCALE = 256
REFERENCES = 16
#: Rows of a group, of a window and of a block of anchors. Results do not depend on them.
GROUP_ROWS, WINDOW_ROWS, ANCHOR_ROWS = 65_536, 512, 512
#: Radians by which an angle interval is widened: far above the error of an arc cosine of doubles and of storing it as a float.
_ANGLE_SLACK = 2e-6
_EXACT = 2.0 ** 53
_LONG = (-(2 ** 63), 2 ** 63 - 1)

_QUESTIONS = "array<array<struct<number:int,low:bigint,high:bigint>>>"
_PACKED = "block int, dim int, n int, ids binary, labels binary, vectors binary, angles binary"
_FOUND = "anchor_key long, question int, row_id long, score long"


def usable(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """id, label and integer vector of the rows that take part."""
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vector.alias("vector")
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    return np.floor(np.concatenate(vectors.tolist()).reshape(len(vectors), dim) * SCALE) if dim else np.zeros((len(vectors), 0))


def reference_directions(rows: DataFrame) -> dict[int, np.ndarray]:
    """Per length of vector the mean directions of its largest labels: at most ``REFERENCES`` in all.

    The sums are taken over all rows, batch by batch, and combined before they are shuffled.
    """
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (label, dim), part in pdf.groupby(["label", pdf["vector"].map(len)]):
                unit = _unit(_matrix(part["vector"], dim))
                yield pd.DataFrame({"label": label, "dim": dim, "n": len(part), "total": [unit.sum(axis=0).tolist()]})

    parts = rows.select("label", "vector").mapInPandas(sums, "label long, dim int, n long, total array<double>")
    flat = parts.select("label", "dim", "n", F.posexplode_outer("total").alias("at", "x"))
    # every component of a batch carries the batch's count; the first component stands for all
    whole = flat.groupBy("label", "dim", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    means = whole.groupBy("label", "dim").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "x"))).alias("xs"))
    found: dict[int, list] = {}
    for r in means.where("dim > 0").orderBy(F.desc("n"), "dim", "label").limit(REFERENCES).collect():
        found.setdefault(r["dim"], []).append([x["x"] for x in r["xs"]])
    return {dim: _unit(np.array(xs)) for dim, xs in found.items()}


def _unit(matrix: np.ndarray) -> np.ndarray:
    # scaled by the largest component first: squares of huge components would overflow
    peak = np.abs(matrix).max(axis=1, keepdims=True, initial=0)
    scaled = matrix / np.where(peak > 0, peak, 1)
    norms = np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
    return scaled / np.where(norms > 0, norms, 1)


def _norms(matrix: np.ndarray) -> np.ndarray:
    peak = np.abs(matrix).max(axis=1, initial=0)
    scaled = matrix / np.where(peak > 0, peak, 1)[:, None]
    return peak * np.sqrt((scaled * scaled).sum(axis=1))


def _angles(matrix: np.ndarray, references: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(matrix) @ references.T, -1, 1))


def pack(rows: DataFrame, references: dict[int, np.ndarray], block_rows: int, asking: bool = False) -> DataFrame:
    """Blocks of rows as byte columns, each with the stored angles. ``block`` deals blocks out evenly.

    With ``asking`` the rows are anchors, and their ``key`` and ``questions`` travel with them.
    """
    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId()
        for pdf in batches:
            for dim, same in pdf.groupby(pdf["vector"].map(len)):
                for at in range(0, len(same), block_rows):
                    part = same.iloc[at:at + block_rows]
                    matrix = _matrix(part["vector"], dim)
                    angles = _angles(matrix, references.get(dim, np.zeros((0, dim)))).astype("<f4")
                    kind = "<f4" if np.abs(matrix).max(initial=0) < 2 ** 24 else "<f8"
                    block = {
                        "block": [number], "dim": [dim], "n": [len(part)], "ids": [part["id"].to_numpy("<i8").tobytes()],
                        "labels": [part["label"].to_numpy("<i8").tobytes()], "vectors": [matrix.astype(kind).tobytes()],
                        "angles": [angles.tobytes()],
                    }
                    if asking:
                        block["keys"] = [part["key"].to_numpy("<i8").tobytes()]
                        block["questions"] = [[list(q) for q in part["questions"]]]
                    yield pd.DataFrame(block)
                    number += 1

    if asking:
        return rows.select("id", "label", "vector", "key", "questions").mapInPandas(
            packed, f"{_PACKED}, keys binary, questions {_QUESTIONS}"
        )
    return rows.select("id", "label", "vector").mapInPandas(packed, _PACKED)


def _unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels, integer matrix and angles of a packed block."""
    size = len(row.vectors) // (row.n * row.dim) if row.dim else 8
    matrix = np.frombuffer(row.vectors, f"<f{size}").reshape(row.n, row.dim).astype("f8")
    angles = np.frombuffer(row.angles, "<f4").reshape(row.n, -1).astype("f8")
    return np.frombuffer(row.ids, "<i8"), np.frombuffer(row.labels, "<i8"), matrix, angles


class Group:
    """The rows of one group and one length, cut into windows with their angle and norm ranges."""

    def __init__(self, ids, labels, matrix, angles):
        nearest = angles.argmin(axis=1) if angles.shape[1] else np.zeros(len(ids), int)
        own = angles[np.arange(len(ids)), nearest] if angles.shape[1] else np.zeros(len(ids))
        order = np.lexsort((ids, own, nearest, labels))
        self.ids, self.matrix = ids[order], matrix[order]
        labels, angles, norms = labels[order], angles[order], _norms(matrix[order])
        starts = np.flatnonzero(np.concatenate([[True], np.diff(labels) != 0])) if len(ids) else np.array([], int)
        ends = np.append(starts[1:], len(ids))
        self.windows = [(a, min(a + WINDOW_ROWS, e)) for s, e in zip(starts, ends) for a in range(s, e, WINDOW_ROWS)]
        self.labels = np.array([labels[a] for a, _ in self.windows], "i8")
        self.least = np.array([angles[a:b].min(axis=0) for a, b in self.windows]).reshape(len(self.windows), -1)
        self.most = np.array([angles[a:b].max(axis=0) for a, b in self.windows]).reshape(len(self.windows), -1)
        self.norms = np.array([(norms[a:b].min(), norms[a:b].max()) for a, b in self.windows]).reshape(len(self.windows), 2)
        self.peak = np.abs(self.matrix).max(initial=0)

    def bounds(self, norms: np.ndarray, angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score bounds of each anchor against each window, from the angles alone."""
        near = np.zeros((len(norms), len(self.windows)))
        far = np.full_like(near, np.pi)
        for i in range(angles.shape[1]):
            mine, least, most = angles[:, i, None], self.least[None, :, i], self.most[None, :, i]
            near = np.maximum(near, np.maximum(least - mine, mine - most))
            far = np.minimum(far, mine + most)
            # two wide angles leave little room on the other side
            far = np.minimum(far, np.where(mine + least > np.pi, 2 * np.pi - mine - least, np.pi))
        high = np.cos(np.maximum(near - _ANGLE_SLACK, 0))
        low = np.cos(np.minimum(far + _ANGLE_SLACK, np.pi))
        small, large = self.norms[None, :, 0], self.norms[None, :, 1]
        room = norms[:, None] * large * 1e-12 + 1
        high = norms[:, None] * np.where(high > 0, large, small) * high + room
        low = norms[:, None] * np.where(low > 0, small, large) * low - room
        return low, high

    def scores(self, anchors: np.ndarray, window: int) -> np.ndarray:
        """Exact integer scores of anchors against the rows of a window, as doubles or Python integers."""
        start, end = self.windows[window]
        part = self.matrix[start:end]
        if np.abs(anchors).max(initial=0) * self.peak * max(anchors.shape[1], 1) < _EXACT:
            return anchors @ part.T
        whole = np.vectorize(int, otypes=[object])
        exact = whole(anchors) @ whole(part).T if anchors.shape[1] else np.zeros((len(anchors), len(part)), object)
        return np.clip(exact, *_LONG)


def best_rows(
    group: Group, keys: np.ndarray, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray, angles: np.ndarray,
    questions: list[list[tuple[int, int, int]]], same_label: bool, k: int,
) -> list[tuple[int, int, int, int]]:
    """(anchor key, question, row, score): the best ``k`` rows of a group for every question of a block of anchors.

    A question is (number, lowest, highest wanted score).
    """
    low, high = group.bounds(_norms(matrix), angles)
    best: list[list[list]] = [[[] for _ in asked] for asked in questions]  # heaps of (score, -id), the worst first
    # as doubles: their rounding is far within the room of the bounds
    floor = np.array([min((q[1] for q in asked), default=_LONG[1]) for asked in questions], float)
    ceiling = np.array([max((q[2] for q in asked), default=_LONG[0]) for asked in questions], float)
    asks = np.array([bool(asked) for asked in questions], bool)
    fits = (labels[:, None] == group.labels[None, :]) == same_label
    # the windows that may hold the highest scores come first, so that the bars rise early
    for window in np.argsort(-high.max(axis=0, initial=-np.inf), kind="stable"):
        at = np.flatnonzero(asks & fits[:, window] & (high[:, window] >= floor) & (low[:, window] <= ceiling))
        if not len(at):
            continue
        scores = group.scores(matrix[at], window)
        rows = group.ids[slice(*group.windows[window])]
        for j, a in enumerate(at):
            mine = scores[j]
            others = rows != ids[a]
            bars = []
            for heap, (_, lowest, highest) in zip(best[a], questions[a]):
                bar = max(lowest, heap[0][0]) if len(heap) == k else lowest
                within = np.flatnonzero((mine >= bar) & (mine <= highest) & others)
                if len(within) > 4 * k:  # only the window's own best can stay, with all that tie with the last of them
                    within = within[mine[within] >= np.sort(mine[within])[-k]]
                for i in within:
                    entry = (int(mine[i]), -int(rows[i]))
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                bars.append(max(lowest, heap[0][0]) if len(heap) == k else lowest)
            floor[a] = min(bars)
    return [
        (int(keys[a]), question[0], -row, score)
        for a, asked in enumerate(questions) for question, heap in zip(asked, best[a]) for score, row in heap
    ]


def search(blocks: DataFrame, anchors: DataFrame, groups: int, same_label: bool, k: int) -> DataFrame:
    """The best ``k`` rows for every question: anchor_key, question, row_id, score, rank.

    ``blocks`` are packed rows, ``anchors`` packed anchors, whose questions have number, low and high.
    Rows of a group come first in its partition, then the anchor blocks stream past.
    """
    held = blocks.select(
        F.pmod("block", F.lit(groups)).alias("g"), F.lit(0).alias("kind"), "*", F.lit(None).cast("binary").alias("keys"),
        F.lit(None).cast(_QUESTIONS).alias("questions"),
    )
    passing = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(1).alias("kind"), "*")
    dealt = held.unionByName(passing).repartition(groups, "g").sortWithinPartitions("g", "kind")

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, parts, ready = None, {}, {}
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if row.g != now:
                    now, parts, ready = row.g, {}, {}
                if row.kind == 0:
                    parts.setdefault(row.dim, []).append(_unpack(row))
                    continue
                if row.dim not in ready:
                    if row.dim not in parts:
                        continue
                    ready[row.dim] = Group(*(np.concatenate(p) for p in zip(*parts.pop(row.dim))))
                questions = [[(q["number"], q["low"], q["high"]) for q in asked] for asked in row.questions]
                found = best_rows(ready[row.dim], np.frombuffer(row.keys, "<i8"), *_unpack(row), questions, same_label, k)
                yield pd.DataFrame(found, columns=["anchor_key", "question", "row_id", "score"])

    found = dealt.mapInPandas(answer, _FOUND)
    order = Window.partitionBy("anchor_key", "question").orderBy(F.desc("score"), "row_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, least_share: int = 80,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    The positives of an anchor are its best other rows of the same label. Hard negatives of a positive are
    the best rows of other labels that score at most like it and at least ``least_share`` hundredths of it.
    ``is_anchor`` is a condition on ``id``.
    """
    spark = rows.sparkSession
    table = usable(rows, id_col, label_col, vector_col)
    references = reference_directions(table)
    blocks = materialize(pack(table, references, 4096))
    total = blocks.agg(F.sum("n")).first()[0] or 0
    cores = spark.sparkContext.defaultParallelism
    groups = max(-(-total // group_rows), min(cores, -(-total // 1024)), 1)
    # equal anchors ask once; a key of its own tells anchors of one id apart
    asking = table.where(is_anchor).dropDuplicates(["id", "label", "vector"])
    asking = materialize(asking.withColumn("key", F.monotonically_increasing_id()))

    def question(number: Column, low: Column, high: Column) -> Column:
        return F.struct(number.cast("int").alias("number"), low.cast("long").alias("low"), high.cast("long").alias("high"))

    anything = F.array(question(F.lit(0), F.lit(_LONG[0]), F.lit(_LONG[1])))
    first = pack(asking.withColumn("questions", anything), references, ANCHOR_ROWS, asking=True)
    near = materialize(search(blocks, first, groups, True, positives).select(
        "anchor_key", F.col("rank").alias("question"), F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score")
    ))
    # the lowest score with least_share * positive <= 100 * score; a positive below zero has no such negative
    least = F.expr(f"positive_score div 100 * {least_share} + (positive_score % 100 * {least_share} + 99) div 100")
    wanted = near.where("positive_score >= 0").groupBy(F.col("anchor_key").alias("key")).agg(
        F.sort_array(F.collect_list(question(F.col("question"), least, F.col("positive_score")))).alias("questions")
    )
    second = pack(asking.join(wanted, "key"), references, ANCHOR_ROWS, asking=True)
    far = search(blocks, second, groups, False, negatives)
    named = near.join(asking.select(F.col("key").alias("anchor_key"), F.col("id").alias("anchor_id")), "anchor_key")
    return far.join(named, ["anchor_key", "question"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("row_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
