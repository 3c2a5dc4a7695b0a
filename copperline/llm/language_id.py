"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters are hashed into ``BUCKETS`` columns. Weights are trained with
follow-the-regularised-leader and elastic-net penalties on all labelled rows but a seventh: each shard trains in a
task of its own, the states are averaged, and the next round starts from the average. Of few rows
all take part in every round, of ``SHARD_ROWS`` or more for each shard and round every row in one. One temperature, fitted on the
seventh that no shard trains on, calibrates the probabilities. No row is left out and all texts are read whole.

Defined cases: a null text or one without a letter is ``und`` with score 0, and so is every text if
there is no labelled row; copies and repeated rows are predicted alike; other columns are kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from copperline.llm.columns import by_place
from copperline.session import materialize

BUCKETS = 1 << 14
#: Rows that a shard learns from in a round, and how many shards there are at least and at most: every one sends its state to the driver.
SHARD_ROWS = 1000
SHARDS = 6
MOST_SHARDS = 48
ROUNDS = 4
#: Scores of the calibration rows that the model keeps at most, evenly spaced by rank.
REACHED = 10_000
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
UNKNOWN = "und"
_SPACE = 32
_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Per code point: itself in lower case if it is a letter, else a space."""
    if "letters" not in _tables:
        table = np.full(0x110000, _SPACE, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _tables["letters"] = table
    return _tables["letters"]


def grams(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(bucket, count) of the n-grams of a text; None if it has no letter."""
    points = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    if not len(points) or points.max() == _SPACE and points.min() == _SPACE:
        return None
    points = np.concatenate(([_SPACE], points, [_SPACE])).astype(np.uint32)
    # runs of other characters count as one space
    points = points[np.concatenate(([True], (points[1:] != _SPACE) | (points[:-1] != _SPACE)))]
    mult = np.uint32(0x9E3779B1)
    h = points * mult
    counts = np.bincount(h >> np.uint32(18), minlength=BUCKETS)
    for n in (2, 3):
        h = (h[:-1] ^ (points[n - 1:] + np.uint32(n))) * mult
        h ^= h >> np.uint32(15)
        counts += np.bincount(h & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), counts[at].astype(np.int32)


def tf_idf(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    length = np.sqrt(x @ x)
    return x / length if length > 0 else x


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The closed form of the leader: exactly zero within the first penalty."""
    shrunk = np.where(np.abs(z) <= L1, 0.0, z - np.sign(z) * L1)
    return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_shard(rows: list[tuple[np.ndarray, np.ndarray, int]], z: np.ndarray, n: np.ndarray, idf: np.ndarray) -> None:
    """One pass over a shard's rows; z and n (buckets + 1 for the bias, classes) change in place."""
    bias = len(idf)
    for at, counts, label in rows:
        where = np.append(at, bias)
        x = np.append(tf_idf(at, counts, idf), 1.0)
        zw, nw = z[where], n[where]
        w = weights_of(zw, nw)
        p = _softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p[None, :]
        n_next = nw + g * g
        z[where] = zw + g - (np.sqrt(n_next) - np.sqrt(nw)) / ALPHA * w
        n[where] = n_next


@dataclass
class Model:
    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float
    #: Scores of the calibration rows whose language was named right, in order; of many, every n-th.
    reached: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def score_reached_by(self, share: float) -> float:
        """The score that this share of the known rows set aside for calibration reaches; 0 if there are none.

        A text below it looks less like any learnt language than nearly all texts known to be in one.
        """
        return float(self.reached[int((1 - share) * len(self.reached))]) if len(self.reached) else 0.0

    def predict(self, text: str | None) -> tuple[str, float]:
        found = grams(text) if isinstance(text, str) and self.classes else None
        if found is None:
            return UNKNOWN, 0.0
        logits = tf_idf(*found, self.idf) @ self.weights[found[0]] + self.weights[-1]
        p = _softmax(logits / self.temperature)
        best = int(p.argmax())
        return self.classes[best], float(p[best])


def _loss(logits: np.ndarray, labels: np.ndarray, temperature: float) -> np.ndarray:
    return -np.log(np.maximum(_softmax(logits / temperature)[np.arange(len(labels)), labels], 1e-12))


def fit_temperature(held: DataFrame) -> float:
    """The temperature of the least log loss over rows of logits and label, by a search over a falling grid.

    Each partition sums its own losses; a sum per point of the grid is all that reaches the driver.
    """
    low, high = np.log(0.1), np.log(10.0)
    for _ in range(4):
        grid = np.linspace(low, high, 17)

        def losses(batches: Iterator[pd.DataFrame], grid: np.ndarray = grid) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    logits, labels = np.stack(pdf["logits"].to_numpy()), pdf["label"].to_numpy()
                    yield pd.DataFrame({"point": range(len(grid)), "loss": [_loss(logits, labels, np.exp(t)).sum() for t in grid]})

        total = held.mapInPandas(losses, "point int, loss double").groupBy("point").agg(F.sum("loss").alias("loss")).orderBy("point").collect()
        best = int(np.argmin([r["loss"] for r in total]))
        low, high = grid[max(best - 1, 0)], grid[min(best + 1, 16)]
    return float(np.exp((low + high) / 2))


def _by_rank(scores: DataFrame) -> np.ndarray:
    """The scores in order; of more than ``REACHED`` so many, those at evenly spaced ranks of all. Exact: ranks are counted, not estimated."""
    n = scores.count()
    if n <= REACHED:
        return np.sort([r["score"] for r in scores.select("score").collect()]).astype(float)
    binned = scores.select("score", F.floor(F.col("score") * (1 << 16)).alias("bin"))
    # one narrow row per bin
    before = binned.groupBy("bin").count().select(
        "bin", F.coalesce(F.sum("count").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    rank = F.col("before") + F.row_number().over(Window.partitionBy("bin").orderBy("score")) - 1
    ranked = binned.join(before, "bin").select("score", rank.alias("rank"))
    # n / REACHED ranks lie between two that are kept; the place is the least whose rank is not below this one
    place = F.expr(f"(rank * {REACHED} + {n} - 1) div {n}")
    kept = ranked.withColumn("place", place).where((F.col("place") < REACHED) & F.expr(f"(place * {n}) div {REACHED} = rank"))
    return np.array([r["score"] for r in kept.orderBy("place").collect()])


def pack(at: np.ndarray, counts: np.ndarray) -> bytes:
    """Buckets in order and their counts as bytes: a fraction of the arrays' size where rows are shuffled."""
    return zlib.compress(np.diff(at, prepend=0).astype("<u2").tobytes() + counts.astype("<u4").tobytes(), 1)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(packed)
    size = len(raw) // 6
    return np.cumsum(np.frombuffer(raw, "<u2", size)).astype(np.int32), np.frombuffer(raw, "<u4", size, 2 * size).astype(np.int32)


@F.pandas_udf(T.BinaryType())
def _grams(texts: pd.Series) -> pd.Series:
    def packed(text: str | None) -> bytes | None:
        found = grams(text) if isinstance(text, str) else None
        return found and pack(*found)

    # one text's arrays at a time: a batch of them would be many times its texts
    return pd.Series([packed(t) for t in texts], dtype=object)


def fit(
    labelled: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, text_col: str = "text", lang_col: str = "lang",
    id_col: str = "doc_id",
) -> Model:
    """Train on rows with a non-null language; the caller leaves out what must not be learnt from.

    Rows are dealt to shards by a hash of id and text, and to rounds by one of id, text and language: copies of a text
    come apart from each other.
    """
    known = labelled.where(F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    total = known.count()
    # each row is learnt in every round, or, where there are enough, in one of them
    parts = max(1, min(rounds, total // (SHARD_ROWS * (shards + 1))))
    dealt = F.hash("id", "text")
    shard = F.pmod(dealt, F.lit(shards + 1)).alias("shard")
    pick = F.pmod(F.xxhash64("id", "text", "lang"), F.lit(1 << 30))
    more = max(1, min(MOST_SHARDS, total // (SHARD_ROWS * parts)) // shards)
    rows = materialize(known.select(
        "lang", pick.alias("pick"), shard, F.pmod(F.xxhash64("id", "text"), F.lit(more)).alias("sub"),
        (pick % parts).alias("part"), _grams("text").alias("grams"),
    ).where("grams is not null"))
    classes = [r["lang"] for r in rows.select("lang").distinct().orderBy("lang").collect()]
    if not classes:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS + 1, 0)), 1.0)

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(BUCKETS, np.int64)
        for pdf in batches:
            for packed in pdf["grams"]:
                seen[unpack(packed)[0]] += 1
        found = np.flatnonzero(seen)
        yield pd.DataFrame({"b": found, "n": seen[found]})

    # at most BUCKETS rows, for every size of input
    df = np.zeros(BUCKETS)
    for r in rows.select("grams").mapInPandas(present, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():
        df[r["b"]] = r["n"]
    idf = np.log((1 + rows.count()) / (1 + df)) + 1
    number = {c: i for i, c in enumerate(classes)}
    shape = (BUCKETS + 1, len(classes))

    def unpacked(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        ordered = pdf.sort_values(["pick", "lang"], kind="stable")
        for packed, lang in zip(ordered["grams"], ordered["lang"]):
            yield *unpack(packed), number[lang]

    def trained(z0: np.ndarray, n0: np.ndarray):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            z, n = z0.copy(), n0.copy()
            train_shard(unpacked(pdf), z, n, idf)
            return pd.DataFrame({"z": [z.astype(np.float32).tobytes()], "n": [n.astype(np.float32).tobytes()]})

        return run

    learn = rows.where(F.col("shard") < shards)
    if learn.isEmpty():
        learn = rows
    z, n = np.zeros(shape), np.zeros(shape)
    for turn in range(rounds):
        states = learn.where(F.col("part") == turn % parts).groupBy("shard", "sub").applyInPandas(trained(z, n), "z binary, n binary").collect()
        if not states:
            continue
        z = np.mean([np.frombuffer(s["z"], np.float32).reshape(shape) for s in states], axis=0).astype(float)
        n = np.mean([np.frombuffer(s["n"], np.float32).reshape(shape) for s in states], axis=0).astype(float)
    weights = weights_of(z, n)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(tf_idf(a, c, idf) @ weights[a] + weights[-1], label) for a, c, label in unpacked(pdf)]
            yield pd.DataFrame(out, columns=["logits", "label"])

    held = materialize(rows.where(F.col("shard") == shards).select("pick", "lang", "grams").mapInPandas(scored, "logits array<double>, label int"))
    if held.isEmpty():
        return Model(classes, idf, weights, 1.0)
    temperature = fit_temperature(held)

    def reached(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                p = _softmax(np.stack(pdf["logits"].to_numpy()) / temperature)
                yield pd.DataFrame({"score": p.max(axis=1)[p.argmax(axis=1) == pdf["label"].to_numpy()]})

    return Model(classes, idf, weights, temperature, _by_rank(materialize(held.mapInPandas(reached, "score double"))))


@by_place("lang_pred", "score")
def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; columns of these names, in any case, are replaced."""
    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    return docs.withColumn("lid", predicted(F.col(text_col))).select(*docs.columns, "lid.lang_pred", "lid.score")


def keep_languages(
    docs: DataFrame, model: Model, languages: list[str] | None = None, min_score: float = 0.0, text_col: str = "text"
) -> DataFrame:
    """Rows whose language is known (and one of ``languages``) with at least ``min_score``; columns as they were."""
    names = list(docs.columns)
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    judged = predict(inner, model, f"c{names.index(text_col)}")
    passed = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)
    if languages is not None:
        passed = passed & F.col("lang_pred").isin(languages)
    return judged.where(passed).select(*inner.columns).toDF(*names)
