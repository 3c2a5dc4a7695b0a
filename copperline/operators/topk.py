"""Nearest vectors by cosine: one query, or many queries as a join of blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

#: Bytes of query vectors that a task holds at once; results do not depend on it.
BLOCK_BYTES = 32 << 20


class Best:
    """The n best ids of each query among the vectors seen so far, ties by id."""

    def __init__(self, names: list, queries: list, n: int):
        matrix = np.asarray(queries, dtype=np.float64)
        lengths = np.sqrt((matrix * matrix).sum(axis=1))
        known = (lengths > 0) & np.isfinite(lengths)
        self.names = np.asarray(names, dtype=object)[known]
        self.unit, self.n = matrix[known] / lengths[known, None], n
        # the running n-th best score: whatever is below cannot enter
        self.bar = np.full(len(self.names), -np.inf)
        self.held = pd.DataFrame({"query": np.array([], int), "id": np.array([], object), "score": np.array([], float)})

    def see(self, ids: pd.Series, vectors: pd.Series) -> None:
        there = vectors.notna().to_numpy()
        if not there.any() or not len(self.names):
            return
        data = np.asarray(vectors[there].tolist(), dtype=np.float64)
        norms = np.sqrt((data * data).sum(axis=1))
        ok = (norms > 0) & np.isfinite(norms)
        keys = ids.to_numpy()[there][ok]
        if not len(keys):
            return
        scores = np.round((data[ok] / norms[ok, None]) @ self.unit.T, 12)
        bar = self.bar
        if len(keys) > self.n:
            bar = np.maximum(bar, np.partition(scores, len(keys) - self.n, axis=0)[len(keys) - self.n])
        row, query = np.nonzero(scores >= bar)
        if not len(row):
            return
        fresh = pd.DataFrame({"query": query, "id": keys[row], "score": scores[row, query]})
        ranked = pd.concat([self.held, fresh] if len(self.held) else [fresh]).sort_values(["query", "score", "id"], ascending=[True, False, True])
        self.held = ranked.groupby("query", sort=False).head(self.n)
        last = self.held.groupby("query")["score"].agg(["size", "min"])
        full = last[last["size"] == self.n]
        self.bar[full.index] = full["min"]

    def rows(self) -> pd.DataFrame:
        return pd.DataFrame({"query_id": self.names[self.held["query"].to_numpy(int)], "id": self.held["id"].to_numpy(), "score": self.held["score"].to_numpy()})


def _found(vectors: DataFrame, id_col: str) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", T.StringType()), T.StructField("id", vectors.schema[id_col].dataType), T.StructField("score", T.DoubleType()),
    ])


def vector_topk(vectors: DataFrame, query: list[float], n: int, id_col: str = "vec_id") -> DataFrame:
    """The n vectors nearest to ``query``: the row with ``score``, ties by id. Each task sends its n best."""
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Best(["q"], [query], n)
        for batch in batches:
            best.see(batch["id"], batch["embedding"])
        yield best.rows()

    # vectors without values are skipped in the task: a filter here would be pushed below the
    # embedding expressions and evaluate them a second time
    scored = vectors.select(F.col(id_col).alias("id"), "embedding").mapInPandas(score, _found(vectors, id_col))
    best = scored.orderBy(F.desc("score"), "id").limit(n)
    return vectors.join(best.select(F.col("id").alias(id_col), "score"), id_col)


def _grid(n_vectors: int, n_queries: int, query_bytes: int, tasks: int, block_bytes: int) -> tuple[int, int]:
    """Into how many parts vectors and queries are cut, so that a part of each meets in about ``tasks`` tasks.

    Vectors travel once per part of the queries and queries once per part of the vectors: the sum is least where
    both weigh the same. A task's queries fit in ``block_bytes``.
    """
    by_weight = round(math.sqrt(tasks * n_queries / max(n_vectors, 1)))
    query_parts = max(1, by_weight, -(-n_queries * query_bytes // block_bytes))
    return max(1, -(-tasks // query_parts)), min(query_parts, max(n_queries, 1))


def vector_topk_batch(
    vectors: DataFrame, queries: DataFrame, n: int, id_col: str = "vec_id", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Per query the n nearest vectors: query_id, id, score, rank.

    A join of blocks: in each task a part of the queries stays while a part of the vectors streams past, with
    the running n-th best score per query as the bar. No query passes the driver; two counts do.
    """
    spark = vectors.sparkSession
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    widest = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vector_parts, query_parts = _grid(vectors.count(), widest["n"], 8 * max(widest["dim"] or 1, 1), tasks, block_bytes)

    def dealt(rows: DataFrame, parts: int, own_step: int, others: int, other_step: int) -> DataFrame:
        """Rows with ``cell``: each row's own part, met with every part of the other side."""
        numbered = rows.withColumn("own", F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int") * own_step)
        across = F.transform(F.sequence(F.lit(0), F.lit(others - 1)), lambda o: F.col("own") + o * other_step)
        return numbered.withColumn("cell", F.explode(across)).drop("own")

    id_type = vectors.schema[id_col].dataType
    staying = dealt(asked, query_parts, 1, vector_parts, query_parts).select(
        "cell", F.lit(0).alias("kind"), "query_id", F.lit(None).cast(id_type).alias("id"), "embedding",
    )
    plain = vectors.select(F.col(id_col).alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    passing = dealt(plain, vector_parts, query_parts, query_parts, 1).select(
        "cell", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("query_id"), "id", "embedding",
    )
    met = staying.unionByName(passing).repartition(vector_parts * query_parts, "cell").sortWithinPartitions("cell", "kind")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, names, waiting, best = None, [], [], None
        for pdf in batches:
            for cell, part in pdf.groupby("cell", sort=False):
                if cell != now:
                    if best is not None:
                        yield best.rows()
                    now, names, waiting, best = cell, [], [], None
                mine = part[(part["kind"] == 0) & part["embedding"].notna()]
                names += mine["query_id"].tolist()
                waiting += mine["embedding"].tolist()
                rows = part[part["kind"] == 1]
                if len(rows) and names:
                    if best is None:
                        best, waiting = Best(names, waiting, n), []
                    best.see(rows["id"], rows["embedding"])
        if best is not None:
            yield best.rows()

    scored = met.mapInPandas(score, _found(vectors, id_col))
    # the rank filter is pushed below the shuffle, so each task sends n rows per query
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
