"""Embedding and similarity expressions."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from copperline.functions.arrays import let

DEFAULT_DIM = 64
WORD = r"[a-z0-9]+"


def bucket_counts(buckets: Column, dim: int) -> Column:
    """How often each of the values 0 to dim - 1 occurs in an array.

    With every value and an end mark added once, the sorted array holds each value's run. One pass finds
    where runs start, and a count is the distance between two starts.
    """
    marks = F.sequence(F.lit(0), F.lit(dim))

    def starts(runs: Column) -> Column:
        return F.filter(F.transform(runs, lambda x, i: F.when((i == 0) | (F.get(runs, i - 1) < x), i).otherwise(-1)), lambda i: i >= 0)

    return let(F.sort_array(F.concat(buckets, marks)), lambda runs: let(starts(runs), lambda at: F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: (F.get(at, d + 1) - F.get(at, d) - 1).cast("double"),
    )))


def embed_question(text: str, dim: int = DEFAULT_DIM) -> list[float]:
    """The default embedding of one short text on the driver, equal to that of ``embed``."""
    counts = Counter(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim for w in re.findall(WORD, text.lower()))
    norm = math.sqrt(sum(c * c for c in counts.values()))
    return [counts[d] / norm if norm else 0.0 for d in range(dim)]


def embed(df: DataFrame, text_col: str, fn: Callable[[pd.Series], pd.Series] | None = None,
          out: str = "embedding", dim: int = DEFAULT_DIM) -> DataFrame:
    """Add an embedding column: the built-in hashed one, or a user model applied to Arrow batches."""
    if fn is None:
        words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WORD), F.lit(0))
        bucketed = df.withColumn("_buckets", F.transform(
            words, lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dim).cast("int")
        ))
        counted = bucketed.withColumn("_counts", bucket_counts(F.col("_buckets"), dim))
        normed = counted.withColumn(
            "_norm", F.sqrt(F.aggregate("_counts", F.lit(0.0), lambda a, x: a + x * x))
        )
        return normed.withColumn(
            out, F.transform("_counts", lambda x: F.when(F.col("_norm") == 0, 0.0).otherwise(x / F.col("_norm")))
        ).drop("_buckets", "_counts", "_norm")

    @F.pandas_udf("array<double>")
    def model(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield fn(batch)

    return df.withColumn(out, model(F.col(text_col)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two array columns; null when one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return dot / F.nullif(F.sqrt(square(a)) * F.sqrt(square(b)), F.lit(0.0))
