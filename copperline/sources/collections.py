"""Vector collections as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from copperline import schemas
from copperline.functions import vectors as vec
from copperline.operators import graph, topk
from copperline.session import materialize

_NAME = r"^[A-Za-z0-9_][A-Za-z0-9_.-]*$"


def _table(name: str) -> str:
    import re

    if not re.match(_NAME, name):
        raise ValueError(f"bad collection name: {name!r}")
    # table names have no - and no .: both are spelled out, so different collections stay different
    return f"`{name.replace('_', '__').replace('-', '_m').replace('.', '_d')}`"


def create_collection(spark: SparkSession, name: str) -> None:
    """Create an empty collection; an existing name is an error. Its metric is the cosine."""
    spark.sql(f"CREATE TABLE {_table(name)} ({schemas.VECTORS}) USING parquet COMMENT 'metric: cosine'")


def drop_collection(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {_table(name)}")


def rows_from_lists(df: DataFrame, documents: str = "documents", metadatas: str = "metadatas", ids: str = "ids") -> DataFrame:
    """Rows of four parallel lists: id, document, metadata (and embedding where present)."""
    lists = {"id": ids, "document": documents, "metadata": metadatas}
    if "embeddings" in df.columns:
        lists["embedding"] = "embeddings"
    zipped = F.arrays_zip(*[F.col(c).alias(n) for n, c in lists.items()])
    return df.select(F.inline(zipped)).toDF(*lists)


def add_embeddings(spark: SparkSession, name: str, docs: DataFrame, fn=None, order: str | None = None) -> None:
    """Embed ``docs`` (id, document, metadata) and upsert them by id.

    New rows replace stored ones of the same id. Of equal ids in ``docs`` the one with the greatest
    ``order`` stays; without such a column the rows are as good as each other and the greatest text stays.
    """
    unique = graph.latest(docs, ["id"], ["document"] if order is None else [order, "document"])
    meta = F.transform_values(F.col("metadata"), lambda k, v: v.cast("string"))
    out = vec.embed(unique, "document", fn).select(
        F.lit(name).alias("collection"), "id", "document", F.col("embedding").cast("array<double>").alias("embedding"),
        meta.alias("metadata"),
    )
    # the new state is a table of its own before the old one is replaced
    others = stored(spark, name).join(unique.select("id"), "id", "left_anti").select(*out.columns)
    materialize(others.unionByName(out)).write.mode("overwrite").insertInto(_table(name))


def stored(spark: SparkSession, name: str) -> DataFrame:
    """All rows of a collection."""
    return spark.table(_table(name))


def query_embeddings(spark: SparkSession, name: str, text: str, n: int, fn=None) -> DataFrame:
    """The n rows nearest to a text, with ``score``."""
    import pandas as pd

    query = vec.embed_question(text) if fn is None else list(fn(pd.Series([text])).iloc[0])
    return topk.vector_topk(stored(spark, name), query, n, id_col="id")
