"""Graph tables: upserts, edges, lookups, checks and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from copperline.operators.skew import salted_join
from copperline.sources import snapshots


def latest(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Last write wins: per key the row with the largest ``order``.

    An aggregate and not a window: rows of one key are combined before the shuffle, so a key
    with a third of all rows still sends one row per task.
    """
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def upsert_entities(entities: DataFrame, as_of: Column) -> DataFrame:
    """Entities keyed by id; the last emitted of the newest file wins."""
    stamped = entities.withColumn("last_updated", as_of)
    return latest(stamped, ["id"], ["last_updated", "path", "seq"]).select(
        "id", "program", "name", "type", "section", "description", "last_updated"
    )


def upsert_programs(programs: DataFrame, as_of: Column) -> DataFrame:
    """Programs keyed by name with file path and update stamp."""
    stamped = programs.select("name", F.col("path").alias("file_path"), as_of.alias("last_updated"))
    return latest(stamped, ["name"], ["last_updated", "file_path"])


def upsert_edges(edges: DataFrame, as_of: Column) -> DataFrame:
    """Edges keyed by source, target and type with update stamp."""
    return edges.groupBy("source", "target", "rel_type").agg(F.max(as_of).alias("last_updated"))


def merge_tables(stored: DataFrame, new: DataFrame, keys: list[str], order: list[str], prune_on: str | None = None) -> DataFrame:
    """Merge new rows into stored ones. ``prune_on`` drops stored rows whose value there is re-delivered."""
    if prune_on:
        stored = stored.join(new.select(prune_on).distinct(), prune_on, "left_anti")
    return latest(stored.unionByName(new, allowMissingColumns=True), keys, order)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that break uniqueness; empty for a sound table."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def containment(entities: DataFrame, programs: DataFrame, hot: list[str] | None = None) -> DataFrame:
    """Distinct program-to-entity edges for entities whose program is known."""
    left = entities.select("program", F.col("id").alias("entity_id")).distinct()
    known = programs.select(F.col("name").alias("program")).distinct()
    return salted_join(left, known, "program", F.col("entity_id"), hot)


def build_edges(edges: DataFrame, programs: DataFrame, hot: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, programs): edges whose source is known, and programs with stubs for unknown targets."""
    known = programs.select(F.col("name").alias("source")).distinct()
    kept = salted_join(edges, known, "source", F.col("target"), hot)
    # targets are made distinct first, so a target called from everywhere is one row here
    targets = kept.select(F.col("target").alias("name")).distinct()
    stubs = targets.join(programs.select("name"), "name", "left_anti")
    return kept, programs.unionByName(stubs, allowMissingColumns=True)


def callees(edges: DataFrame, name: str | None = None) -> DataFrame:
    """One-hop lookup: (source, target) of CALLS edges, of one program when named."""
    calls = edges.where(F.col("rel_type") == "CALLS")
    return (calls if name is None else calls.where(F.col("source") == name)).select("source", "target")


def callee_lists(edges: DataFrame) -> DataFrame:
    """Sorted list of callees per calling program."""
    return callees(edges).distinct().groupBy("source").agg(F.sort_array(F.collect_list("target")).alias("deps"))


def relationship_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("source").agg(F.count(F.lit(1)).alias("n_relationships"))


def ordered_programs(programs: DataFrame) -> DataFrame:
    return programs.select("name").orderBy("name")


def first_edge(edges: DataFrame, source: str) -> DataFrame:
    """First edge of a source in target order."""
    return edges.where(F.col("source") == source).orderBy("target", "rel_type").limit(1)


def run_query(spark: SparkSession, tables: dict[str, DataFrame], text: str, params: dict | None = None) -> DataFrame:
    """SQL with named parameters over the graph tables."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=params or {})


def write_graph(
    tables: dict[str, DataFrame], directory: str, keys: dict[str, list[str]] | None = None, spark: SparkSession | None = None
) -> None:
    """Stage, audit, publish: each table is written once, keys are checked on what was written, then a manifest names it.

    A table with repeated keys raises ValueError and nothing is published; so does a directory with a published graph.
    Rows are dealt by key and sorted, so that key lookups skip row groups and no pass over the rows is needed for ranges.
    """
    spark = spark or next(iter(tables.values())).sparkSession
    keys = keys or {"programs": ["name"], "entities": ["id"]}
    if snapshots.versions(spark, directory):
        raise ValueError(f"{directory} holds a graph already")
    folders = {}
    for name, df in tables.items():
        key = [c for c in ("name", "id", "source", "program") if c in df.columns][:1]
        staged = df.repartition(*key).sortWithinPartitions(*key) if key else df
        folders[name] = snapshots.new_folder(name)
        staged.write.parquet(f"{directory}/{folders[name]}")
    written = {n: spark.read.schema(tables[n].schema).parquet(f"{directory}/{folders[n]}") for n in keys if n in tables}
    broken = [n for n, df in written.items() if not duplicate_keys(df, keys[n]).isEmpty()]
    if broken:
        raise ValueError(f"duplicate keys in {broken}")
    snapshots.publish(spark, directory, {"version": 1, "tables": {n: [{"folder": f}] for n, f in folders.items()}})


def read_graph(spark: SparkSession, directory: str, names: list[str]) -> dict[str, DataFrame]:
    """Tables of the published state."""
    state = snapshots.read(spark, directory)
    if state is None:
        raise ValueError(f"{directory}: nothing is published")
    return {n: snapshots.table(spark, directory, state, n) for n in names}


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
