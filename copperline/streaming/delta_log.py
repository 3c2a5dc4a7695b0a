"""Keyed tables as a log of bucketed deltas.

A batch appends one delta per table: its rows, cut into buckets by a hash of the key. The state of a
bucket is its deltas in order, and per key the row with the greatest order wins, the later delta if that is equal.
A bucket with more than ``MAX_DELTAS`` deltas is compacted by the batch that exceeds the number: only that bucket is
read and written anew. So a batch costs what it brings, plus now and then the buckets it touches.

The manifest remembers the last batch of every stream: a batch that comes again after a failure is not taken twice.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from copperline.operators import graph
from copperline.sources import snapshots

BUCKETS = 16
MAX_DELTAS = 8
_SEQ = "_delta"
_BUCKET = "_bucket"


@dataclass(frozen=True)
class Keyed:
    """A table's key and the columns that say which of two rows is newer; the later delta decides where these do not."""

    key: list[str]
    newest: list[str]


def _bucketed(rows: DataFrame, key: list[str], buckets: int) -> DataFrame:
    return rows.withColumn(_BUCKET, F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))


def _latest(rows: DataFrame, table: Keyed) -> DataFrame:
    """Per key the newest of the stored rows. A key has at most one row in a delta, so a window's groups are small, and
    unlike the picked row of an aggregate it lets columns that nobody reads be left in their files."""
    newest = Window.partitionBy(*table.key).orderBy(*[F.col(c).desc_nulls_last() for c in [*table.newest, _SEQ]])
    return rows.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") == 1).drop("_rank")


def _write(rows: DataFrame, root: str, folder: str, table: Keyed, buckets: int) -> None:
    """The newest row per key, one file per bucket, sorted by key.

    Rows are dealt to their buckets once; what is newest is picked there, in the order that the files want.
    """
    dealt = _bucketed(rows, table.key, buckets).repartition(_BUCKET)
    kept = graph.latest(dealt, [_BUCKET, *table.key], [*table.newest, _SEQ])
    kept.sortWithinPartitions(_BUCKET, *table.key).write.partitionBy(_BUCKET).parquet(f"{root}/{folder}")


def _filled(spark: SparkSession, root: str, folder: str) -> list[int]:
    """The buckets a written folder has."""
    fs, path = snapshots._file_system(spark, root), snapshots._path(spark, f"{root}/{folder}")
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{_BUCKET}="))


def _paths(root: str, folders: list[dict], buckets: set[int]) -> list[str]:
    return [f"{root}/{f['folder']}/{_BUCKET}={b}" for f in folders for b in f["buckets"] if b in buckets]


def _held(live: list[dict]) -> Counter:
    """How many deltas each bucket has."""
    return Counter(bucket for delta in live for bucket in delta["buckets"])


def taken(spark: SparkSession, root: str, stream: str, batch_id: int) -> int | None:
    """The published version if it holds this batch of ``stream`` already."""
    state = snapshots.read(spark, root)
    return state["version"] if state and state["batches"].get(stream, -1) >= batch_id else None


def append(
    spark: SparkSession, root: str, rows: dict[str, DataFrame], tables: dict[str, Keyed], stream: str, batch_id: int,
    buckets: int = BUCKETS, max_deltas: int = MAX_DELTAS,
) -> int:
    """Add one batch to all tables and publish it; returns the version that holds it.

    ``stream`` names the source of batches, whose ids grow; a batch that is in already changes nothing.
    """
    while True:
        state = snapshots.read(spark, root) or {"version": 0, "buckets": buckets, "batches": {}, "tables": {}, "schemas": {}}
        if state["batches"].get(stream, -1) >= batch_id:
            return state["version"]
        version = state["version"] + 1
        fresh = {"version": version, "buckets": state["buckets"], "batches": {**state["batches"], stream: batch_id}, "tables": {}, "schemas": {}}
        for name, new in rows.items():
            table, folder = tables[name], snapshots.new_folder(name)
            marked = new.withColumn(_SEQ, F.lit(version).cast("long"))
            _write(marked, root, folder, table, state["buckets"])
            live = [*state["tables"].get(name, [])]
            filled = _filled(spark, root, folder)
            if filled:
                live.append({"folder": folder, "buckets": filled})
            fresh["schemas"][name] = state["schemas"].get(name) or marked.schema.jsonValue()
            fresh["tables"][name] = _compacted(spark, root, name, table, live, fresh, max_deltas)
        try:
            snapshots.publish(spark, root, fresh)
            return version
        except snapshots.Conflict:
            continue  # another batch came between: this one's deltas are written again after it


def _compacted(spark: SparkSession, root: str, name: str, table: Keyed, live: list[dict], state: dict, max_deltas: int) -> list[dict]:
    """The live folders after the buckets with too many deltas became one each."""
    held = _held(live)
    full = {b for b, n in held.items() if n > max_deltas}
    if not full:
        return live
    folder = snapshots.new_folder(name)
    stored = spark.read.schema(T.StructType.fromJson(state["schemas"][name])).parquet(*_paths(root, live, full))
    _write(stored, root, folder, table, state["buckets"])
    # what is merged is older than any delta to come, so the merged folder goes first
    rest = [{"folder": d["folder"], "buckets": [b for b in d["buckets"] if b not in full]} for d in live]
    return [{"folder": folder, "buckets": sorted(full)}, *[d for d in rest if d["buckets"]]]


def current(spark: SparkSession, root: str, name: str, table: Keyed, version: int | None = None) -> DataFrame:
    """A table's rows as of a version, by default the latest. Buckets of a single delta are read as they are."""
    state = snapshots.read(spark, root, version)
    if state is None:
        raise ValueError(f"{root}: nothing is published")
    live, schema = state["tables"][name], T.StructType.fromJson(state["schemas"][name])
    held = _held(live)
    single, several = {b for b, n in held.items() if n == 1}, {b for b, n in held.items() if n > 1}
    empty = spark.createDataFrame([], schema)
    parts = [spark.read.schema(schema).parquet(*_paths(root, live, side)) if side else empty for side in (single, several)]
    return parts[0].unionByName(_latest(parts[1], table)).drop(_SEQ)
