"""Joins on keys of which one may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_SALTS = 32
#: Rows of one key that are no load for a task; changes plans only.
LEAST_SHARE = 10_000


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out to all cores when the input has fewer splits than that.

    Source texts are few and large for the work they cause; a well split input is left alone.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def shuffled(df: DataFrame) -> DataFrame:
    """One side of a join whose size cannot be told in advance: the join shuffles, and no side is sent through the driver.

    Rows parsed out of texts are estimated by the size of the texts' table, or of a file that compresses them a
    hundredfold; by that, millions of them would count as small enough for a broadcast.
    """
    return df.hint("merge")


def hot_keys(df: DataFrame, key: str, share: float = 0.02) -> list[str]:
    """Keys that hold more than ``share`` of the rows: at most ``1 / share`` of them.

    One counting pass; counts are combined before the shuffle, so a hot key is cheap here.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    limit = max(int(total.first()["total"] * share), 1)
    return [r[key] for r in counts.where((F.col("n") > limit) & F.col(key).isNotNull()).select(key).collect()]


def hot_shares(df: DataFrame, key: str, least: int = LEAST_SHARE) -> dict[str, int]:
    """Keys that hold more than one partition's share of the rows, with how many shares they hold.

    Both grow with the job: there are at most as many such keys as shuffle partitions. A share is ``least`` rows or
    more, which a task joins at once anyway. One counting pass, combined before the shuffle; read ``df`` from a table.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = df.count()
    share = max(-(-total // partitions), least)
    if total <= share:
        return {}
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return {r[key]: -(-r["n"] // share) for r in counts.where(F.col("n") > share).collect()}


def salted_join(
    many: DataFrame, one: DataFrame, key: str, spread: Column, hot: list[str] | dict[str, int] | None = None, how: str = "inner",
    salts: int = _SALTS,
) -> DataFrame:
    """Join on ``key`` with the rows of hot keys spread over several tasks.

    ``many`` rows of a hot key are dealt out by ``spread``, over ``salts`` or as many tasks as ``hot`` says per key; the
    matching rows of ``one`` are repeated once per salt. Other keys have a single salt, so nothing else is
    repeated. Without hot keys this is a plain join, whose oversized partitions adaptive execution splits.
    """
    if not hot:
        return many.join(one, key, how)
    shares = hot if isinstance(hot, dict) else dict.fromkeys(hot, salts)
    known = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
    n = F.coalesce(F.try_element_at(known, F.col(key)), F.lit(1))
    left = many.withColumn("_salt", F.pmod(F.xxhash64(spread), n).cast("int"))
    right = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1)))
    return left.join(right, [key, "_salt"], how).drop("_salt")
