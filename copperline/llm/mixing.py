"""Mixing sources to target weights by Poisson replication, without Python.

The mean number of copies of a document is its source's target share over its present share. The
number of copies of one document is the inverse of that Poisson distribution at a uniform number
hashed from seed and id: no state, no order and no second pass, so a lost task repeats the same
copies. Copies are exploded and dealt over all partitions by a hash of id and copy number.

Defined cases: null is a source of its own; sources without a weight have weight ``default`` (0
drops them); a null id is replaced by the text; repeated rows get equally many copies; an empty
table gives an empty result; other columns are kept, and of columns named like the added ones the
added ones win.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from copperline.llm.columns import by_place

SEED = 42
#: A Poisson mean beyond this is the sum of equal parts below it, each with a uniform number of its own.
PART = 16.0
BROADCAST_SOURCES = 100_000
ADDED = ("n_copies", "copy", "shuffle_key")


def uniform(*parts: Column) -> Column:
    """A uniform number in [0, 1) with 52 bits from the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_steps(mean: Column) -> Column:
    """The cumulative probabilities of a Poisson distribution as far as 52 bits can tell them apart."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("steps"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.array_append(acc["steps"], F.element_at(acc["steps"], -1) + p).alias("steps"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["steps"])


def rates(
    docs: DataFrame, weights: dict[str | None, float] | None, power: float = 0.5, default: float = 0.0,
    total: int | None = None, source_col: str = "source",
) -> tuple[DataFrame, int]:
    """(source, rate) and the number of sources. Without weights a source weighs its count to ``power``.

    ``total`` is the expected number of rows of the mix; by default that of the input.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(power))
    else:
        weight = F.lit(float(default))
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    weighed = counts.withColumn("weight", weight)
    sums = weighed.agg(F.sum("weight").alias("w"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("sources")).first()
    rows = sums["n"] or 0
    if not sums["w"]:
        return weighed.select("source", F.lit(0.0).alias("rate")), sums["sources"]
    share = F.col("weight") / F.lit(float(sums["w"]))
    return weighed.select("source", (share * float(rows if total is None else total) / F.col("n")).alias("rate")), sums["sources"]


@by_place(*ADDED)
def mix(
    docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.5, default: float = 0.0,
    total: int | None = None, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """``docs`` replicated to the target weights and shuffled, with n_copies, copy and shuffle_key."""
    table, n_sources = rates(docs, weights, power, default, total, source_col)
    parts = F.greatest(F.ceil(F.col("rate") / PART).cast("int"), F.lit(1))
    # the steps of a source are made once, in its one row
    table = table.select(F.col("source").alias("_mix_source"), parts.alias("_parts"), (F.col("rate") / parts).alias("_mean"))
    table = table.select("_mix_source", "_parts", poisson_steps(F.col("_mean")).alias("_steps"))
    same = F.col(source_col).eqNullSafe(F.col("_mix_source"))
    base = docs
    if n_sources <= BROADCAST_SOURCES:
        rated = base.join(F.broadcast(table), same)
    else:
        # a source with a large share of all rows is dealt over salts
        salts = 16
        salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rated = base.withColumn("_deal", F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int")).join(
            salted, same & (F.col("_deal") == F.col("_salt"))
        )
    name = F.coalesce(F.col(id_col).cast("string"), F.md5(text_col), F.lit(""))
    first = F.size(F.filter("_steps", lambda c: c <= uniform(F.lit(str(seed)), F.lit("0"), name)))
    more = F.aggregate(
        F.sequence(F.lit(1), F.col("_parts") - 1), F.lit(0),
        lambda acc, j: acc + F.size(F.filter("_steps", lambda c: c <= uniform(F.lit(str(seed)), j.cast("string"), name))),
    )
    n_copies = first + F.when(F.col("_parts") > 1, more).otherwise(0)
    counted = rated.withColumn("_name", name).withColumn("n_copies", n_copies).where("n_copies > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("n_copies")))
    )
    key = F.md5(F.concat_ws("|", F.lit("order"), F.lit(str(seed)), "_name", "copy"))
    shuffled = counted.withColumn("shuffle_key", key)
    return shuffled.select(*docs.columns, *ADDED).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
