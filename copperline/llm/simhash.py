"""Near duplicates by SimHash: fingerprints, one-wildcard segment index, components.

Two fingerprints of 64 bits that differ in at most ``max_bits`` have, when cut into
``(max_bits + 2) // 2`` segments, one segment that differs in at most one bit. That segment with
the differing bit masked is an equal key of both, so an equality join over all segments with one
wildcard finds every link, and the whole fingerprints are then compared.

Keys with more than ``BUCKET`` fingerprints would give all pairs of a dense group. Segments that are
held so often are counted first, and for links of up to two bits the fingerprints with or beside
them are indexed by the whole fingerprint and its 64 one-bit variants instead: two of them share a
variant exactly if they differ in at most two bits, so a link to the smallest fingerprint of each
variant is exact, complete and linear.

Defined cases: a null, empty or wordless text has fingerprint zero and links like any other; fewer
words than a shingle are one shingle; copies are one node of the graph; a null id never names a
component unless all its ids are null; repeated rows get the same component.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from copperline.llm.columns import by_place
from copperline.llm.text import text_key
from copperline.session import materialize

SHINGLE = 3
MAX_BITS = 2
SEED = 42
BUCKET = 32
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number. A bit is set if it is set in over half the shingle hashes."""
    # bytes.split cuts at space and \t to \r, and nowhere else
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    total = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for start in range(0, total, _CHUNK):
        n = min(_CHUNK, total - start)
        parts = map(b" ".join, zip(*[words[start + k:start + k + n] for k in range(shingle)]))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, n)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key and fp of every row."""
    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t if isinstance(t, str) else None, shingle) for t in texts], dtype="int64")

    return docs.select(
        F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), fp(F.col(text_col)).alias("fp")
    )


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment."""
    n = (max_bits + 2) // 2
    edges = [64 * k // n for k in range(n + 1)]
    return list(zip(edges, [b - a for a, b in zip(edges, edges[1:])]))


def _variants(fp: Column, max_bits: int) -> Column:
    """Keys of a fingerprint: each segment as it is (side 2) and with one bit masked (side: that bit)."""
    out = []
    for s, (low, width) in enumerate(_segments(max_bits)):
        value = F.shiftrightunsigned(fp, low).bitwiseAND(_ones(width))
        for bit in range(-1, width):
            masked = value if bit < 0 else value.bitwiseAND(F.lit(~(1 << bit) if bit < 63 else (1 << 63) - 1).cast("long"))
            side = F.lit(2) if bit < 0 else F.shiftrightunsigned(value, bit).bitwiseAND(F.lit(1).cast("long")).cast("int")
            label = s * 65 + bit + 1
            if width <= 48:
                key = masked.bitwiseOR(F.lit(label << 48).cast("long"))
            else:
                key = F.xxhash64(F.lit(label), masked)
            out.append(F.struct(F.lit(s).alias("s"), key.alias("key"), side.alias("side")))
    return F.array(*out)


def _segment_values(fp: Column, max_bits: int) -> Column:
    """(s, value) of each segment."""
    return F.array(*[
        F.struct(F.lit(s).alias("s"), F.shiftrightunsigned(fp, low).bitwiseAND(_ones(width)).alias("value"))
        for s, (low, width) in enumerate(_segments(max_bits))
    ])


def _with_flips(value: Column, width: int | Column) -> Column:
    """The value and all that differ from it in one bit."""
    bits = F.sequence(F.lit(0), F.lit(width) - 1)
    return F.concat(F.array(value), F.transform(bits, lambda b: value.bitwiseXOR(_bit(b))))


def _bit(b: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), b)


def _ones(width: int) -> Column:
    return F.lit(-1 if width == 64 else (1 << width) - 1).cast("long")


def _shuffled(df: DataFrame) -> DataFrame:
    """One side of a join that shuffles whatever Spark thinks of its size.

    Rows made by an explode, and files that compress well, are estimated far too low; a broadcast by that would have to
    fit the driver. A join planned as a broadcast stays one, whatever the rows before it turn out to be.
    """
    return df.hint("merge")


def dense(fps: DataFrame, max_bits: int, bucket: int) -> tuple[DataFrame, DataFrame]:
    """Which fingerprints have a segment that more than half a bucket of them hold, or are one bit from such.

    Returns (fp, s) whose segment s is held that often, and (fp) of those and their neighbours. A key
    with a wildcard joins two segment values, so without the former no key has more than ``bucket`` rows.
    """
    values = fps.select("fp", F.explode(_segment_values(F.col("fp"), max_bits)).alias("v")).select("fp", "v.s", "v.value")
    hot = materialize(values.groupBy("s", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket // 2))
    held = materialize(values.join(_shuffled(hot.select("s", "value")), ["s", "value"], "left_semi").select("fp", "s"))
    widths = F.lit(0)
    for s, (_, width) in enumerate(_segments(max_bits)):
        widths = F.when(F.col("s") == s, width).otherwise(widths)
    around = hot.select("s", F.explode(_with_flips(F.col("value"), widths)).alias("value")).distinct()
    near = materialize(values.join(_shuffled(around), ["s", "value"], "left_semi").select("fp").distinct())
    return held, near


def links(fps: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) with a < b between distinct fingerprints ``fp``: enough to connect all that are within ``max_bits``.

    All links are returned but those between fingerprints of dense groups, where the links to the
    smallest of each variant stand for them. The linear form proves up to two bits; beyond that
    every key is joined whole.
    """
    left_out = F.lit(0)
    if max_bits <= 2:
        held, near = dense(fps, max_bits, bucket)
        # the segments to leave out as bits beside each fingerprint: joined before dozens of keys are made of it
        marks = held.groupBy("fp").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("s"))).alias("held"))
        fps, left_out = fps.select("fp").join(_shuffled(marks), "fp", "left"), F.coalesce("held", F.lit(0))
    keyed = fps.select("fp", left_out.alias("held"), F.explode(_variants(F.col("fp"), max_bits)).alias("v")).where(
        F.getbit("held", F.col("v.s")) == 0
    ).select("fp", "v.key", "v.side")
    a, b = keyed.alias("a"), _shuffled(keyed.alias("b"))
    bits = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp")))
    # with a masked bit only unequal bits need to meet; equal segments meet under the key without a wildcard
    sides = ((F.col("a.side") == 0) & (F.col("b.side") == 1)) | ((F.col("a.side") == 2) & (F.col("b.side") == 2))
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & sides & (F.col("a.fp") != F.col("b.fp")) & (bits <= max_bits))
    found = met.select(F.least("a.fp", "b.fp").alias("a"), F.greatest("a.fp", "b.fp").alias("b"))
    if max_bits <= 2:
        spread = near.select("fp", F.explode(_with_flips(F.col("fp"), 64)).alias("z"))
        first = spread.groupBy("z").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("z", "a")
        star = spread.join(_shuffled(first), "z").where(F.col("a") < F.col("fp")).select("a", F.col("fp").alias("b"))
        found = found.unionByName(star.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node connected with each, by hooking roots and jumping pointers.

    The number of rounds grows with the logarithm of the longest chain. Every round is a table in
    the shared folder, so a lost executor costs one round.
    """
    both = materialize(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("a").alias("other"))
    ))
    state = materialize(both.groupBy("node").agg(F.min("other").alias("m")).select(
        "node", F.least("node", "m").alias("root")
    ))
    while True:
        roots = state.select(F.col("node").alias("other"), F.col("root").alias("seen"))
        offers = both.join(_shuffled(roots), "other").groupBy("node").agg(F.min("seen").alias("offer"))
        offered = state.join(_shuffled(offers), "node").select("node", "root", F.least("root", "offer").alias("offer"))
        # the offer goes to the node and to its root; a root outside the rows so far cannot be
        hooked = offered.select("node", "offer").unionByName(
            offered.select(F.col("root").alias("node"), "offer")
        ).groupBy("node").agg(F.min("offer").alias("root"))
        hooked = materialize(hooked)
        jump = hooked.select(F.col("node").alias("root"), F.col("root").alias("next"))
        following = materialize(hooked.join(_shuffled(jump), "root", "left").select(
            "node", F.least("root", F.coalesce("next", "root")).alias("root")
        ))
        changed = following.join(_shuffled(state.withColumnRenamed("root", "old")), "node").where(F.col("old") != F.col("root"))
        if changed.isEmpty():
            return following
        state = following


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, bucket: int = BUCKET, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, text_key, fp, root (smallest fingerprint of the component) and component_id of every row."""
    rows = materialize(fingerprints(docs, shingle, id_col, text_col))
    # copies meet here: partial results per task, one row per fingerprint after the shuffle
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    # the index makes dozens of keys from each: few large files would leave that to few tasks
    spread = nodes.select("fp").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    linked = components(links(spread, max_bits, bucket)).withColumnRenamed("node", "fp")
    placed = nodes.join(_shuffled(linked), "fp", "left")
    smallest = placed.where("root is not null").groupBy("root").agg(F.min("first_id").alias("smallest"))
    groups = placed.join(smallest, "root", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("smallest", "first_id").alias("component_id")
    )
    return rows.join(_shuffled(groups), "fp").select("doc_id", "text_key", "fp", "root", "component_id")


@by_place()
def keep_one(
    docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, bucket: int = BUCKET, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per component, with all columns: the row with the smallest id (nulls last, then by text hash)."""
    placed = near_duplicates(docs, shingle, max_bits, bucket, id_col, text_col)
    order = F.struct(F.isnull("doc_id").alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("text_key").alias("text_key"))
    first = placed.groupBy("root").agg(F.min(order).alias("first")).select(
        F.col("first.doc_id").alias("_keep_id"), F.col("first.text_key").alias("_keep_key")
    )
    same = F.col(id_col).eqNullSafe(F.col("_keep_id")) & (text_key(F.col(text_col)) == F.col("_keep_key"))
    # repeated rows are equal in both keys; one of them stays
    rank = F.row_number().over(Window.partitionBy("_keep_id", "_keep_key").orderBy("_keep_key"))
    return docs.join(first, same).withColumn("_rank", rank).where("_rank = 1").select(*docs.columns)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
