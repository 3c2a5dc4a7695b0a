"""Benchmark decontamination: test windows found in training texts, without Python.

A window is ``width`` consecutive words of a benchmark item (a shorter item is one window of its
own length m). Any m consecutive words of a document cover a whole block of ``(m + 1) // 2`` words
that starts at a multiple of that block length. So a document looks up only every n-th block in the
hash set of all benchmark blocks, and carries the few words around each block for the exact check
that follows. The set is broadcast if its measured size is within a bound; otherwise the same join
is a shuffle join.

Defined cases: a null or empty text has no words and no hits; a benchmark item without words is no
window; items with a null id hit but are not listed; repeated rows are judged alike and all stay;
extra columns are ignored by ``scan`` and kept by the two removals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from copperline.functions.arrays import let
from copperline.llm.columns import by_place
from copperline.llm.text import BETWEEN_WORDS, lower_ascii, plain_words, text_key

WIDTH = 13
BROADCAST_BYTES = 64 << 20


def _normal(text: Column) -> Column:
    """The words with single spaces between them."""
    return F.trim(F.regexp_replace(lower_ascii(text), BETWEEN_WORDS, " "))


def _n_words(normal: Column) -> Column:
    spaces = F.octet_length(normal) - F.octet_length(F.replace(normal, F.lit(" "), F.lit("")))
    return F.when(normal == "", 0).otherwise(spaces + 1)


def _document_blocks(normal: Column, m: int) -> Column:
    """The blocks side by side, each with its neighbours: (m, at, h, before, block, after)."""
    words = (m + 1) // 2
    # possessive: the text is read once, a block at a time
    cut = F.regexp_extract_all(normal, F.lit(rf"[^ ]++(?: [^ ]++){{0,{words - 1}}}+"), 0)
    return let(cut, lambda c: F.transform(c, lambda x, i: F.struct(
        F.lit(m).alias("m"), (i * words).alias("at"), F.xxhash64(F.lit(m), x).alias("h"),
        F.get(c, i - 1).alias("before"), x.alias("block"), F.get(c, i + 1).alias("after"),
    )))


def _item_blocks(words: Column, m: int) -> Column:
    """Blocks of an item at every word: (h, there). ``there`` is three blocks long, filled up with spaces."""
    n = (m + 1) // 2

    def cut(padded: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(padded) - 3 * n)
        return F.transform(starts, lambda at: F.struct(
            F.xxhash64(F.lit(m), F.array_join(F.slice(padded, at + n + 1, n), " ")).alias("h"),
            F.slice(padded, at + 1, 3 * n).alias("there"),
        ))

    filler = F.array_repeat(F.lit(" "), n)
    return let(F.concat(filler, words, filler), cut)


def _agreement(n: int, m: int) -> Callable[[Column], Column]:
    def agree(here: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda o: (
            F.slice(here, F.lit(n + 1) - o, m) == F.slice(F.col("there"), F.lit(n + 1) - o, m)
        ))

    return agree


def _window_starts(lengths: list[int]) -> Column:
    """How many words before the block whole windows begin that agree with the item."""
    def cut(text: Column, n: int) -> Column:
        return F.when(text.isNull(), F.array_repeat(F.lit(""), n)).otherwise(F.split(text, " "))

    found = F.array().cast("array<int>")
    for m in lengths:
        n = (m + 1) // 2
        # no word is empty or a space, so what lies outside of a text never agrees
        here = F.concat(cut(F.col("before"), n), cut(F.col("block"), n), cut(F.col("after"), n))
        found = F.when(F.col("m") == m, let(here, _agreement(n, m))).otherwise(found)
    return found


def _benchmark_blocks(benchmark: DataFrame, width: int, id_col: str, text_col: str) -> tuple[DataFrame | None, list[int]]:
    """Distinct blocks of all windows with their items, and the window lengths that occur."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), plain_words(F.col(text_col)).alias("words"))
    sized = items.where(F.size("words") > 0).withColumn("m", F.least(F.size("words"), F.lit(width)))
    totals = {r["m"]: r["n"] for r in sized.groupBy("m").agg(F.sum(F.size("words")).alias("n")).collect()}
    if not totals:
        return None, []
    lengths = sorted(totals)
    cut = F.array().cast("array<struct<h:bigint,there:array<string>>>")
    for m in lengths:
        cut = F.when(F.col("m") == m, _item_blocks(F.col("words"), m)).otherwise(cut)
    grams = sized.select("item", "m", F.explode_outer(cut).alias("b")).where("b is not null").groupBy(
        F.col("m").alias("bm"), F.col("b.h").alias("bh"), F.col("b.there").alias("there")
    ).agg(F.collect_set("item").alias("items"))
    # one row per word, of three blocks; a word is taken for 32 bytes
    proven = sum(n * (48 * (m + 1) + 64) for m, n in totals.items())
    return (F.broadcast(grams) if proven <= BROADCAST_BYTES else grams), lengths


def scan(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Per document row: doc_id, text_key, n_words, hits, positions (of hit words), items (sorted ids), copies.

    Repeated rows (same id and text) come as one row with their number in ``copies``.
    """
    grams, lengths = _benchmark_blocks(benchmark, width, item_col, item_text_col)
    texts = docs.select(
        F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), _normal(F.col(text_col)).alias("normal")
    )
    if grams is None:
        counted = texts.select("doc_id", "text_key", _n_words(F.col("normal")).alias("n_words"))
        no = "array<int>", "array<string>"
        return counted.groupBy("doc_id", "text_key", "n_words").agg(F.count(F.lit(1)).alias("copies")).select(
            "doc_id", "text_key", "n_words", F.array().cast(no[0]).alias("positions"),
            F.array().cast(no[1]).alias("items"), "copies",
        )

    # one row stands for the document itself: it carries the number of words and matches nothing
    nothing = F.lit(None).cast("string")
    itself = F.array(F.struct(
        F.lit(0).alias("m"), _n_words(F.col("normal")).alias("at"), F.xxhash64("doc_id", "text_key").alias("h"),
        nothing.alias("before"), nothing.alias("block"), nothing.alias("after"),
    ))
    cut = F.concat(itself, *[_document_blocks(F.col("normal"), m) for m in lengths])
    # the outer form: for the inner one the optimizer would compute the array twice
    rows = texts.select("doc_id", "text_key", F.explode_outer(cut).alias("b")).select("doc_id", "text_key", "b.*")
    met = rows.join(grams, (F.col("h") == F.col("bh")) & (F.col("m") == F.col("bm")), "left").where(
        (F.col("m") == 0) | F.col("bh").isNotNull()
    )
    checked = met.select(
        "doc_id", "text_key", "m", "at", F.when(F.col("m") > 0, _window_starts(lengths)).alias("starts"), "items"
    ).where((F.col("m") == 0) | (F.size("starts") > 0))
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda o: F.sequence(
        F.col("at") - o, F.col("at") - o + F.col("m") - 1
    ))))
    per_row = checked.select(
        "doc_id", "text_key", "m", "at", F.when(F.col("m") > 0, covered).alias("covered"),
        F.when(F.col("m") > 0, F.col("items")).alias("items"),
    )
    return per_row.groupBy("doc_id", "text_key").agg(
        F.max(F.when(F.col("m") == 0, F.col("at"))).alias("n_words"),
        F.array_distinct(F.flatten(F.collect_set("covered"))).alias("positions"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.count(F.when(F.col("m") == 0, 1)).alias("copies"),
    )


def verdicts(found: DataFrame, min_share: float = 0.05) -> DataFrame:
    """One row per document row: the counts of ``scan`` and whether ``min_share`` of the words are hit."""
    # shares as integers: 20 * n_hit >= n_words for the default
    scale = round(1 / min_share)
    counted = found.select(
        "doc_id", "text_key", F.col("n_words").cast("long").alias("n_words"), F.size("positions").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "copies",
    )
    return counted.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * scale >= F.col("n_words")))


@by_place()
def remove_documents(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, min_share: float = 0.05, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` without the contaminated rows; all columns stay."""
    bad = verdicts(scan(docs, benchmark, width, id_col, text_col), min_share).where("contaminated").select(
        F.col("doc_id").alias("_bad_id"), F.col("text_key").alias("_bad_key")
    )
    same = F.col(id_col).eqNullSafe(F.col("_bad_id")) & (text_key(F.col(text_col)) == F.col("_bad_key"))
    return docs.join(bad, same, "left_anti")


@by_place()
def remove_spans(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with the hit words, and what follows each up to the next word, cut out of the text."""
    hits = scan(docs, benchmark, width, id_col, text_col).where(F.size("positions") > 0).select(
        F.col("doc_id").alias("_hit_id"), F.col("text_key").alias("_hit_key"), F.array_sort("positions").alias("_hit_at")
    )
    same = F.col(id_col).eqNullSafe(F.col("_hit_id")) & (text_key(F.col(text_col)) == F.col("_hit_key"))
    word = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
    lead = F.regexp_extract(text_col, rf"(?s)^((?:(?!{word}).)*)", 1)
    pieces = F.regexp_extract_all(text_col, F.lit(rf"(?s)({word}+(?:(?!{word}).)*)"), 1)
    # a set bit per hit word: looking one up costs the same for every number of hits
    flags = F.map_from_entries(F.array(F.struct(F.lit(0), F.col("_hit_at"))))
    kept = let(flags, lambda f: F.filter(pieces, lambda _, i: ~F.array_contains(F.element_at(f, 0), i)))
    cleaned = F.concat(lead, F.array_join(kept, ""))
    joined = docs.join(hits, same, "left")
    return joined.withColumn(
        text_col, F.when(F.col("_hit_at").isNull(), F.col(text_col)).otherwise(cleaned)
    ).select(*docs.columns)
