"""Expansion of COPY lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from copperline.functions.arrays import let
from copperline.operators.skew import hot_keys, salted_join
from copperline.session import materialize

# a line that holds a COPY sentence and nothing else, after an optional sequence area
_COPY_LINE = r"""(?im)^(?:.{6}[^*/\n]|[^*/\n]|)[ \t]*COPY\s+["']?([A-Z0-9][A-Z0-9_#$@-]*)["']?(?:\.[A-Z0-9]+)?\s*\.[^\n]*$"""


def _references(texts: DataFrame, key: str) -> DataFrame:
    """Distinct (key, name) of the copybooks a text names."""
    found = F.array_distinct(F.transform(
        F.regexp_extract_all("content", F.lit(_COPY_LINE), F.lit(1)), F.upper
    ))
    return texts.select(key, F.explode(found).alias("name"))


def _replace(content: Column, parts: Column) -> Column:
    """Put each copybook's text in place of the lines that name it.

    ``parts`` is an array of (name, text). Everything the loop over the lines needs is computed once
    per file and bound before it.
    """
    texts = F.map_from_entries(F.transform(parts, lambda p: F.struct(
        p["name"], F.regexp_replace(p["text"], r"\r?\n$", "").alias("text")
    )))
    bound = F.struct(
        F.split(content, _COPY_LINE).alias("pieces"), F.regexp_extract_all(content, F.lit(_COPY_LINE), F.lit(0)).alias("marks"),
        F.transform(F.regexp_extract_all(content, F.lit(_COPY_LINE), F.lit(1)), F.upper).alias("names"), texts.alias("texts"),
    )

    def rebuilt(b: Column) -> Column:
        filled = F.transform(b["marks"], lambda mark, i: F.concat(
            F.get(b["pieces"], i), F.coalesce(F.try_element_at(b["texts"], F.get(b["names"], i)), mark)
        ))
        return F.concat(F.array_join(filled, ""), F.element_at(b["pieces"], -1))

    return let(bound, rebuilt)


def _expand_once(texts: DataFrame, key: str, copybooks: DataFrame) -> DataFrame:
    refs = _references(texts, key)
    # one copybook may be named by most files: its rows are spread over several tasks
    books = copybooks.select("name", F.col("content").alias("text"))
    pulled = salted_join(refs, books, "name", F.col(key), hot_keys(refs, "name"))
    per_text = pulled.groupBy(key).agg(F.collect_list(F.struct("name", "text")).alias("_parts"))
    joined = texts.join(per_text, key, "left")
    return joined.withColumn("content", F.when(
        F.col("_parts").isNotNull(), _replace(F.col("content"), F.col("_parts"))
    ).otherwise(F.col("content"))).drop("_parts")


def _check_no_circle(books: DataFrame) -> DataFrame:
    """The references among copybooks; an error if some of them name each other in a circle.

    Names alone are followed: references to copybooks that refer to none are taken away until none
    is left, or none can be taken.
    """
    known = books.select("name")
    refs = materialize(books.select(
        F.col("name").alias("_by"),
        F.explode(F.array_distinct(F.transform(F.regexp_extract_all("content", F.lit(_COPY_LINE), F.lit(1)), F.upper))).alias("name"),
    ).join(known, "name", "left_semi"))
    left, n = refs, refs.count()
    while n:
        left = materialize(left.join(left.select(F.col("_by").alias("name")).distinct(), "name", "left_semi"))
        fewer = left.count()
        if fewer == n:
            raise ValueError("copybooks include each other in a circle")
        n = fewer
    return refs


def expand_copybooks(sources: DataFrame, copybooks: DataFrame) -> DataFrame:
    """Replace COPY lines by the copybook's lines; unknown names stay as they are.

    Copybooks that name other copybooks are expanded first, among themselves, until none is
    left: each round doubles the depth and is a table of its own. Sources are then rewritten in a
    single pass. Copybooks that name each other in a circle are an error, found on the names
    before any text is put in.
    """
    books = materialize(copybooks.groupBy("name").agg(F.min_by("content", "path").alias("content")))
    open_refs = _check_no_circle(books)
    while not open_refs.isEmpty():
        keyed = books.withColumnRenamed("name", "book")
        books = materialize(_expand_once(keyed, "book", books).withColumnRenamed("book", "name"))
        open_refs = books.select(
            F.explode(F.transform(F.regexp_extract_all("content", F.lit(_COPY_LINE), F.lit(1)), F.upper)).alias("name")
        ).join(books.select("name"), "name", "left_semi")
    return _expand_once(sources, "path", books)
