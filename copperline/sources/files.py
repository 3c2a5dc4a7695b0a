"""Reading sources and copybooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from copperline.operators import structure

EXTENSIONS = ("cbl", "cob", "cobol")


def _hadoop_path(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def _named(df: DataFrame) -> DataFrame:
    return df.select("path", F.regexp_extract("path", r"([^/\\]+)$", 1).alias("file_name"), "content")


def any_case_glob(exts: tuple[str, ...]) -> str:
    """A file name pattern for the extensions in any case, so that other files are not even opened."""
    each = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in exts]
    return f"*.{{{','.join(each)}}}"


def scan_sources(spark: SparkSession, directory: str, exts: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """All source files below a directory, as raw bytes. Extensions match in any case."""
    fs, path = _hadoop_path(spark, directory)
    if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        raise ValueError(f"Path must be a directory: {directory}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", any_case_glob(exts))
    return _named(files.load(directory))


def decode_sources(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, rejects): files that are valid UTF-8 as text, the others with a reason."""
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    sources = files.where(valid).withColumn("content", text)
    rejects = files.where(~valid).select("path", F.lit("not valid UTF-8").alias("reason"))
    return sources, rejects


def scan_copybooks(spark: SparkSession, files: list[str]) -> DataFrame:
    """The given copybook files: upper-case stem as name, path, content."""
    read = spark.read.format("binaryFile").load(files)
    text = F.col("content").cast("string")
    stem = F.regexp_extract("path", r"([^/\\]*?)(?:\.[^./\\]*)?$", 1)
    return read.where(F.is_valid_utf8(text)).select(F.upper(stem).alias("name"), "path", text.alias("content"))


def copybook_rejects(spark: SparkSession, files: list[str]) -> DataFrame:
    """The given copybook files that ``scan_copybooks`` leaves out, with a reason."""
    _, rejects = decode_sources(spark.read.format("binaryFile").load(files))
    return rejects


def sources_from_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A table of named code texts in the shape of a source scan."""
    name = F.col(id_col).cast("string")
    return df.select(name.alias("path"), name.alias("file_name"), F.col(text_col).alias("content"))


def mark_usable(sources: DataFrame, fmt: str | None = None) -> DataFrame:
    """``_source`` (the row, and its sentences as ``sents``) and ``_ok``: whether the text has a program or data items."""
    usable = F.exists("sents", lambda s: s.rlike(structure.PROGRAM_ID) | (
        s.rlike(structure.ITEM) & s.rlike(r"^((0?1|77)\s+\S|\d+(\s+\S+)+\s+\S)")
    ))
    kept = F.struct(*sources.columns)
    return structure.with_sentences(sources.withColumn("_source", kept), fmt).select(
        F.struct("_source.*", "sents").alias("_source"), F.coalesce(usable, F.lit(False)).alias("_ok")
    )


def split_rejects(sources: DataFrame, fmt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(sources, rejects): texts with a program or data items, and the rest with a reason."""
    return split_marked(mark_usable(sources, fmt), sources.columns)


def split_marked(marked: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(sources, rejects) of marked rows; a job that reads both keeps the marks as a table first."""
    def side(ok: Column) -> DataFrame:
        # rows are chosen by a generator: a filter would be pushed down into the text steps and
        # repeat each of them as often as its result is used
        return marked.select(F.inline_outer(F.when(ok, F.array("_source")))).where(F.col("path").isNotNull())

    rejected = side(~F.col("_ok")).select("path", F.lit("no program and no data items").alias("reason"))
    return side(F.col("_ok")).select(*columns), rejected


def lines(sources: DataFrame, fmt: str | None = None) -> DataFrame:
    """One row per source line with its reference-format areas."""
    st = structure.st
    chosen = st.line_format(F.col("content")) if fmt is None else F.lit(fmt)
    rows = sources.withColumn("_fmt", chosen).select(
        "path", "_fmt", F.posexplode_outer(st.split_lines(F.col("content"))).alias("_i", "raw")
    )
    return rows.where(F.col("_i").isNotNull()).select(
        "path", (F.col("_i") + 1).alias("line_no"), "raw", st.normalize_line(F.col("raw"), F.col("_fmt")).alias("_a")
    ).select("path", "line_no", "raw", "_a.*")
