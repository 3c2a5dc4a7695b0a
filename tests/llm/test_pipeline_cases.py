"""Every pipeline stage on rows with nulls, repeats, very long texts and odd columns, and on no rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from copperline.llm import mixing

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, _rank int, _keep_id int, `a.b` string, Score int"


@pytest.fixture(scope="module")
def clean(spark):
    """Clean English texts of the given table and a benchmark passage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").orderBy("doc_id")
    kept = corpus_pipeline.near_duplicates(spark, corpus_pipeline.quality(spark, docs, SF), SF).orderBy("doc_id").limit(6).collect()
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").where("size(split(text, ' ')) >= 20").orderBy("item_id").first()["text"]
    return [r["text"] for r in kept], passage


@pytest.fixture(scope="module")
def rows(clean):
    texts, passage = clean
    odd = lambda i, t, lang="en", source="s": (i, t, lang, source, None, 7, 8, f"v{i}", 9)
    return [
        odd(1, texts[0]), odd(1, texts[0]), odd(2, texts[1], None, None), odd(None, texts[2]), odd(4, None), odd(5, None), odd(6, ""),
        odd(7, "1234 ?! " * 100), odd(8, texts[3] + " " + passage), odd(9, " ".join(texts[4] for _ in range(300))), odd(10, texts[0]),
    ]


def ids(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.collect())


def same(*wanted):
    return sorted((i is None, i or 0) for i in wanted)


def test_each_stage_on_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    out = {name: stage(spark, docs, SF) for name, stage in stages.items()}
    for name, df in out.items():
        added = list(mixing.ADDED) if name == "source_mixing" else []
        assert df.columns == docs.columns + added, name
        assert df.where("_rank <> 7 or _keep_id <> 8 or Score <> 9 or `a.b` <> concat('v', coalesce(cast(doc_id as string), 'None'))").isEmpty(), name
    assert not set(ids(out["quality_rules"])) & set(same(4, 5, 6))
    assert set(ids(out["quality_rules"])) >= set(same(1, 2, None))
    assert ids(out["language_id"]) == same(1, 1, 2, None, 8, 9, 10)
    # texts without words are one component; the two copies of one row and their copy under another id are one
    kept = ids(out["simhash_near_dedup"])
    assert kept.count((False, 1)) == 1 and (False, 10) not in kept and len(set(kept) & set(same(4, 5, 6))) == 1
    assert set(kept) >= set(same(1, 2, None, 9))
    found = ids(out["benchmark_decontamination"])
    assert (False, 8) not in found and found == same(1, 1, 2, None, 4, 5, 6, 7, 9, 10)
    # repeated rows get equal numbers of copies
    copies = out["source_mixing"].where("doc_id = 1").groupBy("copy").count().collect()
    assert all(r["count"] == 2 for r in copies)


def test_each_stage_on_no_rows(spark, rows):
    empty = spark.createDataFrame(rows, SCHEMA).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


def test_stages_together_reject_what_each_rejects(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert set(ids(docs)) <= set(same(1, 2, None, 9)) and len(ids(docs)) == len(set(ids(docs)))
    assert set(ids(docs)) >= set(same(1, 2, None))
