"""Every column comes back whatever it is called, from every operator that keeps columns."""

import pytest
from pyspark.sql import functions as F

from copperline.llm import chat_format, decontamination, html_extraction, language_id, mixing, secret_scan, simhash, token_counts, registry

NAMES = ["_name", "_rank", "_keep_id", "_bad_id", "_hit_at", "_lid", "_url", "_f", "_steps", "_salt", "Host", "a.b", "in0", "fp", "Copies", "lid"]
TEXT = "the quick brown fox jumps over the lazy dog and then runs far away into the green wood. "


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, TEXT * 8 + f"number {i * 7919}" * 5, "en", "s", *[i * 100 + j for j in range(len(NAMES))]) for i in range(6)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` int" for n in NAMES))


def check(out, added=()):
    lower = {a.lower() for a in added}
    kept = [(j, n) for j, n in enumerate(NAMES) if n.lower() not in lower]
    assert {n for _, n in kept} | {"doc_id"} <= set(out.columns) and len(out.columns) == len({c.lower() for c in out.columns})
    rows = out.collect()
    assert rows
    for r in rows:
        values = dict(zip(out.columns, r))
        assert [values[n] for _, n in kept] == [values["doc_id"] * 100 + j for j, _ in kept]
    return rows


def test_all_columns_come_back(spark, docs, tmp_path):
    bench = spark.createDataFrame([("i", "words that no document has at all but that make a window of thirteen words here")], "item_id string, text string")
    check(mixing.mix(docs, total=60), mixing.ADDED)
    mixing.mix(docs.withColumnRenamed("a.b", "Copy"), total=60).write.parquet(str(tmp_path / "m"))
    check(simhash.keep_one(docs))
    assert len(check(decontamination.remove_documents(docs, bench))) == 6
    check(decontamination.remove_spans(docs, bench))
    model = language_id.Model([], None, None, 1.0)
    check(language_id.predict(docs, model), ("lang_pred", "score"))
    check(token_counts.count_tokens(docs, registry.vocabulary()))
    check(secret_scan.scan(docs))
    check(html_extraction.extract(docs.withColumnRenamed("text", "html").withColumn("Text", F.lit(1))))
    check(chat_format.format_turns(docs.withColumn("role", F.lit("user")).withColumn("parts", chat_format.text_part(F.col("text")))))


def test_unknown_parts_and_sizes_are_defined():
    out = chat_format.format_turn("user", [{"kind": "video", "ref": "v"}, {"kind": "image", "width": -5, "height": 28}, {"kind": "audio", "seconds": -1.0}])
    assert out[0] == "<turn user>\n<other 1><image 2><audio 3>\n</turn>\n"
    assert [a["tokens"] for a in out[3]] == [0, 1, 0] and out[4] == 1
