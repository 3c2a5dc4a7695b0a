"""Learnt operators by held-out accuracy, mixing by its distribution, the pipeline stage by stage."""

import glob
import math
import random
import time
from itertools import combinations, product

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from copperline.llm import language_id, mixing, quality_classifier, registry, simhash, url_filters
from copperline.llm.text import held_out

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {path.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    mine = sorted((tuple(str(r[c]) for c in columns) for r in got.collect()), key=str)
    table = duck.execute(registry.SQL[name])
    names = [d[0] for d in table.description]
    assert sorted(names) == columns
    assert mine == sorted((tuple(str(row[names.index(c)]) for c in columns) for row in table.fetchall()), key=str)


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.where(~held_out(F.col("doc_id"))))
    judged = language_id.predict(docs.withColumn("score", F.lit("mine")), model)
    hits = judged.where(held_out(F.col("doc_id"))).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert hits[0] >= 0.97 and 0 <= hits[1] <= hits[2] <= 1
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !? 3"), (4, "the and of " * 40_000)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in language_id.predict(odd, model).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and rows[4]["lang_pred"] != "und"
    empty = language_id.fit(docs.limit(0))
    assert language_id.predict(odd, empty).where("lang_pred <> 'und' or score <> 0").isEmpty()


def test_quality_on_held_out_rows(spark):
    docs = quality_classifier.measure(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality_classifier.fit(docs.where(~held_out(F.col("doc_id"))), labels)
    judged = quality_classifier.score(docs, model).where(held_out(F.col("doc_id"))).join(labels, "doc_id")
    right = judged.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right >= 0.9
    none = quality_classifier.fit(docs, labels.limit(0))
    odd = quality_classifier.measure(spark.createDataFrame([(1, None), (2, ""), (3, "x " * 100_000)], "doc_id long, text string"))
    assert {r["score"] for r in quality_classifier.score(odd, none).collect()} == {0.5}
    assert quality_classifier.score(odd, model).where("score between 0 and 1").count() == 3


def test_mixing_meets_targets(spark):
    docs = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 3 == 1, None).otherwise("s").alias("source"),
        F.lit(9).alias("copy"))
    mixed = mixing.mix(docs, {"big": 1.0, None: 3.0}, total=20_000)
    counts = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert set(counts) == {"big", None}
    assert abs(counts["big"] - 5_000) < 5 * math.sqrt(5_000) and abs(counts[None] - 15_000) < 5 * math.sqrt(15_000)
    large = mixing.mix(docs.limit(300), {"big": 1.0, None: 1.0, "s": 1.0}, total=300 * 40)
    assert abs(large.count() - 12_000) < 5 * math.sqrt(12_000)  # means over PART are summed
    assert mixing.mix(docs.limit(0)).count() == 0
    zero = spark.createDataFrame([(None, None, None), (None, None, None)], "doc_id long, text string, source string")
    assert mixing.mix(zero, {None: 1.0}, total=20).count() % 2 == 0


def test_url_rules(spark):
    rng = random.Random(8)
    rows = [(f"https://{rng.choice(['www', 'm'])}.{h}.org/{p}/{i}", h == "spam" and p == "win")
            for i in range(400) for h, p in [(rng.choice(["spam", "fine"]), rng.choice(["win", "news"]))]]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    rules = url_filters.mine(labelled, min_support=0.05)
    # the domain and its label are held by the same URLs: one item with two names
    assert [(r["antecedent"], r["members"], r["confidence"]) for r in rules.collect()] == [
        (["d:spam.org", "p:win"], [["d:spam.org", "h:spam"], ["p:win"]], 1.0)]
    pages = spark.createDataFrame(
        [(1, "https://x.spam.org/win/9"), (2, "https://x.spam.org/news/9"), (3, None), (4, "nothing"), (5, "http://WWW.a.example.com/en/?q=1#x"),
         (6, "http://b.example.com/en/"), (7, "http://b.example.com/fr/"), (8, "http://q.net/es/1"), (9, "http://notexample.com/en/"), (1, "https://x.spam.org/win/9")],
        "page_id long, url string").withColumn("host", F.lit("mine"))
    judged = url_filters.judge(pages, registry.CURATED, rules).collect()
    assert len(judged) == 10
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judged}
    assert got[1] == ("x.spam.org", "/win/9", None, "block") and got[2][3] == "allow"
    assert got[3] == got[4] == ("", "", None, "allow")
    assert got[5] == ("www.a.example.com", "/en/", "example.com/en/", "block")
    assert got[6][2:] == ("example.com/en/", "block") and got[7][2:] == ("com/", "allow")
    assert got[8][2:] == ("net/es/", "block") and got[9][2:] == ("com/", "allow")
    empty = url_filters.mine(labelled.limit(0))
    assert url_filters.judge(pages, [], empty).where("verdict = 'block'").isEmpty()


def rules_by_all_subsets(rows, support, gain, lift, deviations):
    """{tokens: confidence} of the rules, from every combination of tokens."""
    total, base = len(rows), sum(bad for _, bad in rows) / len(rows)
    sets = {s for items, _ in rows for n in range(1, len(items) + 1) for s in combinations(sorted(items), n)}
    found = {}
    for s in sets:
        held = [bad for items, bad in rows if set(s) <= items]
        share = sum(held) / len(held)
        z2, n = deviations ** 2, len(held)
        low = (share + z2 / (2 * n) - deviations * math.sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)
        if sum(held) >= support * total and share >= max(base + gain * (1 - base), lift * base) and low >= lift * base:
            found[s] = share
    return {s: c for s, c in found.items() if not any(found.get(tuple(x for x in s if x != t), -1) >= c for t in s)}


def test_url_rules_equal_all_subsets(spark):
    rng = random.Random(12)
    words = ["win", "news", "en", "pills"]
    urls = [f"http://{rng.choice(['a', 'b'])}.{rng.choice(['spam', 'fine', 'pills'])}.org/{'/'.join(rng.choice(words) for _ in range(rng.randrange(5)))}?{rng.choice(['q=1', 'id=2'])}"
            for _ in range(500)]
    rows = [(u, rng.random() < (0.9 if "spam" in u and "/win" in u else 0.8 if "pills.org" in u and "/en" in u else 0.05)) for u in urls]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    tokened = labelled.select("url", url_filters.tokens(F.col("url")).alias("t")).collect()
    items = {r["url"]: frozenset(r["t"]) for r in tokened}
    # segments of any depth are tokens
    assert max(sum(t.startswith("p:") for t in x) for x in items.values()) == 4
    expected = rules_by_all_subsets([(items[u], bad) for u, bad in rows], 0.02, 0.5, 1.5, 5.0)
    rules = url_filters.mine(labelled, min_support=0.02).collect()
    expanded = {tuple(sorted(x)): r["confidence"] for r in rules for x in product(*r["members"])}
    assert len(expected) > 3 and expanded == pytest.approx(expected)
    found = {r["url"] for r in url_filters.blocked(labelled, spark.createDataFrame(rules, url_filters.MINED)).collect()}
    assert found == {u for u in urls if any(set(s) <= items[u] for s in expected)}
    # with labels that say nothing no rule is found
    noise = spark.createDataFrame([(u, rng.random() < 0.15) for u in urls], "url string, bad boolean")
    assert url_filters.mine(noise).isEmpty()


def test_tokens_of_one_deep_host_are_one_item(spark):
    deep = ".".join(f"l{i}" for i in range(30))
    rows = [(f"http://{deep}.spam.org/{i}", True) for i in range(40)] + [(f"http://www.fine.org/{i}", False) for i in range(200)]
    start = time.monotonic()
    rules = url_filters.mine(spark.createDataFrame(rows, "url string, bad boolean")).collect()
    assert time.monotonic() - start < 60
    assert len(rules) == 1 and len(rules[0]["members"][0]) == 32


def test_url_columns_with_clashing_names_come_back(spark):
    rows = spark.createDataFrame([(1, "http://q.net/es/1", "mine", "x", 2)], "page_id long, `u.rl` string, Host string, key string, `hit_url` int")
    out = url_filters.judge(rows, registry.CURATED, spark.createDataFrame([], url_filters.MINED), url_col="u.rl")
    assert out.columns == ["page_id", "u.rl", "key", "hit_url", "host", "path", "rule", "mined", "verdict"]
    row = out.first().asDict()
    assert (row["key"], row["hit_url"], row["host"], row["verdict"]) == ("x", 2, "q.net", "block")


def test_language_bar_comes_from_the_calibration_rows():
    model = language_id.Model(["a"], None, None, 1.0, np.arange(1000) / 1000)
    assert model.score_reached_by(0.995) == 0.005 and model.score_reached_by(1.0) == 0.0
    assert language_id.Model([], None, None, 1.0).score_reached_by(0.9) == 0.0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF).cache()
        sizes.append((name, before.count(), docs.count()))
        if name != "source_mixing":
            assert docs.columns == columns
            assert docs.select("doc_id", "text").exceptAll(before.select("doc_id", "text")).isEmpty()
        if name == "simhash_near_dedup":
            assert simhash.near_duplicates(docs).groupBy("root").count().where("count > 1").isEmpty()
    assert docs.columns == [*columns, "n_copies", "copy", "shuffle_key"]
    assert all(after <= n for name, n, after in sizes[:-1]) and sizes[-1][2] > 0


def test_language_model_learns_from_every_row(spark, monkeypatch):
    """No row is left out, however many there are: each is counted, and learnt from or held for calibration."""
    monkeypatch.setattr(language_id, "SHARD_ROWS", 5)
    monkeypatch.setattr(language_id, "REACHED", 10)
    texts = [(i, f"alpha beta {'x' * (i % 5 + 1)} gamma", "aa") if i % 2 else (i, f"unda dwa {'z' * (i % 5 + 1)} trzy", "bb") for i in range(600)]
    stored, materialize = [], language_id.materialize

    def seen(df):
        stored.append(materialize(df))
        return stored[-1]

    monkeypatch.setattr(language_id, "materialize", seen)
    model = language_id.fit(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    rows = stored[0]
    assert rows.count() == 600 and {r[0] for r in rows.select("part").distinct().collect()} == set(range(language_id.ROUNDS))
    assert rows.select("shard", "sub").distinct().count() > language_id.SHARDS + 1
    # the bars are those of all calibration rows in order
    scores = np.sort([r["score"] for r in stored[2].collect()])
    assert len(scores) > 50 and list(model.reached) == [scores[j * len(scores) // 10] for j in range(10)]
    assert model.predict("alpha gamma")[0] == "aa" and model.predict("dwa trzy")[0] == "bb"


def test_packed_grams_come_back():
    at, n = language_id.grams("Some text, some more text")
    back = language_id.unpack(language_id.pack(at, n))
    assert back[0].tolist() == at.tolist() and back[1].tolist() == n.tolist()
