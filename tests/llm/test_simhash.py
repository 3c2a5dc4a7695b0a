"""Near duplicates against brute force."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from copperline.llm import simhash


def brute_fingerprint(text):
    low = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """doc_id -> smallest reachable doc_id, over (doc_id, fp)."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin((rows[i][1] ^ rows[j][1]) & (1 << 64) - 1).count("1") <= 2:
                parent[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    return {doc: min(docs) for docs in groups.values() for doc in docs}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_equals_brute_force():
    rng = random.Random(3)
    words = ["Ab", "cé", "Été", "x y", "D", "\x1cq"]
    for n in [0, 1, 2, 3, 4, 9, 200]:
        text = rng.choice(["", " "]) + "".join(rng.choice(words) + rng.choice([" ", "\n", "\t\v"]) for _ in range(n))
        assert simhash.fingerprint(text) == signed(brute_fingerprint(text))
    assert simhash.fingerprint(None) == 0
    long = " ".join(str(i) for i in range(70_000))
    assert simhash.fingerprint(long) == signed(brute_fingerprint(long))


@pytest.mark.parametrize("bucket", [2, 32])
def test_components_equal_brute_force(spark, bucket):
    rng = random.Random(bucket)
    fps = set()
    for _ in range(6):  # dense groups, chains and lone fingerprints
        center = rng.getrandbits(64)
        for _ in range(40):
            x = center
            for bit in rng.sample(range(64), rng.choice([0, 1, 2, 3])):
                x ^= 1 << bit
            fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(40)} | {0}
    rows = list(enumerate(sorted(fps, key=lambda _: rng.random())))
    df = spark.createDataFrame([(signed(f),) for _, f in rows], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, bucket=bucket)).collect()}
    expected = brute_components(rows)
    first = {}
    for doc, f in rows:
        key = roots.get(signed(f), signed(f))
        first[key] = min(first.get(key, doc), doc)
    assert {doc: first[roots.get(signed(f), signed(f))] for doc, f in rows} == expected


def test_links_of_three_bits(spark):
    rows = [0, 0b111, 0b1111 << 30, 1 << 63]
    found = simhash.links(spark.createDataFrame([(signed(r),) for r in rows], "fp long"), max_bits=3).collect()
    assert {(r["a"], r["b"]) for r in found} == {(0, 7), (signed(1 << 63), 0)}


def test_nulls_copies_and_keep_one(spark):
    rows = [(3, "A b c d"), (1, "a b c d"), (1, "a b c d"), (None, "a B c d"), (7, None), (5, ""), (9, "other words are here now"),
            (None, "nobody knows this text at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("root", F.lit("mine")).withColumn("_rank", F.lit(1))
    placed = simhash.near_duplicates(docs).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in placed if r["doc_id"] != None or r["component_id"]) == [  # noqa: E711
        (-1, 1), (1, 1), (1, 1), (3, 1), (5, 5), (7, 5), (9, 9)]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 5, 9]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_no_join_sends_rows_through_the_driver(spark, monkeypatch):
    """Rows that grow with the documents are not broadcast: dozens of keys are made of each, and Spark counts them as one."""
    plans, write = [], simhash.materialize

    def recorded(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(simhash, "materialize", recorded)
    # a dense group of one-bit neighbours, copies, and fingerprints alone
    docs = spark.createDataFrame([(i, f"word {i % 90} of some longer text {i % 7}") for i in range(200)], "doc_id long, text string")
    assert simhash.near_duplicates(docs, bucket=2).count() == 200 and len(plans) > 5
    assert not [p for p in plans if "BroadcastExchange" in p]
    group = spark.createDataFrame([(1 << b,) for b in range(40)] + [((1 << 50) + 7 * b,) for b in range(40)], "fp long")
    assert "BroadcastExchange" not in simhash.links(group, bucket=2)._jdf.queryExecution().executedPlan().toString()
