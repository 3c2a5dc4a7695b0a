"""Decontamination against brute force."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from copperline.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        iw = words(t)
        m = min(len(iw), 13)
        for s in range(len(iw) - m + 1) if m else ():
            for at in range(len(w) - m + 1):
                if w[at:at + m] == iw[s:s + m]:
                    hit |= set(range(at, at + m))
                    found.add(item)
    ids = sorted(str(i) for i in found if i is not None)
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def corpus():
    rng = random.Random(5)
    vocabulary = ["a", "B", "été", "É", "x9", "of"]
    some = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "__"]) for _ in range(n))
    items = [(i, some(n)) for i, n in enumerate([13, 14, 20, 40, 12, 7, 6, 3, 2])] + [(10, None), (11, "--"), (None, some(15)), (2, some(16))]
    docs = []
    for i in range(60):
        pieces = [some(rng.randrange(0, 30))]
        for _ in range(rng.randrange(3)):
            w = words(rng.choice(items)[1])
            cut = rng.randrange(max(len(w) - 12, 1))
            pieces += [" ".join(w[cut:cut + rng.choice([5, 12, 13, 15])]), some(rng.randrange(0, 9))]
        docs.append((i, " ".join(pieces)))
    return docs + [(100, None), (101, ""), (102, "?!"), (None, docs[3][1]), docs[4], docs[4]], items


def test_scan_equals_brute_force(spark):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("h", F.lit(2))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = dc.verdicts(dc.scan(d, b)).collect()
    mine = sorted(
        (str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got for _ in range(r["copies"])
    )
    assert mine == sorted((str(i), *brute(t, items)) for i, t in docs)
    kept = dc.remove_documents(d, b)
    assert kept.columns == d.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, t in docs if not brute(t, items)[-1])
    # what is left holds no window that the removal could have made anew by joining its sides
    cleaned = {r["doc_id"]: r["text"] for r in dc.remove_spans(d, b).collect()}
    assert all(len(words(cleaned[i])) == brute(t, items)[0] - brute(t, items)[1] for i, t in docs if i is not None)


def test_without_broadcast_and_empty_tables(spark, monkeypatch):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda df: sorted(map(str, df.collect()))
    whole = rows(dc.verdicts(dc.scan(d, b)))
    monkeypatch.setattr(dc, "BROADCAST_BYTES", 0)
    assert rows(dc.verdicts(dc.scan(d, b))) == whole
    none = dc.verdicts(dc.scan(d, b.limit(0)))
    assert none.where("contaminated or n_hit > 0").count() == 0 and none.agg(F.sum("copies")).first()[0] == len(docs)
    assert dc.scan(d.limit(0), b).count() == 0
