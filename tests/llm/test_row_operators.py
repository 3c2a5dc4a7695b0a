"""Operators that work on each text alone: against brute force, libraries and round trips."""

import random
import re
import time
from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from copperline.llm import chat_format, html_extraction, quality_rules, registry, token_counts

SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def brute_rules(text):
    w = SPACES.findall(text or "")
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    covered = {p for i, x in enumerate(windows) if windows.count(x) > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if SPACES.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_rules_equal_brute_force(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "é", "B#", "|", "x\u00a0y", "\x1c"]) + rng.choice([" ", "\n", "\t", "\v"]) for _ in range(n))
             for n in [0, 1, 2, 3, 5, 40, 40, 300]] + [None, "", "   \n\n", "w " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("mine"))
    rows = {r["doc_id"]: r for r in quality_rules.ledger(docs, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_rules(t), repr(t)
    kept = quality_rules.keep_documents(docs, "base")
    assert kept.columns == docs.columns and kept.where("n_words <> 'mine'").isEmpty()
    good = [i for i, t in enumerate(texts) if (b := brute_rules(t))[0] >= 50 and 100 * b[4] <= 50 * b[0]]
    assert sorted(r["doc_id"] for r in kept.collect()) == good
    assert quality_rules.ledger(docs.limit(0), ["doc_id"]).count() == 0


def test_ablation_counts(spark):
    masks = [0, 1, 3, 3, 4, 5, 64]
    rows = spark.createDataFrame([(m,) for m in masks], "failed long")
    out = {r["rule"]: (r["n_failed"], r["n_only"], r["n_rejected"], r["n_rows"]) for r in quality_rules.ablation(rows, "v1").collect()}
    assert out["few_words"] == (4, 1, 5, 7) and out["many_symbols"] == (2, 1, 5, 7) and out["upper_case"] == (0, 0, 5, 7)


def test_token_counts_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = registry.vocabulary()
    library = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(2)
    alphabet = "aehlt'sTé  \n\t0129.,!?<|>\u00a0\u2003\x1c\x85日🙂"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["a<|endoftext|>b", "<|endoftext|>" * 3, "the " * 3000, "é" * 4000, "x'll 'LL we've", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_bytes", F.lit("mine"))
    rows = token_counts.count_tokens(docs, path).collect()
    for r in rows:
        text = texts[r["doc_id"]] or ""
        expected = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (expected, len(text.encode()), expected > 512), repr(text[:80])


def test_minimum_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(1, 7)
        want = [rng.choice([-2.0, -1.0, -0.4, 0.3, 0.9, 2.5]) for _ in range(n)]
        edges = [(a, b, rng.choice([0.4, 1.2, 3.0])) for a, b in combinations(range(n), 2) if rng.random() < 0.5]

        def cost(keep):
            return sum(-w if k and w < 0 else w if not k and w > 0 else 0 for w, k in zip(want, keep)) + sum(
                c for a, b, c in edges if keep[a] != keep[b])

        got = html_extraction.minimum_cut(want, edges)
        assert cost(got) == pytest.approx(min(map(cost, product([False, True], repeat=n))))


def test_extraction(spark):
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><p>Site name and slogan of the site.</p></header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- <p>no</p> -->
    <div class="ad">Buy this now.</div><article><h1>Title &amp; more</h1><p><b>First
      line <a href="x">with a link</a>.<br><p>Caf&eacute; &lt;b&gt; 1 < 2.</p><p>Be.</p><ul><li>One item</ul>
    <div class="comments"><p>A reader says that this is a long and nice article.</p></div></article>
    <aside><p>Other stories that you may like to read today.</p></aside><form><p>Your mail</p></form><footer>&copy; x"""
    want = "Title & more\nFirst line with a link.\nCafé <b> 1 < 2.\nBe.\nOne item"
    pages = spark.createDataFrame(
        [(1, page), (2, None), (3, ""), (4, "<p>"), (5, "</div></p><p>Some text without any frame stands here, as a sentence of its own."), (6, page)],
        "page_id long, html string").withColumn("text", F.lit("mine"))
    rows = {r["page_id"]: r for r in html_extraction.extract(pages).collect()}
    assert rows[1]["text"] == rows[6]["text"] == want and rows[1]["n_chars"] == len(want)
    assert [rows[i]["text"] for i in (2, 3, 4)] == ["", "", ""]
    assert rows[5]["text"].startswith("Some text without")
    assert html_extraction.main_text("<article>" + "<p>word</p>" * 20_000 + "</article>").count("word") == 20_000


def test_extraction_loses_no_text_of_the_article():
    whole = "One two three four five six seven eight nine ten."
    text = html_extraction.main_text
    assert text(f"<body class='home with-sidebar'><p>{whole}</p></body>") == whole
    assert text(f"<body class='has-comments single-post'><div class='no-sidebar content'><p>{whole}</p></div></body>") == whole
    assert text("<article class='post share'><p>One two three.</p></article>") == "One two three."
    assert text("<article><section class='legal'><p>The law says this.</p></section><figure><figcaption>A caption</figcaption></figure></article>"
                ) == "The law says this.\nA caption"
    # a quote is one only behind an equals sign; one that never ends is read as far as it goes
    assert text("<article><p class=it's>One.</p><p>Two it's.</p><p>Three.</p></article>") == "One.\nTwo it's.\nThree."
    assert text(f'<article><p class="abc>{whole}</p></article>') == whole
    assert text("<article><p title='a > b' data-x=\"<p>\">One.</p></article>") == "One."
    assert text("<article><p>a <math><mi>x</mi></math> b</p><p><object>fallback</object> text</p></article>") == "a x b\nfallback text"
    # and keeps out what does not belong to it
    for name in ("ad", "sidebar-left", "site-footer", "comments", "cookie_notice"):
        assert text(f"<article><p>{whole}</p></article><div class='{name}'><p>{whole}</p></div>") == whole
        assert text(f"<div id={name}><p>{whole}</p></div><article><p>{whole}</p></article>") == whole
    assert text(f"<div class=legal><p>{whole}</p></div><article><p>{whole}</p></article>") == whole
    assert text(f"<article><p style='display: none'>No.</p><p hidden>No.</p><p aria-hidden=true>No.</p><p class=hidden-gem>{whole}</p></article>") == whole


def test_extraction_takes_linear_time():
    rng = random.Random(5)

    def alternating(n):
        return "<body>" + "".join(f"<p>{'word ' * rng.randrange(1, 30)}</p>" if i % 2 else "<p>ab</p>" for i in range(n))

    pages = {
        "blocks": (alternating, 12_500), "equal": (lambda n: "<p>word word word word word word word word</p>" * n, 12_500),
        "levels": (lambda n: "<div>some words " * n, 10_000), "unclosed": (lambda n: "<div><p>x</b></i></zz><span hidden>" * n, 10_000),
        "links": (lambda n: "<a><p>x" * n, 10_000), "quotes": (lambda n: "<p a=\"x' b='y\" c=it's>t" * n, 10_000),
    }
    for kind, (page, n) in pages.items():
        times = []
        for size in (n, 4 * n):
            start = time.process_time()
            html_extraction.main_text(page(size))
            times.append(time.process_time() - start)
        assert times[1] < 10 * times[0] + 0.2, (kind, times)


def test_chat_round_trip():
    rng = random.Random(6)
    for _ in range(2000):
        text = "".join(rng.choice("\\<>/n\nturn a") for _ in range(rng.randrange(20)))
        role = "".join(rng.choice("\\<>\nna") for _ in range(rng.randrange(8)))
        assert chat_format.parse_turn(chat_format.format_turn(role, [{"kind": "text", "text": text}])[0]) == (role, text)


def test_chat_parts_and_digests(spark):
    turns = spark.createDataFrame(
        [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (None, 0, None, "x"), (2, None, "assistant", "<y>")],
        "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("mine"))
    formatted = chat_format.format_turns(turns.withColumn("parts", chat_format.text_part(F.col("text"))))
    rows = {r["conv_id"]: r for r in chat_format.read_back(formatted, ["turn", "role", "text"]).collect()}
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (rows[1]["n_turns"], rows[1]["turns_sha256"], rows[1]["loss_chars"]) == (3, sha("user\n\nassistant\nb\nassistant\nb\n"), 2)
    assert rows[1]["loss_sha256"] == sha("bb") and rows[2]["loss_sha256"] == sha("<y>")
    assert rows[None]["turns_sha256"] == sha("\nx\n") and rows[None]["loss_chars"] == 0
    mixed = [{"kind": "text", "text": "see <image 1>"}, {"kind": "image", "ref": "a.png", "width": 57, "height": 28},
             {"kind": "audio", "ref": "b.wav", "seconds": 1.5}, {"kind": "document", "ref": "c.pdf", "pages": 2}]
    text, start, end, attached, tokens = chat_format.format_turn("assistant", mixed)
    assert text[start:end] == "see \\<image 1\\><image 1><audio 2><document 3>"
    assert [(a["ref"], a["tokens"]) for a in attached] == [("a.png", 3), ("b.wav", 38), ("c.pdf", 1200)] and tokens == 1241
    assert chat_format.read_back(formatted.limit(0), ["turn"]).count() == 0
