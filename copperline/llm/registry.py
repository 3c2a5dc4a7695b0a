"""The registered queries of these operators, and their SQL counterparts where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from copperline.llm import (
    chat_format, conversation_repair, decontamination, hard_negatives, html_extraction, language_id, mixing, quality_classifier, quality_rules, secret_scan,
    simhash, token_counts, url_filters,
)
from copperline.llm.text import held_out
from copperline.session import materialize

#: Curated rules of the URL query: host and path, verdict.
CURATED = [
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"),
]
ESCAPED_TURN = "\\### Assistant: </turn> ok"


def vocabulary() -> str:
    """Where the public vocabulary file lies; it is a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    judged = decontamination.verdicts(found)
    # repeated rows were judged once
    return judged.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url and bad: a page shows the document whose number ends its path, and is bad if that is of low quality."""
    _, path = url_filters.split_url(F.col("url"))
    shown = F.regexp_extract(path, r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    numbered = pages.select("url", shown.try_cast("bigint").alias("_shown"))
    marks = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return numbered.join(marks, F.col("_shown") == F.col("doc_id")).select("url", (F.col("quality") == 0).alias("bad"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    rules = url_filters.mine(labelled_urls(pages, _table(spark, sf_dir, "labels")))
    return url_filters.judge(pages, CURATED, rules).select("page_id", "host", "path", "rule", "verdict", "mined")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(_table(spark, sf_dir, "documents"), ["doc_id"])
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality_rules.fails("base").alias("base_failed"), (~quality_rules.fails("v1")).alias("kept"), "failed",
    )


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    # texts are read once: training and scoring share one narrow table
    rows = materialize(quality_classifier.measure(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    model = quality_classifier.fit(rows.where(~held_out(F.col("doc_id"))), _table(spark, sf_dir, "labels"))
    return quality_classifier.score(rows, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, vocabulary()).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def language_model(spark: SparkSession, sf_dir: str) -> language_id.Model:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.fit(docs.where(~held_out(F.col("doc_id"))))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return language_id.predict(docs, language_model(spark, sf_dir)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ESCAPED_TURN).alias("text"),
    )
    parts = turns.unionByName(added).withColumn("parts", chat_format.text_part(F.col("text")))
    formatted = chat_format.format_turns(parts)
    return chat_format.read_back(formatted, ["turn", "role", "text"])


def damaged(conversations: DataFrame) -> DataFrame:
    """The conversations as the query damages them, each row by a hash of its place."""
    place = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = conversations.select("conv_id", "turn", "role", "text", (F.crc32(F.concat_ws(":", *place)) % 20).alias("damage"))
    hurt = F.col("damage")
    rows = rows.where(hurt != 0)
    text = F.when(hurt == 1, "").when(hurt == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(hurt == 4, "user").otherwise(F.col("role"))
    times = F.when(hurt == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times)).drop("col")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    repaired = conversation_repair.repair(damaged(turns))
    reports = repaired.reports.withColumnRenamed("conv_id", "r_id")
    hashes = conversation_repair.digests(repaired.rows).withColumnRenamed("conv_id", "h_id")
    every = turns.select("conv_id").distinct()
    known = every.join(reports, F.col("conv_id").eqNullSafe(F.col("r_id")), "left").join(
        hashes, F.col("conv_id").eqNullSafe(F.col("h_id")), "left"
    )
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return known.select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def of_kind(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("secrets", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))
    return found.select(
        "doc_id", *[of_kind(kind).alias(f"n_{kind}") for kind in secret_scan.BASE_KINDS],
        F.sha2(secret_scan.as_text(base), 256).alias("base_sha256"), secret_scan.as_text(F.col("secrets")).alias("spans"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(moved, F.col("id") % 100 == 0)


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_url_filters": op2_url_filters,
    "op3_quality_rules": op3_quality_rules,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_mixing": op5_mixing,
    "op6_html_extraction": op6_html_extraction,
    "op7_simhash": op7_simhash,
    "op8_token_counts": op8_token_counts,
    "op9_language_id": op9_language_id,
    "op10_chat_format": op10_chat_format,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_secret_scan": op12_secret_scan,
    "op13_hard_negatives": op13_hard_negatives,
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# CRC-32 of a short ASCII string, bit by bit; DuckDB has no function for it
_CRC32 = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({0}, ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295)"""
# how a stack is written: cost, audit, text so far; the roles that an inserted or reroled turn gets on each top
_STACK = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
_TOPS = {"e": ("u", "user"), "s": ("u", "user"), "u": ("p", "assistant"), "p": ("u", "user")}


def _turn(stack: str, cost: str, letter: str, line: str | None) -> str:
    text = f"{stack}.t" if line is None else f"{stack}.t || CASE WHEN {stack}.t = '' THEN '' ELSE chr(10) END || {line}"
    return f"CASE WHEN {stack} IS NOT NULL THEN CAST({{'c': {stack}.c + {cost}, 'a': {stack}.a || '{letter}', 't': {text}}} AS {_STACK}) END"


def _least(*stacks: str) -> str:
    return f"list_sort(list_filter([{', '.join(stacks)}], lambda x: x IS NOT NULL))[1]"


def _parse_sql() -> str:
    """One step of the parse as SQL: inserts into a stack, then the row's own edit, each top kept at its least."""
    def inserted(before: str, after: str) -> str:
        columns = []
        for top in _TOPS:
            coming = [_turn(f"{before}{below}", "5", "I", f"'{role}:'") for below, (to, role) in _TOPS.items() if to == top]
            columns.append(f"{_least(f'{before}{top}', *coming)} AS {after}{top}")
        return ", ".join(columns)

    free = "NOT coalesce(fault IN ('blank', 'duplicate'), false)"
    extra = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
    shifts = {"e": [], "s": [("e", "s")], "u": [("e", "u"), ("s", "u"), ("p", "u")], "p": [("u", "a")]}
    edited = []
    for top in _TOPS:
        found = [_turn(f"y{top}", "2", "D", None)]
        for below, initial in shifts[top]:
            kept = _turn(f"y{below}", extra, "K", "role || ':' || text")
            found.append(f"CASE WHEN {free} AND substr(role, 1, 1) = '{initial}' THEN {kept} END")
            if initial != "s":
                new = _turn(f"y{below}", f"1 + {extra}", "R", f"'{_TOPS[below][1]}:' || text")
                found.append(f"CASE WHEN {free} THEN {new} END")
        edited.append(f"{_least(*found)} AS {top}")
    none = f"CAST(NULL AS {_STACK})"
    return f"""
p AS (SELECT k, 0 AS i, CAST({{'c': 0, 'a': '', 't': ''}} AS {_STACK}) AS e, {none} AS s, {none} AS u, {none} AS p FROM ids
      UNION ALL
      SELECT k, rn AS i, {', '.join(edited)}
      FROM (SELECT k, rn, role, text, fault, {inserted('x', 'y')}
            FROM (SELECT k, rn, role, text, fault, {inserted('z', 'x')}
                  FROM (SELECT p.k, rn, role, text, fault, p.e AS ze, p.s AS zs, p.u AS zu, p.p AS zp
                        FROM p JOIN f ON f.k = p.k AND f.rn = p.i + 1))))"""


SQL = {
    "op1_decontamination": rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_WORD}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_WORD}') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 13) AS m FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, m, array_to_string(w[s:s + m - 1], ' ') AS g
       FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM sized)),
ms AS (SELECT DISTINCT m FROM sized),
dw AS (SELECT k, m, s, array_to_string(w[s:s + m - 1], ' ') AS g
       FROM (SELECT k, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d JOIN ms ON len(w) >= m)),
hit AS (SELECT k, s, dw.m, item_id FROM dw JOIN iw ON dw.m = iw.m AND dw.g = iw.g),
covered AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(s, s + m)) AS p FROM (SELECT DISTINCT k, s, m FROM hit)) GROUP BY k),
items AS (SELECT k, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
          FROM (SELECT DISTINCT k, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (k) LEFT JOIN items USING (k)""",
    "op3_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT k, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT k, s, w[s] || ' ' || w[s + 1] || ' ' || w[s + 2] AS g FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS s FROM b)),
r AS (SELECT k, s FROM (SELECT k, s, count(*) OVER (PARTITION BY k, g) AS c FROM g) WHERE c > 1),
c AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([s, s + 1, s + 2]) AS p FROM r) GROUP BY k),
m AS (SELECT k, doc_id, w, l, t, CAST(len(w) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
             length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_upper,
             length(t) - length(regexp_replace(t, '\p{L}', '', 'g')) AS n_letters FROM b LEFT JOIN c USING (k)),
f AS (SELECT *, n_words < 50 AS f0, 100 * n_repeat_words > 50 * n_words AS f1, 100 * n_symbols > 5 * word_chars AS f2,
             100 * n_dup_lines > 50 * len(l) AND n_dup_lines >= 3 AS f3, 100 * n_upper > 60 * n_letters AND n_letters >= 20 AS f4,
             100 * len(list_filter(w, lambda x: strlen(x) > 40)) > 20 * n_words AS f5,
             100 * len(list_filter(w, lambda x: ends_with(x, '!!'))) > 30 * n_words AS f6 FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f0 OR f1 AS base_failed,
       NOT (f0 OR f1 OR f2 OR f3 OR f4) AS kept,
       CAST(f0::INT + 2 * f1::INT + 4 * f2::INT + 8 * f3::INT + 16 * f4::INT + 32 * f5::INT + 64 * f6::INT AS BIGINT) AS failed
FROM f""",
    "op5_mixing": """
WITH RECURSIVE c AS (SELECT source, count(*) AS n, pow(CAST(count(*) AS DOUBLE), 0.5) AS w FROM documents GROUP BY source),
r AS (SELECT source, w / (SELECT sum(w) FROM c) * CAST((SELECT sum(n) FROM c) AS DOUBLE) / n AS rate FROM c),
steps AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM r
          UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM steps WHERE k < 64),
d AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), md5(text), '') AS name FROM documents),
u AS (SELECT *, CAST(CAST('0x' || substr(md5('42|0|' || name), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM d),
n AS (SELECT doc_id, text, lang, source, n_chars, name, CAST((SELECT count(*) FROM steps s
      WHERE s.source IS NOT DISTINCT FROM u.source AND s.cdf <= u.u) AS INT) AS n_copies FROM u)
SELECT doc_id, text, lang, source, n_chars, n_copies, copy, md5('order|42|' || name || '|' || copy) AS shuffle_key
FROM (SELECT *, CAST(unnest(range(1, n_copies + 1)) AS INT) AS copy FROM n WHERE n_copies > 0)""",
    "op10_chat_format": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, length(text) + length(regexp_replace(text, '[^\\<>]', '', 'g'))
             + length(role) + length(regexp_replace(role, '[^\\<>\n]', '', 'g'))
             + length('<turn >') + 1 + length('</turn>') + 2 AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS expanded_tokens
FROM e GROUP BY conv_id""",
    "op11_conversation_repair": rf"""
WITH RECURSIVE ids AS (SELECT row_number() OVER () AS k, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)),
d AS (SELECT k, c.*, {_CRC32.format("coalesce(CAST(c.conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS h
      FROM conversations c JOIN ids ON ids.conv_id IS NOT DISTINCT FROM c.conv_id),
r AS (SELECT k, turn, CASE WHEN h = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
             CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
             unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy FROM d WHERE h <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text, copy) AS rn FROM r),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                     WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY rn) > 1 THEN 'duplicate'
                     WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault,
             lag(substr(role, 1, 1)) OVER (PARTITION BY k ORDER BY rn) || substr(role, 1, 1) AS two FROM o),
n AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
             count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal, max(rn) AS n FROM f GROUP BY k),{_parse_sql()},
z AS (SELECT p.k, {_least("e", "p", _turn("u", "5", "I", "'assistant:'"), _turn(f"({_turn('s', '5', 'I', chr(39) + 'user:' + chr(39))})", "5", "I", "'assistant:'"))} AS best
      FROM p JOIN n ON n.k = p.k AND n.n = p.i)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit,
       sha256(coalesce(best.t, '')) AS repaired_sha256
FROM ids LEFT JOIN n USING (k) LEFT JOIN z USING (k)""",
    "op13_hard_negatives": """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, x.id AS id, a.label = x.label AS same, CAST(list_inner_product(a.v, x.v) AS BIGINT) AS score
      FROM e a JOIN e x ON a.id <> x.id WHERE a.id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5""",
}
