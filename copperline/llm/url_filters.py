"""URL filters from association rules, without Python.

URLs become sets of tokens: host labels, registered domain, path segments, query names. Tokens that the very same
labelled URLs hold are one item with several names. Spark's FP-growth mines the combinations of items that go with bad
labels; rules that are too rare, too uncertain or no better than a shorter rule are pruned. All thresholds are
relative to the labelled rows: support as a share, confidence as a gain over the share of bad URLs, and a lower
confidence bound that a handful of rows cannot reach. A rule is listed in an inverted index under its rarest item only;
a URL looks up its tokens and the whole combination is checked in the row. Curated host and path rules go
first: of those that fit the longest wins.

Defined cases: a null URL or one without ``://`` has an empty host, an empty path and no tokens, fits
no rule and is allowed; without labels or mined rules all other URLs are allowed too; an empty table gives an empty
table; long URLs are read whole; of rules that fit with equal confidence the one with the greatest items in order is
named; repeated rows are judged alike and all stay; other columns are kept, and of columns named like the added
ones (in any case) the added ones win.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from copperline.llm.text import lower_ascii
from copperline.session import materialize

#: Share of the labelled URLs that a rule needs.
MIN_SUPPORT = 0.002
#: Of the way from the share of bad URLs to certainty, how much a rule must go.
MIN_GAIN = 0.5
#: The share of bad URLs times this must lie below the rule's confidence, and below its lower bound at so many deviations:
#: many combinations are tried, and few rows must not make a rule.
MIN_LIFT, DEVIATIONS = 1.5, 5.0
BAD = "=bad"
ADDED = ("host", "path", "rule", "verdict", "mined")
MINED = "antecedent array<string>, members array<array<string>>, rarest int, confidence double, support double, lift double"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host in lower case, path) of a URL; both empty if it has no scheme."""
    known = F.coalesce(url, F.lit(""))
    at = F.instr(known, "://")
    rest = F.when(at > 0, F.substring(known, at + 3, F.length(known))).otherwise("")
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL."""
    host, path = split_url(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    domain = F.when(F.size(labels) >= 2, F.array(F.concat_ws(".", F.slice(labels, -2, 2))))
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    query = F.regexp_extract_all(F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), 1)

    def tagged(name: str, values: Column) -> Column:
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.concat(F.lit(name), v))

    return F.array_distinct(F.concat(
        tagged("h:", labels), tagged("d:", domain), tagged("p:", segments), tagged("q:", query)
    ))


def merged_tokens(rows: DataFrame, least: int) -> DataFrame:
    """token, item, n: tokens of at least so many rows (id, items), where those that the same rows hold share one item.

    Two tokens are the same if count, sum and exclusive or of a hash over their rows are; the item is the least token.
    """
    held = rows.select("id", F.explode("items").alias("token"))
    alike = held.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.hash("id").cast("long")).alias("s")
    ).where(F.col("n") >= least)
    groups = alike.groupBy("n", "x", "s").agg(F.sort_array(F.collect_list("token")).alias("names"))
    return groups.select(F.explode("names").alias("token"), F.get("names", F.lit(0)).alias("item"), "n")


def mine(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_gain: float = MIN_GAIN, min_lift: float = MIN_LIFT,
    deviations: float = DEVIATIONS, url_col: str = "url", bad_col: str = "bad",
) -> DataFrame:
    """Rules for bad URLs from rows with a boolean label: the columns of ``MINED``.

    ``members`` has the tokens of each item of ``antecedent``; any of them stands for it. ``rarest`` is the place of
    the item that the fewest labelled URLs hold.
    """
    spark = labelled.sparkSession
    rows = materialize(labelled.where(F.col(bad_col).isNotNull()).select(
        F.monotonically_increasing_id().alias("id"), tokens(F.col(url_col)).alias("items"), F.col(bad_col).alias("bad")
    ))
    counted = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("bad"), 1)).alias("bad")).first()
    total, base = counted["n"], counted["bad"] / max(counted["n"], 1)
    if not counted["bad"]:
        return spark.createDataFrame([], MINED)
    items = materialize(merged_tokens(rows, math.ceil(min_support * total)))
    found = rows.select("id", "bad", F.explode("items").alias("token")).join(items, "token").groupBy("id", "bad").agg(
        F.collect_set("item").alias("items")
    )
    # URLs without a frequent token count in the shares too
    baskets = rows.select("id", "bad").join(found.select("id", "items"), "id", "left").select(F.coalesce("items", F.array().cast("array<string>")).alias("items"), "bad")
    baskets = materialize(baskets.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items")))
    needed = max(base + min_gain * (1 - base), min(1.0, min_lift * base))
    # rules of one consequent: their confidence is over all URLs with the combination
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=needed).fit(baskets)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD))).select(
        F.array_sort("antecedent").alias("antecedent"), "confidence", "support", "lift"
    )
    bound = lower_bound(F.col("confidence"), F.col("support") * total / F.col("confidence"), deviations)
    kept = prune(rules.where(bound >= min(min_lift * base, 1 - (1 - base) / 2)))
    named = items.groupBy(F.col("item").alias("_item")).agg(F.sort_array(F.collect_list("token")).alias("names"), F.max("n").alias("held"))
    spread = kept.select("antecedent", F.posexplode("antecedent").alias("place", "_item")).join(named, "_item")
    parts = spread.groupBy("antecedent").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "names"))), lambda p: p["names"]).alias("members"),
        F.min(F.struct("held", "place"))["place"].alias("rarest"),
    )
    return kept.join(parts, "antecedent").select("antecedent", "members", "rarest", "confidence", "support", "lift")


def lower_bound(share: Column, n: Column, deviations: float) -> Column:
    """Lower end of the score interval of a share seen in n rows."""
    z2 = deviations * deviations
    centre = share + z2 / (2 * n)
    width = deviations * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))
    return (centre - width) / (1 + z2 / n)


def prune(rules: DataFrame) -> DataFrame:
    """Rules without those that a rule with one token less beats or equals in confidence."""
    shorter = rules.select("antecedent", "confidence", "support", "lift", F.explode(F.transform(
        "antecedent", lambda t: F.array_sort(F.array_remove(F.col("antecedent"), t))
    )).alias("part"))
    known = rules.select(F.col("antecedent").alias("part"), F.col("confidence").alias("c"))
    beaten = shorter.join(known, "part").where(F.col("c") >= F.col("confidence")).select("antecedent").distinct()
    return rules.join(beaten, "antecedent", "left_anti")


def blocked(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """Distinct URLs that a mined rule fits, with the best confidence: url, mined (the rule's items), confidence."""
    rows = urls.select(F.col(url_col).alias("url")).where(F.col(url_col).isNotNull()).distinct()
    index = rules.select("antecedent", "members", "confidence", F.explode(F.get("members", F.col("rarest"))).alias("t"))
    found = rows.select("url", tokens(F.col("url")).alias("items")).withColumn("t", F.explode("items")).join(index, "t")
    fits = found.where(F.forall("members", lambda names: F.arrays_overlap(names, "items")))
    best = fits.groupBy("url").agg(F.max(F.struct("confidence", "antecedent")).alias("best"))
    return best.select("url", F.concat_ws(" ", "best.antecedent").alias("mined"), F.col("best.confidence").alias("confidence"))


def curated_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest fitting rule ``host/path``; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at = name.index("/")
        fits = ((host == name[:at]) | host.endswith("." + name[:at])) & path.startswith(name[at:])
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, curated: list[tuple[str, str]], rules: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, mined and verdict (allow or block)."""
    place = pages.columns.index(url_col)
    inner = pages.toDF(*[f"in{i}" for i in range(len(pages.columns))])
    url = f"in{place}"
    hits = blocked(inner, rules, url_col=url).select(F.col("url").alias("hit_url"), "mined")
    host, path = split_url(F.col(url))
    # a null URL fits nothing: such rows get keys of their own and do not meet in one task
    inner = inner.withColumn("key", F.coalesce(url, F.concat(F.lit("null "), F.monotonically_increasing_id().cast("string"))))
    joined = inner.join(hits, F.col("key") == F.col("hit_url"), "left").withColumn("host", host).withColumn("path", path)
    rule, verdict = curated_rule(F.col("host"), F.col("path"), curated)
    by_method = F.when(F.col("mined").isNotNull(), "block").otherwise("allow")
    kept = [i for i, n in enumerate(pages.columns) if n.lower() not in ADDED]
    return joined.select(
        *[f"in{i}" for i in kept], "host", "path", rule.alias("rule"), "mined", F.coalesce(verdict, by_method).alias("verdict")
    ).toDF(*[pages.columns[i] for i in kept], "host", "path", "rule", "mined", "verdict")
