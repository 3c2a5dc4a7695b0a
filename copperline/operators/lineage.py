"""From file statements to external files, and rule coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BROADCAST_RULES = 100_000


def file_lineage(usage: DataFrame, records: DataFrame, file_control: DataFrame) -> DataFrame:
    """File usage with the file and external name behind each row.

    A WRITE names a record, which belongs to a file description; the other verbs name the
    file itself. Names are per program, so joins are on (path, program, name).
    """
    record = records.select(
        "path", "program", F.upper("name").alias("_key"), F.col("fd_name").alias("_fd")
    ).distinct()
    keyed = usage.withColumn("_key", F.upper("file_name")).join(record, ["path", "program", "_key"], "left")
    resolved = keyed.withColumn("fd_name", F.coalesce("_fd", "file_name")).withColumn("_key", F.upper("fd_name"))
    control = file_control.select("path", "program", F.upper("file_name").alias("_key"), "external_name")
    return resolved.join(control, ["path", "program", "_key"], "left").select(
        "path", "program", "verb", "mode", "file_name", "fd_name", "external_name", "into_name"
    )


def uncovered_verbs(stmts: DataFrame, supported: DataFrame) -> DataFrame:
    """Verbs without a matching rule, with how often each occurs.

    Statements are counted per verb first, so the join sees one row per verb.
    """
    counts = stmts.groupBy("verb").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(supported.select("verb").distinct(), "verb", "left_anti")


def first_rule(stmts: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """Per statement the matching rule of highest priority; ties go to the lower rule name.

    ``rules`` has verb, pattern, rule and priority: a rule matches when the verb is equal and its
    pattern, where given, is found in the text. Rules of a verb travel as one array, so no
    statement row is multiplied or grouped. Up to ``BROADCAST_RULES`` rules are broadcast, so the texts
    of a frequent verb are not shuffled into one task.
    """
    by_verb = rules.groupBy("verb").agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("priority")).alias("_rank"), "rule", "priority", "pattern"
    ))).alias("_rules"))
    if rules.count() <= BROADCAST_RULES:
        by_verb = F.broadcast(by_verb)
    joined = stmts.join(by_verb, "verb", "left")
    hit = F.try_element_at(
        F.filter("_rules", lambda r: r["pattern"].isNull() | F.regexp_like(F.col("text"), r["pattern"])), F.lit(1)
    )
    return joined.select(*keys, "verb", hit["rule"].alias("rule"), hit["priority"].alias("priority"))
