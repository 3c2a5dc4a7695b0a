"""Record layouts: types, schemas, renames, references and row checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from copperline.functions import naming, pictures as pic, values as val
from copperline.functions.arrays import let, scan_states, slice_array
from copperline.operators import data_items as di, references
from copperline.session import materialize


def has_children(items: DataFrame) -> DataFrame:
    """Items with at least one child that is no condition."""
    return items.where("has_children")


def layout_table(items: DataFrame) -> DataFrame:
    """One row per item: qualified path, type, lengths, largest repetition, default."""
    p = F.col("pic")
    kind = val.item_type(p, F.col("value_raw"), F.col("has_children"))
    default = let(val.value_clause(F.col("value_raw")), lambda v: F.when(v.isNotNull(), val.as_string(v, F.col("decimal_comma"))))
    return items.select(
        "path", "program", "item_no", "section", "fd_name", "level", "name", "qpath", "kind", "pic",
        kind.alias("type"), pic.pic_integer_len(p).alias("integer_len"), pic.pic_fraction_len(p).alias("fraction_len"),
        pic.pic_string_len(p).alias("string_len"), pic.pic_length(p).alias("length"),
        pic.max_occurs(F.col("occurs_from"), F.col("occurs_to")).alias("max_occurs"),
        default.alias("default_text"),
    )


def fd_layouts(items: DataFrame) -> DataFrame:
    """Layout rows of the records below file descriptions."""
    return layout_table(items.where(F.col("fd_name").isNotNull()))


def scalar_ddl(p: Column, value_raw: Column) -> Column:
    """Spark type of an elementary item; pictures beyond 38 digits and untyped items are strings."""
    kind = val.item_type(p, value_raw, F.lit(False))
    whole, fraction = pic.pic_integer_len(p, compat=False), pic.pic_fraction_len(p, compat=False)
    digits = F.coalesce(whole, F.lit(18)) + F.coalesce(fraction, F.lit(0))
    decimal = F.concat(
        F.lit("DECIMAL("), F.greatest(digits, F.lit(1)).cast("string"), F.lit(","),
        F.coalesce(fraction, F.lit(0)).cast("string"), F.lit(")"),
    )
    return (
        F.when((kind == "INTEGER") & (digits <= 38), decimal)
        .when((kind == "FLOAT") & (digits <= 38), F.when(p.isNull(), "DECIMAL(38,10)").otherwise(decimal))
        .when(kind == "BOOLEAN", "BOOLEAN")
        .otherwise("STRING")
    )


_PIC = r"(?i)\s(?:PICTURE|PIC)(?:\s+IS)?\s+(\S+)"
_OCCURS = r"(?i)\sOCCURS\s+(\d+)(?:\s+TO\s+(\d+))?"


def record_ddl(division_rows: DataFrame) -> DataFrame:
    """path, program, record_no, name and ``ddl`` of every record: a group is a struct, OCCURS an array.

    Works on the item arrays before they are exploded: one fold per unit writes the pieces of all records in order.
    It carries the groups that are open, so its cost is linear in the items.
    """
    arrays = di.item_arrays(division_rows)
    wanted = F.filter("entries", lambda e: e["level"].between(1, 49) | (e["level"] == 77))

    def part(e: Column) -> Column:
        bare = F.regexp_replace(e["text"], r"""(["'])[^"']*\1""", "''")
        p = F.nullif(F.regexp_extract(bare, _PIC, 1), F.lit(""))
        value = F.nullif(F.trim(F.regexp_extract(e["text"], di._VALUE, 1)), F.lit(""))
        times = pic.max_occurs(
            F.nullif(F.regexp_extract(bare, _OCCURS, 1), F.lit("")).cast("int"),
            F.nullif(F.regexp_extract(bare, _OCCURS, 2), F.lit("")).cast("int"),
        )
        return F.struct(
            F.when(e["level"] == 77, 1).otherwise(e["level"]).alias("level"),
            F.regexp_extract(e["qpath"], r"([^.]*)$", 1).alias("name"),
            scalar_ddl(p, value).alias("scalar"), (times > 1).alias("repeats"),
            e["no"].alias("no"),
        )

    prepared = arrays.select("path", "program", F.transform(wanted, part).alias("_parts"))
    # an item is a group if the next one lies deeper
    items = prepared.select("path", "program", F.transform("_parts", lambda x, i: x.withField(
        "opens", F.coalesce(F.get("_parts", i + 1)["level"] > x["level"], F.lit(False))
    )).alias("_items"))
    start = F.struct(
        F.array().cast(_OPEN).alias("open"), F.lit(False).alias("opened"), *[F.lit(None).alias(c) for c in ("level", "no", "name", "text", "closers")],
    ).cast(_STATE)
    states = items.select("path", "program", scan_states(F.col("_items"), _STATE, start, _ddl_step).alias("_states"))
    whole = states.select("path", "program", F.transform(
        slice_array(F.col("_states"), lambda x: x["level"] == 1), lambda r: F.struct(
            F.get(r["part"], F.lit(0))["no"].alias("record_no"), F.get(r["part"], F.lit(0))["name"].alias("name"),
            F.concat(F.array_join(F.transform(r["part"], lambda x: x["text"]), ""), F.element_at(r["part"], -1)["closers"]).alias("ddl"),
            F.get(r["part"], F.lit(0))["level"].alias("level"),
        )
    ).alias("_records"))
    # items ahead of the first record belong to none
    return whole.select("path", "program", F.inline_outer("_records")).where(F.col("level") == 1).drop("level")


_OPEN = "ARRAY<STRUCT<level: INT, repeats: BOOLEAN>>"
_STATE = (
    f"STRUCT<open: {_OPEN}, opened: BOOLEAN, level: INT, no: INT, name: STRING, text: STRING, closers: STRING>"
)


def _closers(groups: Column) -> Column:
    """What ends open groups, the innermost first."""
    return F.array_join(F.transform(F.reverse(groups), lambda g: F.when(g["repeats"], ">>").otherwise(">")), "")


def _ddl_step(prev: Column, x: Column) -> Column:
    """The next piece of a record's DDL. Only the open groups are carried, at most one per level."""
    first = x["level"] == 1

    def with_open(still: Column) -> Column:
        ended = F.when(first, "").otherwise(_closers(F.filter(prev["open"], lambda g: g["level"] >= x["level"])))
        comma = F.when(first | prev["opened"], "").otherwise(", ")
        named = F.when(first, "").otherwise(F.concat(F.lit("`"), x["name"], F.lit("`: ")))
        body = (
            F.when(x["opens"] & x["repeats"], "ARRAY<STRUCT<").when(x["opens"], "STRUCT<")
            .when(x["repeats"], F.concat(F.lit("ARRAY<"), x["scalar"], F.lit(">"))).otherwise(x["scalar"])
        )
        mine = F.array(F.struct(x["level"].alias("level"), x["repeats"].alias("repeats")))
        return let(F.when(x["opens"], F.concat(still, mine)).otherwise(still), lambda now: F.struct(
            now.alias("open"), x["opens"].alias("opened"), x["level"].alias("level"), x["no"].alias("no"), x["name"].alias("name"),
            F.concat(ended, comma, named, body).alias("text"), _closers(now).alias("closers"),
        ).cast(_STATE))

    return let(F.when(first, F.array().cast(_OPEN)).otherwise(F.filter(prev["open"], lambda g: g["level"] < x["level"])), with_open)


def spark_schema(records: DataFrame, program: str, name: str) -> T.StructType:
    """StructType of one record, looked up by program and record name."""
    row = records.where((F.col("program") == program) & (F.col("name") == name.lower().replace("-", "_"))).select(
        "ddl"
    ).orderBy("record_no").first()
    if row is None:
        raise KeyError(f"{program}: no record {name}")
    parsed = T.StructType.fromDDL(f"`{name.lower().replace('-', '_')}` {row['ddl']}")
    inner = parsed.fields[0].dataType
    inner = inner.elementType if isinstance(inner, T.ArrayType) else inner
    return inner if isinstance(inner, T.StructType) else parsed


def resolve_references(refs: DataFrame, items: DataFrame) -> DataFrame:
    """The items that (path, program, name) references mean, through renames to what they rename. One row each.

    A name may be qualified (``A OF B``). Conditions resolve to themselves and name the item they belong to in
    ``parent_no``. Unknown and ambiguous names are left out; ``references.resolve`` tells them apart.
    """
    words = references.split_reference(F.col("name"))
    asked = refs.select(*[F.col(c).alias(f"_{c}" if c == "name" else c) for c in refs.columns], *[c.alias(n) for n, c in words.items()])
    found = references.resolve(asked, items).where("status = 'resolved'")
    kept = [F.col("_name").alias("name") if c == "name" else F.col(c) for c in refs.columns]
    return found.select(*kept, "declared_no", "via_rename", "item_no", "kind", "parent_no")


def current_values(items: DataFrame, provided: DataFrame | None = None) -> DataFrame:
    """Items with ``value``: what the caller provides as (program, name, value), else the initial value."""
    start = val.initial_value(F.col("pic"), F.col("value_raw"), F.col("has_children"))
    real = items.where(~F.col("kind").isin("CONDITION", "RENAME")).withColumn("_start", start)
    if provided is None:
        return real.withColumnRenamed("_start", "value")
    given = provided.select("program", F.upper("name").alias("_key"), F.col("value").alias("_given"))
    return real.withColumn("_key", F.upper("name")).join(given, ["program", "_key"], "left").withColumn(
        "value", F.coalesce("_given", "_start")
    ).drop("_key", "_given", "_start")


def item_texts(items: DataFrame, provided: DataFrame | None = None) -> DataFrame:
    """path, program, item_no, name and ``text``, the current value as the program writes it: with its decimal comma or point."""
    text = F.when(F.col("value").isNotNull(), val.as_string(F.col("value"), F.col("decimal_comma")))
    return current_values(items, provided).select("path", "program", "item_no", "name", text.alias("text"))


def condition_names(items: DataFrame, provided: DataFrame | None = None) -> DataFrame:
    """Level 88 names with ``holds``: whether their item has the condition's first value."""
    owners = current_values(items, provided).select("path", "program", F.col("item_no").alias("parent_no"), "value")
    conditions = items.where(F.col("kind") == "CONDITION").select("path", "program", "name", "parent_no", "value_raw")
    return conditions.join(owners, ["path", "program", "parent_no"]).select(
        "path", "program", "name", val.condition_name_holds(F.col("value"), F.col("value_raw")).alias("holds")
    )


def renames_alias(items: DataFrame) -> DataFrame:
    """Level 66 names with a single source group: name, source name and source item."""
    sources = items.where(F.col("has_children")).select(
        "path", "program", F.upper("name").alias("_from"), F.col("item_no").alias("source_no"), F.col("qpath").alias("source_path"),
    )
    single = items.where((F.col("kind") == "RENAME") & F.col("renames_thru").isNull()).withColumn("_from", F.upper("renames_from"))
    return single.join(sources, ["path", "program", "_from"]).select(
        "path", "program", "item_no", "name", "renames_from", "source_no", "source_path"
    )


def qualified_paths(items: DataFrame) -> DataFrame:
    """Ancestor chain of each item, root first, by walking up ``parent_no``.

    ``data_items`` carries the same path in ``qpath``; this form serves item tables from elsewhere.
    Each level is a table of its own, so nothing is computed twice. Items that are their own
    ancestors are an error: level numbers fall towards the root, so 98 steps always reach it.
    """
    own = F.when(F.col("filler_no").isNotNull(), F.concat(F.lit("filler"), F.col("filler_no").cast("string"))).otherwise(
        naming.column_name(F.col("name"))
    )
    nodes = items.select("path", "program", "item_no", own.alias("_own"), "parent_no",
                         naming.column_name(F.col("fd_name")).alias("_fd"))
    up = nodes.select("path", "program", F.col("item_no").alias("_at"), F.col("_own").alias("_name"), F.col("parent_no").alias("_up"))
    walk = materialize(
        nodes.select("path", "program", "item_no", "_fd", F.array("_own").alias("_chain"), F.col("parent_no").alias("_at"))
    )
    done, level = None, 0
    while True:
        finished = walk.where(F.col("_at").isNull())
        done = finished if done is None else done.unionByName(finished)
        pending = walk.where(F.col("_at").isNotNull())
        if pending.isEmpty():
            break
        level += 1
        if level > 98:  # levels run from 01 to 49, 66, 77 and 88: each parent has a lower one
            raise ValueError("data items are their own ancestors")
        walk = materialize(pending.join(up, ["path", "program", "_at"]).select(
            "path", "program", "item_no", "_fd", F.concat(F.array("_name"), "_chain").alias("_chain"), F.col("_up").alias("_at")
        ))
    return done.select("path", "program", "item_no", F.concat_ws(".", "_fd", F.array_join("_chain", ".")).alias("qualified_path"))


def constraints(layout: list[dict]) -> list[tuple[str, str, Column]]:
    """Violation tests of a record layout: ``(column, rule, test)`` per constrained item.

    ``layout`` has one dict per column with keys ``column`` and ``pic``, as collected for one record.
    """
    out: list[tuple[str, str, Column]] = []
    for item in layout:
        col, kind = F.col(item["column"]), item["type"]
        if kind == "STRING" and item.get("string_len") is not None:
            out.append((item["column"], f"size<={item['string_len']}", F.length(col.cast("string")) > item["string_len"]))
        if kind in ("INTEGER", "FLOAT") and item.get("integer_len") is not None:
            fraction = 0 if kind == "INTEGER" else item.get("fraction_len")
            if fraction is None:
                continue
            number = val.plain_decimal(col.cast("decimal(38,10)"))
            digits = F.regexp_replace(F.regexp_extract(number, r"^-?0*(\d*)", 1), "^0+", "")
            decimals = F.regexp_extract(number, r"\.(\d+)$", 1)
            broken = (F.length(digits) > item["integer_len"]) | (F.length(decimals) > fraction)
            out.append((item["column"], f"digits<={item['integer_len']}.{fraction}", broken))
    return out


def pic_layout(spark, columns: dict[str, str]) -> list[dict]:
    """Constraint layout of a record given as column name to picture."""
    rows = spark.createDataFrame(list(columns.items()), "column string, pic string").select(
        "column", "pic", pic.pic_type(F.col("pic")).alias("type"), pic.pic_integer_len(F.col("pic")).alias("integer_len"),
        pic.pic_fraction_len(F.col("pic")).alias("fraction_len"), pic.pic_string_len(F.col("pic")).alias("string_len"),
    )
    return [r.asDict() for r in rows.collect()]


def constraint_violations(df: DataFrame, layout: list[dict], key: str) -> DataFrame:
    """Broken constraints, one row each: key, column, rule, found. One pass, no shuffle."""
    tests = constraints(layout)
    checks = F.array(*[
        F.when(F.coalesce(test, F.lit(False)), F.struct(
            F.lit(name).alias("column"), F.lit(rule).alias("rule"), F.col(name).cast("string").alias("found")
        ))
        for name, rule, test in tests
    ])
    return df.select(key, F.inline(F.filter(checks, lambda c: c.isNotNull())))
