from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from copperline.functions import naming, pictures as pic, prompts, source_text as st, values as val, vectors as vec


def one(spark, *cols):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return row[0] if len(cols) == 1 else tuple(row)


@pytest.mark.parametrize("text,whole,fraction,chars,total,kind", [
    ("9V9", 1, 1, None, 3, "FLOAT"), ("9V99", 1, 2, None, 4, "FLOAT"), ("9V999", 1, 3, None, 5, "FLOAT"), ("9.9", 1, 1, None, 3, "FLOAT"),
    ("9.99", 1, 2, None, 4, "FLOAT"), ("9(01)", 1, 0, None, 1, "INTEGER"), ("9(02)", 2, 0, None, 2, "INTEGER"), ("9(1)", 1, 0, None, 1, "INTEGER"),
    ("99V9", 2, 1, None, 4, "FLOAT"), ("999V9", 3, 1, None, 5, "FLOAT"), ("X(01)", None, None, 1, 1, "STRING"), ("X(2)", None, None, 2, 2, "STRING"),
    ("AAA", None, None, 3, 3, "STRING"), ("A(7)", None, None, 7, 7, "STRING"), ("S99", 3, 0, None, 4, "INTEGER"), ("S9(4)", 4, 0, None, 5, "INTEGER"),
    ("9(5)V99", 5, 2, None, 8, "FLOAT"), ("99V9(2)", 2, 2, None, 5, "FLOAT"), ("9(3)V9(2)", 3, 2, None, 5, "FLOAT"),
    ("S9(7)V99", None, None, None, None, "FLOAT"), ("S99V9", None, None, None, None, "FLOAT"), ("ZZ9", None, None, None, None, None),
])
def test_pictures(spark, text, whole, fraction, chars, total, kind):
    p = F.lit(text)
    assert one(spark, pic.pic_integer_len(p), pic.pic_fraction_len(p), pic.pic_string_len(p), pic.pic_length(p), pic.pic_type(p)) == (
        whole, fraction, chars, total, kind)


def test_signed_digits_without_compat(spark):
    assert one(spark, pic.pic_integer_len(F.lit("S9(7)V99"), False), pic.pic_fraction_len(F.lit("S9(7)V99"), False), pic.pic_integer_len(F.lit("S99"), False)) == (7, 2, 2)


def test_max_occurs(spark):
    none = F.lit(None).cast("int")
    assert one(spark, pic.max_occurs(none, none), pic.max_occurs(F.lit(2), none), pic.max_occurs(F.lit(2), F.lit(7))) == (1, 2, 7)


def test_arithmetic(spark):
    n = lambda x: F.lit(x).cast(val.DEC)
    none = F.lit(None).cast(val.DEC)
    got = one(
        spark, val.multiply(n(2), n(2)), val.add(val.divide(n(15), n(3)), n(2)), val.power(n(4), n(2)), val.power(-n(2), n(2)),
        val.subtract(n(8), n(5)), val.divide(n(5), n(0)), val.add(n(1), none), val.divide(none, n(0)))
    assert got == (4, 7, 16, 4, 3, 5, None, None)


def test_sign_conditions(spark):
    n = F.lit(-4)
    assert one(spark, val.sign_condition(n, "NEGATIVE"), val.sign_condition(n, "POSITIVE", True), val.sign_condition(n, "ZERO"),
               val.sign_condition(F.lit(None).cast("int"), "ZERO", True)) == (True, True, False, None)


def test_combined_comparison(spark):
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    got = one(
        spark, val.combined_comparison(F.lit(4), ">", arr(2, 3, 0, 2), "AND"), val.combined_comparison(F.lit(4), ">", arr(10, 2, 5), "OR"),
        val.combined_comparison(F.lit(-4), ">", arr(2, 3, 0, -4), "AND", not_=True), val.combined_comparison(F.lit(4), ">", arr(1, 10, 2), "OR", not_=True),
        val.combined_comparison(F.lit(4), ">", arr(1, None), "OR"))
    assert got == (True, True, True, True, None)


def test_condition_chain_has_no_precedence(spark):
    step = lambda op, v: F.struct(F.lit(op).alias("op"), F.lit(v).cast("boolean").alias("v"))
    got = one(
        spark, val.condition_chain(F.lit(True), F.array(step("OR", True), step("AND", False))),
        val.condition_chain(F.lit(False), F.array(step("AND", False), step("OR", True))),
        val.condition_chain(F.lit(True), F.array(step("OR", None))), val.condition_chain(F.lit(True), F.array(step("AND", True)), first_not=True))
    assert got == (False, True, None, False)
    listed = lambda first, *rest: one(spark, val.condition_chain(F.lit(first), [(op, F.lit(v).cast("boolean")) for op, v in rest]))
    assert [listed(True, ("OR", True), ("AND", False)), listed(False, ("AND", False), ("OR", True)), listed(True, ("OR", None))] == [False, True, None]


def test_relations_equal_single_comparisons(spark):
    values = [val.decimal_value(F.lit(x)) for x in (1, 2, None)] + [val.string_value(F.lit(x)) for x in ("a ", "2", "")] + [
        val.boolean_value(F.lit(True)), val.high_value(), val.low_value()]
    left = spark.range(1).select(F.explode(F.array(*values)).alias("a")).withColumn("k", F.lit(1))
    pairs = left.join(left.withColumnRenamed("a", "b"), "k")
    a, b = F.col("a"), F.col("b")
    rows = val.relations(pairs, a, b).select(
        "eq", "ne", "gt", "ge", "lt", "le", val.equal(a, b), val.not_equal(a, b), val.greater(a, b), val.greater_or_equal(a, b), val.less(a, b), val.less_or_equal(a, b)
    ).collect()
    assert len(rows) == 81 and all(tuple(r)[:6] == tuple(r)[6:] for r in rows)


def test_comparisons(spark):
    d, s, b = (lambda x: val.decimal_value(F.lit(x))), (lambda x: val.string_value(F.lit(x))), (lambda x: val.boolean_value(F.lit(x)))
    hi, lo = val.high_value(), val.low_value()
    assert one(spark, val.equal(d(1), d("1.00")), val.equal(s("a"), s("a  ")), val.less(s("A"), s("B")), val.greater(b(True), b(False))) == (True, True, True, True)
    assert one(spark, val.equal(hi, hi), val.equal(hi, lo), val.not_equal(hi, d(1)), val.equal(hi, s("  ")), val.greater(d(10), s("9"))) == (
        True, False, True, True, False)
    assert one(spark, val.not_equal(hi, hi), val.less_or_equal(d(2), d(2)), val.equal(val.decimal_value(F.lit(None)), d(1))) == (False, True, None)


def test_literals(spark):
    kind = lambda raw: one(spark, val.value_clause(F.lit(raw))["kind"])
    assert [kind(x) for x in ("'it. is'", "12", "-1.5", "SPACES", "zero", "HIGH-VALUES", "LOW-VALUE", "TRUE", "QUOTE", "1 THRU 5", "1 2")] == [
        "STRING", "DECIMAL", "DECIMAL", "STRING", "DECIMAL", "HIGH", "LOW", "BOOLEAN", None, None, "DECIMAL"]
    assert one(spark, val.literal_type(F.lit("1.5")), val.literal_type(F.lit("7")), val.literal_type(F.lit("NULL"))) == ("FLOAT", "INTEGER", None)


def test_initial_values(spark):
    none = F.lit(None).cast("string")
    no = F.lit(False)
    text = lambda p, v: one(spark, val.as_string(val.initial_value(p, v, no)))
    assert text(F.lit("X(5)"), F.lit("'ab'")) == "ab   " and text(F.lit("X(3)"), none) == "   " and text(F.lit("9(3)"), none) == "0"
    assert text(F.lit("9(3)V99"), F.lit("99.99")) == "99.99" and text(none, F.lit('"Arlington"')) == "Arlington"
    assert one(spark, val.initial_value(none, none, F.lit(True))) is None


def test_value_texts(spark):
    d = val.decimal_value(F.lit(Decimal("1234.50")))
    assert one(spark, val.as_string(d), val.as_string(d, comma=True), val.as_string(val.boolean_value(F.lit(False)))) == ("1234.5", "1234,5", "0")
    assert one(spark, val.as_decimal(val.string_value(F.lit(" 12.5 "))), val.as_decimal(val.high_value()), val.as_decimal(val.string_value(F.lit("x")))) == (
        Decimal("12.5"), Decimal(0), None)


def test_condition_name(spark):
    s = val.string_value(F.lit("Y "))
    assert one(spark, val.condition_name_holds(s, F.lit("'Y'")), val.condition_name_holds(s, F.lit("'N' 'Y'")), val.condition_name_holds(s, F.lit("1 THRU 2"))) == (
        True, False, None)


def test_expression_types(spark):
    t = lambda x: one(spark, val.expression_type(F.lit(x)))
    assert [t(x) for x in ("A > 1", "1 + B", "LENGTH OF X", "'a > b'", "1.5", "X NOT = Y")] == ["BOOLEAN", "INTEGER", "INTEGER", "STRING", "FLOAT", "BOOLEAN"]


def test_names(spark):
    assert one(spark, naming.column_name(F.lit("WS-NAME#1")), naming.unit_name(F.lit("/a/basic.cbl")), naming.doc_id(F.lit("P"), F.lit("p.cbl"))) == (
        "ws_name$1", "Basic", "P_p.cbl")
    assert one(spark, naming.data_description(F.lit(5), F.lit("X(2)")), naming.data_description(F.lit(5), F.lit(None).cast("string"))) == (
        "Level: 5, Type: X(2)", "Level: 5")


def test_context_and_prompt(spark):
    none = F.lit(None).cast("string")
    assert one(spark, prompts.context_segment(none, none, none)) == "Code from unknown:\n\nDependencies:\n"
    assert one(spark, prompts.dependency_text(F.lit("A"), F.array(F.lit("X"), F.lit("Y")))) == '["X", "Y"]'
    assert one(spark, prompts.dependency_text(F.lit("A"), F.lit(None).cast("array<string>"))) == "[]"
    assert one(spark, prompts.dependency_text(F.lit(""), F.array(F.lit("X")))) == prompts.NO_PROGRAM
    text = one(spark, prompts.prompt(F.lit("C {question}"), F.lit("D"), F.lit("Q?")))
    assert "codebase:\nC {question}\n" in text and "relations:\nD\n" in text and text.endswith("Question: Q?\n\nAnswer in markdown format:\n")
    assert one(spark, *[prompts.question_or_hint(F.lit(q).cast("string")) for q in ("a", " \t", None)]) == (
        "a", prompts.EMPTY_QUESTION_HINT, prompts.EMPTY_QUESTION_HINT)
    assert one(spark, prompts.code_segment(F.lit("s"), none, F.lit("d"))) == "**Source**: s\n**Type**: null\n**Code**:\n```\nd\n```"


def test_lines(spark):
    got = [one(spark, st.split_lines(F.lit(t))) for t in ("", "a", "a\n", "a\r\nb\rc\n\n", "\n")]
    assert got == [[], ["a"], ["a"], ["a", "b", "c", ""], [""]]


def test_driver_embedding_equals_column_embedding(spark):
    text = "The Quick brown fox, the LAZY dog 42 times"
    df = vec.embed(spark.createDataFrame([(text,), ("",), (None,)], "t string"), "t")
    rows = [r["embedding"] for r in df.collect()]
    assert rows[0] == pytest.approx(vec.embed_question(text)) and sum(x * x for x in rows[0]) == pytest.approx(1)
    assert set(rows[1]) == {0.0} == set(rows[2])


def test_user_model(spark):
    df = vec.embed(spark.createDataFrame([("abc",), ("d",)], "t string"), "t", fn=lambda s: s.map(lambda x: [float(len(x)), 1.0]))
    assert [r["embedding"] for r in df.collect()] == [[3.0, 1.0], [1.0, 1.0]]


@pytest.mark.parametrize("hostile", ["a" * 200_000, "'" * 50_000, ". " * 50_000, "x'\n" * 50_000, '"' + "b" * 200_000, "*>" * 50_000])
def test_hostile_text_is_cut_quickly(spark, hostile):
    import time

    from copperline.operators import structure

    df = spark.createDataFrame([("p", "p", hostile)], "path string, file_name string, content string")
    start = time.time()
    structure.with_sentences(df, "TANDEM").select(F.size("sents")).collect()
    assert time.time() - start < 20


def test_arithmetic_keeps_all_places(spark):
    from decimal import Decimal

    from copperline.functions import values as val

    row = spark.createDataFrame(
        [(Decimal("0.0000000001"), Decimal("1"), Decimal("3"), Decimal("1.0000001"), Decimal("1000000000000000"), Decimal("0"))],
        "tiny decimal(38,10), one decimal(38,10), three decimal(12,0), near decimal(12,7), large decimal(16,0), zero decimal(38,10)")
    c = __import__("pyspark").sql.functions.col
    got = row.select(
        val.add(c("tiny"), c("one")).alias("a"), val.subtract(c("tiny"), c("one")).alias("s"), val.multiply(c("near"), c("three")).alias("m"),
        val.multiply(c("large"), c("three")).alias("l"), val.divide(c("one"), c("three")).alias("d"), val.divide(c("one"), c("zero")).alias("z"),
        val.multiply(c("large"), c("large")).alias("o"),
    ).first()
    assert [str(got[x]) for x in "asmldz"] == [
        "1.0000000001", "-0.9999999999", "3.0000003000", "3000000000000000.0000000000", "0.3333333333", "1.0000000000"]
    assert got["o"] is None
