"""Text of context segments and prompts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The texts that answers and prompts are made of.
EMPTY_QUESTION_HINT = "Please provide a valid query about the COBOL codebase."
NO_PROGRAM = "No program name provided"
PROMPT = """You are a COBOL expert assistant. Answer the question based on the context below.
Always include the full dependency context (including any errors) verbatim in your answer.
Include relevant code snippets and explain their purpose.

Context from codebase:
{context}

Dependency graph relations:
{dependencies}

Question: {question}

Answer in markdown format:
"""


def is_valid_question(question: Column) -> Column:
    return F.coalesce(F.regexp_replace(question, r"^[\x00-\x20]+", "") != "", F.lit(False))


def question_or_hint(question: Column) -> Column:
    """The question, or the fixed hint for a null or blank one."""
    return F.when(is_valid_question(question), question).otherwise(F.lit(EMPTY_QUESTION_HINT))


def dependency_list(names: Column) -> Column:
    """`["A", "B"]`, and `[]` for none."""
    quoted = F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.concat(F.lit('"'), n, F.lit('"')))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def dependency_text(program: Column, names: Column) -> Column:
    return F.when(F.coalesce(program, F.lit("")) == "", F.lit(NO_PROGRAM)).otherwise(dependency_list(names))


def context_segment(source: Column, document: Column, dependencies: Column) -> Column:
    return F.concat(
        F.lit("Code from "), F.coalesce(source, F.lit("unknown")), F.lit(":\n"),
        F.coalesce(document, F.lit("")), F.lit("\nDependencies:\n"), F.coalesce(dependencies, F.lit("")),
    )


def code_segment(source: Column, type_: Column, document: Column) -> Column:
    """Markdown with source, type and fenced code; missing parts read `null`."""
    show = lambda c: F.coalesce(c, F.lit("null"))
    return F.concat(
        F.lit("**Source**: "), show(source), F.lit("\n**Type**: "), show(type_),
        F.lit("\n**Code**:\n```\n"), show(document), F.lit("\n```"),
    )


def prompt(context: Column, dependencies: Column, question: Column) -> Column:
    """The filled prompt template. Filled text is never searched for placeholders again."""
    head, rest = PROMPT.split("{context}")
    middle, rest = rest.split("{dependencies}")
    before_question, tail = rest.split("{question}")
    return F.concat(
        F.lit(head), context, F.lit(middle), dependencies, F.lit(before_question), question, F.lit(tail)
    )
