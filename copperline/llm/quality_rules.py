"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed
rule; a policy is a versioned set of bits, so another policy or an ablation is bit arithmetic over
the ledger and reads no text again.

Defined cases: a null, empty or wordless text measures zero everywhere and fails ``few_words``;
repeated rows are judged alike and all stay; other columns are kept.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars", "n_upper", "n_letters",
    "n_long_words", "n_shout",
)



def rules() -> dict[str, Column]:
    """name -> failed, over the measurements; integer arithmetic only, so no rounding decides."""
    m = {c: F.col(c) for c in MEASURES}
    return {
        "few_words": m["n_words"] < 50,
        "repeated_windows": 100 * m["n_repeat_words"] > 50 * m["n_words"],
        "many_symbols": 100 * m["n_symbols"] > 5 * m["word_chars"],
        "repeated_lines": (100 * m["n_dup_lines"] > 50 * m["n_lines"]) & (m["n_dup_lines"] >= 3),
        "upper_case": (100 * m["n_upper"] > 60 * m["n_letters"]) & (m["n_letters"] >= 20),
        "long_words": 100 * m["n_long_words"] > 20 * m["n_words"],
        "shouting": 100 * m["n_shout"] > 30 * m["n_words"],
    }


RULE_NAMES = (
    "few_words", "repeated_windows", "many_symbols", "repeated_lines", "upper_case", "long_words", "shouting",
)
BASE = ("few_words", "repeated_windows")
#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base": BASE,
    "v1": BASE + ("many_symbols", "repeated_lines", "upper_case"),
    "v2": BASE + ("many_symbols", "repeated_lines", "upper_case", "long_words", "shouting"),
}


def bits(names: tuple[str, ...]) -> int:
    return sum(1 << RULE_NAMES.index(n) for n in names)


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words inside windows of ``size`` words that occur twice or more in the text."""
    windows = list(zip(*[words[k:] for k in range(size)]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered, end = 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            covered += at + size - max(at, end)
            end = at + size
    return covered


def measure_text(text: str) -> tuple[int, ...]:
    """The values of ``MEASURES`` for one text."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()  # at space and \t to \r, and nowhere else
    lines = [line for line in raw.split(b"\n") if line.strip()]
    upper = lower = 0
    if raw.isascii():
        upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        letters = upper + len(raw) - len(raw.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    else:
        upper = sum(map(str.isupper, text))
        letters = sum(map(str.isalpha, text))
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), len(text), upper, letters, sum(len(w) > 40 for w in words),
        sum(w.endswith(b"!!") for w in words),
    )


@F.pandas_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def _measured(texts: pd.Series) -> pd.DataFrame:
    rows = [measure_text(t if isinstance(t, str) else "") for t in texts]
    return pd.DataFrame(rows, columns=list(MEASURES), dtype="int64")


def ledger(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep``, the measurements, ``failed`` (bit mask) and ``rule_version``; each rule is evaluated once."""
    kept = [F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)]
    found = docs.select(*kept, _measured(F.col(text_col)).alias("_m")).select(
        *[f"_keep_{i}" for i in range(len(keep))], *[F.col(f"_m.{m}").alias(m) for m in MEASURES]
    )
    mask = F.lit(0).cast("long")
    for n, failed in enumerate(rules().values()):
        mask = mask.bitwiseOR(F.when(failed, F.lit(1 << n)).otherwise(F.lit(0)).cast("long"))
    out = found.withColumn("failed", mask)
    return out.select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)], *MEASURES, "failed")


def fails(policy: str | tuple[str, ...], failed: Column | None = None) -> Column:
    """Whether a ledger row fails a policy (by version, or a set of rule names)."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return (F.col("failed") if failed is None else failed).bitwiseAND(F.lit(bits(names)).cast("long")) != 0


def ablation(rows: DataFrame, policy: str | tuple[str, ...]) -> DataFrame:
    """Per rule of a policy: rule, n_failed, n_only (kept if this rule alone were dropped), n_rejected, n_rows.

    Masks are counted first, so what is exploded is one row per distinct mask.
    """
    names = POLICIES[policy] if isinstance(policy, str) else policy
    masks = rows.groupBy(F.col("failed").bitwiseAND(F.lit(bits(names)).cast("long")).alias("mask")).agg(
        F.count(F.lit(1)).alias("n")
    )
    each = F.explode(F.array(*[
        F.struct(F.lit(n).alias("rule"), F.lit(bits((n,))).cast("long").alias("bit")) for n in names
    ]))
    return masks.select("mask", "n", each.alias("r")).groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("mask").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("mask") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("mask") != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
        F.sum("n").alias("n_rows"),
    )


def keep_documents(docs: DataFrame, policy: str | tuple[str, ...] = "v1", text_col: str = "text") -> DataFrame:
    """The rows that pass a policy, with all their columns."""
    names = list(docs.columns)
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    rows = ledger(inner, inner.columns, f"c{names.index(text_col)}").where(~fails(policy))
    return rows.select(*inner.columns).toDF(*names)
