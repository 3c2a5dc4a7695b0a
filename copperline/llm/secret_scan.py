"""Secret scans: keyword automaton, anchored expressions near its hits, checksums inside the find.

One Aho-Corasick automaton reads a text once and reports where keywords stand. Only there the
expression of the keyword's kind is tried, anchored at the hit. A kind with a check then validates
what the value carries in itself: the CRC-32 that ends newer access tokens, the header of a signed web
token, the Luhn digit of a card number, the mod-97 digits of a bank account. Runs of hexadecimal
digits have no keyword; a run of 24 covers one of every 24 code points, so these are its hits.

A kind's matches are taken from left to right without overlap, as a search over the whole text would
find them; matches that fail their length or check are dropped after that.

Defined cases: null and empty texts have no spans; texts are read whole, whatever their length; of two
spans with the same start the kind named first in ``KINDS`` comes first; repeated rows are scanned
alike; an empty table gives an empty table; all other columns are kept, and of columns named like the
added ones (in any case) the added ones win.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from copperline.llm.columns import add_columns

HEX_RUN = 24
# Fixed value: the digits of the base-62 numbers in checksummed tokens.
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_tail(value: str) -> bool:
    """Whether a token ends in the six base-62 digits of the CRC-32 of what stands between prefix and them."""
    body, tail = value.partition("_")[2][:-6], value[-6:]
    number = 0
    for digit in tail:
        number = number * 62 + _BASE62.index(digit)
    return binascii.crc32(body.encode()) == number


def token_header(value: str) -> bool:
    """Whether the first part of a signed web token is JSON that names its algorithm."""
    head = value.split(".")[0]
    try:
        header = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def luhn(value: str) -> bool:
    digits = [int(c) for c in value if c.isdecimal()]
    doubled = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
    return len(set(digits)) > 1 and (sum(digits[::-2]) + sum(doubled)) % 10 == 0


def mod_97(value: str) -> bool:
    """Whether an account number, its country and check digits moved to the end, leaves 1 modulo 97."""
    bare = re.sub(r"[^A-Z0-9]", "", value)
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


@dataclass(frozen=True)
class Kind:
    """What one sort of secret looks like.

    ``pattern`` is tried where a keyword begins; the reported span is its group ``span``. Keywords are
    in lower case and met in any case of A-Z; the pattern says which case counts.
    """

    name: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    span: int = 0
    valid: Callable[[re.Match], bool] = lambda m: True


# The base kinds and their expressions.
BASE = (
    Kind("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
    ), valid=lambda m: len(m[2]) >= 6),
    Kind("access", ("akia",), re.compile(r"AKIA[A-Z0-9]+"), valid=lambda m: len(m[0]) >= 20),
)
CHECKED = (
    Kind("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
         valid=lambda m: crc_tail(m[0])),
    Kind("npm", ("npm_",), re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), valid=lambda m: crc_tail(m[0])),
    Kind("web_token", ("eyj",), re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), valid=lambda m: token_header(m[0])),
    Kind("private_key", ("-----begin ",), re.compile(
        r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END \1PRIVATE KEY-----"
    )),
    Kind("card", ("card", "visa", "amex"), re.compile(r"(?i:card|visa|amex)[A-Za-z]{0,8}+[\s\w.#:=-]{0,24}?(?<![0-9])((?:[0-9][ -]?){12,18}[0-9])(?![0-9])"),
         span=1, valid=lambda m: luhn(m[1])),
    Kind("account", ("iban",), re.compile(r"(?i:iban)[\s:=#-]{0,8}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])"),
         span=1, valid=lambda m: mod_97(m[1])),
)
#: All kinds in the order that settles equal starts.
KINDS = ("assign", "access", "hex", *(k.name for k in CHECKED))
BASE_KINDS = KINDS[:3]

_UPPER_RUN = re.compile("[A-Z]+")
_HEX_DIGIT = re.compile("[0-9a-f]")
_HEX_REST = re.compile("[0-9a-f]*")


def _lower_ascii(text: str) -> str:
    """A-Z in lower case, every other character as it was, so positions stay."""
    return text.lower() if text.isascii() else _UPPER_RUN.sub(lambda m: m[0].lower(), text)


@cache
def _automaton():
    words = ahocorasick.Automaton()
    for number, kind in enumerate((*BASE, *CHECKED)):
        for word in kind.keywords:
            words.add_word(word, (len(word), number))
    words.make_automaton()
    return words


def hex_runs(text: str) -> Iterator[tuple[int, int]]:
    """Runs of at least ``HEX_RUN`` hexadecimal digits, tried only at every ``HEX_RUN``-th code point."""
    done = 0
    for hit in _HEX_DIGIT.finditer(text[HEX_RUN - 1::HEX_RUN]):
        at = hit.start() * HEX_RUN + HEX_RUN - 1
        if at < done:
            continue
        # the run holds at most HEX_RUN - 1 digits ahead of its first hit
        start = at
        while start > done and text[start - 1] in "0123456789abcdef":
            start -= 1
        done = _HEX_REST.match(text, at).end()
        if done - start >= HEX_RUN:
            yield start, done


def find(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind as a place in ``KINDS``, end) of all spans of a text, in order."""
    if not text:
        return []
    kinds = (*BASE, *CHECKED)
    places = [KINDS.index(kind.name) for kind in kinds]
    free = [0] * len(kinds)  # where each kind's last match ended
    spans = [(start, 2, end) for start, end in hex_runs(text)]
    # hits come by their ends; a kind's matches are taken by their starts
    hits = sorted((end - length + 1, number) for end, (length, number) in _automaton().iter(_lower_ascii(text)))
    for start, number in hits:
        if start < free[number]:
            continue
        kind = kinds[number]
        match = kind.pattern.match(text, start)
        if match is not None:
            free[number] = match.end()
            if kind.valid(match):
                spans.append((match.start(kind.span), places[number], match.end(kind.span)))
    spans.sort()
    return spans


_FOUND = T.StructType([
    T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("kinds", T.ArrayType(T.IntegerType())),
    T.StructField("ends", T.ArrayType(T.IntegerType())),
])


@F.pandas_udf(_FOUND)
def _find(texts: pd.Series) -> pd.DataFrame:
    rows = [[list(c) for c in zip(*spans)] or [[], [], []] for spans in (find(t if isinstance(t, str) else None) for t in texts)]
    return pd.DataFrame(rows, columns=["starts", "kinds", "ends"])


def scan(docs: DataFrame, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with ``out``, an array of (kind, start, end) in order; positions are code points, the end is exclusive."""
    def spans(col: Callable[[str], Column]) -> dict[str, Column]:
        names = F.array(*[F.lit(k) for k in KINDS])
        found = _find(col(text_col))
        return {out: F.transform(
            F.arrays_zip(found["kinds"].alias("k"), found["starts"].alias("s"), found["ends"].alias("e")),
            lambda x: F.struct(F.get(names, x["k"]).alias("kind"), x["s"].alias("start"), x["e"].alias("end")),
        )}

    return add_columns(docs, spans)


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    ), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of the text replaced by ``mark``; overlapping spans become one mark."""
    @F.pandas_udf("string")
    def redacted(texts: pd.Series) -> pd.Series:
        return pd.Series([without(t, mark) if isinstance(t, str) else None for t in texts], dtype="object")

    return add_columns(docs, lambda col: {text_col: redacted(col(text_col))})


def without(text: str, mark: str) -> str:
    out, at = [], 0
    for start, _, end in find(text):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])
