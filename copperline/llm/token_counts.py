"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a piece are a doubly linked list. A heap holds its adjacent pairs by merge rank and
position; the lowest is popped, merged, and its two new neighbours pushed. The count is the number
of initial symbols minus the merges: no token is looked up and no identifier made, so a piece of n
bytes costs n log n. The vocabulary file is a parameter and read once in each worker.

Defined cases: null and empty texts have 0 bytes and 0 tokens; special strings of the vocabulary
inside a text are one token each; texts are read whole; repeated rows are counted alike; other columns
are kept.
"""

from __future__ import annotations

import json
import re
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from copperline.llm.columns import by_place

LIMIT = 512
#: Counts of pieces a worker remembers before it starts anew; results do not depend on it.
REMEMBERED = 800_000
# How byte-level vocabularies of this kind split a text before merging.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""


# the same split where all characters are ASCII, for the faster matcher
_ASCII_PIECES = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII
)


def _byte_of_symbol() -> dict[str, int]:
    """The visible character that stands for a byte in the vocabulary file -> the byte."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Counts(dict):
    """Counts tokens with the merges of one vocabulary file; remembers the counts of short pieces.

    Symbols are numbers: a byte is itself, the result of the merge of rank r is 256 + r.
    """

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        number: dict[str, int] = dict(_byte_of_symbol())
        merges = spec["model"]["merges"]
        # left symbol -> right symbol -> rank; most symbols are never on the left and share one table
        none: dict[int, int] = {}
        self.ranks = [none] * (256 + len(merges))
        for rank, merge in enumerate(merges):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            at = number[left]
            if self.ranks[at] is none:
                self.ranks[at] = {}
            self.ranks[at].setdefault(number[right], rank)
            number.setdefault(left + right, 256 + rank)
        self.pieces = regex.compile(PIECES)
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.starts = tuple(special)

    def of_piece(self, piece: str) -> int:
        symbols = list(piece.encode("utf-8", "replace"))
        n = len(symbols)
        ranks = self.ranks
        following = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        # a heap entry is rank and position in one number: small ones compare fastest
        place = n.bit_length()
        heap = [r << place | i for i in range(n - 1) if (r := ranks[symbols[i]].get(symbols[i + 1])) is not None]
        heapify(heap)
        position = (1 << place) - 1
        merged = 0
        while heap:
            lowest = heappop(heap)
            i = lowest & position
            j = following[i]
            left = symbols[i]
            rank = lowest >> place
            # an entry is stale once one of its two symbols has been merged; a merged one is -1
            if left < 0 or j >= n or ranks[left].get(symbols[j]) != rank:
                continue
            symbol = symbols[i] = 256 + rank
            symbols[j] = -1
            k = following[i] = following[j]
            merged += 1
            if k < n:
                before[k] = i
                r = ranks[symbol].get(symbols[k])
                if r is not None:
                    heappush(heap, r << place | i)
            h = before[i]
            if h >= 0:
                r = ranks[symbols[h]].get(symbol)
                if r is not None:
                    heappush(heap, r << place | h)
        return n - merged

    def __missing__(self, piece: str) -> int:
        n = self.of_piece(piece)
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = n
        return n

    def of_text(self, text: str) -> int:
        total, parts = 0, [text]
        if self.special is not None and any(s in text for s in self.starts):
            parts = self.special.split(text)
            total = len(parts) - 1
        for part in parts:
            pieces = (_ASCII_PIECES if part.isascii() else self.pieces).findall(part)
            total += sum(map(self.__getitem__, pieces))
        return total


_loaded: dict[str, Counts] = {}


def counts_of(path: str) -> Counts:
    if path not in _loaded:
        _loaded[path] = Counts(path)
    return _loaded[path]


@by_place("n_bytes", "n_tokens", "over_limit")
def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT, text_col: str = "text") -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit; columns of these names are replaced."""
    @F.pandas_udf(T.LongType())
    def tokens(texts: pd.Series) -> pd.Series:
        counts = counts_of(vocabulary)
        return pd.Series([counts.of_text(t) if isinstance(t, str) else 0 for t in texts], dtype="int64")

    return docs.select(
        *docs.columns, F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"),
        tokens(F.col(text_col)).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
