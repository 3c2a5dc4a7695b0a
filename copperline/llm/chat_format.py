"""Chat formatting with typed content parts.

A visitor flattens the parts of a turn (text, image, audio, document) into one string: texts with
their control strings escaped, the others as numbered placeholders whose attachment reference and
expanded token count are recorded. ``format_turns`` works on each row alone, so a long conversation
needs no long row. ``read_back`` parses the formatted turns of each conversation again, in order
and as a stream: it holds one turn and two running digests, whatever a conversation's length.

Template: ``<turn ROLE>`` line, content, ``</turn>`` line. Escapes, everywhere: ``\\`` before ``\\``,
``<`` and ``>``, and ``\\n`` for a line break in a role; so no text can form a control string.

Defined cases: a null text or role is empty; a part of an unknown kind is a placeholder ``other`` without tokens; unknown
and negative sizes count as none; a placeholder in a turn under the loss mask is under it like its text; a turn without parts is an empty turn; equal turn
numbers are ordered by role and text, so repeated rows are repeated turns; rows with a null
conv_id form one conversation, null turn numbers come first; other columns are kept by
``format_turns``, and of columns named like the added ones the added ones win.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from copperline.llm.columns import by_place

PART = "kind string, text string, ref string, width int, height int, seconds double, pages int"
#: Tokens a placeholder expands to: image tiles of that many pixels, tokens a second, tokens a page.
IMAGE_TILE, AUDIO_PER_SECOND, DOCUMENT_PER_PAGE = 28, 25, 600
LOSS_ROLE = "assistant"
END = "\n</turn>\n"
_ATTACHMENT = T.StructType([
    T.StructField("number", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("ref", T.StringType()),
    T.StructField("tokens", T.LongType()),
])
FORMATTED = T.StructType([
    T.StructField("formatted", T.StringType()), T.StructField("loss_start", T.IntegerType()),
    T.StructField("loss_end", T.IntegerType()), T.StructField("attachments", T.ArrayType(_ATTACHMENT)),
    T.StructField("expanded_tokens", T.LongType()),
])
DIGEST = (
    "conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "n_attachments long, expanded_tokens long"
)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\<").replace(">", "\\>")


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


@dataclass
class Flattener:
    """Visits the parts of one turn in order."""

    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        kind = part.get("kind") or "text"
        method = getattr(self, f"visit_{kind}", None)
        if method is None:
            # nothing is known of its size: it stands as a placeholder of its own kind without tokens
            self._attach("other", part, 0)
            return
        method(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        tiles = [-(-(_number(part.get(side)) or IMAGE_TILE) // IMAGE_TILE) for side in ("width", "height")]
        self._attach("image", part, int(tiles[0] * tiles[1]))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, int(-(-_number(part.get("seconds")) * AUDIO_PER_SECOND // 1)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, int(_number(part.get("pages")) or 1) * DOCUMENT_PER_PAGE)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        number = len(self.attachments) + 1
        self.out.append(f"<{kind} {number}>")
        self.attachments.append({"number": number, "kind": kind, "ref": part.get("ref"), "tokens": tokens})


def _number(value) -> float:
    """A size; unknown and negative ones count as none."""
    return 0 if value is None or value != value else max(value, 0)


def format_turn(role: str | None, parts: list[dict] | None) -> tuple:
    """The values of ``FORMATTED`` for one turn; the loss span is in code points of the formatted text."""
    flat = Flattener()
    for part in parts if parts is not None else ():
        if part is not None:
            flat.visit(part)
    head = f"<turn {escape(role or '').replace(chr(10), chr(92) + 'n')}>\n"
    body = "".join(flat.out)
    span = (len(head), len(head) + len(body)) if role == LOSS_ROLE else (None, None)
    return head + body + END, *span, flat.attachments, sum(a["tokens"] for a in flat.attachments)


def parse_turn(formatted: str) -> tuple[str, str]:
    """(role, content) of a formatted turn; placeholders stay in the content."""
    head, _, rest = formatted.partition(">\n")
    while head.endswith("\\") and (len(head) - len(head.rstrip("\\"))) % 2:
        more, _, rest = rest.partition(">\n")
        head += ">\n" + more
    if not head.startswith("<turn ") or not rest.endswith(END):
        raise ValueError("not a formatted turn")
    return unescape(head[len("<turn "):]), unescape(rest[: -len(END)])


def text_part(text: Column) -> Column:
    """A text as the only part of a turn."""
    null = lambda t: F.lit(None).cast(t)
    return F.array(F.struct(
        F.lit("text").alias("kind"), text.alias("text"), null("string").alias("ref"), null("int").alias("width"),
        null("int").alias("height"), null("double").alias("seconds"), null("int").alias("pages"),
    ))


@by_place("formatted", "loss_start", "loss_end", "attachments", "expanded_tokens")
def format_turns(turns: DataFrame, role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """``turns`` with the columns of ``FORMATTED``. Works on each row alone."""
    @F.pandas_udf(FORMATTED)
    def formatted(roles: pd.Series, parts: pd.Series) -> pd.DataFrame:
        rows = [format_turn(r if isinstance(r, str) else None, p) for r, p in zip(roles, parts)]
        return pd.DataFrame(rows, columns=FORMATTED.fieldNames()).astype({"loss_start": "Int32", "loss_end": "Int32"})

    def plain(parts: Column) -> Column:  # lists of structs reach the function as lists of dictionaries
        return parts.cast(f"array<struct<{PART.replace(' ', ':').replace(',:', ',')}>>")

    return turns.withColumn("f", formatted(F.col(role_col), plain(F.col(parts_col)))).select(*turns.columns, "f.*")


def read_back(formatted: DataFrame, order: list[str], id_col: str = "conv_id") -> DataFrame:
    """Per conversation the digests of what its formatted turns say, read in ``order``.

    ``turns_sha256`` is over role and text of each turn, ``loss_sha256`` over the text under the loss mask.
    """
    id_type = formatted.schema[id_col].dataType.simpleString()
    needed = [id_col, "formatted", "loss_start", "loss_end", "attachments", "expanded_tokens"]
    lean = formatted.select(*dict.fromkeys([*needed, *order])).repartition(id_col).sortWithinPartitions(id_col, *order)
    lean = lean.select(
        F.col(id_col).alias("conv_id"), F.isnull(id_col).alias("no_id"), "formatted", "loss_start", "loss_end",
        F.size("attachments").alias("n_attachments"), "expanded_tokens",
    )

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "expanded_tokens"]
        now, state, done = None, None, []

        def close() -> None:
            if state is not None:
                n, turns, chars, loss, length, attached, tokens = state
                done.append((None if now[1] else now[0], n, turns.hexdigest(), chars, loss.hexdigest(), length, attached, tokens))

        for pdf in batches:
            for conv, no_id, text, start, end, attached, tokens in pdf.itertuples(index=False):
                at = (0 if no_id else conv, no_id)
                if at != now:
                    close()
                    now, state = at, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                role, content = parse_turn(text)
                state[0] += 1
                state[1].update(f"{role}\n{content}\n".encode())
                if start is not None and start == start:
                    masked = unescape(text[int(start):int(end)])
                    state[2] += len(masked)
                    state[3].update(masked.encode())
                state[4] += len(text)
                state[5] += int(attached)
                state[6] += int(tokens)
            if done:
                yield pd.DataFrame(done, columns=names).astype({"conv_id": "object"})
                done = []
        close()
        if done:
            yield pd.DataFrame(done, columns=names).astype({"conv_id": "object"})

    return lean.mapInPandas(digest, DIGEST.format(id_type=id_type))
