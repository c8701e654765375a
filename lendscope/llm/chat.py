"""Chat formatting with typed content parts.

A message is an ordered list of parts (text, image, audio, document).  A visitor flattens them: text is escaped and
kept, every other part becomes a placeholder ``<|image:3|>`` numbered in order within its conversation turn, its
reference is recorded, and the number of tokens that the placeholder stands for is counted.  Each turn is written as
``<|turn:role|>\\n body <|end|>\\n``; control strings inside texts and roles are escaped reversibly, so the formatted
text can be read back to the same turns, and the loss mask is the body of every assistant turn.

At scale: formatting is map-only, turn by turn.  A digest of a conversation needs its turns in order, so turns are
hashed by ``conv_id``, sorted on disk by Spark and streamed through a running digest: a conversation of any length
holds one Arrow batch in memory, never a collected group.

Null text: empty; null role: the empty role; null ``conv_id``: a conversation of its own; null turn: before all
others.  Rows that tie in (conv_id, turn) are ordered by role and text.  Empty table: no rows.  Unknown part types
raise, as a part without a rule would be lost silently.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready

PART = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
TURN = ("conv_id long, turn long, formatted string, loss_start long, loss_end long, "
        "refs array<string>, media_tokens long")
DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
          "formatted_chars long, media_tokens long")
#: Tokens a placeholder stands for: image tiles of 28 x 28 pixels, audio frames a second, tokens a page.
TILE, FRAMES, PAGE = 28, 25, 512
#: Opening characters of control strings (``<|end|>``, ``</s>``, ``[INST]``) and the escape itself.
_ESCAPE = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_PLAIN = {v: k for k, v in _ESCAPE.items()}
_HEAD, _END = re.compile(r"<\|turn:(.*?)\|>\n", re.S), "<|end|>\n"


def escape(text: str) -> str:
    """No control string survives in the result: each needs ``<`` or ``[``."""
    return re.sub(r"[\\<\[]", lambda m: _ESCAPE[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\[\\lb]", lambda m: _PLAIN[m[0]], text)


class Flat(NamedTuple):
    body: str
    refs: list[str]
    tokens: int


class Flattener:
    """Visitor over typed parts: one method per type."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.refs: list[str] = []
        self.tokens = 0

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        method = getattr(self, f"visit_{kind}", None)
        if method is None:
            raise ValueError(f"no rule for a content part of type {kind!r}")
        method(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part.get("text") or ""))

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.out.append(f"<|{kind}:{len(self.refs)}|>")
        self.refs.append(part.get("ref") or "")
        self.tokens += tokens

    def visit_image(self, part: dict) -> None:
        across, down = (-(-max(part.get(k) or 0, 1) // TILE) for k in ("width", "height"))
        self._attach("image", part, across * down)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, round((part.get("seconds") or 0.0) * FRAMES)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, part.get("pages") or 0) * PAGE)

    def result(self) -> Flat:
        return Flat("".join(self.out), self.refs, self.tokens)


def flatten(parts: list[dict] | None) -> Flat:
    visitor = Flattener()
    for part in parts or []:
        visitor.visit(part or {})
    return visitor.result()


def format_turn(role: str | None, flat: Flat) -> tuple[str, int, int]:
    """The formatted turn and the span of its loss mask (empty unless the assistant speaks)."""
    head = f"<|turn:{escape(role or '')}|>\n"
    text = head + flat.body + _END
    return (text, len(head), len(head) + len(flat.body)) if role == "assistant" else (text, 0, 0)


def read_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of a formatted turn; placeholders of attachments stay as they are."""
    head = _HEAD.match(formatted)
    if not head or not formatted.endswith(_END):
        raise ValueError("not a formatted turn")
    return unescape(head[1]), unescape(formatted[head.end():len(formatted) - len(_END)])


def format_turns(turns: DataFrame) -> DataFrame:
    """Format each turn of (conv_id, turn, role, and ``parts`` or plain ``text``)."""
    ready(turns.sparkSession)
    if "parts" in turns.columns:
        parts = F.col("parts").cast(PART)
    else:
        parts = F.array(F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"),
                                 F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"),
                                 F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"),
                                 F.lit(None).cast("int").alias("pages")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, turn, roles, contents = (c.to_pylist() for c in batch.columns)
            flats = [flatten(p) for p in contents]
            done = [format_turn(r, f) for r, f in zip(roles, flats)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(conv, pa.int64()), pa.array(turn, pa.int64()), pa.array([d[0] for d in done], pa.string()),
                 pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64()),
                 pa.array([f.refs for f in flats], pa.list_(pa.string())),
                 pa.array([f.tokens for f in flats], pa.int64())],
                names=["conv_id", "turn", "formatted", "loss_start", "loss_end", "refs", "media_tokens"])

    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"),
                        parts.alias("parts")).mapInArrow(run, TURN)


def digest(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted turns in order."""
    ready(formatted.sparkSession)
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in DIGEST.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        state: list | None = None  # conv, turns, digest, loss characters, loss digest, formatted characters, media

        def close(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            rows = []
            for conv, text, a, b, media in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or state[0] != conv:
                    if state is not None:
                        rows.append([*state[:2], state[2].hexdigest(), state[3], state[4].hexdigest(), *state[5:]])
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                role, body = read_turn(text)
                loss = unescape(text[a:b])
                state[1] += 1
                state[2].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                state[3] += len(loss)
                state[4].update(loss.encode("utf-8", "surrogatepass"))
                state[5] += len(text)
                state[6] += media
            if rows:
                yield close(rows)
        if state is not None:
            yield close([[*state[:2], state[2].hexdigest(), state[3], state[4].hexdigest(), *state[5:]]])

    return ordered.select("conv_id", "formatted", "loss_start", "loss_end", "media_tokens").mapInArrow(run, DIGEST)


#: The same digests in DuckDB, for plain text turns and one added conversation.
SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(18 + 2 * (length(role) + length(text))
    - length(translate(role, '\\<[', '')) - length(translate(text, '\\<[', ''))) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS media_tokens
FROM t GROUP BY conv_id
"""
