"""Chat formatting with a grammar round trip.

Each turn becomes `OPEN text CLOSE`, where the two marks depend on the role. A deterministic parser reads the rendered text
back; a turn whose text the parser doesn't return as it was has its control strings escaped (one more backslash before
each) and is parsed again, until what comes back is identical. All results are read from the parse, not from the source.

Turns are dealt by conversation, sorted, and streamed: a task holds PART characters of rendered text and two running
hashes, whatever the length of the conversation. A digest of all turns in order is sequential by nature, so one
conversation is one task's work; its memory doesn't grow.

Defined results: a null text or role counts as empty; turns are ordered by turn (null first), ties by role and text, and
rows that repeat a turn stay; rows with a null conv_id form one conversation of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import read_table

#: Characters of rendered text that are parsed at once.
PART = 1_000_000
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[TURN:", "[/TURN]")
_CONTROL = r"<</?SYS>>|\[/?INST\]|</?s>|\[TURN:[^\]\s]*\]|\[/TURN\]"
_MARK = re.compile(rf"(\\*)({_CONTROL})")
_ESCAPED = re.compile(rf"\\(\\*(?:{_CONTROL}))")
_OPEN = {a: (role, z) for role, (a, z) in MARKS.items()}
#: Between two turns.
JOIN = "\n"


class GrammarError(ValueError):
    """The text is no sequence of turns."""


def escape(text: str) -> str:
    return _MARK.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def marks(role: str) -> tuple[str, str]:
    return MARKS[role] if role in MARKS else (f"{OTHER[0]}{quote(role, safe='')}]", OTHER[1])


def render_turn(role: str, body: str) -> str:
    start, end = marks(role)
    return f"{start} {body} {end}{JOIN}"


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, unescaped text, start, end of the text as rendered) of each turn."""
    turns, at, role, close, start = [], 0, None, "", 0
    for m in _MARK.finditer(rendered):
        if m[1]:
            continue  # escaped: part of a text
        mark = m[2]
        if role is None:
            if m.start() != at:
                raise GrammarError(f"text outside a turn at {at}")
            if mark in _OPEN:
                role, close = _OPEN[mark]
            elif mark.startswith(OTHER[0]):
                role, close = unquote(mark[len(OTHER[0]) : -1]), OTHER[1]
            else:
                raise GrammarError(f"{mark} opens no turn at {m.start()}")
            start = m.end() + 1
            if rendered[m.end() : start] != " ":
                raise GrammarError(f"no space after {mark}")
        else:
            end = m.start() - 1
            if mark != close or end < start or rendered[end] != " ":
                raise GrammarError(f"{mark} inside a turn at {m.start()}")
            at = m.end() + len(JOIN)
            if rendered[m.end() : at] != JOIN:
                raise GrammarError(f"nothing joins the turns at {m.end()}")
            turns.append((role, unescape(rendered[start:end]), start, end))
            role = None
    if role is not None or at != len(rendered):
        raise GrammarError("the last turn doesn't end")
    return turns


def format_turn(role: str, text: str) -> str:
    """The turn as rendered, escaped only if its plain form doesn't come back as it was."""
    for body in (text, escape(text)):
        rendered = render_turn(role, body)
        try:
            if [(r, t) for r, t, *_ in parse(rendered)] == [(role, text)]:
                return rendered
        except GrammarError:
            pass
    raise GrammarError(f"a turn of {role!r} can't be rendered")


class _Conversation:
    """What has been read back of a conversation so far."""

    def __init__(self, conv_id):
        self.conv_id, self.held, self.source, self.size = conv_id, [], [], 0
        self.turns = self.loss_chars = self.chars = self.part = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, role: str, text: str) -> None:
        self.held.append(format_turn(role, text))
        self.source.append((role, text))
        self.size += len(self.held[-1])

    def flush(self) -> dict:
        """Read the held turns back; one part of the formatted conversation."""
        rendered = "".join(self.held)
        back = parse(rendered)
        if [(r, t) for r, t, *_ in back] != self.source:
            raise GrammarError(f"conversation {self.conv_id} doesn't come back as it was")
        spans = []
        for role, text, start, end in back:
            self.all.update(f"{role}\n{text}\n".encode())
            if role == "assistant":
                self.loss.update(text.encode())
                self.loss_chars += len(text)
                spans.append([self.chars + start, self.chars + end])
        out = {"conv_id": self.conv_id, "part": self.part, "formatted": rendered, "loss_spans": spans}
        self.turns += len(back)
        self.chars += len(rendered)
        self.part += 1
        self.held, self.source, self.size = [], [], 0
        return out

    def digest(self) -> dict:
        return {
            "conv_id": self.conv_id,
            "n_turns": self.turns,
            "turns_sha256": self.all.hexdigest(),
            "loss_chars": self.loss_chars,
            "loss_sha256": self.loss.hexdigest(),
            "formatted_chars": self.chars,
        }


def _stream(batches: Iterator[pd.DataFrame], texts: bool, frame) -> Iterator[pd.DataFrame]:
    now, out, room = None, [], 8 * PART

    def end() -> None:
        if now is not None:
            last = now.flush() if now.held else None
            out.extend([last] if texts and last else [] if texts else [now.digest()])

    for batch in batches:
        for conv_id, role, text in zip(batch["__conv"], batch["__role"], batch["__text"]):
            if now is None or now.conv_id != conv_id:
                end()
                now = _Conversation(conv_id)
            now.add(role, text)
            room -= len(now.held[-1]) if texts else 1
            if now.size >= PART:
                part = now.flush()
                out.extend([part] if texts else [])
            if room < 0:
                yield frame(out)
                out, room = [], 8 * PART
    end()
    yield frame(out)


def _formatted(conversations: DataFrame, texts: bool) -> DataFrame:
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select(
        F.col("conv_id").alias("__id"),
        F.col("conv_id").cast("string").alias("__conv"),  # pandas holds no integers beside nulls
        F.col("turn").alias("__turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("__role"),
        F.coalesce(F.col("text"), F.lit("")).alias("__text"),
    )
    columns = (
        "conv_id string, part int, formatted string, loss_spans array<array<bigint>>"
        if texts
        else "conv_id string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )
    names = [c.split()[0] for c in columns.split(", ")]

    def frame(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype=object) for n in names})

    dealt = rows.repartition("__id").sortWithinPartitions("__id", "__turn", "__role", "__text").drop("__id", "__turn")
    out = dealt.mapInPandas(lambda batches: _stream(batches, texts, frame), columns)
    return out.withColumn("conv_id", F.col("conv_id").cast(kind))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """The formatted text in parts of about PART characters: conv_id, part (from 0), formatted, loss_spans (start and end of
    each assistant text, in characters from the start of the conversation)."""
    return _formatted(conversations, texts=True)


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """What the parser reads back from each formatted conversation: counts and hashes."""
    return _formatted(conversations, texts=False)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.sql(
        "SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"
    )
    return conversation_digests(rows.union(hard))


OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), f AS (
  SELECT *, len(regexp_extract_all(text, '<</?SYS>>|\[/?INST\]|</?s>|\[TURN:[^\]\s]*\]|\[/TURN\]')) AS marks,
         CASE role WHEN 'system' THEN 7 + 8 WHEN 'user' THEN 6 + 7 WHEN 'assistant' THEN 3 + 4 ELSE 6 + length(url_encode(role)) + 1 + 7 END AS around FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(around + 3 + length(text) + marks)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
