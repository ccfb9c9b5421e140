"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are its
context and only the reply itself is trainable.  What follows the last assistant
turn is kept as one context-only example, so the output holds every turn.

Template: ``### Role: text`` and a line ``</turn>`` per turn.  Inside texts a
backslash, ``###`` and ``</turn>`` get a backslash in front; each backslash of
the output therefore opens exactly one escape, and reading back is unambiguous.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame

OPEN, CLOSE = "### ", "\n</turn>\n"
TRAINABLE = "assistant"
FLUSH = 4_000_000  # characters of examples per output batch
_ESCAPE = re.compile(r"\\|###|</turn>")
_UNESCAPE = re.compile(r"\\(\\|###|</turn>)")
_TURN = re.compile(r"### ([^:\n]*): ((?:[^\\<]+|\\(?:\\|###|</turn>)|<(?!/turn>))*+)</turn>\n")
_NAMED = {r.capitalize(): r for r in ("system", "user", "assistant", "tool")}


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def header(role: str | None) -> str:
    """``### Role: ``; roles other than the four usual ones are quoted after an equals sign."""
    role = role or ""
    shown = role.capitalize() if role in _NAMED.values() else "=" + quote(role, safe="")
    return f"{OPEN}{shown}: "


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted example; raises if anything is left over."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m or not m[2].endswith("\n"):
            raise ValueError(f"no turn at {at}")
        role = unquote(m[1][1:]) if m[1].startswith("=") else _NAMED[m[1]]
        out.append((role, unescape(m[2][:-1])))
        at = m.end()
    return out


def prefix_target_examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end), code points; examples of a conversation follow each other in order.

    ``turns`` holds conv_id, turn, role, text; other columns are ignored.  Null
    texts and roles are empty; turns with the same number are ordered by role and
    text; a null conv_id is one conversation.  Rows stream in order, so a task
    holds one conversation's prefix at a time.
    """
    names = ["conv_id", "example", "text", "loss_start", "loss_end"]
    kinds = [pa.int64(), pa.int64(), pa.large_string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = run  # no conversation yet
        prefix, number, tail, held = "", 0, False, 0
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            cols[2] = cols[2].cast(pa.string())
            rows.clear()
            return pa.RecordBatch.from_arrays(cols, names=names)

        def rest() -> None:
            if tail:
                rows.append((now, number, prefix, len(prefix), len(prefix)))

        for b in batches:
            for conv, role, text in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if conv != now:
                    rest()
                    now, prefix, number, tail = conv, "", 0, False
                head, body = header(role), escape(text or "")
                start = len(prefix) + len(head)
                prefix = f"{prefix}{head}{body}{CLOSE}"
                tail = role != TRAINABLE
                if not tail:
                    rows.append((conv, number, prefix, start, start + len(body)))
                    number += 1
                    held += len(prefix)
                if held > FLUSH:
                    yield batch()
                    held = 0
        rest()
        if rows:
            yield batch()

    ordered = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, example long, text string, loss_start long, loss_end long")


def read_back(examples: DataFrame) -> DataFrame:
    """One row per conversation from the formatted examples alone (they must still lie in order, as they were made)."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = run
        longest, chars, loss, total, count = "", 0, hashlib.sha256(), 0, 0

        def row() -> tuple:
            turns = parse(longest)
            digest = hashlib.sha256()
            for role, text in turns:
                digest.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            return (now, len(turns), digest.hexdigest(), chars, loss.hexdigest(), total, count)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            rows = []
            for conv, text, start, end in zip(b.column(0).to_pylist(), b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if conv != now:
                    if now is not run:
                        rows.append(row())
                    now, longest, chars, loss, total, count = conv, "", 0, hashlib.sha256(), 0, 0
                longest = text.as_py()
                reply = unescape(longest[start:end])
                chars += len(reply)
                loss.update(reply.encode("utf-8", "surrogatepass"))
                total += len(longest)
                count += 1
            if rows:
                yield batch(rows)
        if now is not run:
            yield batch([row()])

    return examples.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long")


def chat_report(turns: DataFrame) -> DataFrame:
    """Contract rows of op9: all conversations and conversation -7, whose texts imitate the template."""
    tricky = r"\### Assistant: </turn> ok"
    extra = turns.sparkSession.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    base = turns.selectExpr("CAST(conv_id AS BIGINT) conv_id", "CAST(turn AS BIGINT) turn", "role", "text")
    return read_back(prefix_target_examples(base.unionByName(extra)))


def oracle_sql() -> str:
    """The contract rows of ``conversations`` in DuckDB's SQL: for system, user, assistant and tool turns."""
    return r"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS final,
    sum(length('### ' || role || ': ' || replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') || chr(10) || '</turn>' || chr(10))) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS chars
  FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) FILTER (role = 'assistant' OR final) AS BIGINT) AS formatted_chars, count(*) FILTER (role = 'assistant' OR final) AS n_examples
FROM f GROUP BY conv_id"""
