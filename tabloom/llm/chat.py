r"""Chat formatting by columnar byte assembly.

A turn becomes ``### role: text</turn>`` and a line feed.  Inside roles and texts the backslash, ``#``, ``<`` (and in roles
the colon) are written as a backslash and a letter, so no text can hold a control string, and reading back is exact.
For a whole Arrow batch the lengths of all segments are computed in numpy, their running sum gives every segment's
place, and headers, roles and texts are scattered into one preallocated buffer, which becomes the Arrow column
without a copy.  The loss mask of a part is the list of (start, length) in bytes of its assistant texts.

Rows of a conversation are brought together and sorted by turn; the result has one row for each conversation and
Arrow batch (``part`` counts them), so a conversation of any length passes through in bounded memory.  Its digest
is sequential by nature and is made by the task that holds it, turn after turn.

Edge cases: NULL roles and texts are empty; rows of one turn number are ordered by role, then text; NULL turns come
first; rows with a NULL conversation form one conversation; repeated rows are repeated turns; an empty table
gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.llm.common import pieces, raw_bytes, table

HEAD, MIDDLE, END = b"### ", b": ", b"</turn>\n"
LETTERS = {ord("\\"): b"\\", ord("#"): b"h", ord("<"): b"l", ord(":"): b"c"}
_BACK = {letter: bytes([byte]) for byte, letter in LETTERS.items()}


def _specials(chars: str) -> tuple[np.ndarray, np.ndarray]:
    special, code = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
    for c in chars:
        special[ord(c)], code[ord(c)] = True, LETTERS[ord(c)][0]
    return special, code


IN_TEXT, IN_ROLE = _specials("\\#<"), _specials("\\#<:")


def escaped(texts: pa.Array, rule: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the escaped texts."""
    raw, offsets = raw_bytes(pc.fill_null(texts, ""))
    special = rule[0][raw]
    before = np.concatenate([[0], np.cumsum(special)])
    out = np.empty(len(raw) + before[-1], np.uint8)
    place = np.arange(len(raw)) + before[1:]
    out[place] = rule[1][raw]
    out[place[special] - 1] = ord("\\")
    return out, offsets + before[offsets]


def unescaped(data: bytes) -> bytes:
    return re.sub(rb"\\(.)", lambda m: _BACK[m[1]], data, flags=re.S) if b"\\" in data else data


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, ends of rows, start and length of each text in the buffer)."""
    parts = [escaped(roles, IN_ROLE), escaped(texts, IN_TEXT)]
    n = len(texts)
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = len(HEAD), len(MIDDLE), len(END)
    for column, (_, offsets) in zip((1, 3), parts):
        lengths[:, column] = np.diff(offsets)
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    starts = ends - lengths
    buffer = np.empty(int(ends[-1, 4]) if n else 0, np.uint8)
    for column, fixed in ((0, HEAD), (2, MIDDLE), (4, END)):
        buffer[starts[:, column, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
    for column, (data, offsets) in zip((1, 3), parts):
        buffer[np.repeat(starts[:, column] - offsets[:-1], lengths[:, column]) + np.arange(len(data))] = data
    return buffer, ends[:, 4], starts[:, 3], lengths[:, 3]


def formatted(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
              trained: str = "assistant") -> DataFrame:
    """Rows of (conv_id, part, n_turns, formatted, loss_start, loss_length); a conversation's rows lie in one partition,
    in order."""
    rows = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"),
                     F.col(text).cast("string").alias("text"))
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = object(), -1
        for batch in batches:
            for piece in pieces(batch):
                ids = piece.column("conv_id")
                codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                first = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])
                stop = np.append(first[1:], len(codes))
                buffer, ends, at, length = assemble(piece.column("role"), piece.column("text"))
                offsets = np.concatenate([[0], ends[stop - 1]])
                texts = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(buffer))
                loss = pc.fill_null(pc.equal(piece.column("role"), trained), False).to_numpy(zero_copy_only=False)
                of = np.repeat(np.arange(len(first)), stop - first)[loss]
                lists = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(first)))]).astype(np.int32)
                names = ids.take(pa.array(first))
                numbers = np.zeros(len(first), np.int32)
                part = part + 1 if names[0].as_py() == last else 0
                numbers[0] = part
                last, part = names[-1].as_py(), int(numbers[-1])
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array(numbers), pa.array(stop - first), texts.cast(pa.string()),
                     pa.ListArray.from_arrays(lists, pa.array(at[loss] - offsets[of])),
                     pa.ListArray.from_arrays(lists, pa.array(length[loss]))],
                    ["conv_id", "part", "n_turns", "formatted", "loss_start", "loss_length"])

    return (rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .mapInArrow(run, f"conv_id {kind}, part int, n_turns long, formatted string, loss_start array<long>, "
                             "loss_length array<long>"))


def turns(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The (role, text) pairs of formatted turns."""
    for segment in data.split(END)[:-1]:
        if not segment.startswith(HEAD):
            raise ValueError("not a formatted turn")
        role, _, text = segment[len(HEAD):].partition(MIDDLE)
        yield unescaped(role), unescaped(text)


def digests(parts: DataFrame) -> DataFrame:
    """What reading the parts of ``formatted`` back gives, one row for each conversation."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now = [], None

        def out() -> pa.RecordBatch:
            types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)

        def close() -> None:
            key, n, whole, chars, loss, length = now
            done.append((key, n, whole.hexdigest(), chars, loss.hexdigest(), length))

        for batch in batches:
            id_type = batch.column("conv_id").type
            for row in batch.to_pylist():
                if now is None or row["part"] == 0:
                    if now is not None:
                        close()
                    now = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                data = row["formatted"].encode()
                for role, text in turns(data):
                    now[1] += 1
                    now[2].update(role + b"\n" + text + b"\n")
                for start, length in zip(row["loss_start"], row["loss_length"]):
                    text = unescaped(data[start:start + length])
                    now[3] += len(text.decode())
                    now[4].update(text)
                now[5] += len(row["formatted"])
            if done:
                yield out()
                done = []
        if now is not None:
            close()
            yield out()

    return parts.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                 "formatted_chars long")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(F.lit(-7).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"),
                                 F.lit("\\### Assistant: </turn> ok"))
    return digests(formatted(rows.union(trap)))


OP6_SQL = r"""
WITH all_turns AS (SELECT conv_id, turn, role, text FROM conversations
                   UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
  filled AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM all_turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(14 + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g'))
           + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')))::BIGINT AS formatted_chars
FROM filled GROUP BY conv_id"""
