"""Conversations as training text with an offset-aligned loss mask.

A conversation is rendered whole, ``MARK role MARK text`` for each turn and a ``MARK`` at the end,
and encoded once with offsets. The tokens under the loss are found by binary search of the
assistant turns' spans in the sorted spans of the tokens. ``MARK`` is the vocabulary's special token,
at which every encoder cuts, so that no token crosses the border of a text.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bpe import shared_vocabulary

MARK = "<|endoftext|>"
#: Strings that steer models; inside a text each is broken by a backslash after its first character.
CONTROL = (MARK, "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LEARNED = "assistant"
#: A conversation longer than this continues in another part, cut between turns.
PART = 1 << 20
#: Characters of rendered text that a task gathers before it hands them on.
TOGETHER = 1 << 18
_FIND = re.compile("|".join(map(re.escape, CONTROL)))
_UNDO = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """``text`` without control strings: backslashes doubled, a single one put into each control string."""
    return _FIND.sub(lambda m: m.group()[0] + "\\" + m.group()[1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _UNDO.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of the turns, and the sorted spans of those to be learned."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        body = escape(text)
        head = MARK + escape(role) + MARK
        start = at + len(head)
        at = start + len(body)
        parts += [head, body]
        if role == LEARNED:
            spans.append((start, at))
    return "".join(parts) + MARK, spans


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered text."""
    fields = [unescape(field) for field in text.split(MARK)[1:-1]]
    return list(zip(fields[::2], fields[1::2]))


def mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens (sorted by offset) share a character with a span."""
    change = np.zeros(len(starts) + 1, np.int64)
    if spans:
        borders = np.array(spans)
        first = np.searchsorted(ends, borders[:, 0], "right")
        last = np.searchsorted(starts, borders[:, 1], "left")
        some = first < last
        np.add.at(change, first[some], 1)
        np.add.at(change, last[some], -1)
    return np.cumsum(change[:-1]) > 0


def covered(text: str, starts: np.ndarray, ends: np.ndarray, masked: np.ndarray) -> list[str]:
    """The stretches of text under the masked tokens. Tokens that share a character count it once."""
    starts, ends = starts[masked], ends[masked]
    if not len(starts):
        return []
    reached = np.maximum.accumulate(ends)
    breaks = np.flatnonzero(starts[1:] > reached[:-1]) + 1
    firsts, lasts = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(starts)]]) - 1
    return [text[a:b] for a, b in zip(starts[firsts].tolist(), reached[lasts].tolist())]


_tokenizers: dict[str, object] = {}


def _tokenizer(text: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = Tokenizer.from_str(text)
    return _tokenizers[key]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, int, list[tuple[str, str]]]]:
    """``(conversation, part, turns)`` from rows sorted by conversation and turn."""
    conversation, part, turns, size, begun = None, 0, [], 0, False
    for batch in batches:
        for key, role, text in zip(*(column.to_pylist() for column in batch.columns)):
            if begun and key != conversation:
                yield conversation, part, turns
                part, turns, size = 0, [], 0
            elif begun and size > PART:
                yield conversation, part, turns
                part, turns, size = part + 1, [], 0
            conversation, begun = key, True
            turns.append((role or "", text or ""))
            size += len(role or "") + len(text or "")
    if begun:
        yield conversation, part, turns


def _lists(rows: Sequence[np.ndarray]) -> pa.Array:
    """An Arrow list for each array."""
    offsets = np.concatenate([[0], np.cumsum([len(row) for row in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows)))


def _rows_of(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The lists of an Arrow column as arrays, without a Python object for each element."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return (values[a:b] for a, b in zip(offsets[:-1], offsets[1:]))


def format_conversations(turns: DataFrame, path: str) -> DataFrame:
    """``(conv_id, part, text, tokens, starts, ends, mask)``: each conversation rendered and encoded by the
    tokenizers file at ``path``; ``mask`` says for each token whether its text is learned.

    ``turns`` has ``conv_id, turn, role, text``; other columns are not looked at. Turns go by ``turn``, NULL
    first; ties and repeated rows all stay, by role, then text. NULL roles and texts are empty; rows with a
    NULL ``conv_id`` are one conversation. A conversation of more than ``PART`` characters continues in further
    parts, cut between turns, where the encoder cuts as well, so that a task holds one part at a time
    however long the conversation. No rows: no rows.
    """
    shared = shared_vocabulary(turns.sparkSession, path)
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, part int, text string, tokens array<int>, starts array<int>, ends array<int>, mask array<boolean>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(shared.value)
        rows: list[tuple] = []
        held = 0
        for key, part, group in _parts(batches):
            text, spans = render(group)
            encoded = tokenizer.encode(text, add_special_tokens=False)
            offsets = np.fromiter(chain.from_iterable(encoded.offsets), np.int64, 2 * len(encoded)).reshape(-1, 2)
            starts, ends = offsets[:, 0].astype(np.int32), offsets[:, 1].astype(np.int32)
            rows.append((key, part, text, np.array(encoded.ids, np.int32), starts, ends, mask(starts, ends, spans)))
            held += len(text)
            if held >= TOGETHER:
                yield pack(rows)
                rows, held = [], 0
        if rows:
            yield pack(rows)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        plain = [pa.array(values, kind) for values, kind in zip(columns[:3], types)]
        return pa.RecordBatch.from_arrays([*plain, *map(_lists, columns[3:])], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    types = arrow.types
    rows = turns.select("conv_id", "turn", "role", "text").repartition("conv_id")
    rows = rows.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` of each conversation, from
    its rendered text, token offsets and mask alone. Parts are read in order, one at a time."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        open_row = None
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for key, text, starts, ends, masked in zip(keys, texts, *map(_rows_of, batch.columns[2:])):
                if open_row is None or key != open_row[0]:
                    if open_row is not None:
                        rows.append(finish(open_row))
                    open_row = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    open_row[1] += 1
                    open_row[2].update(f"{role}\n{said}\n".encode())
                under = covered(text, starts, ends, masked)
                for stretch in map(unescape, under):
                    open_row[3] += len(stretch)
                    open_row[4].update(stretch.encode())
                open_row[5] += len(text)
            if len(rows) >= 1000:
                yield pack(rows)
                rows = []
        if open_row is not None:
            yield pack([*rows, finish(open_row)])

    def finish(row):
        return [row[0], row[1], row[2].hexdigest(), row[3], row[4].hexdigest(), row[5]]

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=names)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    types, names = arrow.types, arrow.names
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.select("conv_id", "text", "starts", "ends", "mask").mapInArrow(run, schema)
