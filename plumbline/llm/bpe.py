"""Byte-level BPE with a published vocabulary: encoding and decoding.

A piece's merges are driven by a segment tree over its adjacent pairs. A leaf holds the
rank of the pair that starts there, with its place; an inner node holds the lesser of its
children, so that the root is the leftmost pair of lowest rank. A merge changes
three leaves, each a climb of logarithmic length, until no pair at the root can merge.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.frames import map_rows

#: How byte-level vocabularies cut a text into pieces (a fixed value of the format).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A vocabulary file above this size is refused, as every executor gets a copy.
LARGEST_VOCABULARY = 64 << 20
#: Texts longer than this are cut into pieces a stretch at a time.
STRETCH = 1 << 19
_NONE = 1 << 62
_PLACE = (1 << 32) - 1


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 characters
    stand for themselves, the other bytes for the code points from 256 on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Encoder and decoder of one vocabulary (the JSON text of its file)."""

    REMEMBERED = 200_000

    def __init__(self, text: str):
        data = json.loads(text)
        letters, ids = byte_letters(), data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for a, b in pairs:
            if (key := ids[a] << 32 | ids[b]) not in self.rank:
                self.rank[key] = len(self.merged)
                self.merged.append(ids[a + b])
        self.byte_id = [0] * 256
        for letter, byte in letters.items():
            self.byte_id[byte] = ids[letter]
        words = {i: bytes(letters[x] for x in token) for token, i in ids.items()}
        words |= {i: token.encode() for token, i in self.special.items()}
        self.token = [words.get(i, b"") for i in range(max(words) + 1)]
        self.pieces = regex.compile(PIECES)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.byte_ids = np.array(self.byte_id)
        self.pair_keys = np.array(sorted(self.rank))
        self.pair_ranks = np.array([self.rank[k] for k in self.pair_keys.tolist()])
        self.merged_ids = np.array(self.merged)
        self.first = {token: i.to_bytes(4, "little") for token, i in self.special.items()}
        self.known = dict(self.first)

    def merge(self, ids: list[int]) -> list[int]:
        """The ids after all merges."""
        n, rank = len(ids), self.rank
        if n < 2:
            return ids
        size = 1 << (n - 2).bit_length()
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            found = rank.get(ids[i] << 32 | ids[i + 1])
            if found is not None:
                tree[size + i] = found << 32 | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (root := tree[1]) != _NONE:
            place = root & _PLACE
            gone = after[place]
            follower = after[gone]
            ids[place] = self.merged[root >> 32]
            ids[gone] = -1
            after[place] = follower
            changed = [(gone, _NONE)]
            if follower < n:
                before[follower] = place
                found = rank.get(ids[place] << 32 | ids[follower])
                changed.append((place, _NONE if found is None else found << 32 | place))
            else:
                changed.append((place, _NONE))
            if (left := before[place]) >= 0:
                found = rank.get(ids[left] << 32 | ids[place])
                changed.append((left, _NONE if found is None else found << 32 | left))
            for leaf, value in changed:
                i = size + leaf
                if i >= 2 * size or tree[i] == value:
                    continue
                tree[i] = value
                while i > 1:
                    other = tree[i ^ 1]
                    i >>= 1
                    least = value if value < other else other
                    if tree[i] == least:
                        break
                    tree[i] = value = least
        return [i for i in ids if i >= 0]

    def _stretches(self, text: str) -> Iterator[str]:
        """The text cut before single spaces after other characters, where pieces always end."""
        start = 0
        while len(text) - start > STRETCH:
            at = text.find(" ", start + STRETCH)
            while at > 0 and text[at - 1].isspace():
                at = text.find(" ", at + 1)
            if at < 0:
                break
            yield text[start:at]
            start = at
        yield text[start:]

    def merge_many(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of many short pieces of two bytes or more, with one row of a matrix of trees for each piece."""
        results: list[np.ndarray] = [None] * len(pieces)
        lengths = np.array([len(p) for p in pieces])
        sizes = 1 << np.ceil(np.log2(np.maximum(lengths - 1, 1))).astype(int)
        for size in np.unique(sizes):
            chosen = np.flatnonzero(sizes == size)
            ids = self._merge_rows([pieces[i] for i in chosen], lengths[chosen], int(size))
            kept = ids >= 0
            ends = np.cumsum(kept.sum(axis=1)).tolist()
            flat = ids[kept].astype("<u4")
            for i, start, end in zip(chosen.tolist(), [0, *ends], ends):
                results[i] = flat[start:end]
        return results

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def _merge_rows(self, pieces: list[bytes], lengths: np.ndarray, size: int) -> np.ndarray:
        count, width = len(pieces), size + 1
        letters = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(count, width)
        places = np.arange(width)
        ids = np.where(places < lengths[:, None], self.byte_ids[letters], -1)
        tree = np.full((count, 2 * size), _NONE)
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        tree[:, size:] = np.where((ranks >= 0) & (ids[:, 1:] >= 0), ranks << 32 | places[:-1], _NONE)
        for i in range(size - 1, 0, -1):
            tree[:, i] = np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1])
        after = np.tile(places + 1, (count, 1))
        before = np.tile(np.arange(-1, width), (count, 1))
        rows = np.flatnonzero(tree[:, 1] != _NONE)

        def put(rows, leaves, values):
            nodes = leaves + size
            tree[rows, nodes] = values
            for _ in range(size.bit_length() - 1):
                nodes = nodes >> 1
                tree[rows, nodes] = np.minimum(tree[rows, 2 * nodes], tree[rows, 2 * nodes + 1])

        while len(rows):
            root = tree[rows, 1]
            place = root & _PLACE
            gone = after[rows, place]
            follower = after[rows, gone]
            ids[rows, place] = self.merged_ids[root >> 32]
            ids[rows, gone] = -1
            after[rows, place] = follower
            before[rows, follower] = place
            there = gone < size
            put(rows[there], gone[there], _NONE)
            last = follower >= lengths[rows]
            ranks = self._ranks(ids[rows, place], ids[rows, np.minimum(follower, size)])
            put(rows, place, np.where((ranks < 0) | last, _NONE, ranks << 32 | place))
            left = before[rows, place]
            there = left >= 0
            some, left, place = rows[there], left[there], place[there]
            ranks = self._ranks(ids[some, left], ids[some, place])
            put(some, left, np.where(ranks < 0, _NONE, ranks << 32 | left))
            rows = rows[tree[rows, 1] != _NONE]
        return ids

    def _pieces(self, text: str) -> Iterator[list[str]]:
        """The pieces of the text, a stretch at a time; special tokens are pieces."""
        for stretch in [text] if len(text) <= STRETCH else self._stretches(text):
            start, found = 0, []
            for special in self.cut.finditer(stretch) if self.cut else ():
                found += self.pieces.findall(stretch[start : special.start()])
                found.append(special.group())
                start = special.end()
            yield found + self.pieces.findall(stretch[start:]) if start else self.pieces.findall(stretch)

    def _learn(self, lists: list[list[str]]) -> None:
        """Remember the ids of all pieces."""
        every = set().union(*lists)
        fresh = every.difference(self.known)
        if len(self.known) + len(fresh) > self.REMEMBERED:
            self.known = dict(self.first)
            fresh = every.difference(self.known)
        short = {p: e for p in fresh if 1 < len(e := p.encode("utf-8")) <= 65}
        for piece, ids in zip(short, self.merge_many(list(short.values()))):
            self.known[piece] = ids.tobytes()
        for piece in fresh:
            if piece not in short:
                ids = self.merge([self.byte_id[b] for b in piece.encode("utf-8")])
                self.known[piece] = np.array(ids, "<u4").tobytes()

    def encode_many(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text as the library's encode() without added tokens; special tokens are found in the text.

        Works on about a stretch of text at a time: its new pieces are merged together.
        """
        waiting: list[list[str]] = []
        chars = 0

        def flush():
            self._learn(waiting)
            known = self.known.__getitem__
            return [np.frombuffer(b"".join(map(known, pieces)), "<u4") for pieces in waiting]

        for text in texts:
            if len(text) > STRETCH:
                yield from flush()
                waiting, chars, parts = [], 0, []
                for pieces in self._pieces(text):
                    self._learn([pieces])
                    parts.append(b"".join(map(self.known.__getitem__, pieces)))
                yield np.frombuffer(b"".join(parts), "<u4")
                continue
            waiting.append(next(self._pieces(text)))
            chars += len(text)
            if chars > STRETCH:
                yield from flush()
                waiting, chars = [], 0
        yield from flush()

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_many([text]))

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.token.__getitem__, ids.tolist())).decode("utf-8", "replace")


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary_of(text: str) -> Vocabulary:
    """The vocabulary, built once per Python worker."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[key] = Vocabulary(text)
    return _vocabularies[key]


def shared_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The file's text for all executors. Read by the driver, so that only it needs the file."""
    with open(path, encoding="utf-8") as file:
        text = file.read(LARGEST_VOCABULARY + 1)
    if len(text) > LARGEST_VOCABULARY:
        raise ValueError(f"{path} is larger than {LARGEST_VOCABULARY} bytes")
    return spark.sparkContext.broadcast(text)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, tokens binary)`` for every row of ``docs``, by the vocabulary at ``path``;
    ``tokens`` holds the ids as little-endian 32-bit numbers.

    NULL and empty texts have no tokens. Long texts are cut a stretch at a time where a piece
    ends. Each row is encoded by itself: ids may be NULL or repeated. No rows: no rows. Other
    columns are not looked at.
    """
    shared = shared_vocabulary(docs.sparkSession, path)

    def run(ids, texts):
        vocabulary = vocabulary_of(shared.value)
        return ids, [tokens.tobytes() for tokens in vocabulary.encode_many(text or "" for text in texts)]

    kind = docs.schema[id_col].dataType.simpleString()
    columns = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(columns, ["doc_id", "text"], run, f"doc_id {kind}, tokens binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, tokens, text)``: the text of each row's ``tokens``; NULL and empty tokens give an empty text.

    Special tokens are kept, and bytes that are no UTF-8 become U+FFFD. An id outside the
    vocabulary is an error.
    """
    shared = shared_vocabulary(encoded.sparkSession, path)

    def run(ids, tokens):
        vocabulary = vocabulary_of(shared.value)
        return ids, tokens, [vocabulary.decode(np.frombuffer(row or b"", "<u4")) for row in tokens]

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return map_rows(encoded, ["doc_id", "tokens"], run, f"doc_id {kind}, tokens binary, text string")
