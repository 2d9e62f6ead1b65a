"""Benchmark items inside documents, also with small edits.

Edit distance is embedded into Hamming distance by random walks (Chakraborty, Goldenberg and
Koucky, 2016): a walk along a string writes its character at every step and moves on or stays by a
random bit of step and character, so that two walks over strings with few edits soon fall
into step again. Bits (here characters) of the embedding are sampled, some at a time, by
repeated locality-sensitive keys; windows that agree with an item on one key are verified by exact
edit distance.

Windows have the size of an item and are placed where the document has pieces of it. An item is cut into pieces of ``PIECE``
characters. Each edit spoils one of them at most, and what is left lies on diagonals (place in the text less place in the item) that
differ by no more than the edits. So a copy has at least as many pieces, close together, as there are more pieces than
edits; and of all runs of ``PIECE`` characters it keeps all but ``PIECE`` for each edit, on such diagonals. No copy is lost by these two counts. From each of
the pieces that are left a window is walked, to its end or back to its start, whichever is longer.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import islice
from uuid import uuid4

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.frames import map_rows
from plumbline.llm.words import mixed, split_words

#: An item is found where this share of its characters' number, or fewer, are edits.
MOST_EDITS = 0.15
#: Items of fewer words and fewer characters are not searched: they occur by chance. Items are cut into pieces of ``PIECE`` characters.
LEAST_WORDS, LEAST_CHARS, PIECE = 5, 25, 5
#: Keys, characters of the embedding in each, and steps of a walk for each character of the window.
KEYS, SAMPLED, STRETCH = 16, 2, 3
#: Longest part of a window that is walked along; verification is always by the whole item.
WALK = 256
#: Pieces of a text that are looked at together.
TOGETHER = 1 << 20
#: Bytes of items that are searched for in one pass over the documents.
BLOCK = 8 << 20


def edit_distance_inside(item: str, text: str) -> int:
    """The least edit distance of ``item`` to any substring of ``text``, by bit vectors (Myers, 1999)."""
    m = len(item)
    if not m:
        return 0
    where: dict[str, int] = defaultdict(int)
    for i, letter in enumerate(item):
        where[letter] |= 1 << i
    every, last = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = every, 0, m, m
    for letter in text:
        equal = where.get(letter, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (every & ~(horizontal | plus))
        down = plus & horizontal
        if up & last:
            score += 1
        elif down & last:
            score -= 1
        best = min(best, score)
        up, down = (up << 1) & every, (down << 1) & every
        plus = down | (every & ~(vertical | up))
        minus = up & vertical
    return best


def _piece_hashes(text: str) -> np.ndarray:
    """A hash of the ``PIECE`` characters at each place of ``text``."""
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    rolled = np.zeros(max(0, len(letters) - PIECE + 1), np.uint64)
    for i in range(PIECE):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + letters[i : i + len(rolled)]
    return mixed(rolled)


class Walks:
    """Random walks with shared coins: sampled characters of the embeddings of many strings at once."""

    def __init__(self, seed: int = 5):
        generator = np.random.default_rng(seed)
        self.coins = generator.integers(0, 2, (KEYS, STRETCH * WALK, 256), np.uint8)
        self.places = np.sort(generator.random((KEYS, SAMPLED)), axis=1)

    def sampled(self, strings: list[bytes], sizes: list[int]) -> np.ndarray:
        """``strings x KEYS x SAMPLED`` characters; ``sizes`` are the lengths to walk for, 1 or more.

        Strings that are shorter are continued by zeros.
        """
        sizes = np.minimum(np.array(sizes), WALK)
        longest = int(sizes.max()) if len(sizes) else 0
        text = np.frombuffer(b"".join(s[:longest].ljust(longest + 1, b"\0") for s in strings), np.uint8).reshape(len(strings), -1)
        stops = np.minimum((self.places[None] * (STRETCH * sizes[:, None, None])).astype(np.int64), STRETCH * WALK - 1)
        rows, keys = np.arange(len(strings))[:, None], np.arange(KEYS)[None]
        at = np.zeros((len(strings), KEYS), np.int64)
        result = np.zeros(stops.shape, np.uint8)
        for step in range(int(stops.max()) + 1 if len(strings) else 0):
            now = text[rows, np.minimum(at, longest)]
            for i in range(SAMPLED):
                reached = stops[:, :, i] == step
                result[:, :, i][reached] = now[reached]
            at += self.coins[keys, step, now]
        return result


class Items:
    """The items of a block, by the pieces in them."""

    def __init__(self, items: Iterable[tuple[object, str]]):
        self.ids, self.texts = [], []
        for key, text in items:
            words = split_words(text)
            own = b" ".join(words).decode("utf-8", "replace")
            if len(words) >= LEAST_WORDS or len(own) >= LEAST_CHARS:
                self.ids.append(key)
                self.texts.append(own)
        self.runs = []
        for text in self.texts:
            own = _piece_hashes(text)
            order = np.argsort(own, kind="stable")
            self.runs.append((own[order], order))
        distinct = [np.unique(own) for own, _ in self.runs]
        runs, known_to = np.unique(np.concatenate([np.empty(0, np.uint64), *distinct]), return_counts=True)
        self.lengths = np.array([len(text) for text in self.texts], np.int64)
        self.limits = np.array([self.most_edits(i) for i in range(len(self.texts))], np.int64)
        self.needed = np.ones(len(self.texts), np.int64)
        hashes, owners, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for item, text in enumerate(self.texts):
            own = _piece_hashes(text)
            spare = len(text) // PIECE - self.limits[item] - 1
            at = np.arange(0, len(own), PIECE if spare >= 0 else 1)
            # Half of the pieces to spare are left out, those that most items have.
            left = max(0, int(spare) // 2)
            common = known_to[np.searchsorted(runs, own[at])]
            at = at[np.lexsort((at, -common))][left:]
            self.needed[item] = max(1, spare + 1 - left)
            hashes.append(own[at])
            owners.append(np.full(len(at), item))
            places.append(at)
        every = np.concatenate(hashes)
        order = np.argsort(every, kind="stable")
        self.owners, self.places = np.concatenate(owners)[order], np.concatenate(places)[order]
        self.hashes, first = np.unique(every[order], return_index=True)
        self.bounds = np.append(first, len(every))
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.hashes >> np.uint64(42)).astype(np.int64)] = True
        self.pieces = [dict[int, list[int]]() for _ in self.texts]
        for h, item, place in zip(every[order].tolist(), self.owners.tolist(), self.places.tolist()):
            self.pieces[item].setdefault(h, []).append(place)
        self.walks = Walks()
        self.keys: dict[tuple[int, int], np.ndarray] = {}

    def most_edits(self, item: int) -> int:
        return int(MOST_EDITS * len(self.texts[item]))

    def _regions(self, hashes: np.ndarray) -> list[tuple[int, int, int]]:
        """``(item, first, last)`` of the stretches of a text that may have a copy of an item, by the ``hashes`` of its places."""
        at = np.flatnonzero(self.seen[(hashes >> np.uint64(42)).astype(np.int64)])
        which = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        same = self.hashes[which] == hashes[at]
        at, which = at[same], which[same]
        if not len(at):
            return []
        starts, many = self.bounds[which], self.bounds[which + 1] - self.bounds[which]
        cuts = np.searchsorted(np.cumsum(many) // TOGETHER, np.arange(1, int(many.sum()) // TOGETHER + 1))
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for part in np.split(np.arange(len(at)), cuts):
            n = many[part]
            piece = np.repeat(starts[part] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            item = self.owners[piece]
            diagonal = np.repeat(at[part], n) - self.places[piece] + self.lengths[item]
            some, found = np.unique((item << 40) | diagonal // (self.limits[item] + 1), return_counts=True)
            keys, back = np.unique(np.concatenate([keys, some]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, found]), len(keys)).astype(np.int64)
        # Diagonals that differ by no more than the edits lie in one stripe or in two neighbouring ones.
        both = counts.copy()
        both[:-1] += np.where(keys[1:] == keys[:-1] + 1, counts[1:], 0)
        keys = keys[both >= self.needed[keys >> 40]]
        regions: list[list[int]] = []
        for key in keys.tolist():
            item, stripe = key >> 40, key & ((1 << 40) - 1)
            size, limit = len(self.texts[item]), int(self.limits[item])
            first = max(0, stripe * (limit + 1) - size - limit)
            last = (stripe + 2) * (limit + 1) + 2 * limit
            kept, low = size - PIECE + 1 - PIECE * limit, stripe * (limit + 1) - size
            if kept > 1 and self._runs_kept(item, hashes[first : last - PIECE + 1], low - first, low - first + 2 * limit + 1) < kept:
                continue
            if regions and regions[-1][0] == item and first <= regions[-1][2]:
                regions[-1][2] = last
            else:
                regions.append([item, first, last])
        return [(item, first, last) for item, first, last in regions]

    def _runs_kept(self, item: int, there: np.ndarray, low: int, high: int) -> int:
        """How many places of ``there`` begin a run of the item on one of the diagonals ``low`` to ``high``."""
        own, places = self.runs[item]
        left = np.searchsorted(own, there, "left")
        many = np.searchsorted(own, there, "right") - left
        at = np.repeat(np.arange(len(there)), many)
        diagonals = at - places[np.repeat(left - (np.cumsum(many) - many), many) + np.arange(len(at))]
        return len(np.unique(at[(diagonals >= low) & (diagonals <= high)]))

    def _windows(self, hashes: np.ndarray, region: tuple[int, int, int]) -> list[tuple[int, int]]:
        """``(place, place in the item)`` of the item's pieces in a region, those in the middle of it first."""
        item, first, last = region
        pieces, limit = self.pieces[item], int(self.limits[item])
        found = [
            (first + i, place) for i, h in enumerate(hashes[first : last - PIECE + 1].tolist()) for place in pieces.get(h, ())
            if first <= first + i - place + limit and first + i - place - limit <= last
        ]
        return found[len(found) // 2 :] + found[: len(found) // 2][::-1]

    def _side(self, text: str, place: int, item: int, at: int, slack: int) -> tuple[bytes, int]:
        """What is walked of the window with ``place`` at the item's ``at``, and for how long: the text from there on, or before it backwards."""
        ahead = len(self.texts[item]) - at
        if ahead >= at:
            side, size = text[place : place + min(ahead + slack, WALK)], self.texts[item][at : at + WALK]
        else:
            reach = min(at + slack, WALK)
            side, size = text[max(0, place - reach) : place][::-1], self.texts[item][max(0, at - WALK) : at]
        return side.encode("utf-8", "replace"), len(size.encode("utf-8", "replace"))

    def agree(self, windows: list[tuple[str, int, int, int]]) -> list[bool]:
        """Whether each window ``(text, place, item, place in the item)`` shares a key with its item."""
        needed = list(dict.fromkeys((item, at) for _, _, item, at in windows if (item, at) not in self.keys))
        for chosen in (needed[i : i + 500] for i in range(0, len(needed), 500)):
            sides = [self._side(self.texts[item], at, item, at, 0) for item, at in chosen]
            for key, value in zip(chosen, self.walks.sampled([s for s, _ in sides], [n for _, n in sides])):
                self.keys[key] = value
        result: list[bool] = []
        for part in (windows[i : i + 500] for i in range(0, len(windows), 500)):
            sides = [self._side(text, place, item, at, int(self.limits[item])) for text, place, item, at in part]
            own = np.stack([self.keys[item, at] for _, _, item, at in part])
            found = self.walks.sampled([s for s, _ in sides], [n for _, n in sides])
            result += (found == own).all(axis=2).any(axis=1).tolist()
        return result

    def find(self, texts: list[str | None]) -> list[list[tuple[object, int, int]]]:
        """For each text ``(item id, distance, item length)`` of every item found in it."""
        found: list[dict[int, int]] = [{} for _ in texts]
        waiting: list[tuple[int, str, tuple[int, int, int], Iterator[tuple[int, int]]]] = []
        for owner, text in enumerate(texts):
            whole = b" ".join(split_words(text)).decode("utf-8", "replace")
            if len(whole) < PIECE or not len(self.hashes):
                continue
            hashes = _piece_hashes(whole)
            for region in self._regions(hashes):
                waiting.append((owner, whole, region, iter(self._windows(hashes, region))))
        together = 1
        while waiting:
            tried = [(each, windows) for each in waiting if (windows := list(islice(each[3], together)))]
            same = iter(self.agree([(each[1], place, each[2][0], at) for each, windows in tried for place, at in windows]))
            together *= 4
            waiting = []
            for each, windows in tried:
                owner, whole, (item, first, last), _ = each
                if not any(list(islice(same, len(windows)))):
                    waiting.append(each)
                    continue
                distance = edit_distance_inside(self.texts[item], whole[first:last])
                if distance <= min(int(self.limits[item]), found[owner].get(item, len(whole))):
                    found[owner][item] = distance
        return [[(self.ids[i], d, int(self.lengths[i])) for i, d in sorted(f.items())] for f in found]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """``(doc_id, item_id, distance, item_chars)``: the items of ``benchmark (item_id, text)`` that occur in each document.

    Compared are words of A-Z as a-z with single spaces between. An item is found where a substring is within
    ``MOST_EDITS`` of its length in edits; ``distance`` is the least seen. A document with two items has two rows, one without
    has none. NULL, empty and blank texts and items, and items of fewer than ``LEAST_WORDS`` words and ``LEAST_CHARS`` characters, are found
    nowhere; items of 9 or 14 characters only where ``PIECE`` of them in a row are unchanged. Repeated documents and items are found each. Without documents or items: no rows. Other columns are not
    looked at. Items go to the executors in blocks of about ``BLOCK`` bytes, each a pass over the documents.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col("text").alias("text")).filter("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / BLOCK))
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    columns = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    result = None
    for block in range(blocks):
        chosen = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in chosen.collect()])

        def run(ids, texts, shared=shared, name=uuid4().hex):
            found = _items(name, shared.value).find(texts)
            rows = [(key, *hit) for key, hits in zip(ids, found) for hit in hits]
            return [[row[i] for row in rows] for i in range(4)]

        part = map_rows(columns, ["doc_id", "text"], run, f"doc_id {kinds[0]}, item_id {kinds[1]}, distance bigint, item_chars bigint")
        result = part if result is None else result.unionByName(part)
    return result


_built: dict[object, Items] = {}


def _items(key: object, items: list[tuple[object, str]]) -> Items:
    """The items of a broadcast, built once per Python worker."""
    if key not in _built:
        _built.clear()
        _built[key] = Items(items)
    return _built[key]


def without_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the documents in which an item is found; rows with a NULL id are searched as well and go
    if any of them has an item."""
    found = contaminated(docs, benchmark, id_col).select(F.col("doc_id").alias("__found")).distinct()
    return docs.join(found, docs[id_col].eqNullSafe(found["__found"]), "left_anti")
