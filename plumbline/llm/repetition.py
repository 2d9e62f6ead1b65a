"""Repetition inside documents by a suffix array over their words.

The suffix array of a batch of texts is built by prefix doubling: suffixes are sorted by
their first word, then only groups of equal suffixes are sorted on, by twice as many words in each
round. The ranks of each round are kept; they give the longest common prefix of neighbours by
binary descent. The deepest interval of common prefixes that holds a suffix is then the
longest repeated substring that starts there; the union of these is what repeats cover.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.frames import map_rows

#: Words of a window of the base rule, and of the shortest repeat that the limits look at.
WINDOW, REPEAT = 3, 10
#: Documents of fewer words, or with more than this percentage of words in repeated windows, fail.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: A kept document has at most this percentage of its words in repeats of ``REPEAT`` words or more,
#: and no repeat of more words than the longest allowed.
MOST_COVERED, LONGEST = 45, 200
#: Words whose suffixes are sorted together; a longer text is sorted by itself.
TOGETHER = 400_000
_SPACES = b" \t\n\r\x0b\x0c"
#: The characters that count as symbols (a fixed value).
SYMBOLS = b"#*$%&|<>"


def suffix_ranks(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of ``symbols`` (0 or more), and ranks by the first 1, 2, 4... symbols."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    sizes = np.diff(np.r_[starts, n])
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.repeat(starts, sizes)
    levels, length = [rank.copy()], 1
    tied = np.flatnonzero(np.repeat(sizes > 1, sizes))
    while len(tied):
        suffixes = order[tied]
        group = rank[suffixes]
        key = group * (n + 2) + rank[np.minimum(suffixes + length, n)] + 1
        by = np.argsort(key, kind="stable")
        suffixes, key, group = suffixes[by], key[by], group[by]
        order[tied] = suffixes
        fresh = np.r_[True, key[1:] != key[:-1]]
        starts = np.flatnonzero(fresh)
        sizes = np.diff(np.r_[starts, len(key)])
        rank[suffixes] = np.repeat(tied[starts], sizes)
        levels.append(rank.copy())
        length *= 2
        tied = tied[np.repeat(sizes > 1, sizes)]
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The longest common prefix of each suffix in the array with the one before it; 0 for the first."""
    n = len(order)
    result = np.zeros(n, np.int64)
    if n < 2:
        return result
    at = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    left, right = order[at - 1], order[at]
    shared = np.zeros(len(at), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        ranks = levels[level]
        equal = ranks[np.minimum(left + shared, n)] == ranks[np.minimum(right + shared, n)]
        shared += equal.astype(np.int64) << level
    result[at] = shared
    return result


def longest_from_each(symbols: np.ndarray) -> np.ndarray:
    """For each place, the length of the longest substring from there that also starts elsewhere."""
    order, levels = suffix_ranks(symbols)
    before = common_prefixes(order, levels)
    longest = np.empty(len(symbols), np.int64)
    longest[order] = np.maximum(before, np.r_[before[1:], 0])
    return longest


def _covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Which places lie in a repeat of ``least`` symbols or more."""
    starts = np.flatnonzero(longest >= least)
    change = np.zeros(len(longest) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + longest[starts], -1)
    return np.cumsum(change[:-1]) > 0


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def _batches(texts: list[list[bytes]]) -> Iterator[list[list[bytes]]]:
    batch: list[list[bytes]] = []
    size = 0
    for words in texts:
        if batch and size + len(words) > TOGETHER:
            yield batch
            batch, size = [], 0
        batch.append(words)
        size += len(words)
    if batch:
        yield batch


def repeats(texts: list[list[bytes]], window: int, repeat: int) -> Iterator[tuple[int, int, int]]:
    """For each list of words: words in repeats of ``window`` words or more, words in repeats of ``repeat``
    words or more, and the words of its longest repeat."""
    for batch in _batches(texts):
        sizes = np.array([len(words) for words in batch])
        numbers = _Numbers()
        flat = [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for words in batch]
        # A text's symbols are its own, so that no common prefix reaches into another text.
        longest = longest_from_each(np.concatenate(flat) + np.repeat(np.arange(len(batch)), sizes) * len(numbers))
        ends = np.cumsum(sizes)
        by_window = np.r_[0, np.cumsum(_covered(longest, window))]
        by_repeat = np.r_[0, np.cumsum(_covered(longest, repeat))]
        for start, end in zip((ends - sizes).tolist(), ends.tolist()):
            most = int(longest[start:end].max()) if end > start else 0
            yield int(by_window[end] - by_window[start]), int(by_repeat[end] - by_repeat[start]), most


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, repeat: int = REPEAT) -> DataFrame:
    """Counts of every row of ``docs``: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_covered_words, longest_repeat``.

    Words are runs of other characters than the six ASCII white spaces. ``n_dup_lines`` are lines with a word
    that equal an earlier line, ``n_repeat_words`` words in repeats of ``window`` words or more,
    ``n_covered_words`` those in repeats of ``repeat`` words or more; ``longest_repeat`` is in words. Repeats
    may overlap themselves. NULL, empty and blank texts have 0 everywhere. Each row is looked at by itself:
    ids may be NULL or repeated. No rows: no rows. Other columns are not looked at.
    """

    def run(ids, texts):
        words, chars, symbols, lines = [], [], [], []
        for text in texts:
            data = (text or "").encode("utf-8")
            words.append(data.split())
            chars.append(len(text or "") - len(data) + len(data.translate(None, _SPACES)))
            symbols.append(len(data) - len(data.translate(None, SYMBOLS)))
            there = [line for line in data.split(b"\n") if line.strip(_SPACES)]
            lines.append(len(there) - len(set(there)))
        found = list(repeats(words, window, repeat))
        return ids, [len(w) for w in words], chars, symbols, lines, *([f[i] for f in found] for i in range(3))

    kind = docs.schema[id_col].dataType.simpleString()
    counts = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_covered_words longest_repeat"
    schema = f"doc_id {kind}, " + ", ".join(f"{name} bigint" for name in counts.split())
    return map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["doc_id", "text"], run, schema)


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``measures`` with ``base_failed`` (too few words, or too many in repeated windows) and ``kept``:
    not failed, covered fraction and longest repeat within the limits. Cases as in ``measures``; texts
    without words fail."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    within = (100 * F.col("n_covered_words") <= MOST_COVERED * F.col("n_words")) & (F.col("longest_repeat") <= LONGEST)
    return measures(docs, id_col, text_col).withColumn("base_failed", failed).withColumn("kept", ~failed & within)
