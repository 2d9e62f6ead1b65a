"""Secrets in texts: fixed patterns, and credential values that are hard to guess.

A value in a credential context is rated by the guesses that an attacker needs for it: the
cheapest way to write it as a row of words, dates, repeats, keyboard walks and
brute-force characters, found by dynamic programming over its prefixes.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.frames import map_rows

# The patterns of the base kinds, in the order in which kinds sort.
ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST = 8
KINDS = ("assign", "access", "hex", "guess")

#: Where a value is a credential, beyond the pattern of ``assign``.
CONTEXT = re.compile(
    r"""(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|(?:access|private|auth|client)[_-]?(?:key|token|secret)|credentials?|bearer)"""
    r"""["']?\x20*(?:[:=]|=>)\x20*(?:"([^"\n]{8,})"|'([^'\n]{8,})'|([^\s"'<>,;(){}\[\]]{8,}))""",
    re.ASCII,
)
#: Values from this many decimal digits of guesses on are secrets.
HARD = 10.0
#: Repeats and walks of any length count. Those longer than this start and end within so many places of where they could.
SPAN = 64

#: Words that attackers try first, commonest first.
WORDS = """
password qwerty welcome admin login master dragon monkey letmein football baseball shadow sunshine princess
iloveyou superman batman trustno hello freedom whatever secret changeme default example sample test guest root
user server system service database backup public private access token manager office company summer winter
spring autumn monday friday january july october december love star magic orange purple silver golden cookie
ginger pepper flower soccer hockey hunter killer ranger harley mustang mercedes corvette computer internet
samsung apple google windows linux oracle jordan michael jennifer thomas robert daniel andrew jessica ashley
nicole charlie george joshua matthew amanda maggie buster tigger bailey yankee chelsea arsenal liverpool
london paris berlin your here placeholder insert value none null true false undefined redacted
""".split()
_RANK = {w: math.log10(i + 2) for i, w in enumerate(WORDS)}
_LONGEST_WORD = max(map(len, WORDS))
_LEET = str.maketrans("013457@$!", "oieastasi")
_ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_YEAR, _MONTH, _DAY = r"(?:19|20)\d\d", r"(?:1[0-2]|0?[1-9])", r"(?:[12]\d|3[01]|0?[1-9])"
#: Dates with the year first, or last after day and month or month and day; with the shortest and longest they can be.
_DATE = re.compile(
    rf"{_YEAR}[-/._]?{_MONTH}[-/._]?{_DAY}|(?:{_DAY}([-/._]){_MONTH}|{_MONTH}([-/._]){_DAY})[-/._](?:{_YEAR}|\d\d)|{_YEAR}", re.ASCII
)
_DATE_LENGTHS = range(4, 11)


def _neighbours() -> dict[str, str]:
    near: dict[str, set[str]] = {}
    for y, row in enumerate(_ROWS):
        for x, key in enumerate(row):
            spots = [(y, x - 1), (y, x + 1), (y - 1, x), (y - 1, x + 1), (y + 1, x - 1), (y + 1, x)]
            near[key] = {_ROWS[b][a] for b, a in spots if 0 <= b < len(_ROWS) and 0 <= a < len(_ROWS[b])}
    return {k: "".join(sorted(v)) for k, v in near.items()}


_NEAR = _neighbours()


def _step(a: str, b: str) -> tuple | None:
    """How a walk goes from one key to the next; None if it doesn't."""
    if b in _NEAR.get(a, ""):
        return ("key",)
    along = ord(b) - ord(a)
    return ("order", along) if along in (1, -1) and a.isalnum() and b.isalnum() else None


class _Stretch:
    """A place from which a repeat or walk goes on for more than ``SPAN`` places, up to ``last``; ``turns`` before each step."""

    def __init__(self, text: str, first: int, step) -> None:
        self.first, self.turns, at, before = first, [0, 0], first + 1, None
        while at < len(text) and (now := step(text, at)) is not None:
            self.turns.append(self.turns[-1] + (before is not None and now != before))
            before, at = now, at + 1
        self.last = at

    def ends(self, start: int, unit: int) -> Iterator[tuple[int, int]]:
        """``(end, turns)`` of spans over ``SPAN`` places from ``start`` on, both ends within ``SPAN`` of the stretch's."""
        if start - self.first < SPAN:
            least = max(start + SPAN + 1, self.last - SPAN)
            for end in range(self.last - (self.last - start) % unit, least - 1, -unit):
                yield end, self.turns[end - self.first] - self.turns[start - self.first + 2]


def _repeat_cost(length: int, unit: int) -> float:
    return 0.3 + unit + math.log10(length // unit)


def _walk_cost(length: int, turns: int) -> float:
    return 1.8 + math.log10(length) + 0.6 * turns


def guess_cost(value: str, enough: float = math.inf) -> tuple[float, list[tuple[str, int, int]]]:
    """Decimal digits of the guesses for ``value``, and the segments ``(kind, start, end)`` of the cheapest way.

    Each segment costs the logarithm of its own guesses plus a little for its place in the row.
    Words: rank, doubled for capitals and for digits that stand for letters. Dates: days of about
    a century, in every reading. Repeats: the unit's brute force times the count. Walks: a start key, then turns.
    Everything else: ten guesses a character.

    A value of which no beginning can go on at less than ``enough`` costs that much: it is then rated, and divided, up
    to there only.
    """
    n, joint = len(value), 0.3
    lower = value.lower()
    if len(lower) != n:  # a few letters grow in lower case
        lower = value
    plain = lower.translate(_LEET)
    stretches: dict[int, _Stretch] = {}
    best = [0.0] + [math.inf] * n
    back: list[tuple[str, int]] = [("", 0)] * (n + 1)
    far = 0

    def offer(kind: str, start: int, end: int, cost: float) -> None:
        nonlocal far
        if best[start] + cost < best[end]:
            best[end], back[end] = best[start] + cost, (kind, start)
            if best[end] < enough and end > far:
                far = end

    def stretch(start: int, unit: int) -> _Stretch:
        """Of repeats of ``unit``, or with 0 of walks. Starts come in order, so the first one seen is a stretch's first."""
        known = stretches.get(unit)
        if known is None or start >= known.last:
            if unit:
                known = _Stretch(value, start, lambda text, at: True if at < start + unit or text[at] == text[at - unit] else None)
            else:
                known = _Stretch(lower, start, lambda text, at: _step(text[at - 1], text[at]))
            stretches[unit] = known
        return known

    for i in range(n):
        if i > far:
            n = i
            break
        offer("brute", i, i + 1, 1.0)
        for end in range(i + 3, min(n, i + _LONGEST_WORD) + 1):
            rank = _RANK.get(plain[i:end])
            if rank is not None:
                changed = (value[i:end] != lower[i:end]) + (plain[i:end] != lower[i:end])
                offer("word", i, end, joint + rank + changed * math.log10(2))
        if value[i].isdigit():
            for length in _DATE_LENGTHS:
                if i + length <= n and _DATE.fullmatch(value, i, i + length):
                    offer("date", i, i + length, joint + (2.0 if length == 4 else 4.6))
        for unit in (1, 2, 3, 4):
            end = i + unit
            while end < min(n, i + SPAN) and value[end] == value[end - unit]:
                end += 1
                if (end - i) % unit == 0 and end - i >= max(3, 2 * unit):
                    offer("repeat", i, end, _repeat_cost(end - i, unit))
            if end == i + SPAN < n and value[end] == value[end - unit]:
                for far_end, _ in stretch(i, unit).ends(i, unit):
                    offer("repeat", i, far_end, _repeat_cost(far_end - i, unit))
        turns, end, before = 1, i + 1, None
        while end < min(n, i + SPAN) and (now := _step(lower[end - 1], lower[end])) is not None:
            turns += before is not None and now != before
            before, end = now, end + 1
            if end - i >= 3:
                offer("walk", i, end, _walk_cost(end - i, turns))
        if end == i + SPAN < n and _step(lower[end - 1], lower[end]) is not None:
            for far_end, more in stretch(i, 0).ends(i, 1):
                offer("walk", i, far_end, _walk_cost(far_end - i, 1 + more))
    segments, at = [], n
    while at:
        kind, start = back[at]
        if segments and kind == "brute" == segments[-1][0]:
            segments[-1] = ("brute", start, segments[-1][2])
        else:
            segments.append((kind, start, at))
        at = start
    return best[n], segments[::-1]


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """All spans ``(kind, start, end)`` by start, then kind as listed in ``KINDS``."""
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    base = sorted((start, end) for _, start, end in spans)
    starts, reach = [start for start, _ in base], [-1, *accumulate((end for _, end in base), max)]
    for m in CONTEXT.finditer(text):
        start, end = m.span(m.lastindex)
        # No base span that starts before reaches as far.
        if reach[bisect_right(starts, start)] < end and guess_cost(m.group(m.lastindex), HARD)[0] >= HARD:
            spans.append(("guess", start, end))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, spans array<struct<kind, start, end>>)`` for every row of ``docs``, none or many spans.

    Offsets are code points of the whole text, ends exclusive. ``assign``, ``access`` and ``hex`` are
    matches of the fixed patterns; ``guess`` are values in a credential context that take ``10 ** HARD``
    guesses or more and lie in no other span. NULL and empty texts have no spans. Each row is looked at by
    itself: ids may be NULL or repeated. No rows: no rows. Other columns are not looked at.
    """

    def run(ids, texts):
        found = [spans_of(text) if text else [] for text in texts]
        return ids, [[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in found]

    kind = docs.schema[id_col].dataType.simpleString()
    columns = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return map_rows(columns, ["doc_id", "text"], run, schema)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret of ``text_col`` replaced by ``mark``; all other columns as they are.

    Overlapping and adjoining spans become one mark. A NULL text stays NULL.
    """

    def clean(text: str) -> str:
        parts, at = [], 0
        for _, start, end in spans_of(text):
            if start > at or not parts:
                parts += [text[at:start], mark]
            at = max(at, end)
        return "".join(parts) + text[at:]

    def run(*columns):
        columns = list(columns)
        columns[place] = [None if text is None else clean(text) for text in columns[place]]
        return columns

    place = docs.columns.index(text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema))
    return map_rows(docs.toDF(*names), names, run, schema).toDF(*docs.columns)
