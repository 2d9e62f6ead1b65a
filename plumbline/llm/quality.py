"""Quality of documents by a sparse ensemble of rules.

Shallow trees are boosted on text statistics of labelled documents. Every path from a root to a
node is a rule, a conjunction of comparisons; a logistic model with an L1 penalty
weighs the rules and drops most. What remains is compiled to one Spark column.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.frames import keep_ids, map_rows, stored
from plumbline.llm.words import shingle_set

#: The most labelled rows that a model is fitted on; further ones are left out by a hash of their id.
SAMPLE = 20_000
TREES, DEPTH, SHRINK, BINS = 30, 3, 0.3, 32
#: Fewest rows on either side of a split, and the weight of the L1 penalty.
LEAST_SIDE, PENALTY = 10, 5e-4
#: Documents with this score or more are predicted good.
ACCEPT = 0.7
_SPACES = b" \t\n\r\x0b\x0c"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_LOWER = bytes(range(ord("a"), ord("z") + 1))
_DIGITS = b"0123456789"
_SYMBOLS = b"#*$%&|<>@^~_=+\\{}[]"
_MARKS = b".,;:!?\"'()-"

STATISTICS = (
    "n_words", "word_length", "longest_word", "distinct_words", "distinct_shingles", "commonest_word", "upper",
    "digits", "symbols", "marks", "shouts", "bars", "other_bytes", "words_per_line", "repeated_lines", "capital_words",
    "odd_endings",
)


def statistics_of(text: str | None) -> tuple[float, ...]:
    """The values of ``STATISTICS``; shares are 0 for a text without words."""
    data = (text or "").encode("utf-8")
    words = data.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATISTICS)
    size = len(data.translate(None, _SPACES))

    def share(characters: bytes) -> float:
        return (len(data) - len(data.translate(None, characters))) / size

    lines = [line for line in data.split(b"\n") if line.strip(_SPACES)]
    ascii_other = bytes(range(128, 256))
    firsts = np.frombuffer(bytes([w[0] for w in words]), np.uint8)
    lasts = np.frombuffer(bytes([w[-1] for w in words]), np.uint8)
    odd = np.isin(lasts, np.frombuffer(_SYMBOLS + b"!", np.uint8)).mean()
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    return (
        float(n), size / n, float(max(map(len, counts))), len(counts) / n, len(shingle_set(words, 5)) / max(1, n - 4),
        max(counts.values()) / n, share(_UPPER), share(_DIGITS), share(_SYMBOLS), share(_MARKS), data.count(b"!") / n,
        data.count(b"|") / n, share(ascii_other), n / len(lines), 1 - len(set(lines)) / len(lines),
        float(((firsts >= 65) & (firsts <= 90)).mean()), float(odd),
    )


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``STATISTICS`` of every row; NULL, empty and blank texts have 0 everywhere."""

    def run(ids, texts):
        rows = [statistics_of(text) for text in texts]
        return ids, *([row[i] for row in rows] for i in range(len(STATISTICS)))

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{name} double" for name in STATISTICS)
    return map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["doc_id", "text"], run, schema)


#: A comparison ``(statistic, above, bound)``: ``> bound`` or ``<= bound``.
Comparison = tuple[int, bool, float]
Rule = tuple[Comparison, ...]


def _bounds(values: np.ndarray) -> list[np.ndarray]:
    """Bounds between bins of about equal size, halfway between neighbouring values."""
    result = []
    for column in values.T:
        distinct = np.unique(column)
        if len(distinct) > BINS:
            distinct = np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)))
        result.append((distinct[1:] + distinct[:-1]) / 2)
    return result


def _tree(binned: np.ndarray, slope: np.ndarray, curve: np.ndarray, bounds: list[np.ndarray], paths: list[Rule]) -> np.ndarray:
    """Grow one tree for the loss's slopes and curvatures; adds its paths and returns its values by row."""
    values = np.zeros(len(slope))
    waiting: list[tuple[np.ndarray, Rule]] = [(np.arange(len(slope)), ())]
    while waiting:
        rows, path = waiting.pop()
        total, weight = slope[rows].sum(), curve[rows].sum()
        values[rows] = total / (weight + 1.0)
        best: tuple[float, int, int] | None = None
        for j in range(binned.shape[1]) if len(path) < DEPTH else ():
            bins = len(bounds[j]) + 1
            count = np.cumsum(np.bincount(binned[rows, j], minlength=bins))[:-1]
            left, left_weight = (np.cumsum(np.bincount(binned[rows, j], x[rows], bins))[:-1] for x in (slope, curve))
            gain = left**2 / (left_weight + 1) + (total - left) ** 2 / (weight - left_weight + 1) - total**2 / (weight + 1)
            gain[(count < LEAST_SIDE) | (len(rows) - count < LEAST_SIDE)] = 0
            if len(gain) and gain.max() > (best[0] if best else 1e-6):
                best = (float(gain.max()), j, int(gain.argmax()))
        if best:
            _, j, at = best
            above = binned[rows, j] > at
            for side in (False, True):
                longer = (*path, (j, side, float(bounds[j][at])))
                paths.append(longer)
                waiting.append((rows[above == side], longer))
    return values


def _simplified(path: Rule) -> Rule:
    """At most one bound of each statistic and direction, in order."""
    tight: dict[tuple[int, bool], float] = {}
    for j, above, bound in path:
        old = tight.get((j, above))
        tight[j, above] = bound if old is None else max(old, bound) if above else min(old, bound)
    return tuple((j, above, bound) for (j, above), bound in sorted(tight.items()))


def tree_rules(values: np.ndarray, good: np.ndarray) -> list[Rule]:
    """The distinct paths of boosted trees, in the order in which they were grown."""
    bounds = _bounds(values)
    binned = np.stack([np.searchsorted(b, column, "left") for b, column in zip(bounds, values.T)], axis=1)
    margin, paths = np.zeros(len(good)), []
    for _ in range(TREES):
        chance = 1 / (1 + np.exp(-margin))
        margin += SHRINK * _tree(binned, good - chance, chance * (1 - chance), bounds, paths)
    return list(dict.fromkeys(map(_simplified, paths)))


def _holds(rules: list[Rule], values: np.ndarray) -> np.ndarray:
    result = np.ones((len(values), len(rules)), np.float32)
    for i, rule in enumerate(rules):
        for j, above, bound in rule:
            result[:, i] *= values[:, j] > bound if above else values[:, j] <= bound
    return result


def lasso(design: np.ndarray, good: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic model with an L1 penalty, by accelerated proximal gradient."""
    n, m = design.shape
    centre = design.mean(axis=0)
    shifted = design - centre
    vector = np.ones(m, np.float32)
    for _ in range(20):
        vector = shifted.T @ (shifted @ vector)
        vector /= max(np.linalg.norm(vector), 1e-12)
    step = 1 / (0.25 * (float(np.linalg.norm(shifted @ vector)) ** 2 / n * 1.1 + 1e-9))
    weights = ahead = np.zeros(m)
    start = intercept = float(np.log((good.sum() + 1) / (len(good) - good.sum() + 1)))
    t = 1.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(shifted @ ahead.astype(np.float32) + intercept))) - good
        moved = ahead - step * (shifted.T @ error.astype(np.float32)).astype(float) / n
        fresh = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        intercept -= min(4.0, step) * float(error.mean())
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, weights, t = fresh + (t - 1) / later * (fresh - weights), fresh, later
    return (intercept if np.any(weights) else start) - float(centre @ weights), weights


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """The probability that a document is good, as a column over ``STATISTICS``."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            tests = [F.col(STATISTICS[j]) > bound if above else F.col(STATISTICS[j]) <= bound for j, above, bound in rule]
            holds = tests[0]
            for test in tests[1:]:
                holds = holds & test
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def describe(self) -> list[str]:
        """The rules in words, heaviest first."""
        heavy = sorted(self.rules, key=lambda r: -abs(r[1]))
        return [f"{weight:+.3f} if " + " and ".join(f"{STATISTICS[j]} {'>' if above else '<='} {bound:.6g}" for j, above, bound in rule) for rule, weight in heavy]


def fit_rules(values: np.ndarray, good: np.ndarray, penalty: float = PENALTY) -> RuleEnsemble:
    """The ensemble for rows of ``STATISTICS`` and 0/1 labels. Without rows, or with one class only,
    there are no rules and the score is the smoothed share of good rows."""
    good = good.astype(float)
    if len(good) == 0 or good.min() == good.max():
        return RuleEnsemble(float(np.log((good.sum() + 1) / (len(good) - good.sum() + 1))), ())
    rules = tree_rules(values, good)
    intercept, weights = lasso(_holds(rules, values), good, penalty)
    return RuleEnsemble(intercept, tuple((rule, float(w)) for rule, w in zip(rules, weights) if w))


def train(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleEnsemble:
    """Fit on ``stats`` (of ``statistics``) and ``labels (doc_id, quality)``: rows whose id is not held out,
    with a quality of 0 or 1, and of these the ``sample`` first by a hash of the id."""
    known = labels.select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter(F.col("quality").isin(0, 1) & ~held_out("label_id"))
    known = known.orderBy(F.xxhash64("label_id"), "label_id", "quality").limit(sample)
    rows = stats.join(known, stats.doc_id == known.label_id).select(*STATISTICS, "quality", "label_id")
    data = np.array([tuple(r) for r in rows.orderBy("label_id", "quality", *STATISTICS).limit(sample).collect()], float)
    data = data.reshape(-1, len(STATISTICS) + 2)
    return fit_rules(data[:, :-2], data[:, -2])


def held_out(id_col: str) -> Column:
    """Whether a document is kept from training: by CRC-32 of its id as text. A NULL id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    Only statistics of the whole text are looked at: not the id, nor other columns. NULL, empty and blank texts
    have statistics of 0 and get a score as any other. Repeated rows get the same score. Without usable
    labels every score is that of no rules (see ``fit_rules``). No rows: no rows. Labels whose document is
    missing, or with another quality than 0 and 1, are ignored; repeated labels all count.
    """
    stats = stored(statistics(docs, id_col, text_col), "statistics")
    score = train(stats, labels, sample).score()
    return stats.select("doc_id", held_out("doc_id").alias("held_out"), score.alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= ACCEPT, 1).otherwise(0)
    )


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents predicted to be bad, all columns as they are. Rows of one id, or with a NULL id,
    stay together if any of them is accepted."""
    good = score_quality(docs, labels, id_col, text_col).filter("predicted = 1").select("doc_id")
    return keep_ids(docs, good, id_col)
