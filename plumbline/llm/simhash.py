"""Near-duplicate documents: SimHash fingerprints searched by the pigeonring principle.

Documents with equal fingerprints are one *class*. The 64 bits of a fingerprint are dealt to ``SEGMENTS`` segments in
a ring. If two fingerprints differ in at most ``DIFFERENCES`` bits, some segment starts a chain around the ring of which
every beginning keeps to its share of the budget: its first ``l`` segments hold at most ``l * DIFFERENCES / SEGMENTS``
differences (Qin and Xiao, "Pigeonring", 2018). As long as that share is less than one the segments must be equal, so
these are the key under which classes meet, once for each start. A pair that meets is dropped as soon as a longer
beginning of its chain exceeds its share; what is left is compared in full.

A key that more than ``CROWD`` classes share is not paired. Its classes carry their chain through to its end in the key instead:
two fingerprints within two bits of each other have one in the middle, at most one bit from each, so classes meet at all
values within one bit of them. No value has more than 65 such neighbours, so a crowd costs 65 rows a class however large it is, and loses no link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.llm.frames import map_rows, stored
from plumbline.llm.words import split_words

#: Bits of a fingerprint, segments of the ring, and the bits in which linked fingerprints may differ (the step by
#: midpoints holds for two).
BITS, SEGMENTS, DIFFERENCES = 64, 5, 2
#: A key shared by more classes than this is not paired.
CROWD = 16
#: Shingles that are hashed at a time, so that long texts need little memory.
BLOCK = 65_536

#: Where the segments begin, and how many of them make up a key: those whose share of the budget is below one.
STARTS = [BITS * i // SEGMENTS for i in range(SEGMENTS + 1)]
EQUAL = -(-SEGMENTS // DIFFERENCES) - 1


def fingerprint(words: list[bytes], width: int = 3, seed: int = 42) -> int:
    """The bits that are set in over half of the hashes of all ``width``-word shingles, repeats included."""
    if not words:
        return 0
    joined, n, wide = b" ".join(words), len(words), min(width, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    firsts = np.concatenate([[0], ends[: n - wide]])
    lasts = ends[wide - 1 :] - 1
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(firsts), BLOCK):
        spans = zip(firsts[start : start + BLOCK].tolist(), lasts[start : start + BLOCK].tolist())
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(firsts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``(id, print)``, the fingerprint as a long of the same 64 bits."""

    def prints(ids, texts):
        return ids, [v - (v >> 63 << 64) for v in (fingerprint(split_words(t), width) for t in texts)]

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_rows(rows, ["id", "text"], prints, f"id {kind}, print bigint")


def _keys(classes: DataFrame) -> DataFrame:
    """``(key, print)`` for each start of a chain: its equal segments, and the number of the start as the remainder."""
    keys = []
    for start in range(SEGMENTS):
        at = STARTS[start]
        width = sum(STARTS[i % SEGMENTS + 1] - STARTS[i % SEGMENTS] for i in range(start, start + EQUAL))
        turned = f"(shiftrightunsigned(print, {at}) | shiftleft(print, {BITS - at}))" if at else "print"
        keys.append(f"({turned} & {(1 << width) - 1}L) * {SEGMENTS} + {start}")
    return classes.select("print", F.explode(F.array(*map(F.expr, keys))).alias("key"))


def chain_holds(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether every beginning of the chain that starts at segment ``start`` keeps to its share of the budget."""
    differ = a ^ b
    sizes = np.array([
        np.bitwise_count((differ >> np.uint64(STARTS[i])) & np.uint64((1 << STARTS[i + 1] - STARTS[i]) - 1)) for i in range(SEGMENTS)
    ]).astype(np.int64)
    holds, total, rows = np.ones(len(a), bool), np.zeros(len(a), np.int64), np.arange(len(a))
    for length in range(1, SEGMENTS + 1):
        total += sizes[(start + length - 1) % SEGMENTS, rows]
        holds &= total * SEGMENTS <= length * DIFFERENCES
    return holds


def _chained(rows: DataFrame) -> DataFrame:
    """Linked pairs among at most ``CROWD`` classes of each key, in partitions that are sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            fresh = len(keys)
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            prints = np.concatenate([prints, batch.column(1).to_numpy().view(np.uint64)])
            for step in range(1, CROWD):
                after = np.arange(max(fresh, step), len(keys))
                after = after[keys[after] == keys[after - step]]
                if not len(after):
                    break
                a, b = prints[after - step], prints[after]
                passed = chain_holds(a, b, keys[after] % SEGMENTS)
                a, b = a[passed], b[passed]
                linked = np.bitwise_count(a ^ b) <= DIFFERENCES
                yield pa.RecordBatch.from_arrays([pa.array(x[linked].view(np.int64)) for x in (a, b)], names=["a", "b"])
            keys, prints = keys[1 - CROWD :], prints[1 - CROWD :]

    return rows.select("key", "print").mapInArrow(run, "a bigint, b bigint")


def _through_midpoints(prints: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that join all of the distinct ``prints`` within two bits of each other."""
    near = prints.select("print", F.explode(F.expr(f"sequence(-1, {BITS - 1})")).alias("bit"))
    near = near.selectExpr("bit < 0 AS own", "CASE WHEN bit < 0 THEN 0L ELSE shiftleft(1L, bit) END AS flip", "print")
    met = near.groupBy(F.expr("print ^ flip").alias("middle")).agg(F.bit_or("flip").alias("flips"), F.bool_or("own").alias("own"))
    met = met.filter("bit_count(flips) + int(own) > 1")
    met = met.select("middle", "own", F.expr(f"filter(sequence(0, {BITS - 1}), bit -> getbit(flips, bit) = 1)").alias("bits"))
    hub = F.expr("CASE WHEN own THEN middle ELSE middle ^ shiftleft(1L, bits[0]) END").alias("a")
    return met.select(hub, "middle", F.explode("bits").alias("bit")).selectExpr("a", "middle ^ shiftleft(1L, bit) AS b").filter("a <> b")


def links(classes: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` that join all distinct fingerprints of ``classes (print)`` which differ in two bits or fewer."""
    keys = stored(_keys(classes), "ring")
    sizes = stored(keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "keys")
    few = keys.join(sizes.filter(F.col("size") <= CROWD).select("key"), "key")
    found = _chained(few.repartition("key").sortWithinPartitions("key", "print"))
    crowded = keys.join(sizes.filter(F.col("size") > CROWD).select("key"), "key").select("print").distinct()
    return found.unionByName(_through_midpoints(crowded))


def simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    Fingerprints are of the text's ``width``-word shingles in lower case (A-Z), repeats included; fewer words are one shingle. NULL, empty
    and blank texts have fingerprint zero, which is linked like any other. Fingerprints are linked if they
    differ in two bits or fewer; ``component_id`` is the smallest id reachable. Rows that repeat an id are
    rows like others. A NULL id names nothing: its row gets the smallest id that others of its component have, NULL if
    they have none. No rows: no rows. Other columns are not looked at.
    """
    rows = stored(fingerprints(docs, id_col, text_col, width), "prints")
    classes = stored(rows.groupBy("print").agg(F.min("id").alias("id")), "classes")
    groups = components(links(classes.select("print")))
    parts = classes.join(groups, classes["print"] == groups["node"], "left")
    parts = parts.select("print", "id", F.coalesce("component", "print").alias("part"))
    firsts = parts.groupBy("part").agg(F.min("id").alias("component_id"))
    named = parts.join(firsts, "part").select("print", "component_id")
    return rows.join(named, "print").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )
