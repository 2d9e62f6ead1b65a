"""All pairs of similar sets inside a crowd, by prefix filtering.

Where very many sets share whatever a sketch looks at, a sketch can't tell close pairs from others. Here the
elements of each set are put in one order, rarest in the crowd first. Two sets that are
similar enough have so much in common that they share an element among their first ones
(Chaudhuri, Ganti and Kaushik, 2006; Xiao et al., 2008, for the two lengths of prefixes). Elements that
the whole crowd has come last, so that they bring together only sets which nothing else tells apart.

Any order finds the same pairs; the counts that it is made from may be of a part of the crowd.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.frames import stored
from plumbline.llm.words import mixed

#: Elements are counted in about so many sets of a crowd; those in fewer than ``COMMON`` of them are equally rare,
#: and at most ``LISTED`` others go to the executors with their counts.
COUNTED, COMMON, LISTED = 20_000, 3, 300_000
#: Elements that a task counts together before they are sent on.
COMBINED = 1_000_000


def _counts(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The commonest elements in order, and how many sets have them."""

    def counts(values: list[np.ndarray]) -> pa.RecordBatch:
        found, times = np.unique(np.concatenate(values), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(times.astype(np.int64))], names=["token", "sets"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for value in batch.column(0).to_pylist():
                held.append(np.frombuffer(value, np.int64))
                size += len(held[-1])
                if size >= COMBINED:
                    yield counts(held)
                    held, size = [], 0
        if held:
            yield counts(held)

    share = max(1, sets.count() // COUNTED)
    some = sets.filter(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).select("hashes").mapInArrow(combine, "token bigint, sets bigint")
    counted = some.groupBy("token").agg(F.sum("sets").alias("sets")).filter(F.col("sets") >= COMMON)
    listed = counted.orderBy(F.desc("sets"), "token").limit(LISTED).toArrow()
    tokens, many = listed.column("token").to_numpy().view(np.uint64), listed.column("sets").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], many[order]


def close_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``, ``a < b``: pairs of ``sets (id, part, hashes)`` that may have 100 * intersection >= percent * union.

    Every pair that has is among them, but for pairs of the same ``part``. ``hashes`` are the bytes of distinct 64-bit values, one or more.
    """
    kinds = sets.schema["id"].dataType.simpleString(), sets.schema["part"].dataType.simpleString()
    shared = sets.sparkSession.sparkContext.broadcast(_counts(sets))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, many = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                rows = batch.slice(start, 100)
                found, sizes, owners, places = [], [], [], []
                for owner, value in enumerate(rows.column(2).to_pylist()):
                    hashes = np.frombuffer(value, np.uint64)
                    n = len(hashes)
                    length = n + percent * -n // 100 + 1
                    rank = np.zeros(n, np.int64)
                    if len(tokens):
                        at = np.minimum(np.searchsorted(tokens, hashes), len(tokens) - 1)
                        rank = np.where(tokens[at] == hashes, many[at], 0)
                    order = np.lexsort((mixed(hashes), rank))[:length]
                    found.append(hashes[order].view(np.int64))
                    sizes.append(np.full(length, n))
                    owners.append(np.full(length, owner))
                    places.append(np.arange(length))
                which = pa.array(np.concatenate(owners))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found)), rows.column(0).take(which), rows.column(1).take(which),
                     pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))],
                    names=["token", "id", "part", "n", "place"],
                )

    schema = f"token bigint, id {kinds[0]}, part {kinds[1]}, n bigint, place bigint"
    rows = stored(sets.select("id", "part", "hashes").mapInArrow(prefixes, schema), "prefixes")
    mixed_tokens = rows.groupBy("token").agg(F.min("part").alias("x"), F.max("part").alias("y")).filter("x <> y").select("token")
    rows = rows.join(mixed_tokens, "token")
    larger, smaller = (rows.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "part", "n", "place"))) for s in "xy")
    smaller = smaller.filter(f"(n_y - place_y) * {100 + percent} >= {2 * percent} * n_y")
    pairs = larger.join(smaller.hint("merge"), "token").filter(
        f"""part_x <> part_y and (n_x > n_y or n_x = n_y and id_x < id_y) and n_y * 100 >= n_x * {percent}
        and (n_x - place_x) * {100 + percent} >= {percent} * (n_x + n_y)
        and (n_y - place_y) * {100 + percent} >= {percent} * (n_x + n_y)"""
    )
    return pairs.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()
