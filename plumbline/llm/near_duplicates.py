"""Near-duplicate documents: an LSH forest over MinHash signatures.

Documents with equal shingle sets are one *class*, so that copies cost one grouped
aggregation. Classes enter the trees of the forest, each a different order of the
signature's minima, as sorted labels. Classes whose labels share a prefix, its *region*, are
neighbours. Where a prefix is shared by few, all of its pairs are candidates. In the largest of its crowded
regions each class is first compared with its neighbour in the sorted order and with the first class of the region.

Levels are linked one after the other. After each, classes are counted by the component they have come into, and only
pairs between components are of any further interest: a crowd of near copies is one component by
then and done with. Where a crowded region has few classes outside its largest component, those meet all others. In regions of
many components neighbours of different ones are compared in all trees, and their classes descend: they move to longer
prefixes, of as many more trees as keep the recall at the threshold. Regions of several components that are still crowded at
the last depth are paired by the full sets (``crowds``).

Candidates whose signatures agree too little to be possible are dropped; the others
are confirmed on the full sets. Components need no link twice: a first round confirms
for every class its likeliest candidate and its first one, a second round whatever
still lies between different components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.components import components
from plumbline.llm.crowds import close_pairs
from plumbline.llm.frames import keep_ids, map_rows, stored
from plumbline.llm.words import MinHash, copies_needed, mixed, shingle_set, similar, split_words

#: Minima in a signature.
SIGNATURE = 112
#: Prefix lengths by level of the forest, and the chance that all trees of a level
#: miss a pair whose similarity is just the threshold.
DEPTHS, MISS = (3, 9), 1e-4
#: A prefix shared by more classes than this descends.
CROWD = 16
#: Crowded regions, the largest ones, in which a class is compared first. What that leaves apart meets or descends.
AT_FIRST = 2


def _order(level: int, tree: int) -> np.ndarray:
    return np.random.default_rng((level, tree)).permutation(SIGNATURE)


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``(id, n, print, signature)``; without words n is 0 and the others are NULL."""
    minhash = MinHash(SIGNATURE)

    def sketch(ids, texts):
        counts, prints, signatures = [], [], []
        for text in texts:
            hashes = shingle_set(split_words(text), width)
            counts.append(len(hashes))
            prints.append(blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None)
            signatures.append(minhash(hashes).tobytes() if len(hashes) else None)
        return ids, counts, prints, signatures

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")),
        ["id", "text"], sketch, f"id {kind}, n bigint, print binary, signature binary",
    )


def _labels(classes: DataFrame, level: int, trees: int) -> DataFrame:
    """``(region, rest, id, part)``: for each tree the hash of the prefix, and the minima after it."""
    depth, kind = DEPTHS[level], classes.schema["id"].dataType.simpleString()
    orders = np.array([_order(level, tree)[: depth + 4] for tree in range(trees)])
    seeds = mixed(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(len(DEPTHS)) + np.uint64(level))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 100):
                rows = batch.slice(part, 100)
                signatures = np.frombuffer(b"".join(rows.column(1).to_pylist()), np.uint32).reshape(-1, SIGNATURE)
                minima = signatures[:, orders].astype(np.uint64)
                region = np.broadcast_to(seeds, minima.shape[:2]).copy()
                for i in range(depth):
                    region = mixed(region + minima[:, :, i])
                rest = (minima[:, :, depth] << np.uint64(31)) | (minima[:, :, depth + 1] >> np.uint64(1))
                each = pa.array(np.repeat(np.arange(rows.num_rows), trees))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(region.ravel().view(np.int64)), pa.array(rest.ravel().view(np.int64)),
                        rows.column(0).take(each), rows.column(2).take(each),
                    ],
                    names=["region", "rest", "id", "part"],
                )

    return classes.select("id", "signature", "part").mapInArrow(run, f"region bigint, rest bigint, id {kind}, part {kind}")


def _pairs_in_runs(rows: DataFrame, reach: int) -> DataFrame:
    """Pairs of ids at most ``reach`` places apart in the same region but of different parts, in partitions that are sorted by region."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_regions, last_ids, last_parts = np.empty(0, np.int64), np.empty(0, object), np.empty(0, object)
        for batch in batches:
            regions = np.concatenate([last_regions, batch.column(0).to_numpy()])
            ids, parts = (
                np.concatenate([last, np.array(batch.column(i).to_pylist(), dtype=object)]) for i, last in ((1, last_ids), (2, last_parts))
            )
            fresh = len(last_ids)
            for step in range(1, reach + 1):
                after = np.arange(max(fresh, step), len(ids))
                after = after[regions[after] == regions[after - step]]
                if not len(after):
                    break
                after = after[parts[after] != parts[after - step]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[after - step].tolist(), batch.column(1).type), pa.array(ids[after].tolist(), batch.column(1).type)],
                    names=["a", "b"],
                )
            last_regions, last_ids, last_parts = regions[-reach:], ids[-reach:], parts[-reach:]

    return rows.select("region", "id", "part").mapInArrow(run, f"a {kind}, b {kind}")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def candidates(labels: DataFrame, regions: DataFrame) -> DataFrame:
    """``(a, b)``, ``a < b``: classes that meet in ``regions (region, size, first)``. All pairs of parts where few classes meet; in crowded
    ones each class with its neighbour in the order and with the first, in its ``AT_FIRST`` largest regions."""
    few = labels.join(regions.filter(F.col("size") <= CROWD).select("region"), "region")
    pairs = _pairs_in_runs(few.repartition("region").sortWithinPartitions("region", "id"), CROWD - 1)
    there = labels.join(regions.filter(F.col("size") > CROWD).select("region", "size", "first"), "region")
    largest = Window.partitionBy("id").orderBy(F.desc("size"), "region")
    there = there.withColumn("place", F.row_number().over(largest)).filter(F.col("place") <= AT_FIRST)
    ordered = there.repartitionByRange("region", "rest", "id").sortWithinPartitions("region", "rest", "id")
    return _ordered(
        pairs.unionByName(_pairs_in_runs(ordered, 1)).unionByName(there.select(F.col("first").alias("a"), F.col("id").alias("b")))
    )


def _parted(classes: DataFrame, groups: DataFrame) -> DataFrame:
    """``classes`` with the components they are in as their parts."""
    of = groups.select(F.col("node").alias("id"), F.col("component").alias("__part"))
    return classes.drop("part").join(of, "id", "left").withColumn("part", F.coalesce("__part", "id")).drop("__part")


def _outsiders(there: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows ``(region, rest, id, part)``: ``(a, b)`` of regions where few classes lie outside the largest part, all pairs of parts,
    and of the others, neighbours of different parts; and the rows of these other regions.

    Few means as many pairs as in regions that are not crowded, for each class.
    """
    kind = there.schema["id"].dataType.simpleString()
    sizes = there.groupBy("region", "part").agg(F.count("*").alias("n"))
    shape = sizes.groupBy("region").agg(
        F.sum("n").alias("size"), F.sum(F.expr("CAST(n AS DECIMAL(38,0)) * n")).alias("squares"), F.max_by("part", F.struct("n", "part")).alias("main")
    ).filter("size * CAST(size AS DECIMAL(38,0)) > squares")
    shape = shape.withColumn("few", F.expr(f"size * CAST(size AS DECIMAL(38,0)) - squares <= 2 * {CROWD} * size"))
    shape = stored(shape.select("region", "main", "few"), "shapes")
    outside = there.join(shape.filter("few").select("region", "main"), "region").filter("part <> main")
    outside = outside.select("region", "main", F.col("id").alias("a"), F.col("part").alias("part_a"))
    pairs = there.join(outside, "region").filter("part <> part_a and (part = main or id < a)")
    many = there.join(shape.filter("not few").select("region"), "region")
    ordered = many.repartitionByRange("region", "rest", "id").sortWithinPartitions("region", "rest", "id")
    return pairs.select("a", F.col("id").cast(kind).alias("b")).unionByName(_pairs_in_runs(ordered, 1)), many


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose signatures don't rule it out, with the share of equal minima.

    The share of a pair at the threshold is lower by ``0.22`` with a chance of 1e-7.
    """
    least = percent / 100 - 0.22

    def share(a, b, x, y):
        if not a:
            return a, b, []
        equal = np.frombuffer(b"".join(x), np.uint32) == np.frombuffer(b"".join(y), np.uint32)
        return a, b, equal.reshape(-1, SIGNATURE).mean(axis=1).tolist()

    kind = classes.schema["id"].dataType.simpleString()
    side = {
        s: classes.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("signature").alias(f"s_{s}")) for s in "ab"
    }
    joined = pairs.join(side["a"], "a").join(side["b"], "b")
    joined = joined.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    return map_rows(joined, ["a", "b", "s_a", "s_b"], share, f"a {kind}, b {kind}, share double").filter(F.col("share") >= least)


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def confirm(a, b, x, y):
        known: dict[str, np.ndarray] = {}

        def hashes(text):
            if text not in known:
                if len(known) > 200:
                    known.clear()
                known[text] = shingle_set(split_words(text), width)
            return known[text]

        kept = [i for i in range(len(a)) if similar(hashes(x[i]), hashes(y[i]), percent)]
        return [a[i] for i in kept], [b[i] for i in kept]

    kind = texts.schema["id"].dataType.simpleString()
    side = {s: texts.select(F.col("id").alias(s), F.col("text").alias(f"t_{s}")) for s in "ab"}
    # Few bytes but much work: dealt out evenly, in a number of partitions that stays.
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.select("a", "b").repartition(parts, "a", "b").sortWithinPartitions("a", "b")
    return map_rows(dealt.join(side["a"], "a").join(side["b"], "b"), ["a", "b", "t_a", "t_b"], confirm, f"a {kind}, b {kind}")


def _texts(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return stored(keep_ids(rows, ids, "id").dropDuplicates(["id"]), "texts")


def _linked(likely: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Components of the ``likely`` pairs that are confirmed; pairs that the likeliest ones have joined already are not looked at."""
    if likely.isEmpty():
        return components(likely.select("a", "b"))
    both = likely.unionByName(likely.select(F.col("b").alias("a"), F.col("a").alias("b"), "share"))
    best = both.groupBy("a").agg(F.max_by("b", F.struct("share", "b")).alias("x"), F.min("b").alias("y"))
    best = _ordered(best.select("a", F.explode(F.array("x", "y")).alias("b")))
    groups = components(_confirmed(best, texts, width, percent))
    apart = likely.select("a", "b").join(best, ["a", "b"], "left_anti")
    for end in "ab":
        of = groups.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
        apart = apart.join(of, end, "left")
    apart = apart.filter(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")
    return _with_links(groups, apart, texts, width, percent)


def _with_links(groups: DataFrame, pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """``groups`` and what the confirmed ones of ``pairs`` join."""
    new = stored(_confirmed(pairs, texts, width, percent), "links")
    return groups if new.isEmpty() else components(new.unionByName(groups.toDF("a", "b")))


def grouped(classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """``(node, component)`` of all ``classes (id, n, signature)`` that are linked to others."""
    groups, at_level, texts = None, classes.withColumn("part", F.col("id")), None
    settled: list[DataFrame] = []

    def likely_of(pairs: DataFrame) -> DataFrame:
        # Linked, too far apart, or in one component: not looked at again on other levels.
        if settled:
            pairs = pairs.join(reduce(DataFrame.unionByName, settled), ["a", "b"], "left_anti")
        found = stored(_likely(pairs, classes, percent), "likely")
        settled.append(found.select("a", "b"))
        return found

    def joined(likely: DataFrame) -> DataFrame:
        if groups is None:
            return _linked(likely, texts, width, percent)
        # These are pairs of different components already: most are no links, and none makes the others needless.
        return _with_links(groups, likely, texts, width, percent)

    for level, depth in enumerate(DEPTHS):
        labels = stored(_labels(at_level, level, copies_needed(percent / 100, depth, MISS)), "forest")
        regions = labels.groupBy("region").agg(
            F.count("*").alias("size"), F.min("id").alias("first"), F.min("part").alias("x"), F.max("part").alias("y")
        )
        regions = stored(regions.filter("x <> y").select("region", "size", "first"), "regions")
        likely = likely_of(candidates(labels, regions))
        crowded = regions.filter(F.col("size") > CROWD).select("region")
        there = labels.join(crowded, "region").select("region", "rest", "id")
        if texts is None:  # of all that may ever be confirmed: later candidates are members of these regions
            ends = likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id")))
            texts = _texts(ends.unionByName(there.select("id")), docs, id_col, text_col)
        groups = joined(likely)
        if crowded.isEmpty():
            return groups
        members = stored(_parted(there.select("id").distinct(), groups), "members")
        there = stored(there.join(members, "id").select("region", "rest", "id", "part"), "crowd")
        if level < len(DEPTHS) - 1:
            outsiders, there = _outsiders(there)
            groups = joined(likely_of(_ordered(outsiders)))
        else:  # the full sets settle all pairs of different parts, and bring fewer of them together
            parts = there.groupBy("region").agg(F.min("part").alias("x"), F.max("part").alias("y"))
            there = there.join(parts.filter("x <> y").select("region"), "region")
        ids = there.select("id").distinct()
        at_level = stored(_parted(keep_ids(classes, ids, "id"), groups), "descend")
        if at_level.isEmpty():
            return groups
    return _crowd_groups(at_level.select("id", "part"), groups, texts, width, percent)


def _crowd_groups(members: DataFrame, groups: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """``groups``, and all that join further classes among the ``members (id, part)``."""
    kinds = texts.schema["id"].dataType.simpleString(), members.schema["part"].dataType.simpleString()

    def sets(ids, parts, texts):
        return ids, parts, [shingle_set(split_words(text), width).tobytes() for text in texts]

    there = map_rows(texts.join(members, "id"), ["id", "part", "text"], sets, f"id {kinds[0]}, part {kinds[1]}, hashes binary")
    more = stored(close_pairs(stored(there, "sets"), percent), "close")
    return _with_links(groups, more, texts, width, percent)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``.

    Documents are linked when ``100 * intersection >= percent * union`` of their sets of
    ``width``-word shingles; ``component_id`` is the smallest id reachable and ``kept`` holds
    for that document. A text of fewer words is one shingle. NULL, empty and blank texts have
    an empty set and stay alone. Rows that repeat an id must repeat its text: they are one
    document, and each of its rows gets the same result. A NULL id cannot name a component: such rows
    are kept, alone. No rows: no rows. Other columns are not looked at.
    """
    rows = stored(sketches(docs, id_col, text_col, width), "sketches")
    known = rows.filter("id is not null and n > 0")
    classes = known.groupBy("print").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    classes = stored(classes, "classes")
    groups = grouped(classes.select("id", "n", "signature"), docs, id_col, text_col, width, percent)
    named = classes.select("print", "id").join(groups, classes.id == groups.node, "left")
    named = named.select("print", F.coalesce("component", "id").alias("component_id"))
    result = rows.select("id", "n", "print").join(named, "print", "left")
    component = F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component_id"))).otherwise(F.col("id"))
    return result.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates, all columns as they are.

    The document of smallest id stays, once if its rows repeat. Rows with a NULL id all stay.
    """
    found = near_duplicates(docs, id_col, text_col).filter("kept and doc_id is not null").select("doc_id")
    stays = keep_ids(docs.filter(F.col(id_col).isNotNull()), found, id_col).dropDuplicates([id_col])
    return stays.unionByName(docs.filter(F.col(id_col).isNull()))
