"""Repeated paragraphs, also with small changes: MinHash banding.

A paragraph is a line, or in a longer line a sentence, of ``LEAST_WORDS`` words or more. Where shorter ones
follow each other, every shortest row of them that has so many words is one. Equal
ones (the same set of word shingles) are one *form*, so that a text repeated by the thousand is one row
of a grouped aggregation. Forms collide in bands of their MinHash signature; within a band they are
sorted by the rest of the signature, and each is compared with those before it, nearest first. Exact
Jaccard similarity confirms. Where a crowded band is then still in several components, all pairs of its forms
follow by their full sets (``crowds``). Components of confirmed pairs are clusters, of which the first paragraph stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.llm.crowds import close_pairs
from plumbline.llm.frames import keep_ids, map_rows, stored
from plumbline.llm.words import MinHash, copies_needed, mixed, similar, word_hashes

#: Fewest words of a paragraph, and of a run of repeated paragraphs that is removed.
LEAST_WORDS, LEAST_RUN = 8, 20
#: Minima in a band, and the share of pairs at the threshold that may miss all bands.
ROWS, MISS = 1, 0.016
#: How many forms before it, in the order of a band, each form is compared with; bands of more are crowded.
REACH = 6
_PAIR = "a_doc {0}, a_place bigint, b_doc {0}, b_place bigint"


def paragraph_bounds(text: str) -> tuple[list[bytes], np.ndarray]:
    """The words (A-Z as a-z) and where paragraphs start in them, shorter ones too; the end is the last bound."""
    words, firsts = [], []
    for line in text.encode("utf-8").lower().split(b"\n"):
        firsts.append(len(words))
        words += line.split()
    lasts = np.frombuffer(bytes([w[-1] for w in words]), np.uint8)
    ends = np.flatnonzero((lasts == 46) | (lasts == 33) | (lasts == 63)) + 1
    return words, np.unique(np.concatenate([[0], firsts, ends, [len(words)]]).astype(np.int64))


def paragraph_spans(bounds: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the paragraphs of ``least`` words or more, in order; no two have the same start or end.

    Neighbours of fewer words are joined from each of their starts to the first end that is far enough, the shortest
    row for each end. So a copied passage has the same rows, wherever it stands; two rows share less than ``least`` words.
    """
    short = np.diff(bounds) < least
    long = np.flatnonzero(~short)
    few = np.flatnonzero(short)
    stops = np.r_[long, len(short)][np.searchsorted(long, few)]
    ends = np.searchsorted(bounds, bounds[few] + least)
    few, ends = few[ends <= stops], ends[ends <= stops]
    last = np.r_[ends[1:] != ends[:-1], True][: len(ends)]
    starts, ends = np.r_[bounds[long], bounds[few[last]]], np.r_[bounds[long + 1], bounds[ends[last]]]
    order = np.argsort(starts)
    return starts[order], ends[order]


def _shingled(words: list[bytes], bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the paragraphs of enough words: their starts and numbers of words, hashes of their shingles one after
    another, and where each one's begin."""
    firsts, ends = paragraph_spans(bounds, max(LEAST_WORDS, width))
    sizes = ends - firsts
    hashes = word_hashes(words)
    rolled = hashes[: max(0, len(words) - width + 1)].copy()
    for offset in range(1, width):
        rolled *= np.uint64(0x9E3779B97F4A7C15)
        rolled += hashes[offset : offset + len(rolled)]
    rolled = mixed(rolled)
    counts = sizes - width + 1
    starts = np.cumsum(counts) - counts
    at = np.repeat(firsts - starts, counts) + np.arange(int(counts.sum()))
    return firsts, sizes, rolled[at], starts


def _forms(docs: DataFrame, width: int, bands: int) -> DataFrame:
    """``(doc, place, start, words, form, keys)`` of every paragraph of enough words; ``place`` counts these in a
    document, ``start`` its words."""
    minhash = MinHash(bands * ROWS)
    kind = docs.schema["doc"].dataType.simpleString()
    names = ["doc", "place", "start", "words", "form", *(f"k{i}" for i in range(bands))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                rows = batch.slice(part, 500)
                owners, places, offsets, sizes, sets, begins, total = [], [], [], [], [], [], 0
                for owner, text in enumerate(rows.column(1).to_pylist()):
                    words, bounds = paragraph_bounds(text or "")
                    firsts, lengths, hashes, starts = _shingled(words, bounds, width)
                    if not len(firsts):
                        continue
                    owners.append(np.full(len(firsts), owner))
                    places.append(np.arange(len(firsts)))
                    offsets.append(firsts)
                    sizes.append(lengths)
                    sets.append(hashes)
                    begins.append(starts + total)
                    total += len(hashes)
                if not total:
                    continue
                hashes, starts = np.concatenate(sets), np.concatenate(begins)
                of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, total]))
                order = np.lexsort((hashes, of))
                hashes, of = hashes[order], of[order]
                again = np.r_[False, (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])]
                form = np.add.reduceat(np.where(again, np.uint64(0), mixed(hashes * np.uint64(3) + np.uint64(1))), starts)
                keys = []
                for i in range(bands * ROWS):
                    keys.append(np.minimum.reduceat(hashes * minhash.factor[i] + minhash.offset[i], starts))
                ids = rows.column(0).take(pa.array(np.concatenate(owners)))
                columns = [np.concatenate(places), np.concatenate(offsets), np.concatenate(sizes), form.view(np.int64), *(k.view(np.int64) for k in keys)]
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns)], names=names)

    schema = f"doc {kind}, " + ", ".join(f"{n} bigint" for n in names[1:])
    return docs.select("doc", "text").mapInArrow(run, schema)


def _neighbours(rows: DataFrame) -> DataFrame:
    """Pairs of forms at most ``REACH`` places apart in the same band and key, over sorted partitions.

    ``rows (key, doc, place)``. The ends of every partition come out with their key, so that a key which
    is split over partitions can be joined again; so does one form of every key of more than ``REACH + 1``.
    """
    kind = rows.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = [np.empty(0, np.int64), np.empty(0, object), np.empty(0, np.int64)]
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = len(last[0])
            new = [batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), dtype=object), batch.column(2).to_numpy()]
            keys, docs, places = (np.concatenate([a, b]) for a, b in zip(last, new))
            if first:
                yield edge(keys[0], docs[0], places[0])
                first = False
            for step in range(1, REACH + 1):
                after = np.arange(max(fresh, step), len(keys))
                after = after[keys[after] == keys[after - step]]
                if not len(after):
                    break
                yield pack([None] * len(after), docs[after - step], places[after - step], docs[after].tolist(), places[after].tolist())
            over = np.arange(max(fresh, REACH + 1), len(keys))
            over = over[keys[over] == keys[over - REACH - 1]]
            for i in over[np.unique(keys[over], return_index=True)[1]].tolist():
                yield edge(keys[i], docs[i], places[i])
            last = [keys[-REACH - 1 :], docs[-REACH - 1 :], places[-REACH - 1 :]]
        if not first:
            yield edge(last[0][-1], last[1][-1], last[2][-1])

    def edge(key, doc, place):
        return pack([int(key)], np.array([doc], dtype=object), np.array([place]), [None], [None])

    def pack(keys, docs, places, more_docs, more_places):
        columns = [keys, docs.tolist(), places.tolist(), more_docs, more_places]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types)], names=arrow.names)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = "key bigint, " + _PAIR.format(kind)
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return rows.mapInArrow(run, schema)


def _candidates(forms: DataFrame, bands: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of forms that collide in a band, ``a`` before ``b``; forms are named by their first paragraph. And
    ``(key, p)``, the forms of crowded bands, of whose pairs only a part is among them."""
    keys = [f"k{i}" for i in range(bands)]
    tagged = F.array(
        *(
            F.struct(F.xxhash64(F.lit(i), k).alias("key"), F.col(keys[(i + 1) % bands]).alias("x"), F.col(keys[(i + 2) % bands]).alias("y"))
            for i, k in enumerate(keys)
        )
    )
    rows = forms.select("doc", "place", F.explode(tagged).alias("t")).select("t.key", "t.x", "t.y", "doc", "place")
    order = ["key", "x", "y", "doc", "place"]
    found = stored(_neighbours(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "doc", "place")), "bands")
    ends = found.filter("key is not null").select("key", F.struct("a_doc", "a_place").alias("end"))
    first = ends.groupBy("key").agg(F.min("end").alias("first"))
    joined = ends.join(first, "key").filter("end <> first")
    across = joined.select("first.a_doc", "first.a_place", F.col("end.a_doc").alias("b_doc"), F.col("end.a_place").alias("b_place"))
    pairs = found.filter("key is null").drop("key").unionByName(across)
    a, b = F.struct(F.col("a_doc").alias("doc"), F.col("a_place").alias("place")), F.struct(F.col("b_doc").alias("doc"), F.col("b_place").alias("place"))
    crowd = rows.join(first.select("key"), "key").select("key", F.struct("doc", "place").alias("p"))
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct(), crowd


def _sets(ends: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """``(p, shingles)`` of the paragraphs ``ends (p)``, stored."""
    wanted = ends.groupBy(F.col("p.doc").alias("wanted")).agg(F.collect_list("p.place").alias("places"))
    there = docs.join(wanted, docs.doc == wanted.wanted).select("doc", "text", "places")
    kind = docs.schema["doc"].dataType.simpleString()

    def sets(ids, texts, places):
        out = [], [], []
        for key, text, wanted in zip(ids, texts, places):
            words, bounds = paragraph_bounds(text)
            _, _, hashes, starts = _shingled(words, bounds, width)
            starts = np.r_[starts, len(hashes)]
            for place in wanted:
                for column, value in zip(out, (key, place, np.unique(hashes[starts[place] : starts[place + 1]]).tobytes())):
                    column.append(value)
        return out

    known = stored(map_rows(there, ["doc", "text", "places"], sets, f"doc {kind}, place bigint, shingles binary"), "shingles")
    return known.select(F.struct("doc", "place").alias("p"), "shingles")


def _confirmed(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs whose sets of shingles, ``known (p, shingles)``, are similar enough."""
    kind = pairs.schema["a"].dataType["doc"].dataType.simpleString()

    def confirm(a, b, x, y):
        kept = [i for i in range(len(a)) if similar(np.frombuffer(x[i], np.uint64), np.frombuffer(y[i], np.uint64), percent)]
        return [a[i] for i in kept], [b[i] for i in kept]

    sides = {s: known.select(F.col("p").alias(s), F.col("shingles").alias(f"s_{s}")) for s in "ab"}
    both = pairs.join(sides["a"], "a").join(sides["b"], "b")
    return map_rows(both, ["a", "b", "s_a", "s_b"], confirm, f"a struct<doc:{kind},place:bigint>, b struct<doc:{kind},place:bigint>")


def _clusters(pairs: DataFrame, crowd: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``(node, component)`` of the forms that are similar enough to another one."""
    ends = pairs.select(F.col("a").alias("p")).unionByName(pairs.select(F.col("b").alias("p"))).distinct()
    found = stored(_confirmed(pairs, _sets(ends, docs, width), percent), "links")
    groups = components(found)
    parts = crowd.join(groups, crowd.p == groups.node, "left").select("key", "p", F.coalesce("component", "p").alias("part"))
    parts = stored(parts, "crowd")
    apart = parts.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y")).filter("x <> y").select("key")
    members = stored(parts.join(apart, "key").select("p", "part").distinct(), "members")
    if members.isEmpty():
        return groups
    known = _sets(members.select("p"), docs, width)
    sets = stored(known.join(members, "p").select(F.col("p").alias("id"), "part", F.col("shingles").alias("hashes")), "sets")
    more = stored(close_pairs(sets, percent), "close")
    return components(found.unionByName(_confirmed(more, known, percent)))


def repeated_paragraphs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75
) -> DataFrame:
    """``(doc_id, n_paragraphs, n_repeated, removed array<struct<start, end>>)`` for every document.

    ``n_paragraphs`` counts paragraphs of ``LEAST_WORDS`` words or more, rows of shorter ones too, ``n_repeated`` those that are not the first
    of their cluster (by id, then place). ``removed`` are spans in words: runs of repeated paragraphs, with
    the shorter ones between them, of ``LEAST_RUN`` words or more. NULL, empty and blank texts have no
    paragraphs. Rows that repeat an id must repeat its text and give one row; rows with a NULL id are
    left out, as nothing could point at them. No rows: no rows. Other columns are not looked at.
    """
    bands = copies_needed(percent / 100, ROWS, MISS)
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).filter("doc is not null")
    rows = stored(_forms(texts, width, bands), "paragraphs")
    keys = ["form", *(f"k{i}" for i in range(bands))]
    forms = rows.groupBy(*keys).agg(F.min(F.struct("doc", "place")).alias("first"))
    pairs, crowd = _candidates(stored(forms.select("first.doc", "first.place", *keys[1:]), "forms"), bands)
    groups = _clusters(stored(pairs, "pairs"), crowd, texts, width, percent)
    groups = groups.filter("node <> component").select(F.col("node").alias("first"), "component")
    many = rows.groupBy(*keys).agg(F.min(F.struct("doc", "place")).alias("first"), F.count("*").alias("copies"))
    many = many.join(groups, "first", "left").filter("copies > 1 or component is not null")
    many = many.select(*keys, F.coalesce("component", "first").alias("cluster"))
    again = rows.join(many, keys).filter(F.struct("doc", "place") != F.col("cluster"))
    again = again.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("place", "start", "words"))).alias("repeated"))
    counts = rows.groupBy("doc").agg(F.max("place").alias("last"))
    kind = docs.schema[id_col].dataType.simpleString()

    def finish(ids, lasts, repeated):
        return (
            ids, [0 if last is None else last + 1 for last in lasts], [len(found or ()) for found in repeated],
            [runs(found or []) for found in repeated],
        )

    ids = texts.select("doc").distinct()
    joined = ids.join(counts, "doc", "left").join(again, "doc", "left")
    schema = f"doc_id {kind}, n_paragraphs bigint, n_repeated bigint, removed array<struct<start:bigint,end:bigint>>"
    return map_rows(joined, ["doc", "last", "repeated"], finish, schema)


def runs(repeated: list[dict]) -> list[dict]:
    """Spans of words of the runs of repeated paragraphs (in order of place) that are long enough."""
    result: list[list[int]] = []
    for p in repeated:
        end = p["start"] + p["words"]
        if result and result[-1][0] + 1 == p["place"]:
            result[-1][0], result[-1][2] = p["place"], end
        else:
            result.append([p["place"], p["start"], end])
    return [{"start": start, "end": end} for _, start, end in result if end - start >= LEAST_RUN]
