"""Catalog search by postings, for catalogs too large to read for each search.

A table next to the catalog holds for every run of three characters the entries that have it, sorted by these runs,
so that a search opens the few files and row groups of its own. What the postings find is a
superset; the exact test of :func:`catalog.search` follows on these entries alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import catalog as entries_of

GRAM = 3
#: Runs of a search text that are looked up, the rarest ones. More of them seldom narrow it further.
RAREST = 4
_FIELDS = ("name", "alias", "owner", "description")


def postings(catalog: DataFrame) -> DataFrame:
    """``(place, gram, name)``, one row for each run of ``GRAM`` characters that an entry has in its texts
    (``place`` is ``text``) or its tags (``tag``), in lower case. NULLs and texts of fewer characters have none."""
    in_texts = F.array_distinct(F.flatten(F.array(*[_grams(F.col(c)) for c in _FIELDS])))
    in_tags = F.array_distinct(F.flatten(F.transform(F.coalesce("tags", F.array().cast("array<string>")), _grams)))
    places = F.array(
        F.struct(F.lit("text").alias("place"), in_texts.alias("grams")), F.struct(F.lit("tag").alias("place"), in_tags.alias("grams"))
    )
    rows = catalog.select("name", F.explode(places).alias("at"))
    return rows.select("at.place", F.explode("at.grams").alias("gram"), "name").distinct()


def write_postings(catalog: DataFrame, path: str) -> None:
    """Write the postings of ``catalog``, sorted, so that a search skips what it does not ask for. A run of characters that very
    many entries have is cut by name. They are to be written anew when entries change."""
    rows = postings(catalog).repartitionByRange("place", "gram", "name").sortWithinPartitions("place", "gram", "name")
    rows.write.mode("overwrite").parquet(path)


def search_postings(catalog: DataFrame, index: DataFrame, text: str = "", tag: str = "") -> DataFrame:
    """The rows of :func:`catalog.search`, found through ``index``, the postings of this ``catalog``.

    A text of fewer than ``GRAM`` characters has no postings: only the other condition, if it is long enough, narrows
    what is read then, else all entries are. One small job counts the postings of the search text's own runs.
    """
    asked = [(place, sorted(runs)) for place, needle in (("text", text), ("tag", tag.strip())) if (runs := _runs(needle))]
    candidates = [_having(index, place, runs) for place, runs in asked]
    narrowed = reduce(lambda found, names: found.join(names, "name", "left_semi"), candidates, catalog)
    return entries_of.search(narrowed, text, tag)


def _having(index: DataFrame, place: str, runs: list[str]) -> DataFrame:
    """Names of the entries that have all of the rarest of ``runs`` at ``place``."""
    there = index.filter((F.col("place") == place) & F.col("gram").isin(runs))
    counts = dict.fromkeys(runs, 0) | {r["gram"]: r["n"] for r in there.groupBy("gram").agg(F.count("*").alias("n")).collect()}
    rarest = sorted(runs, key=lambda run: (counts[run], run))[:RAREST]
    few = index.filter((F.col("place") == place) & F.col("gram").isin(rarest))
    return few.groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") == len(rarest)).select("name")


def _runs(needle: str) -> set[str]:
    needle = needle.lower()
    return {needle[i : i + GRAM] for i in range(len(needle) - GRAM + 1)}


def _grams(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    last = F.length(low) - (GRAM - 1)
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.substr(low, at, F.lit(GRAM)))
