"""Reading stores, which may not have been written yet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def started(spark: SparkSession, read: Callable[[], DataFrame], schema: T.StructType | str) -> DataFrame:
    """What ``read`` returns; an empty table of ``schema`` where the path does not exist. Other errors are raised."""
    try:
        return read()
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def keyed_entries(df: DataFrame, column: str, entry: str) -> DataFrame:
    """``(key, entry)`` of JSON objects in ``column``, whose values have the type ``entry``.

    A document that is no JSON, or a field of another type, is an error, so that a damaged store never
    passes for an empty one; blank documents have no entries. Of entries with the same key the last one counts.
    """
    documents = df.select(F.col(column).alias("text"), F.monotonically_increasing_id().alias("document"))
    parsed = F.from_json("text", f"map<string,{entry}>", {"mode": "FAILFAST"})
    entries = documents.filter(F.trim("text") != "").select("document", F.posexplode(parsed).alias("place", "key", "entry"))
    return entries.groupBy("key").agg(F.max_by("entry", F.struct("document", "place")).alias("entry"))
