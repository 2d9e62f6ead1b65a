"""A SELECT statement as the dataset."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from plumbline.sources.jdbc import is_query


def read_sql(spark: SparkSession, ref: str, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """The result of a query, or the table of that name.

    ``tables`` are temporary views while the query is resolved. The query stays part of
    the plan of whatever is done with the result, so filters and column choices
    reach the scans below its joins.
    """
    ref = ref.strip()
    if not ref:
        raise ValueError("no table or query given")
    # The result is resolved at once, so the caller's own views of these names come back before it is used.
    own = {name: spark.table(name) for name in tables or {} if spark.catalog.tableExists(name)}
    try:
        for name, table in (tables or {}).items():
            table.createOrReplaceTempView(name)
        return spark.sql(ref) if is_query(ref) else spark.table(ref)
    finally:
        for name in tables or {}:
            spark.catalog.dropTempView(name)
            if name in own and not spark.catalog.tableExists(name):
                own[name].createOrReplaceTempView(name)
