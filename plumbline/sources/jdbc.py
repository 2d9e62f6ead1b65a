"""Database tables and queries over JDBC."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Fixed value: lists the tables of the public schema.
_POSTGRES_TABLES = (
    "(SELECT table_name FROM information_schema.tables WHERE table_schema = 'public') t"
)


def postgres_url(host: str, database: str, port: int | str = 5432) -> str:
    return f"jdbc:postgresql://{host}:{port}/{database}"


def is_query(text: str) -> bool:
    """Whether a reference is a query rather than a table name."""
    return re.match(r"\s*(SELECT|WITH)\b", text, re.IGNORECASE) is not None


def jdbc_options(
    url: str,
    ref: str,
    user: str | None = None,
    password: str | None = None,
    driver: str | None = None,
    partition_column: str | None = None,
    lower_bound: object = None,
    upper_bound: object = None,
    num_partitions: int | None = None,
    fetch_size: int | None = 10_000,
) -> dict[str, str]:
    """Reader options for a table, or for a query the database is to run.

    Without a partition column the whole result arrives through one connection
    and one task. The bounds only shape the slices: rows outside them are read
    too, by the first and last slice.
    """
    ref = ref.strip()
    if not ref:
        raise ValueError("no table or query given")
    options: dict[str, object] = {
        "url": url,
        "dbtable": f"({ref.rstrip(';').rstrip()}) t" if is_query(ref) else ref,
        "user": user,
        "password": password,
        "driver": driver,
        "fetchsize": fetch_size,
    }
    slicing = (partition_column, lower_bound, upper_bound, num_partitions)
    if any(s is not None for s in slicing):
        if any(s is None for s in slicing):
            raise ValueError(
                "a partitioned read needs partition_column, lower_bound, upper_bound and num_partitions"
            )
        options.update(
            partitionColumn=partition_column,
            lowerBound=lower_bound,
            upperBound=upper_bound,
            numPartitions=num_partitions,
        )
    return {k: str(v) for k, v in options.items() if v is not None}


def read_jdbc(spark: SparkSession, url: str, ref: str, **options: object) -> DataFrame:
    """Read a table or a query; keyword arguments as in :func:`jdbc_options`."""
    return spark.read.format("jdbc").options(**jdbc_options(url, ref, **options)).load()


def jdbc_tables(spark: SparkSession, url: str, **options: object) -> DataFrame:
    """Names of the tables in the public schema, sorted."""
    options = {k: v for k, v in options.items() if k in ("user", "password", "driver")}
    settings = jdbc_options(url, "tables", **options) | {"dbtable": _POSTGRES_TABLES}
    return spark.read.format("jdbc").options(**settings).load().orderBy("table_name")
