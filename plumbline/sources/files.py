"""File datasets, on a local disk or in an object store: the same readers serve
both, only the URI differs."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File extension -> reader.
EXTENSIONS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".jsonl": "json"}


# Fixed value: schemes of object stores, whose paths are a bucket and a key.
OBJECT_PATH = "^(?:s3a?n?|gs|wasbs?|abfss?|oss|cosn?)://([^/]+)/(.+)$"


def format_of(path: str) -> str:
    """Reader for a path, by its extension in any case; what follows a ``?`` is
    not part of the name."""
    extension = posixpath.splitext(path.split("?")[0].rstrip("/"))[1].lower()
    if extension not in EXTENSIONS:
        raise ValueError(f"unsupported file format: {extension or path!r}")
    return EXTENSIONS[extension]


def read_path(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Read a CSV (with header), Parquet or JSON-lines dataset.

    Without ``schema`` the types of CSV and JSON files are inferred, which reads
    all the data once more; pass the schema for large datasets.
    """
    fmt = fmt or format_of(path)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        return reader.csv(path, header=True, inferSchema=schema is None)
    if fmt == "parquet":
        return reader.parquet(path)
    if fmt == "json":
        return reader.json(path)
    raise ValueError(f"unsupported file format: {fmt!r}")


def file_inventory(
    spark: SparkSession, root: str, active: str | None = None, recursive: bool = False
) -> DataFrame:
    """Files and folder datasets with a supported extension in ``root``, by name.

    ``name`` is relative to ``root``, ``active`` marks the dataset with that path. A folder
    dataset (``orders.parquet/part-0.parquet``) is one entry of the size of all its files. With
    ``recursive=True``, as for an object store, every file below ``root`` is an entry instead.
    ``bucket`` and ``key`` are the parts of an object store's path (``s3a://bucket/key``); NULL for files.
    Only the listing is used: file contents are not read, and ``k=v`` folders mean nothing. Spark
    lists no names that begin with ``_`` or ``.``.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    plain = F.regexp_replace("path", "^file:/+", "/")
    base = _plain(root).rstrip("/") + "/"
    # An absolute local root and a URI root both end up as a prefix of the path.
    name = F.when(plain.startswith(base), F.substr(plain, F.lit(len(base) + 1))).otherwise(
        F.element_at(F.split("path", "/"), -1)
    )
    entry = name if recursive else F.substring_index(name, "/", 1)
    under = F.substr(plain, F.lit(1), F.length(plain) - F.length(name))
    entries = listed.select(entry.alias("name"), F.concat(under, entry).alias("path"), "length")
    ext = F.lower(F.regexp_extract("name", r"[^/](\.[^./]*)$", 1))
    return (
        entries.groupBy("name", "path")
        .agg(F.sum("length").alias("length"))
        .select(
            "name",
            "path",
            F.substr(ext, F.lit(2)).alias("ext"),
            F.bround(F.col("length") / F.lit(1024.0), 1).alias("size_kb"),
            *[F.nullif(F.regexp_extract("path", OBJECT_PATH, i + 1), F.lit("")).alias(c) for i, c in enumerate(("bucket", "key"))],
            (F.col("path") == F.lit(_plain(active) if active else None)).alias("active"),
        )
        .filter(F.col("ext").isin([e[1:] for e in EXTENSIONS]))
        .fillna(False, subset=["active"])
        .orderBy("name")
    )


def _plain(path: str) -> str:
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path


def object_path(bucket: str, key: str) -> str:
    """URI of an object."""
    if not bucket or not key.strip():
        raise ValueError("bucket and key are both needed")
    return f"s3a://{bucket}/{key.strip()}"


def object_store_conf(endpoint: str, access_key: str, secret_key: str) -> dict[str, str]:
    """Session settings for an S3-compatible store reached at its own endpoint.

    Hand them to the session builder; reading needs the hadoop-aws jar.
    """
    return {
        "spark.hadoop.fs.s3a.endpoint": endpoint,
        "spark.hadoop.fs.s3a.access.key": access_key,
        "spark.hadoop.fs.s3a.secret.key": secret_key,
        "spark.hadoop.fs.s3a.path.style.access": "true",
        "spark.hadoop.fs.s3a.connection.ssl.enabled": str(endpoint.startswith("https:")).lower(),
    }
