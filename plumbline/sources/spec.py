"""Source descriptions, passed explicitly instead of a shared selection."""

from __future__ import annotations

import posixpath
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from plumbline.sources.files import file_inventory, format_of, object_path, read_path
from plumbline.sources.jdbc import read_jdbc
from plumbline.sources.sql import read_sql

# Source types as they appear in reports and catalog entries.
LOCAL, OBJECT_STORE, DATABASE = "local", "minio", "postgres"
# A query over tables that Spark already knows; ours.
SPARK_SQL = "sql"


@dataclass(frozen=True)
class SourceSpec:
    """What to read.

    ``ref`` is a file name or path (local), an object URI or ``bucket/key``
    (object store), or a table name or query (database, Spark SQL). ``options``:
    ``root`` for local names, ``schema`` for files, and the arguments of
    :func:`plumbline.sources.jdbc.jdbc_options` for databases.
    """

    type: str
    ref: str | None = None
    options: Mapping[str, object] = field(default_factory=dict)


def resolve(spark: SparkSession, source: SourceSpec) -> DataFrame:
    """The DataFrame a source stands for."""
    if source.type == LOCAL:
        return read_path(spark, _local_path(spark, source), schema=source.options.get("schema"))
    if source.type not in (OBJECT_STORE, DATABASE, SPARK_SQL):
        raise ValueError(f"unknown source type: {source.type!r}")
    if not source.ref or not source.ref.strip():
        raise ValueError(f"nothing selected for source type {source.type!r}")
    if source.type == OBJECT_STORE:
        return read_path(spark, _object_uri(source.ref), schema=source.options.get("schema"))
    if source.type == DATABASE:
        return read_jdbc(spark, ref=source.ref, **source.options)
    return read_sql(spark, source.ref, source.options.get("tables"))


def settled(spark: SparkSession, source: SourceSpec) -> SourceSpec:
    """``source`` with its file named: a local source without one stands for the first file of its root."""
    if source.type != LOCAL or source.ref:
        return source
    schema = source.options.get("schema")
    return SourceSpec(LOCAL, _local_path(spark, source), {} if schema is None else {"schema": schema})


def reads_whole_rows(source: SourceSpec) -> bool:
    """Whether a scan of one column costs about as much as a scan of all."""
    if source.type in (LOCAL, OBJECT_STORE) and source.ref:
        return format_of(source.ref) != "parquet"
    return True


def source_label(source: SourceSpec) -> str:
    """Short name of a source: the last path component of a file, the table or
    query text otherwise."""
    ref = source.ref or ""
    if source.type in (LOCAL, OBJECT_STORE):
        return posixpath.basename(ref)
    return ref or source.type


def _local_path(spark: SparkSession, source: SourceSpec) -> str:
    root = source.options.get("root")
    if source.ref:
        if root is None:
            return source.ref
        name = source.ref.strip()
        if name in ("", ".", "..") or "/" in name or "\\" in name:
            raise ValueError(f"not a file name: {source.ref!r}")
        return posixpath.join(root, name)
    if root is None:
        raise ValueError("a local source needs a file or a root folder")
    first = file_inventory(spark, root).select("path").first()
    if first is None:
        raise FileNotFoundError(f"no supported file in {root}")
    return first["path"]


def _object_uri(ref: str) -> str:
    if "://" in ref:
        return ref
    bucket, _, key = ref.partition("/")
    return object_path(bucket, key)
