"""Where datasets come from."""

from plumbline.sources.files import (
    EXTENSIONS,
    file_inventory,
    format_of,
    object_path,
    object_store_conf,
    read_path,
)
from plumbline.sources.jdbc import (
    jdbc_options,
    jdbc_tables,
    postgres_url,
    read_jdbc,
)
from plumbline.sources.scratch import scratch_path
from plumbline.sources.spec import SourceSpec, reads_whole_rows, resolve, source_label
from plumbline.sources.sql import read_sql

__all__ = [
    "EXTENSIONS",
    "SourceSpec",
    "file_inventory",
    "format_of",
    "jdbc_options",
    "jdbc_tables",
    "object_path",
    "object_store_conf",
    "postgres_url",
    "read_jdbc",
    "read_path",
    "read_sql",
    "reads_whole_rows",
    "resolve",
    "scratch_path",
    "source_label",
]
