"""Reading tables, storing intermediate results, and Arrow tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.scratch import scratch_path


#: Rows that a function of ``map_rows`` sees at a time.
TOGETHER = 500
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read again.

    Cuts the lineage with files that outlive any executor. The shuffle files that led to it are
    not needed any more and go at once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def map_rows(df: DataFrame, columns: list[str], function: Callable, schema: str) -> DataFrame:
    """``function`` on each batch of ``columns``: lists in, lists out.

    ``function`` takes one list per column and returns one list per column of
    ``schema``. It gets at most ``TOGETHER`` rows at a time, whatever the session's batches.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                rows = batch.slice(start, TOGETHER)
                results = function(*(column.to_pylist() for column in rows.columns))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values, field.type) for values, field in zip(results, arrow)], schema=arrow
                )

    return df.select(*columns).mapInArrow(run, schema)


def keep_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is in ``ids`` (one column; NULL is an id), all columns as they are.

    The plan is the same at every size: ids grow with the data, so they are not broadcast.
    """
    wanted = ids.select(F.col(ids.columns[0]).alias("__kept_id")).distinct().hint("merge")
    return docs.join(wanted, docs[id_col].eqNullSafe(wanted["__kept_id"]), "left_semi")
