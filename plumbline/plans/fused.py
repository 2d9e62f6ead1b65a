"""Many scalar aggregates in one pass over the data.

Expressions are written as SQL text: a suite has hundreds of them, and a text
costs the driver one call where a tree of Column objects costs one per node.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Measures:
    """The aggregates one pass computes. Asking twice for the same aggregate
    yields the same output column, so rules that share a count share its
    computation.

    Conditional counts are best written ``count(CASE WHEN ... THEN 1 END)``:
    ``count_if`` makes Spark compute all conditions of the pass in one generated
    method, which a few dozen rules make too long for the JIT compiler.
    """

    def __init__(self) -> None:
        self._names: dict[str, str] = {}

    @property
    def slots(self) -> int:
        """Buffer columns of the aggregation."""
        return len(self._names)

    @property
    def names(self) -> list[str]:
        """The output columns."""
        return list(self._names.values())

    def need(self, aggregate: str) -> str:
        """The name of the column that will hold the aggregate."""
        return self._names.setdefault(aggregate, f"m{len(self._names)}")

    @property
    def columns(self) -> list[Column]:
        """The requested aggregates."""
        return [F.expr(f"{sql} AS {name}") for sql, name in self._names.items()]

    def over(self, df: DataFrame) -> DataFrame:
        """The one-row DataFrame with every requested aggregate."""
        return df.agg(*self.columns)


def struct_sql(fields: Mapping[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {sql}" for name, sql in fields.items()) + ")"


def unpack(row: DataFrame, structs: Sequence[str]) -> DataFrame:
    """Turn a one-row DataFrame into rows, one per struct expression over it."""
    return row.selectExpr(f"inline(array({', '.join(structs)}))")


def literal_rows(spark: SparkSession, structs: Sequence[str]) -> DataFrame:
    """Rows written out in the program, in a single task."""
    return unpack(spark.range(0, 1, 1, 1), structs)


def in_order(parts: Sequence[DataFrame], order_by: str) -> DataFrame:
    """The rows of several unpacked parts, ordered, in one partition.

    The row count is the number of structs written in the program, never the
    data's, and every part sits behind its own shuffle, so the single partition
    only holds finished results.
    """
    return reduce(DataFrame.unionByName, parts).coalesce(1).sortWithinPartitions(order_by)
