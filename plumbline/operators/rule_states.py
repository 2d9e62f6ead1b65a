"""Mergeable verdicts: what a suite needs to know of a part of the data, also of a stream's micro-batches.

States of parts, put together, give the verdicts on the whole: counts and exact sums add up, and values meet by their
keys, however late the second one comes. A stream writes one state for each micro-batch, under the batch's number: a batch that
is run again after a failure replaces its state and counts once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from plumbline.functions.columns import positional
from plumbline.functions.text import text_literal
from plumbline.operators.rules import Check, Rule, bind_all
from plumbline.operators.stores import started
from plumbline.operators.validate import MEASURES_PER_SCAN, chunks, measured
from plumbline.plans.fused import Measures, in_order, struct_sql, unpack
from plumbline.plans.grouped import key_text
from plumbline.plans.sums import PIECES, column_means, column_sums

_NUMBERS = ("n", "low", "high", *PIECES)
RULE_STATE = f"suite STRING, kind STRING, pos INT, key STRING, n BIGINT, low DOUBLE, high DOUBLE, {', '.join(f'{p} BIGINT' for p in PIECES)}"


def rule_state(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The state of a suite on ``df`` (schema ``RULE_STATE``): counts, sums by bin, and for uniqueness rules one row per
    distinct value, keyed by a text of at most 64 bytes. One scan for the rules on values and counts, one for means, one for uniqueness."""
    checks, flat = _mergeable(df.schema, rules, df.sparkSession), positional(df)
    parts = []
    for number, chunk in enumerate(_counted(checks)):
        measures = Measures()
        for check in chunk:
            check.row(measures)
        if measures.names:
            named = [struct_sql({"key": text_literal(f"{number}.{m}"), "n": m}) for m in measures.names]
            parts.append(_rows(unpack(measures.over(flat), named), "count", n="n", key="key"))
    if means := _columns(checks, "by_sum"):
        parts.append(_rows(column_sums(df, means), "sum", pos="pos", key="CAST(bin AS STRING)", n="present", **{c: c for c in _NUMBERS[1:]}))
    if unique := _columns(checks, "by_value"):
        pairs = ", ".join(f"struct({p} AS pos, {key_text(f'c{p}', df.schema.fields[p].dataType)} AS key)" for p in unique)
        values = flat.selectExpr(f"inline(array({pairs}))").groupBy("pos", "key").agg(F.count(F.lit(1)).alias("n"))
        parts.append(_rows(values, "value", pos="pos", key="key", n="n"))
    if not parts:
        return df.sparkSession.createDataFrame([], RULE_STATE)
    return reduce(DataFrame.unionByName, parts).withColumn("suite", F.lit(_suite(checks, df.schema)))


def merge_rule_states(states: DataFrame) -> DataFrame:
    """One state that stands for all."""
    merged = {c: f"{'min' if c == 'low' else 'max' if c == 'high' else 'sum'}({c})" for c in _NUMBERS}
    return states.groupBy("suite", "kind", "pos", "key").agg(*[F.expr(f"{sql} AS {c}") for c, sql in merged.items()])


def results_from_states(states: DataFrame, rules: Sequence[Rule], schema: T.StructType) -> DataFrame:
    """What ``validate`` returns for all parts together (schema ``CHECK_RESULT``).

    The states must be of these rules on these columns, else using the result is an error. No states: as on an empty table.
    """
    spark = states.sparkSession
    checks = _mergeable(schema, rules, spark)
    suite = text_literal(_suite(checks, schema))
    same = states.filter(F.expr(f"CASE WHEN suite = {suite} THEN TRUE ELSE raise_error('a state of other rules or columns') END"))
    parts: list[tuple[DataFrame, list[str]]] = []
    for number, chunk in enumerate(_counted(checks)):
        measures = Measures()
        rows = [c.row(measures) for c in chunk]
        sums = [F.expr(f"coalesce(sum(n) FILTER (WHERE key = '{number}.{m}'), 0) AS {m}") for m in measures.names]
        parts.append((same.filter("kind = 'count'").agg(*sums), rows))
    if by_sum := [c for c in checks if c.by_sum and not c.settled]:
        sums = same.filter("kind = 'sum'").selectExpr("pos", "CAST(key AS BIGINT) AS bin", "n AS present", *_NUMBERS[1:])
        parts.append(measured(column_means(sums), by_sum))
    if by_value := [c for c in checks if c.by_value and not c.settled]:
        values = same.filter("kind = 'value'").groupBy("pos", "key").agg(F.sum("n").alias("n"))
        parts.append(measured(values.selectExpr("pos", "key IS NULL AS is_null", "n"), by_value))
    if settled := [c.row(Measures()) for c in checks if c.settled]:
        parts.append((spark.range(0, 1, 1, 1), settled))
    return in_order([unpack(row, structs) for row, structs in parts], "pos")


def stream_validate(stream: DataFrame, rules: Sequence[Rule], path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Start a query that keeps the state of a suite on a stream in the store at ``path``, one part per micro-batch.

    ``trigger`` is that of the stream writer, by default ``availableNow=True``: all that is there now, in micro-batches, and done. A query that
    starts again from its ``checkpoint`` goes on after the last finished batch. States grow with the distinct values
    of columns that must be unique; without such rules, every batch has a few rows.
    """

    def keep(batch: DataFrame, number: int) -> None:
        rule_state(batch, rules).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    _mergeable(stream.schema, rules, stream.sparkSession)  # errors come before the stream starts
    writer = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_rule_states(spark: SparkSession, path: str) -> DataFrame:
    """The states of all parts; none before the first."""
    return started(spark, lambda: spark.read.schema(RULE_STATE).parquet(path), RULE_STATE)


def stream_results(spark: SparkSession, path: str, rules: Sequence[Rule], schema: T.StructType) -> DataFrame:
    """The verdicts on all that a stream has brought so far."""
    return results_from_states(read_rule_states(spark, path), rules, schema)


def _mergeable(schema: T.StructType, rules: Sequence[Rule], spark: SparkSession) -> list[Check]:
    if not rules:
        raise ValueError("the suite has no rules")
    checks = bind_all(rules, schema, spark)
    for check in checks:
        if check.by_value and not check.settled and key_text("c", schema.fields[check.position].dataType) is None:
            raise ValueError(f"values of type {schema.fields[check.position].dataType.simpleString()} have no key that parts share")
    return checks


def _counted(checks: Sequence[Check]) -> list[list[Check]]:
    return chunks([c for c in checks if not (c.settled or c.by_value or c.by_sum)], MEASURES_PER_SCAN)


def _columns(checks: Sequence[Check], need: str) -> list[int]:
    return sorted({c.position for c in checks if getattr(c, need) and not c.settled})


def _rows(df: DataFrame, kind: str, **columns: str) -> DataFrame:
    """Rows of a state from expressions; what is not given is NULL."""
    given = {"kind": f"'{kind}'", **columns}
    fields = [f.split() for f in RULE_STATE.split(", ")]
    return df.selectExpr(*[f"CAST({given.get(name, 'NULL')} AS {dtype}) AS {name}" for name, dtype in fields])


def _suite(checks: Sequence[Check], schema: T.StructType) -> str:
    """A digest of the rules and of the columns they are on."""
    said = [[c.rule.expectation_type, c.kwargs, c.position] for c in checks]
    return hashlib.sha256(json.dumps([said, schema.simpleString()]).encode()).hexdigest()
