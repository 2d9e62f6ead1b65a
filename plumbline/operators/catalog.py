"""The metadata catalog: one row per described dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import contains_ignore_case, strip, text_literal
from plumbline.operators.stores import keyed_entries, started
from plumbline.plans.fused import struct_sql

FIELDS = "array<struct<name:string,type:string,description:string,nullable:boolean>>"
_ENTRY_JSON = (
    "struct<name:string,alias:string,description:string,owner:string,tags:array<string>,"
    f"source_type:string,source_ref:string,fields:{FIELDS},created_at:string,updated_at:string>"
)
_TEXTS = ("alias", "description", "owner")
_SOURCE = ("source_type", "source_ref")
COLUMNS = ("name", *_TEXTS, "tags", *_SOURCE, "fields", "created_at", "updated_at")


def read_catalog(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Catalogs kept as JSON objects keyed by entry name: one object per file, or
    one object per line. No catalog yet: no entries."""
    text = started(spark, lambda: spark.read.text(path, wholetext=not one_per_line), "value STRING")
    return catalog_from_json(text, "value")


def catalog_from_json(df: DataFrame, column: str) -> DataFrame:
    """Catalog rows from JSON objects keyed by entry name. What an older entry
    lacks (such as ``fields``) is NULL."""
    parsed = keyed_entries(df, column, _ENTRY_JSON)
    rest = [
        F.col(f"entry.{c}").try_cast("timestamp_ntz").alias(c) if c.endswith("_at") else F.col(f"entry.{c}")
        for c in COLUMNS[1:]
    ]
    return parsed.select(F.coalesce("entry.name", "key").alias("name"), *rest)


def search(catalog: DataFrame, text: str = "", tag: str = "") -> DataFrame:
    """Entries with ``text`` in name, alias, owner or description, and ``tag`` in
    one of the tags; both are plain substrings in any case, and a blank one does
    not filter."""
    found = catalog
    if text:
        anywhere = F.lit(False)
        for c in ("name", "alias", "owner", "description"):
            anywhere = anywhere | contains_ignore_case(F.col(c), text)
        found = found.filter(anywhere)
    tag = tag.strip()
    if tag:
        hit = F.exists("tags", lambda t: contains_ignore_case(t, tag))
        found = found.filter(F.coalesce(hit, F.lit(False)))
    return found


def normalize(entries: DataFrame) -> DataFrame:
    """Clean incoming entries: texts are stripped, blank tags and fields without a
    name dropped, what is missing blank, and entries without a name left out."""
    return entries.withColumns(
        {
            "name": _clean("name"),
            **{c: _clean(c) for c in _TEXTS},
            "tags": _clean_tags(),
            **{c: F.coalesce(F.col(c), F.lit("")) for c in _SOURCE},
            "fields": _clean_fields(),
        }
    ).filter("name <> ''")


def create(catalog: DataFrame, entries: DataFrame) -> DataFrame:
    """Add entries (with ``created_at``) whose name is not taken; of several new
    ones with one name the earliest counts."""
    clean = normalize(entries)
    payload = [c for c in COLUMNS if c not in ("name", "created_at", "updated_at")]
    # The entry's own content breaks ties, so that a re-run picks the same one.
    chosen = clean.groupBy("name").agg(F.min(F.struct("created_at", *payload)).alias("entry"))
    fresh = chosen.join(catalog.select("name").distinct(), "name", "left_anti").select(
        "name", "entry.*", F.col("entry.created_at").alias("updated_at")
    )
    return catalog.select(*COLUMNS).unionByName(fresh.select(*COLUMNS))


def merge(catalog: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply partial updates ``(name, changed_at, ...)``: a NULL leaves the column
    as it is, ``tags`` and ``fields`` are replaced whole, the name never changes,
    and updates of unknown names have no effect.

    Several updates of one entry apply in the order of ``changed_at``. They are
    folded before the join, with partial aggregation, so an entry that draws most
    of the updates still joins as a single row.
    """
    values = {
        **{c: strip(F.col(c)) for c in (*_TEXTS, *_SOURCE)},
        "tags": _clean_tags(keep_null=True),
        "fields": F.col("fields"),
    }
    cleaned = changes.select("name", "changed_at", *[v.alias(c) for c, v in values.items()])
    folded = cleaned.groupBy("name").agg(
        F.max("changed_at").alias("changed_at"),
        *[
            F.max(F.when(F.col(c).isNotNull(), F.struct("changed_at", c)))[c].alias(f"new_{c}")
            for c in values
        ],
    )
    joined = catalog.join(folded, "name", "left")
    return joined.select(
        "name",
        *[
            F.coalesce(f"new_{c}", c).alias(c)
            if c in values
            else (F.coalesce("changed_at", c).alias(c) if c == "updated_at" else F.col(c))
            for c in COLUMNS[1:]
        ],
    )


def delete(catalog: DataFrame, names: DataFrame) -> DataFrame:
    """Remove entries by ``name``."""
    return catalog.join(names.select("name").distinct(), "name", "left_anti")


def described_fields(catalog: DataFrame) -> DataFrame:
    """One row per described column; a column is nullable unless it says not."""
    return catalog.select("name", F.posexplode("fields").alias("pos", "field")).select(
        "name",
        "pos",
        F.col("field.name").alias("field"),
        F.coalesce("field.type", F.lit("")).alias("type"),
        F.coalesce("field.description", F.lit("")).alias("description"),
        F.coalesce("field.nullable", F.lit(True)).alias("nullable"),
    )


def autofill(catalog: DataFrame, dataset: DataFrame, source_ref: str) -> DataFrame:
    """Describe the columns of entries that refer to ``source_ref`` and have no
    description yet, from the dataset's schema."""
    return catalog.withColumn(
        "fields",
        F.when(
            (F.col("source_ref") == source_ref) & (F.coalesce(F.size("fields"), F.lit(-1)) <= 0),
            schema_fields(dataset),
        ).otherwise(F.col("fields")),
    )


def schema_fields(dataset: DataFrame) -> Column:
    """A dataset's columns as catalog fields with blank descriptions."""
    described = [
        struct_sql(
            {"name": text_literal(name), "type": text_literal(dtype), "description": "''", "nullable": "TRUE"}
        )
        for name, dtype in dataset.dtypes
    ]
    return F.expr(f"CAST(array({', '.join(described)}) AS {FIELDS})")


def _clean(name: str) -> Column:
    return strip(F.coalesce(F.col(name), F.lit("")))


def _clean_tags(keep_null: bool = False) -> Column:
    kept = F.filter(F.transform("tags", strip), lambda t: t != "")
    return kept if keep_null else F.coalesce(kept, F.array().cast("array<string>"))


def _clean_fields() -> Column:
    kept = F.filter(
        F.transform(
            "fields",
            lambda f: F.struct(
                strip(f["name"]).alias("name"),
                strip(F.coalesce(f["type"], F.lit(""))).alias("type"),
                strip(F.coalesce(f["description"], F.lit(""))).alias("description"),
                F.coalesce(f["nullable"], F.lit(True)).alias("nullable"),
            ),
        ),
        lambda f: f["name"] != "",
    )
    return F.coalesce(kept, F.array().cast(FIELDS))
