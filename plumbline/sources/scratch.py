"""Where derived datasets are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_local: list[tempfile.TemporaryDirectory] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a derived dataset, in the folder that the session names
    in ``spark.checkpoint.dir``.

    Executors must all see the folder. Only a local session, where there are no
    other machines, may do without the setting; its files go when Python exits.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if not _local:
            _local.append(tempfile.TemporaryDirectory(prefix="plumbline-"))
        root = _local[0].name
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}-{name}"
