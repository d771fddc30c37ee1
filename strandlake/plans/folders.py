"""Folders of queries for collections and steps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame


def new_path(spark) -> str:
    """A new folder for a collection: in the shared folder if the session names one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='strandlake-')}"
    return f"{top.rstrip('/')}/collection-{uuid.uuid4().hex}"


def stored_in(where: str) -> Callable[[DataFrame, str], DataFrame]:
    """A function that stores a table under a name in a folder and reads it back."""

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{where}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{where}/{name}")

    return keep
