"""Gives executors this package, so that functions sent to them can be imported there, and keeps Arrow batches small."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()
#: Rows of an Arrow batch: whole texts and sequences are held in the JVM's and in Python's memory at once.
BATCH_ROWS, BATCH, DEFAULT = "1000", "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def ship(spark: SparkSession) -> None:
    if spark.conf.get(BATCH, DEFAULT) == DEFAULT:
        spark.conf.set(BATCH, BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app not in _done:
        top = Path(__file__).resolve().parents[1]
        target = os.path.join(tempfile.mkdtemp(prefix="strandlake-"), "strandlake.zip")
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, f"{top.name}/{p.relative_to(top)}")
        spark.sparkContext.addPyFile(target)
        _done.add(app)
