"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: For steps whose Python workers should hold little: what Spark hands on at once is some MB, not 10,000 rows or 64 MB.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Only where that setting is missing and the master is local (tests on one
    machine) a temporary folder of this process takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = getattr(shared_dir, "own", None)
        if base is None or not os.path.isdir(base):
            base = shared_dir.own = tempfile.mkdtemp(prefix="wordloom-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/wordloom-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None, name: str = "table", settings: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts lineage.

    What the executors shuffled for it is of no use afterwards, so Spark is told
    to delete it at the end of the write.  ``settings`` hold for the write only.
    """
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/{name}"
    held = {CLEAN_UP: "true"} | (settings or {})
    before = {key: spark.conf.get(key, None) for key in held}
    try:
        for key, value in held.items():
            spark.conf.set(key, value)
        df.write.mode("overwrite").parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """True for the rows that no label may be learnt from (crc32 of the id as text, mod 5)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
