"""What the operators of this subpackage share: stages on shared storage, shipping, hashing."""

from __future__ import annotations

import logging
import os
import sys
import tempfile
import types
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans.stage import delete, drop, new_path, running_sum, shared_dir, staged, stored_bytes  # noqa: F401

_own: dict[str, str] = {}
ROWS, BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def ship(spark: SparkSession) -> None:
    """Gives executors this package, as --py-files would, once per application.

    Where the session's Arrow batches have their defaults, they are set to BATCH rows
    and BATCH_BYTES for this session, and the log says so: texts may be long, and a
    task holds a batch in the JVM and in its worker. Other settings are left alone.
    """
    if (spark.conf.get(BYTES, None) or "").rstrip("b") == "67108864":
        spark.conf.set(BYTES, str(BATCH_BYTES))
        logging.getLogger(__name__).warning("%s: %d bytes", BYTES, BATCH_BYTES)
    if spark.conf.get(ROWS) == "10000":
        spark.conf.set(ROWS, str(BATCH))
        logging.getLogger(__name__).warning("%s: %d rows", ROWS, BATCH)
    key = spark.sparkContext.applicationId
    if _own.get("shipped") == key:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    fd, name = tempfile.mkstemp(prefix="tessella-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w") as z:
        for folder, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(name)
    _own["shipped"] = key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def resident(key: str, make):
    """A worker's model that outlives tasks: make()'s, until another key is asked for.

    One at a time: the models of earlier stages of a job would add up in a worker.
    """
    store = sys.modules.setdefault("_tessella_resident", types.ModuleType("_tessella_resident")).__dict__
    if key not in store:
        release()
        store[key] = make()
    return store[key]


def release() -> None:
    """Frees the worker's model, for tasks that need none."""
    module = sys.modules.get("_tessella_resident")
    if module is not None and module.__dict__:
        import ctypes
        import gc

        import pyarrow as pa

        module.__dict__.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps what is freed otherwise
        if trim:
            trim(0)


def n_words(text: Column) -> Column:
    """Number of maximal runs of characters other than space and the ASCII controls 9 to 13; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
