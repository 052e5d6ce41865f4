"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step handles; a longer single text is handled alone and whole.
STEP_BYTES = 1 << 20

_names = count()
#: Folders that `settled` has written and nobody has removed.
written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_slices(batch: pa.RecordBatch, column: str, limit: int | None = None) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Cut a batch into runs of rows with about `limit` bytes of text; yields each run and its texts as UTF-8 bytes.

    Only one run at a time becomes Python objects, and freed buffers go back to
    the system, as workers outlive their tasks.
    """
    ends = np.cumsum(np.nan_to_num(np.asarray(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), float)))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + (limit or STEP_BYTES), side="right")))
        run = batch.slice(start, stop - start)
        yield run, run.column(column).cast(pa.large_binary()).to_pylist()
        start = stop
    give_back()


def give_back() -> None:
    """Return freed memory to the system: idle Python workers would hold it beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; a local one only where all runs in one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isEmpty() and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = found.get() if found.isDefined() else "file://" + tempfile.mkdtemp(prefix="fieldstream-")
    app = spark.sparkContext.applicationId
    return f"{root.rstrip('/')}/fieldstream-{app}-{next(_names)}-{zlib.crc32(tempfile.mktemp().encode()):08x}"


def settled(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors, and is computed once."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_path = path
    return out


def _removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    written.remove(folder)


def forget(df: DataFrame) -> None:
    """Remove what `settled` wrote for df, once nothing reads it any more."""
    _removed(df.sparkSession, df.settled_path)


def forget_all(spark: SparkSession, since: int, but: DataFrame) -> None:
    """Remove what `settled` has written since then (a length of `written`), once nothing reads it any more, except for one table."""
    for folder in [x for x in written[since:] if x != but.settled_path]:
        _removed(spark, folder)


def fold(id_column: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as decimal text, modulo folds; null ids fall in fold 0."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % folds, F.lit(0))
