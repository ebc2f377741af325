"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A row whose id is null sorts and compares as this id.
NULL_ID = -(2**63)

#: Rows, and bytes, that are turned into Python objects at a time; a longer row is a slice of its own.
SLICE, SLICE_BYTES = 1024, 64 << 20
#: Bits of the filter that marked() sends to the tasks.
MARK_BITS = 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read through Spark, so that any file system will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col: Column | str) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(col, UPPER, UPPER.lower())


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    The folder is the session's ``spark.checkpoint.dir``; only where that is
    unset and all runs in one process, as in tests, a temporary one is made and
    remembered. A cluster must name its folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="velora-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/velora/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    This cuts the lineage: what comes after survives lost executors without
    running df's own stages again. Files are zstd-compressed Parquet.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Remove the folders of tables that written() gave and nothing reads any more."""
    for df in tables:
        for folder in {path.rpartition("/")[0] for path in df.inputFiles()}:
            discard(df.sparkSession, folder)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that is no longer read."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def marked(keys: DataFrame, column: Column) -> Column:
    """True wherever the 64-bit value of column is a row of keys, and by chance elsewhere.

    A bitmap of fixed size, put together by aggregation, is sent to the tasks, so
    that most rows that a join would not match never reach its shuffle. The join
    itself decides; the more keys, the less is spared.
    """
    key = keys.select(F.pmod(F.col(keys.columns[0]), F.lit(MARK_BITS)).cast("long").alias("k"))
    words = key.groupBy(F.floor(F.col("k") / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(k % 64 as int)))").alias("bits")).toArrow()
    bitmap = np.zeros(MARK_BITS // 64, np.int64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
    sent = keys.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def has(values: pd.Series) -> pd.Series:
        at = values.to_numpy() % MARK_BITS
        return pd.Series((sent.value[at >> 6] >> (at & 63)) & 1 == 1)

    return has(column)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that are used, under fixed names; so no other column can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts_utf8(column: pa.Array) -> Iterator[bytes]:
    """The texts of an Arrow string column as UTF-8, one at a time; null is empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def gathered(ids: list[bytes], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids (32-bit, little-endian) of entries at[0], at[1], ... one behind the other, and where each ends."""
    sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
    begins = np.cumsum(sizes, dtype=np.int32) - sizes
    n = sizes[at]
    ends = np.cumsum(n, dtype=np.int32)
    total = int(ends[-1]) if len(ends) else 0
    return np.frombuffer(b"".join(ids), "<u4")[np.repeat(begins[at] - ends + n, n) + np.arange(total, dtype=np.int32)], ends


def release_memory() -> None:
    """Give freed memory back to the system; a Python worker lives on after a task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """A batch in slices of bounded rows and bytes."""
    open_slices = [batch.slice(k, rows) for k in range(0, batch.num_rows, rows)][::-1]
    while open_slices:
        part = open_slices.pop()
        if part.num_rows > 1 and part.nbytes > SLICE_BYTES:
            half = part.num_rows // 2
            open_slices += [part.slice(half), part.slice(0, half)]
        else:
            yield part


@contextlib.contextmanager
def no_cycles() -> Iterator[None]:
    """For code that makes many objects but no cycles: the search for cycles, which reads all that a worker remembers, waits."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Arrow batches through fn, in slices of bounded size; slices that give no rows are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole):
                with no_cycles():
                    out = fn(part)
                if out is not None:
                    yield out
        release_memory()

    return df.mapInArrow(run, schema)
