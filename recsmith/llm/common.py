"""Shared helpers of the corpus operators: session set-up, narrow inputs, Arrow batching."""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir, ship_package

#: UTF-8 bytes of text that one step of a Python worker holds at a time.
SLICE_BYTES = 8 << 20

__all__ = ["SLICE_BYTES", "byte_slices", "cut_lineage", "id_text", "map_texts", "prepare", "release_shuffles", "remove_folder", "sample_order", "table"]


def prepare(spark: SparkSession) -> SparkSession:
    """Checkpoint folder from the session and the package on the workers' path."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle and checkpoint files of frames that are no longer used.

    The cleaner acts when the driver's JVM collects its references, which a loop over
    large tables and a quiet driver may wait for too long while disks fill.
    """
    gc.collect()
    spark._jvm.System.gc()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system (a table that was only needed meanwhile)."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns the text operators read, under names no input column can clash with."""
    return df.select(F.col(id_col).cast("bigint").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))


def byte_slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row ranges of at most ``limit`` text bytes; a longer row stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def map_texts(df: DataFrame, fn: Callable[[list, list], dict], schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Run ``fn(ids, texts) -> {column: values}`` over byte-balanced slices in Arrow batches.

    ``fn`` runs on the executors and may return any number of rows; ``schema`` names the
    result columns.  Null texts arrive as empty strings, null ids as None.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 1):
                got = fn(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    return id_text(df, id_col, text_col).mapInArrow(run, schema)


def sample_order(*cols: str):
    """A fixed pseudo-random order of rows (ties broken by the columns themselves)."""
    return [F.xxhash64(*cols), *[F.col(c) for c in cols]]


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
