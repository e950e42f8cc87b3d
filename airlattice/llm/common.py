"""What the operators share: tables, folds, texts out of Arrow batches, staged intermediate data."""

import ctypes
import os
import tempfile
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airlattice.session import pin_time_zone, shared_folder, stage

__all__ = ["arrow_rows", "byte_texts", "fold", "return_memory", "row_order", "shared_folder", "ship", "stage", "table", "whole_row"]


_shipped: set = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python workers, once per application, as --py-files would."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        target = os.path.join(tempfile.mkdtemp(prefix="run-"), "airlattice.zip")
        with zipfile.ZipFile(target, "w") as out:
            for folder, _, files in os.walk(os.path.join(root, "airlattice")):
                for name in sorted(files):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, root))
        context.addPyFile(target)
        _shipped.add(context.applicationId)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin_time_zone(ship(spark)).read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as the struct ``row``: columns that are worked with beside it cannot clash with
    any of the table's own. ``select("row.*")`` gives the table back."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row")


def row_order(docs: DataFrame) -> Column:
    """A number by which rows that differ in any column of ``row`` are put in order."""
    text = F.to_json("row") if any("map<" in f.dataType.simpleString() for f in docs.schema) else F.col("row")
    return F.xxhash64(text)


def fold(key, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts


def byte_texts(column: pa.Array):
    """The UTF-8 bytes of each text of an Arrow string column, without making strings; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    if data is None:
        return [b""] * len(column)
    view = memoryview(data)
    texts = [view[a:b].tobytes() for a, b in zip(ends, ends[1:])]
    if column.null_count:
        texts = [t if ok else b"" for t, ok in zip(texts, column.is_valid().to_pylist())]
    return texts


def _trim():
    """glibc's malloc_trim, or nothing where there is none."""
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda keep: None


def return_memory() -> None:
    """Let this worker's batches go back to the system when they are done with: workers stay on between tasks,
    and both Arrow's own allocators and the heap of freed strings keep what the largest batch took."""
    pa.set_memory_pool(pa.system_memory_pool())
    _trim()(0)


def arrow_rows(df: DataFrame, schema: str, make) -> DataFrame:
    """Rows that ``make()``'s function gives for each Arrow batch of ``df``; ``make`` runs once a task.

    The function returns a dict of arrays in the order of ``schema``, or None for no rows.
    """
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches):
        step = make()
        for batch in batches:
            columns = step(batch)
            if columns is not None:
                yield pa.RecordBatch.from_arrays([columns[name] for name in names], names)

    return df.mapInArrow(run, schema)
