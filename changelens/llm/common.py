"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import threading
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import cut_at, shared_path

#: The six ASCII white-space characters of the contracts.
SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table that lower-cases A-Z only; UTF-8 lead and trail bytes stay.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    return shared_path(spark, name)


#: Spark setting by which an execution's shuffle files go when it ends; how many writes hold it on, and what it was before them.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleanup, _writers, _before = threading.Lock(), 0, None


@contextmanager
def _shuffle_files_go(spark: SparkSession):
    """Holds the setting on while any thread writes, and puts it back with the last."""
    global _writers, _before
    with _cleanup:
        if not _writers:
            _before = spark.conf.get(SHUFFLE_CLEANUP, None)
            spark.conf.set(SHUFFLE_CLEANUP, "true")
        _writers += 1
    try:
        yield
    finally:
        with _cleanup:
            _writers -= 1
            if not _writers:
                spark.conf.unset(SHUFFLE_CLEANUP) if _before is None else spark.conf.set(SHUFFLE_CLEANUP, _before)


def kept_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As written(), with the path, for a table that remove() takes away once what follows has been written."""
    spark = df.sparkSession
    with _shuffle_files_go(spark):
        return cut_at(df, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back. The write's shuffle files are deleted with its end."""
    return kept_at(df, name)[0]


def boxed(df: DataFrame, *more: Column) -> DataFrame:
    """All columns of df as one struct `row`, and `more` beside it: no column of the caller's can clash with a working one."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *more)


def unboxed(df: DataFrame, columns: list[str], **added: Column) -> DataFrame:
    """The columns of `row`, but those whose names, in whatever case, added takes, and then added."""
    taken = {a.lower() for a in added}
    return df.select(*[F.col(f"row.`{c}`").alias(c) for c in columns if c.lower() not in taken], *[v.alias(k) for k, v in added.items()])


def give_back() -> None:
    """Return a Python worker's free memory, which it would hold while idle."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; the cheap path takes pure ASCII, where lower() does the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """Bind value once inside an expression, so that lambdas in body don't evaluate it per element."""
    return F.transform(F.array(value), body)[0]


def byte_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def store(path: str):
    """(file system, path on it) of a path in the shared folder, for Python on the driver or an executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def slices(batch: pa.RecordBatch, column: str | pa.Array, most_bytes: int):
    """Cut a record batch into runs of rows whose text, in the column named or given, stays under most_bytes; a longer text stands alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column) if isinstance(column, str) else column), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and size + n > most_bytes:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)

