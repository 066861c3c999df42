"""What the operators share: the shared folder, tables in it, Arrow batches, digests of words."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"
_KEPT: ContextVar[list[str] | None] = ContextVar("kept", default=None)
_TABLES: dict[str, Callable[[], None]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session (tests) may leave it unset and gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def file_system(path: str):
    """The store of a path or URI and the path in it."""
    return fs.FileSystem.from_uri(path if re.match(r"[a-z0-9]+:", path) else "file://" + path)


@contextmanager
def keeping(paths: list[str]):
    """Note in ``paths`` the tables that :func:`stored` makes within, so that the caller can drop them."""
    before = _KEPT.set(paths)
    try:
        yield
    finally:
        _KEPT.reset(before)


def drop(paths: list[str]) -> None:
    """Delete these tables and forget them. Only for callers who have no use for frames made from them."""
    while paths:
        store, inside = file_system(paths.pop())
        if store.get_file_info(inside).type == fs.FileType.Directory:
            store.delete_dir(inside)


def alone(name: str, forget: Callable[[], None] | None = None) -> None:
    """To be called where a task of an operator begins. Tables that other operators left in this Python worker go, and
    what they had freed goes back to the system, tables or not; ``forget`` drops this operator's own when another one's task comes."""
    others = [other for other in _TABLES if other != name]
    for other in others:
        _TABLES.pop(other)()
    _TABLES[name] = forget or (lambda: None)
    if others:
        _trim()


def _trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def handing_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A task whose freed memory goes back to the system as it ends: Spark keeps idle workers, which the next stage need not use."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _trim()

    return task


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: lost executors cost no earlier stage, and readers don't run the plan again."""
    path = shared_path(df.sparkSession, label)
    if (kept := _KEPT.get()) is not None:
        kept.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, for small frames of iterative jobs."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def slices(batch: pa.RecordBatch, text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in row ranges of at most ``most`` bytes of text, or a row alone (without empty ones) where its text is longer."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
    ends, start, total = [], 0, 0
    for row, size in enumerate(lengths):
        if row > (ends[-1] if ends else 0) and total + size > most:
            ends.append(row)
            total = 0
        total += size
    for end in [*ends, batch.num_rows]:
        if end > start:
            yield batch.slice(start, end - start)
            start = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and the offsets of each text (null: empty)."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def n_words(text) -> F.Column:
    """Number of runs of characters that are not ASCII white space (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (in place where it can)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
