"""Helpers that the training-data operators share: the shared scratch folder and byte-wise access to Arrow columns."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share. Only where that is unset and Spark runs in
    this one machine's process (tests) a local temporary folder is set instead; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write the rows as Parquet to the shared folder and read them again."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, taken) -> str:
    """A column name that is not taken yet, however a caller named its own columns."""
    while name.lower() in {t.lower() for t in taken}:
        name = f"_{name}"
    return name


def utf8(column: str | Column) -> Column:
    """The text as bytes; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def row_name(doc_id: str, text: Column) -> Column:
    """A row's name by id and text: two 64-bit hashes in 16 bytes. Equal rows have one name."""
    hashes = [F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(doc_id, text), F.xxhash64(text, F.lit(9), doc_id))]
    return F.unhex(F.concat(*hashes))


def byte_spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, n + 1 offsets) of a binary Arrow column without nulls, without a copy."""
    _, offsets, data = column.buffers()
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8), at


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges [lo, hi) of at most `most` bytes each, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64, copy=False), pa.int64())


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that, when it ends, gives back what the allocators of its worker still hold: Spark keeps workers
    for later stages, which would otherwise add theirs to it."""

    @wraps(run)
    def own(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return own
