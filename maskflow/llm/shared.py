"""Shared storage and size-checked joins for the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskflow.functions.storage import Shelf, clean_up, discard, scratch, shared_dir, stored

__all__ = ["Shelf", "clean_up", "discard", "local_path", "release", "scratch", "shared_dir", "sized_join", "stored", "stored_bytes", "whole_number"]

#: A side of a join is broadcast only when its files hold at most this many bytes.
BROADCAST_BYTES = 16 << 20


def stored_bytes(df: DataFrame) -> int:
    """Size of the files behind a DataFrame that was just read from storage."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(stats.sizeInBytes())


def sized_join(left: DataFrame, right: DataFrame, on, how: str = "left", bound: int = BROADCAST_BYTES, otherwise: str = "merge") -> DataFrame:
    """Join ``left`` with a stored ``right``.

    ``right`` is broadcast if its files are within ``bound``; beyond it both
    sides are shuffled on the key, where adaptive execution splits hot keys: it
    can as ``right`` is read from storage and not a grouping of the same stage.
    """
    # files are compressed, so the bound counts them four times over
    if stored_bytes(right) * 4 <= bound:
        return left.join(F.broadcast(right), on, how)
    return left.join(right.hint(otherwise), on, how)


def local_path(uri: str) -> str | None:
    """The path of a ``file:`` URI or plain path, else None."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def release() -> None:
    """Give a worker's freed memory back to the machine, as its next task may be of another kind."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def whole_number(df: DataFrame, name: str) -> int | None:
    """The place of a column that holds whole numbers, or None."""
    return next((k for k, f in enumerate(df.schema) if f.name == name and isinstance(f.dataType, (T.IntegerType, T.LongType))), None)
