"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lapse.session import worker_path
from lapse.staging import drop_path, drop_staged, shared_path, staged

__all__ = ["drop_path", "drop_staged", "is_empty", "shared_path", "staged", "tidy", "worker_path"]


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after which the worker gives freed memory back to the system:
    workers live on between tasks, and an executor's memory holds them all."""

    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return tidied
