"""Memory of Python workers that serve one job after another."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import SparkSession

_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows that travel to a worker at once; whole texts always, so a longer row comes alone.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches of the session hold about BATCH_BYTES, unless a smaller bound is set; results do not depend on it."""
    now = spark.conf.get(_SETTING, "64m").lower().rstrip("b")
    size = int(now.rstrip("kmg")) << {"k": 10, "m": 20, "g": 30}.get(now[-1:], 0)
    if size < 0 or size > BATCH_BYTES:
        spark.conf.set(_SETTING, str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory to the system at the end of a task; a worker that is reused would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL("libc.so.6").malloc_trim(0)
