"""Python over Arrow columns, a few rows at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa

#: Rows, and bytes of Arrow data, that are Python objects at a time; a row alone may be larger.
ROWS, BYTES = 64, 1 << 20


def by_rows(one: Callable, out: pa.DataType, *columns: pa.Array) -> pa.Array:
    """one(*values) of every row. A whole batch as Python objects, several times over, is what fills a worker; here few rows are."""
    n, made, at = len(columns[0]), [], 0
    while at < n:
        k = ROWS
        while k > 1 and sum(c.slice(at, k).nbytes for c in columns) > BYTES:
            k //= 2
        made.append(pa.array([one(*row) for row in zip(*(c.slice(at, k).to_pylist() for c in columns))], out))
        at += k
    whole = pa.concat_arrays(made) if made else pa.array([], out)
    del made
    # Workers outlive their tasks, so what is freed goes back to the system.
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # only glibc has it
        pass
    return whole
