"""What a Python worker keeps from task to task: the tokenizer of one operator at a time.

Spark reuses its Python workers for whatever stage comes next, so what one operator left in
them would count against the executor's memory in all later stages. Operators that need much
memory, or none of a tokenizer, release it first.
"""

from __future__ import annotations

import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa

_kept: dict[Any, Any] = {}


def kept(key: Any, build: Callable[[], Any]) -> Any:
    """Built once per worker, unless another key was asked for or :func:`release` called meanwhile."""
    if key not in _kept:
        release()
        _kept[key] = build()
    return _kept[key]


def release() -> None:
    """Give back what is kept; costs nothing where nothing is."""
    if _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
