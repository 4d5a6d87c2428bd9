"""What a Python worker process holds from task to task: encoders and caches of one operator at a time.

Workers outlive stages. An operator that begins drops what another left and gives its memory back to the system, so
that it doesn't add up.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa

_held: dict[str, dict[Hashable, Any]] = {}


def held(owner: str, key: Hashable = None, make: Callable[[], Any] = lambda: None) -> Any:
    """``owner``'s object under ``key``, made where it lacks; all other owners' objects are dropped."""
    if owner not in _held:
        if _held:
            _held.clear()
            give_back()
        _held[owner] = {}
    own = _held[owner]
    if key not in own:
        own[key] = make()
    return own[key]


def trimmed(made: Iterator[Any]) -> Iterator[Any]:
    """What a task makes; at its end it gives freed memory back, since the worker may idle while the JVM needs it."""
    yield from made
    give_back()


def give_back() -> None:
    """Return freed memory to the system, where its allocator can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
