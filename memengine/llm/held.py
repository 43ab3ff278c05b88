"""What a Python worker keeps from one task to the next: one large object at a time.

Workers outlive the stage they were started for.  A stage that builds a table of
its own, or needs the room, lets go of what an earlier stage has left.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable
from typing import Any

MMAP_FROM_BYTES = 1 << 18
_M_MMAP_THRESHOLD = -3  # fixed value: its number in mallopt(3)
_HELD: dict[Hashable, Any] = {}
_SET = False


def give_back_arrays() -> None:
    """From now on arrays of some size go back to the system when they are freed, where the C library can do that.

    By default the bound rises with the arrays a process has freed, and a worker keeps the most it ever used.
    """
    global _SET
    if not _SET:
        _SET = True
        try:
            libc = ctypes.CDLL(None)
            libc.mallopt(_M_MMAP_THRESHOLD, MMAP_FROM_BYTES)
            libc.malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library; only memory is at stake


def held(key: Hashable, build: Callable[[], Any]) -> Any:
    if key not in _HELD:
        let_go()
        _HELD[key] = build()
    return _HELD[key]


def let_go() -> None:
    give_back_arrays()
    _HELD.clear()
