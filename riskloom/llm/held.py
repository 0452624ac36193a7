"""What a Python worker holds between its tasks: the cache of one operator at most.

Spark keeps workers from task to task and from stage to stage. A cache of some 100 MB that one operator filled
would stay with every later stage of the session, beside what that stage needs itself.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

_HELD: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """This worker's own ``make()``, made once; what it holds under another key goes first."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def let_go() -> None:
    """For tasks that need no cache of an earlier operator."""
    _HELD.clear()
