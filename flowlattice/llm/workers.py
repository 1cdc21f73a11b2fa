"""State that a Python worker keeps between its tasks: loaded vocabularies and pure caches.

Functions reach the workers by value, so a module of theirs is made anew for every
task; a module of our own in ``sys.modules`` outlives them.  Only what depends on
nothing but its key may be kept.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Hashable
from types import ModuleType

_HOME = "flowlattice_worker_state"


def kept[T](slot: str, key: Hashable, make: Callable[[], T]) -> T:
    """What the last task of this process made for ``slot``, if it was for the same key; a new one takes its place."""
    state = sys.modules.setdefault(_HOME, ModuleType(_HOME)).__dict__.setdefault("kept", {})
    if slot not in state or state[slot][0] != key:
        state[slot] = (key, make())
    return state[slot][1]
