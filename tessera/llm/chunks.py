"""A two-generation cache for results of pre-tokens, kept by each Python worker between tasks of its operator."""

from __future__ import annotations

import ctypes
import weakref
from collections.abc import Callable

_filled: weakref.WeakValueDictionary[int, Chunks] = weakref.WeakValueDictionary()


def trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def drop_all() -> None:
    """Empty this process's caches: operators that use none call it, so that a worker that goes on from an operator's
    tasks to another's doesn't hold both's memory."""
    if _filled:
        for c in list(_filled.values()):
            c.clear()
            c.old.clear()
        _filled.clear()
        trim()


class Chunks(dict):
    """chunk -> value; when `most` chunks are held, those not asked for since the last turn are dropped.

    Bounded, so a worker's memory doesn't grow with the corpus; what is dropped is worked out again.
    """

    def __init__(self, most: int = 500_000) -> None:
        super().__init__()
        self.most, self.old = most, {}

    def look(self, many: list[list[str]], learn: Callable[[list[str]], None], first: dict | None = None) -> list[list]:
        """Values of the chunks of each list; learn(new) has to set those of chunks that aren't held.

        first: a table that is asked before this cache.
        """
        get = (self if first is None else first).get
        found = [list(map(get, cs)) for cs in many]
        holes = [(k, [i for i, v in enumerate(f) if v is None]) for k, f in enumerate(found) if None in f]
        wanted = {many[k][i] for k, at in holes for i in at}
        if first is not None:
            wanted.difference_update(self)
        _filled[id(self)] = self
        new, old = [], self.old
        for c in wanted:
            v = old.get(c)
            if v is None:
                new.append(c)
            else:
                self[c] = v
        if new:
            learn(new)
        for k, at in holes:
            f, cs = found[k], many[k]
            for i in at:
                f[i] = self[cs[i]]
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        return found
