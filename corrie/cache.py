"""Results of SELECTs by statement tree and table versions, the least recently used going first."""

from __future__ import annotations

import threading
from collections import OrderedDict
from collections.abc import Hashable
from typing import Any


class ResultCache:
    def __init__(self, capacity: int = 100) -> None:
        self.capacity, self._all, self._lock = capacity, OrderedDict(), threading.Lock()

    def get(self, key: Hashable) -> Any | None:
        with self._lock:
            if key in self._all:
                self._all.move_to_end(key)
            return self._all.get(key)

    def put(self, key: Hashable, value: Any) -> None:
        with self._lock:
            self._all[key] = value
            self._all.move_to_end(key)
            while len(self._all) > self.capacity:
                self._all.popitem(last=False)

    def forget(self, table: str) -> None:
        """Keys are (statement, ((table, version), ...))."""
        with self._lock:
            for key in [k for k in self._all if any(t == table for t, _ in k[1])]:
                del self._all[key]

    def clear(self) -> None:
        with self._lock:
            self._all.clear()

    def __len__(self) -> int:
        return len(self._all)
