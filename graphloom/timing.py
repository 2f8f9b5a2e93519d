"""Timers of named phases."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager


class Timers:
    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    def report(self) -> str:
        return "\n".join(f"{name}: {s:.3f} s" for name, s in self.seconds.items())
