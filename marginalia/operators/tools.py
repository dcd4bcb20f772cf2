"""Named tools with permissions, and limits for nested calls."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from typing import Any


class Tools:
    """Functions that a caller may use if its set of permissions names them.

    A call inside a call counts one deeper; more than ``depth`` levels, or more than ``budget`` seconds since the
    outermost call began, are refused.
    """

    def __init__(self, depth: int = 2, budget: float = 8.0, clock: Callable[[], float] = time.monotonic):
        self.functions: dict[str, Callable[..., Any]] = {}
        self.permitted: dict[str, frozenset[str]] = {}
        self.depth, self.budget, self.clock = depth, budget, clock
        self._level, self._began = 0, 0.0

    def add(self, name: str, function: Callable[..., Any]) -> None:
        if name in self.functions:
            raise ValueError(f"{name} is there already")
        self.functions[name] = function

    def permit(self, caller: str, names: Iterable[str]) -> None:
        names = frozenset(names)
        if unknown := names - self.functions.keys():
            raise KeyError(f"unknown: {', '.join(sorted(unknown))}")
        self.permitted[caller] = names

    def call(self, caller: str, name: str, *args: Any, **kwargs: Any) -> Any:
        if name not in self.permitted.get(caller, ()):
            raise PermissionError(f"{caller} may not use {name}")
        if self._level >= self.depth:
            raise RecursionError(f"{name} lies deeper than {self.depth} calls")
        if not self._level:
            self._began = self.clock()
        elif self.clock() - self._began > self.budget:
            raise TimeoutError(f"{name} comes after {self.budget} seconds")
        self._level += 1
        try:
            return self.functions[name](*args, **kwargs)
        finally:
            self._level -= 1
