"""Steps in order, the first failure ends the run."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Step:
    name: str
    run: Callable[[], object]
    needs: list[str] = field(default_factory=list)


@dataclass
class Budget:
    """A wall-clock budget: expired() tells a loop over batches when to stop."""

    seconds: float
    clock: Callable[[], float] = time.monotonic
    began: float | None = None

    def expired(self) -> bool:
        self.began = self.clock() if self.began is None else self.began
        return self.clock() - self.began >= self.seconds


class Latest:
    """Guards a state against answers that come late: only the answer to the last request counts."""

    def __init__(self):
        self._last = 0

    def begin(self) -> int:
        """A new request's id; all earlier ones are stale from now on."""
        self._last += 1
        return self._last

    def is_current(self, request: int) -> bool:
        return request == self._last


def ordered(steps: list[Step]) -> list[Step]:
    """Steps after all that they need, otherwise as given; ValueError for unknown names and circles."""
    done: dict[str, Step] = {}
    names = {s.name for s in steps}
    if missing := {n for s in steps for n in s.needs} - names:
        raise ValueError(f"unknown steps: {sorted(missing)}")
    while len(done) < len(steps):
        ready = next((s for s in steps if s.name not in done and all(n in done for n in s.needs)), None)
        if ready is None:
            raise ValueError("steps need each other")
        done[ready.name] = ready
    return list(done.values())


def run_steps(steps: list[Step], budget: Budget | None = None) -> list[tuple[str, str, float]]:
    """(name, ok or failed or skipped, seconds) of each step; what follows a failure or the budget's end is skipped."""
    log: list[tuple[str, str, float]] = []
    stopped = False
    for step in ordered(steps):
        if stopped or budget and budget.expired():
            log.append((step.name, "skipped", 0.0))
            continue
        began = time.monotonic()
        try:
            step.run()
            state = "ok"
        except Exception:
            state, stopped = "failed", True
        log.append((step.name, state, time.monotonic() - began))
    return log
