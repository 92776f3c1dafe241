"""ML-11: the client interface, retries, usage; the only implementation shipped is a deterministic stand-in."""

from __future__ import annotations

import json
import random
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol


class ModelClient(Protocol):
    def complete(self, system: str, user: str) -> str: ...


class Busy(Exception):
    """A call worth repeating; ``after`` seconds if the service said so."""

    def __init__(self, message: str = "", after: float | None = None):
        super().__init__(message)
        self.after = after


@dataclass
class Usage:
    calls: int = 0
    chars_in: int = 0
    chars_out: int = 0
    lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def add(self, chars_in: int, chars_out: int) -> None:
        with self.lock:
            self.calls += 1
            self.chars_in += chars_in
            self.chars_out += chars_out


class RetryingClient:
    """Spaces calls, repeats those that may succeed later with growing, jittered waits, and counts what was used."""

    def __init__(self, inner: ModelClient, attempts: int = 6, spacing: float = 0.1, base_wait: float = 1.0, sleep: Callable[[float], None] = time.sleep, seed: int = 7):
        self.inner, self.attempts, self.spacing, self.base_wait, self.sleep = inner, attempts, spacing, base_wait, sleep
        self.usage = Usage()
        self._random, self._last, self._lock = random.Random(seed), 0.0, threading.Lock()

    def complete(self, system: str, user: str) -> str:
        for attempt in range(self.attempts):
            with self._lock:
                wait = self._last + self.spacing - time.monotonic()
                if wait > 0:
                    self.sleep(wait)
                self._last = time.monotonic()
            try:
                reply = self.inner.complete(system, user)
                self.usage.add(len(system) + len(user), len(reply))
                return reply
            except Busy as e:
                if attempt + 1 == self.attempts:
                    raise
                self.sleep(e.after if e.after is not None else self.base_wait * 2**attempt * (0.5 + self._random.random()))
        raise AssertionError("unreachable")


class CannedClient:
    """Replies from a list, in order; the last one repeats."""

    def __init__(self, *replies: str):
        self.replies, self.asked = list(replies), []

    def complete(self, system: str, user: str) -> str:
        self.asked.append((system, user))
        return self.replies.pop(0) if len(self.replies) > 1 else self.replies[0]


class FirstWords:
    """A stand-in that needs no service: a category per first word of a text; it labels every text with the category of that number."""

    def complete(self, system: str, user: str) -> str:
        lines = [line.partition("\t") for line in user.splitlines()]
        first = {t.split()[0].lower(): int(n) for n, _, t in lines if t.split()}
        places = {w: i for i, w in enumerate(sorted(first), 1)}
        results = [{"n": int(n), "label_ids": [str(places[t.split()[0].lower()])], "fit": 3} for n, _, t in lines if t.split()]
        return json.dumps({"candidates": [{"name": w, "evidence": [n]} for w, n in sorted(first.items())], "results": results})
