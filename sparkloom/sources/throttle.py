"""Reader-side pacing: a token bucket, a rate that adapts, and backoff."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class TokenBucket:
    rate: float
    burst: float
    clock: Callable[[], float] = time.monotonic
    tokens: float = field(init=False)
    at: float = field(init=False)

    def __post_init__(self):
        self.tokens, self.at = self.burst, self.clock()

    def take(self, cost: float = 1.0) -> float:
        """0 if granted now, else the seconds to wait."""
        now = self.clock()
        self.tokens, self.at = min(self.burst, self.tokens + (now - self.at) * self.rate), now
        if self.tokens >= cost:
            self.tokens -= cost
            return 0.0
        return (cost - self.tokens) / self.rate


@dataclass
class AdaptiveRate:
    rate: float
    most: float
    least: float = 0.05

    def slow_down(self) -> None:
        self.rate = max(self.least, self.rate / 2)

    def reward(self) -> None:
        self.rate = min(self.most, self.rate * 1.1)


@dataclass(frozen=True)
class Backoff:
    base: float = 0.4
    cap: float = 30.0
    attempts: int = 5

    def delay(self, attempt: int, retry_after: float | None = None, rng: random.Random | None = None) -> float:
        """Full jitter, but no less than the server asks for."""
        jitter = (rng or random).uniform(0, min(self.cap, self.base * 2**attempt))
        return max(jitter, retry_after or 0.0)

    def again(self, attempt: int, status: int | None) -> bool:
        return attempt < self.attempts and (status is None or status == 429 or status >= 500)
