"""Run profiles and constants of the measures."""

from __future__ import annotations

from dataclasses import dataclass

TAU = 0.5
TAU_GRID = (0.3, 0.4, 0.5, 0.6, 0.7)
CONTRADICTION = 0.3


@dataclass(frozen=True)
class Profile:
    name: str
    n_queries: int
    repeats: int
    registry_version: str = "v1"

    @property
    def expected_cells(self) -> int:
        return self.n_queries * self.repeats


PROFILES = {p.name: p for p in (Profile("pilot", 100, 3), Profile("scaleup", 250, 8, "v2"))}


@dataclass(frozen=True)
class Price:
    """Dollars per million tokens in and out, and per call."""

    tokens_in: float
    tokens_out: float
    per_call: float = 0.0
