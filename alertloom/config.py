"""Vocabulary and parameters of the feature families."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """``cash`` and ``intl`` name the two types whose shares are tracked together; ``shift_types`` those whose shifts are measured."""

    # fixed values, up to the last line: windows, hour bins, half-lives, trends, velocities and limits must be these for equal features
    types: tuple[str, ...] = ("card", "transfer", "cash", "intl")
    directions: tuple[str, ...] = ("in", "out")
    cash: str = "cash"
    intl: str = "intl"
    shift_types: tuple[str, ...] = ("card", "transfer", "cash")
    windows: tuple[int, ...] = (1, 3, 7, 14, 30, 60, 90)
    shift_windows: tuple[int, ...] = (7, 14, 30, 60)
    last_k: int = 20
    burst_seconds: int = 300
    half_lives: tuple[int, ...] = (3, 7, 30)
    trends: tuple[int, ...] = (30, 60, 90, 180)
    hour_bins: tuple[int, ...] = (0, 6, 9, 12, 15, 18, 21, 24)
    velocities: tuple[tuple[str, int], ...] = (("5m", 300), ("1h", 3600), ("6h", 21600), ("24h", 86400))


EVENTS = EngineConfig(types=("click", "view", "purchase", "signup", "error"), cash="purchase", intl="signup", shift_types=("click", "view", "purchase"), windows=(1, 3, 7, 14), shift_windows=(3, 7), last_k=5, burst_seconds=21600)
LINEITEM = EngineConfig(types=("A", "N", "R"), cash="N", intl="R", shift_types=("A", "N", "R"), windows=(30, 90, 180, 365, 730), shift_windows=(90, 365), last_k=5, burst_seconds=86400)
