"""Identities of configurations and of pieces of work."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import dataclass


def stable_hash(config: Mapping) -> str:
    """SHA-256 of a configuration, whatever the order of its keys; NaN is refused."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), allow_nan=False, ensure_ascii=False).encode()).hexdigest()


@dataclass(frozen=True)
class Task:
    """The key of a piece of work; seed and seed_type are given together."""

    analysis_id: str
    model_name: str
    space_name: str
    scale: int
    source: str
    seed_type: str | None = None
    seed: int | None = None

    def __post_init__(self):
        if type(self.scale) is not int or self.scale <= 0:
            raise ValueError("a scale is a positive integer")
        if self.seed is not None and (type(self.seed) is not int or self.seed < 0):
            raise ValueError("a seed is an integer, not negative")
        if (self.seed_type is None) != (self.seed is None):
            raise ValueError("seed and seed_type are given together")

    @property
    def key(self) -> str:
        return stable_hash(self.__dict__)
