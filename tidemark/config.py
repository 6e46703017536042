"""Settings of a deployment, from the environment; one that cannot be read leaves the default."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from typing import Any

PREFIX = "TIDEMARK_"
TRUE = frozenset(("1", "true", "yes", "on"))


@dataclass(frozen=True)
class Settings:
    brief_tokens: int = 500
    summary_every: int = 25
    transcript_chars: int = 24_000
    retention_days: int = 0
    half_life_days: float = 14.0
    min_score: float = 0.12
    redact: bool = True
    summary_model: str = ""
    embedder_options: dict | None = None


def _read(text: str, like: Any) -> Any:
    if isinstance(like, bool):
        return text.strip().lower() in TRUE
    if isinstance(like, (int, float)):
        return type(like)(text)
    if isinstance(like, str):
        return text
    value = json.loads(text)
    if not isinstance(value, dict):
        raise ValueError("no object")
    return value


def settings(env: Mapping[str, str] | None = None) -> Settings:
    """Settings from variables named like the fields, with PREFIX, in capitals. Blank and unreadable ones count as unset."""
    env, given = os.environ if env is None else env, {}
    for f in fields(Settings):
        text = env.get(PREFIX + f.name.upper(), "")
        if text.strip():
            try:
                given[f.name] = _read(text, f.default)
            except ValueError:
                continue
    return Settings(**given)
