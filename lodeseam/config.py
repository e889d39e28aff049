"""Settings from the environment."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields
from typing import Any

#: Texts that mean true; every other text means false (fixed values).
TRUE = {"1", "true", "yes", "on"}


def _number(kind: Callable[[str], Any]) -> Callable[[str, Any], Any]:
    def read(text: str, default: Any) -> Any:
        try:
            return kind(text)
        except ValueError:
            return default

    return read


_READ = {"int": _number(int), "float": _number(float), "bool": lambda t, _: t.strip().lower() in TRUE, "str": lambda t, _: t}


@dataclass(frozen=True)
class Settings:
    store: str = "data/lodeseam"
    embedder: str = "hashing"
    embedding_dimensions: int = 256
    chunk_size: int = 1200
    chunk_overlap: int = 150
    max_pages: int = 50
    max_depth: int = 3
    request_timeout: float = 15.0
    respect_robots: bool = True
    crawl_delay: float = 1.0
    prune_missing: bool = True
    user_agent: str = "lodeseam/1.0"


def from_env(env: Mapping[str, str] | None = None, prefix: str = "LODESEAM_") -> Settings:
    """Settings with what the environment sets; numbers that cannot be read keep their default."""
    env = os.environ if env is None else env
    base = Settings()
    given = {f.name: _READ[str(f.type)](env[prefix + f.name.upper()], getattr(base, f.name)) for f in fields(base) if prefix + f.name.upper() in env}
    return Settings(**given)
