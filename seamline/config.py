"""Settings of the engine, from arguments, an env file or the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass


def read_env_file(path: str) -> dict[str, str]:
    """KEY=VALUE lines; blank lines and comments are skipped; a missing file is empty."""
    out = {}
    try:
        with open(path, encoding="utf-8") as f:
            for line in f:
                key, eq, value = line.strip().partition("=")
                if eq and key and not key.startswith("#"):
                    out[key.strip()] = value.strip().strip("\"'")
    except OSError:
        pass
    return out


def int_setting(source: dict[str, str], key: str, fallback: int) -> int:
    """A whole number, or the fallback where it is missing or none."""
    try:
        return int(source.get(key, ""))
    except ValueError:
        return fallback


@dataclass(frozen=True)
class Config:
    store: str
    dim: int = 1536
    bits: int = 4
    seed: int = 42
    max_chunk_bytes: int = 20_000
    default_limit: int = 10
    most_results: int = 50
    call_depth: int = 2
    yaml_compat: bool = False

    @classmethod
    def load(cls, store: str, env_file: str | None = None) -> Config:
        env = (read_env_file(env_file) if env_file else {}) | dict(os.environ)
        return cls(
            store,
            dim=int_setting(env, "EMBEDDING_DIM", cls.dim),
            bits=int_setting(env, "QUANTIZER_BITS", cls.bits),
            seed=int_setting(env, "QUANTIZER_SEED", cls.seed),
            max_chunk_bytes=int_setting(env, "SPLITTER_MAX_CHUNK_SIZE", cls.max_chunk_bytes),
            default_limit=int_setting(env, "SEARCH_DEFAULT_LIMIT", cls.default_limit),
            call_depth=int_setting(env, "CALL_GRAPH_DEFAULT_DEPTH", cls.call_depth),
        )
