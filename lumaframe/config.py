"""Settings from the environment (prefix ``LUMAFRAME_``)."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Defaults of the operators; every field can be set by an environment variable."""

    min_gain: float = 0.02
    top_k: int = 3
    folds: int = 4
    seed: int = 42
    rounds: int = 3
    tokenizer_dir: str = "/opt/tokenizers"
    near_cosine: float = 0.99

    @classmethod
    def from_environment(cls, prefix: str = "LUMAFRAME_") -> Settings:
        kinds = {"float": float, "int": int, "str": str}
        given = {f.name: os.environ.get(prefix + f.name.upper()) for f in fields(cls)}
        return cls(**{f.name: kinds[str(f.type)](given[f.name]) for f in fields(cls) if given[f.name] is not None})
