"""Settings from the environment, from a file of ``NAME=value`` lines, or given."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

PREFIX = "LEXMILL_"


def read_lines(path: str) -> dict[str, str]:
    """The values of a file of ``NAME=value`` lines; comments, blank and other lines are left out, quotes around values too."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        lines = [x.strip() for x in f]
    named = (x.split("=", 1) for x in lines if "=" in x and not x.startswith("#"))
    return {k.strip(): v.strip().strip("\"'") for k, v in named}


def value(name: str, env: Mapping[str, str] | None = None, file: str = ".env") -> str | None:
    """A value by name: the environment's unless it is empty, else the file's."""
    found = (os.environ if env is None else env).get(name, "").strip()
    return found or read_lines(file).get(name)


@dataclass(frozen=True)
class Settings:
    """Where a run reads and writes; any path that Spark can open."""

    train: str = "data/train.parquet"
    input: str = "data/validation.parquet"
    work: str = "work"
    log: str = "work/corrections"
    submission: str = "work/submission.zip"
    threshold: float = 0.5

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None, file: str = ".env") -> Settings:
        """The defaults, with what ``LEXMILL_<NAME>`` sets in the environment or the file."""
        found = {f.name: value(PREFIX + f.name.upper(), env, file) for f in fields(cls)}
        return cls(**{k: type(getattr(cls, k))(v) for k, v in found.items() if v})
