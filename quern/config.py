"""Configuration (file, then overrides), validation, and the path guard."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

from quern.functions.text import normalise_extensions

MB = 1_000_000


class ConfigError(ValueError):
    pass


class NotFound(FileNotFoundError):
    pass


class OutsideDirectory(PermissionError):
    pass


#: HTTP status by kind of error.
STATUS = {"NotFound": 404, "OutsideDirectory": 403, "NotAFile": 400, "UnsupportedFormat": 415, "TooLarge": 413, "Conversion": 500, "Internal": 500}


@dataclass
class Config:
    directory: str
    port: int = 8080
    bind: str = "127.0.0.1"
    max_file_size_mb: int = 20
    batch_size: int = 500
    batch_timeout_ms: int = 1000
    index_path: str = ""
    extensions: list[str] = field(default_factory=list)

    @property
    def max_bytes(self) -> int:
        return self.max_file_size_mb * MB


def load(file: str | None = None, **overrides) -> Config:
    """Overrides that are not None win over the file, which wins over defaults. Unknown keys are errors;
    a file that can't be read or parsed is ignored."""
    names = {f.name for f in fields(Config)}
    found: dict = {}
    if file:
        try:
            found = tomllib.loads(Path(file).read_text("utf-8"))
            if extra := set(found) - names:
                raise ConfigError(f"unknown keys: {', '.join(sorted(extra))}")
        except (OSError, tomllib.TOMLDecodeError, ConfigError):
            found = {}
    found |= {k: v for k, v in overrides.items() if v is not None}
    if not found.get("directory"):
        raise ConfigError("a directory is needed")
    c = Config(**found)
    c.index_path = c.index_path or os.path.join(c.directory, ".quern", "index")
    c.extensions = normalise_extensions(c.extensions)
    return validated(c)


def validated(c: Config) -> Config:
    if not os.path.isdir(c.directory):
        raise ConfigError(f"{c.directory} is not a directory")
    for name in ("port", "max_file_size_mb", "batch_size", "batch_timeout_ms"):
        if getattr(c, name) <= 0:
            raise ConfigError(f"{name} must be above zero")
    return c


def guarded(base: str, path: str) -> str:
    """The real path of a relative path below base; raises if it is empty, missing, or leads outside."""
    if not path:
        raise NotFound(path)
    if os.path.isabs(path) or ".." in Path(path).parts:
        raise OutsideDirectory(path)
    full = os.path.join(base, path)
    if not os.path.lexists(full) or not os.path.exists(full):
        raise NotFound(path)
    real, root = os.path.realpath(full), os.path.realpath(base)
    if os.path.commonpath([real, root]) != root:
        raise OutsideDirectory(path)
    return real
