"""Configuration: a YAML file with `paths` and `database_path`."""

from __future__ import annotations

import os
from dataclasses import dataclass

from ..functions.paths import expand_home

DEFAULT_DATABASE = "~/.leafquarry/catalog"


@dataclass(frozen=True)
class Config:
    paths: tuple[str, ...] = ()
    database_path: str = ""


def _plain_yaml(text: str) -> dict:
    """The two keys that matter, for installations without PyYAML."""
    out: dict = {}
    key = None
    for line in text.splitlines():
        line = line.split(" #")[0].rstrip()
        if not line or line.lstrip().startswith("#"):
            continue
        if line.lstrip().startswith("- ") and key:
            out.setdefault(key, [])
            out[key] = [*(out[key] or []), line.lstrip()[2:].strip().strip("'\"")]
        elif ":" in line:
            key, value = (x.strip() for x in line.split(":", 1))
            out[key] = value.strip("'\"") or None
    return out


def load(path: str) -> Config:
    """A missing file is an empty configuration."""
    path = expand_home(path)
    if not os.path.exists(path):
        return Config()
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml

        raw = yaml.safe_load(text) or {}
    except ImportError:
        raw = _plain_yaml(text)
    return Config(tuple(expand_home(p) for p in raw.get("paths") or ()), expand_home(raw.get("database_path") or ""))


def database_path(flag: str | None, config: Config) -> str:
    """The flag, else the configuration, else the default. A flag that is given must not be blank."""
    if flag is not None:
        if not flag.strip():
            raise ValueError("database path is empty")
        return expand_home(flag)
    return config.database_path or expand_home(DEFAULT_DATABASE)
