"""Configuration from TOML, JSON or YAML files, with defaults and the environment on top."""

from __future__ import annotations

import json
import os
import tomllib
from collections.abc import Iterable, Mapping
from pathlib import Path
from typing import Any

#: Endings that are tried where a name has no file of its own.
ENDINGS = ("json", "yaml", "yml", "toml")


def _yaml(text: str) -> Any:
    import yaml  # only where a YAML file is used

    return yaml.safe_load(text)


READERS = {"json": json.loads, "toml": tomllib.loads, "yaml": _yaml, "yml": _yaml}


def find(name: str, folders: Iterable[str | Path]) -> Path | None:
    """The first folder's file of that name, else of its stem with a known ending."""
    at = [Path(f) for f in folders]
    names = [name, *(f"{Path(name).stem}.{e}" for e in ENDINGS)]
    return next((p for n in names for f in at if (p := f / n).is_file()), None)


def _merged(base: Mapping, top: Mapping) -> dict:
    out = dict(base)
    for k, v in top.items():
        out[k] = _merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def _typed(text: str, like: Any) -> Any:
    if isinstance(like, bool):
        return text.strip().lower() in ("1", "true", "yes", "on")
    if isinstance(like, (int, float)):
        return type(like)(text)
    return json.loads(text) if isinstance(like, (list, dict)) else text


def _overridden(config: dict, prefix: str, env: Mapping[str, str]) -> dict:
    """Values of variables PREFIX_KEY, PREFIX_KEY_INNER, ..., in the type of the value that they replace."""
    out = {}
    for k, v in config.items():
        name = f"{prefix}_{k}".upper()
        out[k] = _overridden(v, name, env) if isinstance(v, Mapping) else _typed(env[name], v) if name in env else v
    return out


def load(name: str, folders: Iterable[str | Path], defaults: Mapping | None = None, prefix: str = "KRONOGRAPH", env: Mapping[str, str] | None = None) -> dict:
    """Defaults, over them the file, over both the environment; a missing file leaves the defaults, and is an error without any."""
    path = find(name, folders)
    if path is None and defaults is None:
        raise FileNotFoundError(name)
    read: dict = {}
    if path is not None:
        reader = READERS.get(path.suffix[1:].lower())
        if reader is None:
            raise ValueError(f"{path}: no reader for this ending")
        read = reader(path.read_text()) or {}
    return _overridden(_merged(defaults or {}, read), prefix, os.environ if env is None else env)
