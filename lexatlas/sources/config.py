"""Layered YAML settings, prompt templates and artefact checks (driver side)."""

from __future__ import annotations

import os
import re
import tarfile
from collections.abc import Mapping
from functools import lru_cache
from pathlib import Path

_TEMPLATE = re.compile(r"^[A-Za-z0-9_-]{1,64}$")
_FOLDERS = ("system", "rag_templates")


def deep_merge(base: Mapping, extra: Mapping) -> dict:
    merged = dict(base)
    for key, value in extra.items():
        both = isinstance(value, Mapping) and isinstance(merged.get(key), Mapping)
        merged[key] = deep_merge(merged[key], value) if both else value
    return merged


def load_settings(folder: str | Path, environment: str = "base", overrides: Mapping[str, str] | None = None) -> dict:
    """``base.yaml`` under ``<environment>.yaml`` under explicit overrides (SRC-23).

    ``overrides`` maps dotted keys to environment variable names.
    """
    import yaml

    read = lambda name: yaml.safe_load((Path(folder) / f"{name}.yaml").read_text(encoding="utf-8")) or {}
    settings = read("base")
    if environment != "base":
        settings = deep_merge(settings, read(environment))
    for dotted, variable in (overrides or {}).items():
        if variable in os.environ:
            nested: dict | str = os.environ[variable]
            for key in reversed(dotted.split(".")):
                nested = {key: nested}
            settings = deep_merge(settings, nested)
    return settings


@lru_cache(maxsize=64)
def load_template(root: str, folder: str, name: str) -> str:
    """Prompt template by a plain name from a known folder (SRC-24)."""
    if folder not in _FOLDERS or not _TEMPLATE.match(name):
        raise ValueError("unknown template folder or unsafe template name")
    base = (Path(root) / folder).resolve()
    path = (base / f"{name}.md").resolve()
    path.relative_to(base)
    return path.read_text(encoding="utf-8").strip()


def extract_archive(archive: str | Path, target: str | Path) -> None:
    """Unpack a corpus archive, refusing links and paths that leave it (SRC-25)."""
    with tarfile.open(archive, "r:gz") as tar:
        for member in tar.getmembers():
            inside = (Path(target) / member.name).resolve().is_relative_to(Path(target).resolve())
            if not inside or not (member.isfile() or member.isdir()):
                raise ValueError(f"unsafe archive entry {member.name!r}")
        tar.extractall(target, filter="data")


def require_identity(stored: Mapping, current: Mapping) -> None:
    """A run may be resumed only when its identity is unchanged (V-09)."""
    changed = sorted(k for k in set(stored) | set(current) if stored.get(k) != current.get(k))
    if changed:
        raise ValueError(f"run identity changed: {', '.join(changed)}")


def readiness(paths: Mapping[str, str | Path]) -> dict[str, bool]:
    """Which required inputs are present (UDT-18)."""
    return {name: Path(path).exists() for name, path in paths.items()}
