"""Settings from the environment (``LEXFRAME_STORE`` …) and a ``.env`` file; the environment prevails."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path

PREFIX = "LEXFRAME_"


@dataclass(frozen=True)
class Settings:
    store: str = "store"
    catalog: str = "catalog.json"
    landing: str = "raw"
    service: str = ""
    query_log: str = ""
    max_chars: int = 3200
    top_k: int = 8
    abstain_below: float | None = None
    log_level: str = "INFO"


def _dotenv(path: Path) -> dict[str, str]:
    lines = path.read_text("utf-8").splitlines() if path.is_file() else []
    pairs = (line.removeprefix("export ").split("=", 1) for line in map(str.strip, lines) if "=" in line and not line.startswith("#"))
    return {k.strip(): v.strip().strip("\"'") for k, v in pairs}


def load(environ: Mapping[str, str] | None = None, dotenv: str | Path = ".env") -> Settings:
    """Settings that are given, defaults otherwise; a value that is no number where one is needed is an error."""
    given = _dotenv(Path(dotenv)) | dict(os.environ if environ is None else environ)
    found = {}
    for f in fields(Settings):
        value = given.get(PREFIX + f.name.upper())
        if value:
            found[f.name] = int(value) if f.type == "int" else float(value) if "float" in str(f.type) else value
    return Settings(**found)
