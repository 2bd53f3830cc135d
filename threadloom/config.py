"""Settings: bounds, defaults, merging, and the file they are kept in."""

from __future__ import annotations

import dataclasses
import json
import os
import re
from dataclasses import dataclass, field
from typing import Any


class Invalid(ValueError):
    """A setting is out of its bounds or of a wrong type."""


def _number(low: int, high: int | None = None):
    def check(name: str, v: Any) -> int:
        if isinstance(v, bool) or not isinstance(v, (int, float)) or v != int(v) or v < low or high is not None and v > high:
            raise Invalid(f"{name}: {v!r} is no whole number from {low}" + (f" to {high}" if high else ""))
        return int(v)

    return check


def _flag(name: str, v: Any) -> bool:
    if not isinstance(v, bool):
        raise Invalid(f"{name}: {v!r} is neither true nor false")
    return v


def _choice(*options: str):
    def check(name: str, v: Any) -> str:
        if v not in options:
            raise Invalid(f"{name}: {v!r} is none of {', '.join(options)}")
        return v

    return check


def _text(least: int = 0):
    def check(name: str, v: Any) -> str:
        if not isinstance(v, str) or len(v) < least:
            raise Invalid(f"{name}: {v!r} is no text" + " or empty" * bool(least))
        return v

    return check


def _url(name: str, v: Any) -> str:
    if not isinstance(v, str) or not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:\S+\Z", v):
        raise Invalid(f"{name}: {v!r} is no URL")
    return v


def setting(default: Any, check) -> Any:
    return field(default=default, metadata={"check": check})


@dataclass(frozen=True)
class Truncate:
    maxLines: int = setting(200, _number(1))
    maxKB: int = setting(20, _number(1))
    maxInputChars: int = setting(2000, _number(1))


@dataclass(frozen=True)
class Errors:
    enabled: bool = setting(True, _flag)
    minChars: int = setting(8000, _number(1))
    contextLines: int = setting(8, _number(1, 30))
    toolLevel: bool = setting(False, _flag)
    archive: bool = setting(True, _flag)
    retentionDays: int = setting(30, _number(1, 365))


@dataclass(frozen=True)
class Summarize:
    afterTurns: int = setting(8, _number(2, 100))
    minChars: int = setting(8000, _number(1))
    via: str = setting("local", _choice("local", "cloud"))
    localModel: str = setting("qwen2.5-coder:3b", _text(1))
    localUrl: str = setting("http://127.0.0.1:11434", _url)
    cloudModelId: str = setting("", _text())
    maxSummaryChars: int = setting(4000, _number(1))


@dataclass(frozen=True)
class Ui:
    showStatusBadge: bool = setting(True, _flag)


@dataclass(frozen=True)
class Stats:
    measure: bool = setting(True, _flag)


@dataclass(frozen=True)
class Config:
    enabled: bool = setting(True, _flag)
    level: str = setting("truncate", _choice("structural", "truncate", "summarize"))
    maxContextChars: int = setting(60_000, _number(1))
    protectedTurns: int = setting(2, _number(1, 50))
    truncate: Truncate = field(default_factory=Truncate)
    errors: Errors = field(default_factory=Errors)
    summarize: Summarize = field(default_factory=Summarize)
    ui: Ui = field(default_factory=Ui)
    stats: Stats = field(default_factory=Stats)

    def to_dict(self) -> dict:
        return dataclasses.asdict(self)


def _build(kind, values: Any, at: str = ""):
    if not isinstance(values, dict):
        raise Invalid(f"{at or 'settings'}: {values!r} is no object")
    made = {}
    for f in dataclasses.fields(kind):
        if f.name in values:
            name = f"{at}.{f.name}".lstrip(".")
            made[f.name] = f.metadata["check"](name, values[f.name]) if "check" in f.metadata else _build(f.default_factory, values[f.name], name)
    return kind(**made)


def merge(*parts: Any) -> Config:
    """Later parts win, one level deep; what is no object counts as nothing. Unknown members are ignored."""
    out: dict = {}
    for part in parts:
        for k, v in (part.items() if isinstance(part, dict) else ()):
            out[k] = {**out[k], **v} if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return _build(Config, out)


def load(path: str) -> tuple[Config, str | None]:
    """The settings of a file, or the defaults and a warning."""
    try:
        with open(path, encoding="utf-8") as f:
            return merge(json.load(f)), None
    except (OSError, ValueError) as e:
        return Config(), f"{os.path.basename(path)} can't be read ({e}); defaults are used"


def save(config: Config, path: str) -> None:
    """Whole or not at all: a file beside it is written, synced and renamed."""
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(config.to_dict(), f, indent=2, ensure_ascii=False)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f"{path}.tmp", path)


def updated(config: Config, changes: list[tuple[str, Any]]) -> Config:
    """A copy with dotted paths set."""
    values = config.to_dict()
    for path, value in changes:
        *above, last = path.split(".")
        at = values
        for k in above:
            if not isinstance(at.get(k), dict):
                at[k] = {}
            at = at[k]
        at[last] = value
    return _build(Config, values)


def update_file(path: str, changes: list[tuple[str, Any]]) -> Config:
    """Change settings in the file by one write; it starts from the file's settings, or the defaults."""
    config = updated(load(path)[0], changes)
    save(config, path)
    return config
