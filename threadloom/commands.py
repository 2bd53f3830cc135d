"""Text commands: parsed into settings to change, and reports on what was saved."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from typing import Any

from . import config as settings
from .config import Config


@dataclass(frozen=True)
class Command:
    """What to do: a kind, and for settings the dotted paths to set."""

    kind: str
    changes: tuple[tuple[str, Any], ...] = ()
    said: str = ""
    raw: str = field(default="", compare=False)


def _whole(text: str | None, low: int, high: int | None = None) -> int | None:
    """A number rounded first, halves upwards, and then held against its bounds."""
    try:
        value = float(text)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None
    if not math.isfinite(value):
        return None
    n = math.floor(value + 0.5)
    return n if n >= low and (high is None or n <= high) else None


def _set(kind: str, path: str, value: Any, said: str) -> Command:
    return Command(kind, ((path, value),), said)


def _onoff(word: str | None) -> bool | None:
    return {"on": True, "off": False}.get(word or "")


def _numbered(args: list[str], kind: str, path: str, said: str, low: int = 1, high: int | None = None) -> Command | None:
    n = _whole(args[0] if args else None, low, high)
    return None if n is None else _set(kind, path, n, said.format(f"{n:,}"))


def _errors(args: list[str]) -> Command | None:
    word, rest = (args[0] if args else ""), args[1:]
    if (on := _onoff(word)) is not None:
        return _set("errors-toggle", "errors.enabled", on, f"error summaries {word}")
    if word == "clear":
        return Command("errors-clear")
    if word in ("toollevel", "archive"):
        on = _onoff(rest[0] if rest else None)
        path = {"toollevel": "errors.toolLevel", "archive": "errors.archive"}[word]
        return None if on is None else _set(f"errors-{word}", path, on, f"error {word} {rest[0]}")
    numbers = {"minchars": ("errors.minChars", "error summaries from {} characters", 1, None), "lines": ("errors.contextLines", "{} lines of context", 1, 30), "retention": ("errors.retentionDays", "archive kept for {} day(s)", 1, 365)}
    if word in numbers:
        path, said, low, high = numbers[word]
        return _numbered(rest, f"errors-{word}", path, said, low, high)
    return None


def _summarize(args: list[str]) -> Command | None:
    word, value = (args + ["", ""])[:2]
    if word == "via" and value in ("local", "cloud"):
        return _set("summarize-via", "summarize.via", value, f"summaries by {value}")
    if word == "model" and value:
        return _set("summarize-model", "summarize.localModel", value, f"local model {value}")
    if word == "cloud" and value:
        return _set("summarize-cloud", "summarize.cloudModelId", value, f"cloud model {value}")
    if word == "after":
        return _numbered([value], "summarize-after", "summarize.afterTurns", "summaries after {} turns", 2)
    return None


def _level(args: list[str]) -> Command | None:
    return _set("level", "level", args[0], f"level {args[0]}") if args and args[0] in ("structural", "truncate", "summarize") else None


def _truncate(args: list[str]) -> Command | None:
    lines, kb = (_whole(a, 1) for a in (args + ["", ""])[:2])
    return None if lines is None or kb is None else Command("truncate", (("truncate.maxLines", lines), ("truncate.maxKB", kb)), f"outputs cut to {lines} lines and {kb} KB")


def _measure(args: list[str]) -> Command | None:
    if not args:
        return Command("measure")
    on = _onoff(args[0])
    return None if on is None else _set("measure-toggle", "stats.measure", on, f"run records {args[0]}")


GRAMMAR = {
    "level": _level,
    "maxchars": lambda a: _numbered(a, "maxchars", "maxContextChars", "lossy passes above {} characters"),
    "protect": lambda a: _numbered(a, "protect", "protectedTurns", "{} turns protected", 1, 50),
    "truncate": _truncate,
    "errors": _errors,
    "summarize": _summarize,
    "measure": _measure,
    **{k: (lambda a, k=k: Command(k)) for k in ("status", "stats", "reset", "selftest", "help")},
    **{k: (lambda a, k=k: _set("toggle", "enabled", k == "on", f"compaction {k}")) for k in ("on", "off")},
}


def parse(args: list[str]) -> Command:
    """A command from words; what isn't understood becomes kind `unknown` with its words."""
    raw = " ".join(args)
    rule = GRAMMAR.get(args[0] if args else "status")
    return (rule(list(args[1:])) if rule else None) or Command("unknown", raw=raw)


def apply(command: Command, config: Config, path: str) -> tuple[Config, str]:
    """Write a command's changes to the settings file at once; commands without any leave `config` as it is."""
    if not command.changes:
        return config, ""
    return settings.update_file(path, list(command.changes)), command.said


HELP = """status | on | off | level structural|truncate|summarize
maxchars N | protect N (1 to 50) | truncate LINES KB
errors on|off|minchars N|lines N (1 to 30)|toollevel on|off|archive on|off|retention DAYS (1 to 365)|clear
summarize via local|cloud | summarize model NAME | summarize cloud ID | summarize after N (2 or more)
stats | measure [on|off] | reset | selftest | help"""


def tokens(chars: int) -> int:
    return math.floor(chars / 4 + 0.5)


def amount(chars: int) -> str:
    return f"{chars:,} chars (≈ {tokens(chars):,} tokens)"


def usd(value: float) -> str:
    return "$0.00" if not math.isfinite(value) or value <= 0 else f"${value:.4f}" if value < 0.01 else f"${value:.2f}"


def stats_text(config: Config, stats: dict | None, per_million: float | None = None, label: str = "") -> str:
    """A task's totals (a row of ledger.headline()) as text."""
    if not stats:
        return "Nothing recorded for this task so far."
    how = "measured as input before less after" if stats["measured"] else "sum of the passes, as sizes weren't recorded"
    lines = [f"{stats['passes']} run(s)", f"  saved: {amount(stats['saved_total'])}, {how}"]
    if per_million is not None:
        lines.append(f"  cost saved: {usd(tokens(stats['saved_total']) / 1e6 * per_million)}" + f" ({label})" * bool(label))
    lines += [f"  {p}: {amount(stats[p])}" for p in ("structural", "error", "truncate", "summarize")]
    lines.append(f"  summaries asked for: {stats['summarize_calls']}, last by {stats['last_summarizer'] or 'none'}")
    lines.append(f"  level {config.level}, lossy above {config.maxContextChars:,} chars, {config.protectedTurns} turn(s) protected")
    return "\n".join(lines)


def measure_text(total: dict | None, tasks: list[dict], more: int = 0) -> str:
    """Totals over runs (a row of ledger.measure()) and the top tasks as text; the reduction is a ratio of sums."""
    if not total:
        return "No runs recorded so far; switch records on with `measure on`."
    days = math.floor(total["span_ms"] / 86_400_000 * 10 + 0.5) / 10
    share = math.floor((total["chars_before"] - total["chars_after"]) / total["chars_before"] * 1000 + 0.5) / 10 if total["chars_before"] > 0 else 0
    lines = [
        f"{total['runs']} run(s) of {total['tasks']} task(s)" + f" over {days:g} day(s)" * (total["span_ms"] > 0),
        f"  input: {amount(total['chars_before'])}, summed over runs that see the same conversation again",
        f"  output: {amount(total['chars_after'])}, {share:g} % less",
        f"  saved: {amount(total['saved'])}; a run: mean {amount(total['mean_saved'])}, median {amount(total['median_saved'])}, most {amount(total['max_saved'])}",
        f"  summaries asked for: {total['summarize_calls']}",
        *(f"    {t['task']}: {t['runs']} run(s), {amount(t['saved'])}" for t in tasks),
    ]
    return "\n".join(lines + [f"    and {more} more task(s)"] * (more > 0))


def status_text(config: Config, stats: dict | None = None) -> str:
    c = config
    lines = [
        f"{'on' if c.enabled else 'OFF'}, level {c.level}, lossy above {c.maxContextChars:,} chars, {c.protectedTurns} turn(s) protected",
        f"  outputs cut to {c.truncate.maxLines} lines and {c.truncate.maxKB} KB, inputs to {c.truncate.maxInputChars} chars",
        f"  error summaries {'on' if c.errors.enabled else 'off'} from {c.errors.minChars:,} chars, {c.errors.contextLines} lines of context, archive {'on' if c.errors.archive else 'off'} for {c.errors.retentionDays} day(s)",
        f"  summaries by {c.summarize.via} ({c.summarize.localModel if c.summarize.via == 'local' else c.summarize.cloudModelId or 'the model of the task'}) after {c.summarize.afterTurns} turns and {c.summarize.minChars:,} chars",
        "  defaults: " + json.dumps({k: Config().to_dict()[k] for k in ("level", "maxContextChars", "protectedTurns", "truncate")}),
    ]
    return "\n".join(lines + ([stats_text(config, stats)] if stats else []))
