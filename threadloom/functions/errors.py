"""Summaries of compiler, test and runtime errors as column expressions.

The first kind that matches gives the summary.  Patterns are applied to the
whole text in multi-line mode, where only the line feed ends a line; a carriage
return before it keeps a line from matching, as the message must reach its end.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS_LINE, blank, let, trim

_S = f"[{WS_LINE}]"
_ANY = r"[^\n\r\u2028\u2029]"
#: What error lines look like.
TSC = rf"^([^\s(]+\.\w+):(\d+):(\d+){_S}*-{_S}*error{_S}+(TS\d+):{_S}*({_ANY}*)$"
EXCERPT = rf"{_S}*\d+{_S}[^\n]*|{_S}*[~^][^\n]*"
TRACEBACK = r"^Traceback \(most recent call last\):"
PY_FRAME = rf"^{_S}*File \"([^\"\n]+)\", line (\d+), in ({_ANY}+)$"
PY_ERROR = rf"^([A-Za-z_][\w.]*(?:Error|Exception|Warning|Failure|Interrupt)):{_S}?({_ANY}*)$"
PY_FAILED = rf"^FAILED{_S}+([^\s]+){_S}*-{_S}*({_ANY}+)$"
TEST_FAILED = rf"^{_S}*[✕×]{_S}+({_ANY}+)$"
TEST_BLOCK = rf"^{_S}*●{_S}+({_ANY}+)$"
ANY_FRAME = rf"at{_S}+({_ANY}+?){_S}+\(([^)\n]+):(\d+):(\d+)\)"
NODE_ERROR = rf"^([A-Za-z_][\w.]*(?:Error|Exception)):{_S}?({_ANY}*)$"
NODE_FRAME = rf"^{_S}+at{_S}+({_ANY}+?){_S}+\(([^)\n]+):(\d+):(\d+)\)$"
PLAIN_ERROR = rf"^([A-Za-z_][\w.]*(?:Error|Exception|Failure)):{_S}?({_ANY}*)$"
NAMED = 5

_M = "(?md)"


def _group(text: Column, pattern: str, k: int) -> Column:
    return F.regexp_extract(text, _M + pattern, k)


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(_M + pattern)


def _after(text: Column, pattern: str) -> Column:
    """What follows the first match of a line, from the next line on."""
    return F.regexp_extract(text, rf"{_M}{pattern}(?:\n((?s:.*)))?", re.compile(pattern).groups + 1)


def _lines(*parts: Column) -> Column:
    """Parts joined by line feeds, null ones left out."""
    return F.concat_ws("\n", *parts)


def _trim_end(c: Column) -> Column:
    return F.regexp_replace(c, rf"[{WS_LINE}\n]+\z", "")


def tsc(text: Column, context: int) -> Column:
    excerpt = F.regexp_extract(_after(text, TSC), rf"\A((?:(?:{EXCERPT})(?:\n|\z)){{0,{context}}})", 1)
    kept = F.filter(F.split(excerpt, "\n", -1), lambda x: x != "")
    shown = F.when(F.size(kept) > 0, F.array_join(F.transform(kept, lambda x: F.concat(F.lit("  "), _trim_end(x))), "\n"))
    more = F.regexp_count(text, F.lit(_M + TSC)) - 1
    body = _lines(
        F.concat(F.lit("error "), _group(text, TSC, 4), F.lit(": "), _group(text, TSC, 5)),
        F.concat_ws(":", F.concat(F.lit("at "), _group(text, TSC, 1)), _group(text, TSC, 2), _group(text, TSC, 3)),
        shown,
        F.when(more > 0, F.concat(F.lit("(+"), more.cast("string"), F.lit(" more tsc error entries)"))),
    )
    return F.when(_has(text, TSC), body)


def _traced(rest: Column, before: Column, context: int) -> Column:
    """Summary of a traceback from what follows its first line, and the part of that before the error."""
    last = rf"(?d)\A(?s:.*)(?m:{PY_FRAME})"
    at = [F.regexp_extract(before, last, k) for k in (1, 2, 3)]
    # the lines right above the error, upwards to a blank line or a frame
    upwards = F.reverse(F.split(F.regexp_replace(before, r"\n\z", ""), "\n", -1))
    run = F.aggregate(
        upwards,
        F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("over")),
        lambda a, x: F.when(a["over"] | blank(x) | _has(x, PY_FRAME), F.struct(a["kept"].alias("kept"), F.lit(True).alias("over"))).otherwise(F.struct(F.concat(a["kept"], F.array(F.concat(F.lit("  "), trim(x)))).alias("kept"), F.lit(False).alias("over"))),
        lambda a: F.slice(a["kept"], 1, context),
    )
    source = let(run, lambda r: F.when(F.size(r) > 0, F.array_join(r, "\n")))
    frame = F.when(_has(before, PY_FRAME), _lines(F.concat(F.lit("at "), at[0], F.lit(":"), at[1], F.lit(" in "), at[2]), source))
    return F.when(_has(rest, PY_ERROR), _lines(F.concat(_group(rest, PY_ERROR, 1), F.lit(": "), _group(rest, PY_ERROR, 2)), frame))


def python(text: Column, context: int) -> Column:
    before = lambda rest: F.regexp_extract(rest, rf"(?d)\A((?s:.*?))(?m:{PY_ERROR})", 1)
    traced = let(_after(text, TRACEBACK + r"[^\n]*"), lambda rest: let(before(rest), lambda b: _traced(rest, b, context)))
    failed = F.when(_has(text, PY_FAILED), F.concat(F.lit("pytest FAILED: "), _group(text, PY_FAILED, 2), F.lit("\nat "), _group(text, PY_FAILED, 1)))
    return F.when(_has(text, TRACEBACK), traced).otherwise(failed)


def _frame(lines: Column, pattern: str, otherwise_first: bool) -> Column:
    """`at file:line:column (function)` of the first frame in the user's own code."""

    def chosen(frames: Column) -> Column:
        own = F.get(F.filter(frames, lambda x: ~F.regexp_extract(x, pattern, 2).rlike("node:internal|node_modules")), F.lit(0))
        return F.coalesce(own, F.get(frames, F.lit(0))) if otherwise_first else own

    def shown(frame: Column) -> Column:
        g = [F.regexp_extract(frame, pattern, k) for k in range(1, 5)]
        return F.concat(F.lit("at "), g[1], F.lit(":"), g[2], F.lit(":"), g[3], F.lit(" ("), _trim_end(g[0]), F.lit(")"))

    return let(let(F.filter(lines, lambda x: x.rlike(pattern)), chosen), shown)


def jest(text: Column) -> Column:
    def names(pattern: str, label: str) -> Column:
        found = F.slice(F.regexp_extract_all(text, F.lit(_M + pattern), F.lit(1)), 1, NAMED)
        return let(found, lambda f: F.when(F.size(f) > 0, F.concat(F.lit(label), F.array_join(F.transform(f, trim), " | "))))

    frame = _frame(F.split(text, "\n", -1), ANY_FRAME, False)
    return F.when(_has(text, TEST_FAILED) | _has(text, TEST_BLOCK), _lines(names(TEST_FAILED, "failed tests: "), names(TEST_BLOCK, "failure blocks: "), frame))


def node(text: Column) -> Column:
    frame = _frame(F.split(_after(text, NODE_ERROR), "\n", -1), NODE_FRAME.replace("^", r"\A", 1)[:-1] + r"\z", True)
    return F.when(_has(text, NODE_ERROR), _lines(F.concat(_group(text, NODE_ERROR, 1), F.lit(": "), _group(text, NODE_ERROR, 2)), frame))


def plain(text: Column) -> Column:
    return F.when(_has(text, PLAIN_ERROR), F.concat(_group(text, PLAIN_ERROR, 1), F.lit(": "), _group(text, PLAIN_ERROR, 2)))


def summary(text: Column, context: int = 8) -> Column:
    """The essence of an error output, or null where none is recognised; a kind's patterns are tried only where a word that it needs occurs."""

    def tried(t: Column) -> Column:
        holds = lambda *words: reduce(or_, (t.contains(w) for w in words))
        return F.coalesce(
            F.when(holds("error"), tsc(t, context)),
            F.when(holds("Traceback (most recent", "FAILED"), python(t, context)),
            F.when(holds("✕", "×", "●"), jest(t)),
            F.when(holds("Error:", "Exception:"), node(t)),
            F.when(holds("Failure:", "Error:", "Exception:"), plain(t)),
        )

    return let(text, tried)


def marked(text: Column, body: Column, label: str, suffix: str | Column) -> Column:
    """A summary under a line that tells how many lines it stands for."""
    count = lambda c: F.size(F.split(c, "\n", -1)).cast("string")
    suffix = F.lit(suffix) if isinstance(suffix, str) else suffix
    return F.concat(F.lit(f"… [{label} "), count(text), F.lit(" lines → "), count(body), F.lit(" lines]"), suffix, F.lit("\n"), body)
