import pytest
from pyspark.sql import functions as F

from threadloom.functions import errors, text
from threadloom.operators import passes


def values(spark, column, items, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r[1] for r in df.select("i", column(F.col("x"))).orderBy("i").collect()]


TSC = "lib/queue/worker.ts:208:17 - error TS2345: Argument of type 'Job' is not assignable to parameter of type 'Task'.\n\n208       schedule(job);\n                   ~~~\nlib/z.ts:9:2 - error TS7: other"
TSC_NEAR = "tsc --noEmit\nlib/queue/worker.ts:208:17 - error TS2345: Argument of type 'Job' is not assignable to parameter of type 'Task'.\n208       schedule(job);  \n                   ~~~\n\nlib/z.ts:9:2 - error TS7: other"
PYTHON = 'Traceback (most recent call last):\n  File "/srv/jobs/nightly.py", line 3, in <module>\n    main()\n  File "/srv/jobs/nightly.py", line 77, in load\n    row = table[key]\nKeyError: \'cpu\''
JEST = "  ● queue keeps the order of jobs\n\n    expect(first).toBe(last)\n      at D:\\q.js (node:internal/timers:4:5)\n      at Worker.next (D:\\lib\\worker.test.ts:61:9)\n"


@pytest.mark.parametrize(
    "log, body",
    [
        (TSC, "error TS2345: Argument of type 'Job' is not assignable to parameter of type 'Task'.\nat lib/queue/worker.ts:208:17\n(+1 more tsc error entries)"),
        (TSC_NEAR, "error TS2345: Argument of type 'Job' is not assignable to parameter of type 'Task'.\nat lib/queue/worker.ts:208:17\n  208       schedule(job);\n                     ~~~\n(+1 more tsc error entries)"),
        (PYTHON, "KeyError: 'cpu'\nat /srv/jobs/nightly.py:77 in load\n  row = table[key]"),
        (JEST, "failure blocks: queue keeps the order of jobs\nat D:\\lib\\worker.test.ts:61:9 (Worker.next)"),
        ("FAILED a/b.py::t - AssertionError: x", "pytest FAILED: AssertionError: x\nat a/b.py::t"),
        ("Traceback (most recent call last):\nno error line\nFAILED a - b", None),
        ("DiskFailure: full", "DiskFailure: full"),
        ("Error: x", None),
        ("TypeError: x\r\nmore", None),
        ("TypeError: x\n    at f (/a/node_modules/b.js:1:2)\n    at g (/src/c.js:3:4)", "TypeError: x\nat /src/c.js:3:4 (g)"),
        ("all is well", None),
        ("", None),
        (None, None),
    ],
)
def test_error_summary(spark, log, body):
    assert values(spark, errors.summary, [log]) == [body]


def test_context_is_bounded(spark):
    log = "a.ts:1:1 - error TS1: m\n" + "\n".join(f"{i} x" for i in range(20))
    got = values(spark, lambda c: errors.summary(c, 3), [log])[0]
    assert got.split("\n")[2:] == ["  0 x", "  1 x", "  2 x"]


def test_secrets(spark):
    k = "a1B2" * 8
    cases = {
        f"key sk-{k}": "key [REDACTED]",
        "AKIA" + "Z" * 16: "[REDACTED]",
        f"ghp_{k}": "[REDACTED]",
        f"Bearer {k}": "Bearer [REDACTED]",
        "postgres://u:p@h/db": "postgres://[REDACTED]@h/db",
        "https://a/b?x=1&sig=abc&y": "https://a/b?x=1&sig=[REDACTED]&y",
        "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----": "[REDACTED-PRIVATE-KEY]",
        "password: 'hunter2' ok": "password=[REDACTED] ok",
        "nothing here": "nothing here",
    }
    assert values(spark, text.mask_secrets, list(cases)) == list(cases.values())


def test_scalars(spark):
    assert values(spark, text.half_up, [-2.5, 2.5, 2.4], "double") == [-2, 3, 2]
    assert values(spark, text.u16len, ["a😀b", None, ""]) == [4, 0, 0]
    assert values(spark, text.trim, ["\u00a0\n x \ufeff", "\u2028"]) == ["x", ""]
    assert values(spark, text.blank, [None, "", " \u3000", "x"]) == [True, True, True, False]
    assert values(spark, text.usd, [0.0, -1.0, 0.00123, 1.234, None], "double") == ["$0.00", "$0.00", "$0.0012", "$1.23", "$0.00"]
    long = values(spark, text.safe_name, ["x" * 90 + "1", "x" * 90 + "2", "a/b", ""])
    assert len(set(long)) == 4 and long[2].startswith("a_b-") and long[3].startswith("unknown-")


def test_output_text(spark):
    part = lambda c: text.output_text(F.lit("json"), c)
    items = ['{"stdout":"a","stderr":"e","exitCode":1}', '{"stdout":"","stderr":"e"}', '{"stdout":1}', '{"rows":[1]}', "[1]", "no json"]
    assert values(spark, part, items) == ["a\ne", "\ne", None, None, None, None]
    events = ['"plain"', '{"content":[{"type":"text","text":"a"},{"type":"text","text":"b"}]}', '{"content":[{"type":"text","text":"a"},{"type":"image"}]}', '{"stdout":"o"}', "5"]
    assert values(spark, text.event_text, events) == ["plain", "a\nb", None, "o", None]


def test_with_streams_keeps_other_members(spark):
    got = values(spark, lambda c: text.with_streams(c, F.lit('x"y')), ['{"stdout":"a","exitCode":1,"stderr":"b"}', '{"stdout":"a"}'])
    assert got == ['{"stdout":"x\\"y","stderr":"","exitCode":1}', '{"stdout":"x\\"y","stderr":""}']


def test_truncated(spark):
    cut = lambda lines, kb: lambda c: passes.truncated(c, lines, kb, passes.Marks())
    rows = "\n".join(f"line {i}" for i in range(300))
    got = values(spark, cut(100, 20), [rows])[0].split("\n")
    assert got[:60] == rows.split("\n")[:60] and got[61:] == rows.split("\n")[-40:] and "300 lines → 100" in got[60]
    one = values(spark, cut(200, 20), ["x" * 30_000])[0]
    assert len(one) <= 20_480 and "29 KB → 20 KB" in one
    assert values(spark, cut(1, 20), ["a\n" * 49 + "a"])[0].endswith("output removed\n")
    assert values(spark, cut(200, 20), ["short", ""]) == ["short", ""]
