"""Settings, commands, ledgers of files, archive, rules over time."""

import json

import pytest
from pyspark.sql import functions as F

from threadloom import commands, config
from threadloom.operators import archive, sequential
from threadloom.sources import ledgers, model_server


def test_merge_and_bounds():
    c = config.merge({"truncate": {"maxLines": 10}, "level": "summarize"}, None, [1], {"truncate": {"maxKB": 5}})
    assert (c.truncate.maxLines, c.truncate.maxKB, c.level, c.maxContextChars) == (10, 5, "summarize", 60_000)
    for bad in ({"level": "x"}, {"protectedTurns": 0}, {"protectedTurns": 51}, {"truncate": {"maxKB": 1.5}}, {"enabled": 1}, {"summarize": {"localUrl": "no"}}, {"errors": 3}):
        with pytest.raises(config.Invalid):
            config.merge(bad)


def test_files(tmp_path):
    path = str(tmp_path / "c.json")
    assert config.load(path)[1]
    config.update_file(path, [("errors.contextLines", 3), ("level", "structural")])
    c, warning = config.load(path)
    assert warning is None and c.errors.contextLines == 3 and c.level == "structural"
    (tmp_path / "c.json").write_text("{")
    c, warning = config.load(path)
    assert c == config.Config() and warning


@pytest.mark.parametrize(
    "words, kind, changes",
    [
        ("", "status", ()), ("on", "toggle", (("enabled", True),)), ("level truncate", "level", (("level", "truncate"),)), ("level x", "unknown", ()), ("maxchars 0.4", "unknown", ()), ("maxchars 99.5", "maxchars", (("maxContextChars", 100),)),
        ("protect 50", "protect", (("protectedTurns", 50),)), ("protect 51", "unknown", ()), ("truncate 10 2", "truncate", (("truncate.maxLines", 10), ("truncate.maxKB", 2))), ("truncate 10", "unknown", ()), ("errors off", "errors-toggle", (("errors.enabled", False),)),
        ("errors lines 30", "errors-lines", (("errors.contextLines", 30),)), ("errors lines 31", "unknown", ()), ("errors archive on", "errors-archive", (("errors.archive", True),)), ("errors clear", "errors-clear", ()), ("errors retention 366", "unknown", ()),
        ("summarize via cloud", "summarize-via", (("summarize.via", "cloud"),)), ("summarize cloud", "unknown", ()), ("summarize after 1", "unknown", ()), ("summarize after 9", "summarize-after", (("summarize.afterTurns", 9),)), ("measure", "measure", ()), ("measure off", "measure-toggle", (("stats.measure", False),)),
        ("measure x", "unknown", ()), ("reset", "reset", ()), ("nonsense", "unknown", ()),
    ],
)
def test_parse(words, kind, changes):
    got = commands.parse(words.split())
    assert (got.kind, got.changes) == (kind, changes)


def test_apply_and_texts(tmp_path):
    path = str(tmp_path / "c.json")
    c, said = commands.apply(commands.parse(["truncate", "10", "2"]), config.Config(), path)
    assert c.truncate.maxKB == 2 and said and json.loads((tmp_path / "c.json").read_text())["truncate"]["maxLines"] == 10
    with pytest.raises(config.Invalid):
        commands.apply(commands.parse(["summarize", "after", "101"]), c, path)
    assert commands.apply(commands.parse(["help"]), c, path) == (c, "")
    assert "Nothing" in commands.stats_text(c, None) and "No runs" in commands.measure_text(None, [])
    total = {"runs": 2, "tasks": 1, "span_ms": 86_400_000, "chars_before": 1000, "chars_after": 675, "saved": 325, "mean_saved": 163, "median_saved": 163, "max_saved": 200, "summarize_calls": 0}
    assert "32.5 % less" in commands.measure_text(total, [], 1) and "1 day" in commands.measure_text(total, [])
    assert commands.usd(0.005) == "$0.0050" and "level truncate" in commands.status_text(c)


def test_ledger_files(spark, tmp_path):
    path = str(tmp_path / "m.jsonl")
    for i in range(6):
        ledgers.append(path, {"kind": "run", "task": f"t{i}", "at": i, "chars_before": 10}, limit=100)
    with open(path, "a") as f:
        f.write("broken\n\n" + json.dumps({"kind": "other", "task": "x", "chars_before": 1}) + "\n")
    there = [p for p in ledgers.files(path) if (tmp_path / p.rsplit("/", 1)[1]).exists()]
    assert len(there) > 1
    got = ledgers.run_records(ledgers.lines(spark, there)).orderBy("generation", "line").collect()
    assert [r.task for r in got if r.valid] == [f"t{i}" for i in range(6)] and sum(not r.valid for r in got) == 2


def test_retention(spark):
    files = spark.createDataFrame([(f"f{i}", i * 1000, 50) for i in range(8)], "path string, mtime long, size long")
    got = {r.path: r.reason for r in archive.retention(files, 8000, 300, 200, None).collect()}
    assert [p for p, why in sorted(got.items()) if why == "cap"] == ["f0", "f1", "f2", "f3"]
    day = 86_400_000
    old = spark.createDataFrame([("a", 0, 50), ("b", 2 * day, 50)], "path string, mtime long, size long")
    assert {r.path: r.reason for r in archive.retention(old, 2 * day, 60, 40, 1).collect()} == {"a": "age", "b": None}


def test_gate_opens_for_successes_only(spark):
    outcomes = ["f", "f", "s", "f", "n", "f", "f", "n", "s"]
    df = spark.createDataFrame([(1, i, o == "f", o == "s") for i, o in enumerate(outcomes)], "k int, i int, failed boolean, succeeded boolean")
    got = [r.open for r in sequential.failure_gate(df, "k", ["i"]).orderBy("i").collect()]
    assert got == [True] * 7 + [False] * 2


def test_throttle_bounds(spark):
    df = spark.createDataFrame([(1, 0), (1, 60), (1, 61), (1, 120), (2, 5)], "k int, t long")
    emitted = lambda strict: [r.t for r in sequential.throttled(df, "k", "t", 60, strict).filter("emitted and k = 1").orderBy("t").collect()]
    assert emitted(False) == [0, 60, 120] and emitted(True) == [0, 61]


def test_throttle_of_equal_times(spark):
    df = spark.createDataFrame([(1, 5, n) for n in (3, 1, 2, 0)], "k int, t long, n int").repartition(3)
    assert [r.n for r in sequential.throttled(df, "k", "t", 60, False, tie=["n"]).filter("emitted").collect()] == [0]


def test_unreachable_server():
    got = model_server.status("http://127.0.0.1:9", 0.5)
    assert not got["reachable"] and got["error"]


def test_epoch_is_independent_of_zone(spark):
    from threadloom.functions.text import epoch_ms

    df = spark.sql("SELECT TIMESTAMP_NTZ'1970-01-02 00:00:00' AS ts")
    assert df.select(epoch_ms("ts").alias("m")).first().m == 86_400_000
    assert df.select(F.lit(1)).count() == 1


def test_running_stats_of_equal_times(spark):
    from threadloom.operators import ledger

    rows = [("a", 5, n, 10**n, 1) for n in (3, 1, 4, 2, 0)]
    got = ledger.running_stats(spark.createDataFrame(rows, "task string, at long, line long, saved long, chars_before long"), "line").collect()
    assert {r.line: (r.passes_so_far, r.saved_so_far) for r in got} == {n: (n + 1, int("1" * (n + 1))) for n in range(5)}
