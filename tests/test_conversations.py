"""Clean-up, passes and the whole plan on conversations built here."""

import json
import random

import pytest
from pyspark.sql import functions as F

from threadloom.config import Config, Summarize
from threadloom.operators import ledger, passes, region, structural, summarize
from threadloom.plans.compaction import compact
from threadloom.sources.messages import SCHEMA, from_json, part

SCHEMA_NAMES = ("conv_id", "pos", "msg_id", "role", "kind", "text", "parts")


def said(role, content):
    return {"role": role, "content": content}


def call(i, tool="bash", given=None, words="Running the tool..."):
    parts = [{"type": "tool-call", "toolCallId": i, "toolName": tool, "input": given or {"command": "x"}}]
    return said("assistant", ([{"type": "text", "text": words}] if words else []) + parts)


def result(i, value, tool="bash"):
    return said("tool", [{"type": "tool-result", "toolCallId": i, "toolName": tool, "output": {"type": "text", "value": value}}])


def rows(messages):
    out = []
    for i, m in enumerate(messages):
        c = m["content"]
        kind = "string" if isinstance(c, str) else "parts"
        out.append({"conv_id": 0, "pos": i, "msg_id": str(i), "role": m["role"], "kind": kind, "text": c if kind == "string" else None, "parts": [part(p) for p in c] if kind == "parts" else None})
    return out


def cleaned(spark, *chats):
    """Messages that remain of each conversation, without their columns of state, and the characters that went."""
    df = spark.createDataFrame([m | {"conv_id": n} for n, c in enumerate(chats) for m in c], SCHEMA)
    out = [([], 0) for _ in chats]
    for r in structural.structural(df, 2).orderBy("conv_id", "pos").collect():
        kept, _ = out[r.conv_id]
        kept.append({k: v for k, v in r.asDict(recursive=True).items() if k in SCHEMA_NAMES} | {"conv_id": 0})
        out[r.conv_id] = (kept, r.structural_removed)
    return out


def repeated(n, words):
    chat = [said("user", "task")]
    for k in range(n):
        chat += [call(f"c{k}", words=words), result(f"c{k}", "same")]
    return rows(chat + [said("user", "a"), said("user", "b")])


@pytest.mark.parametrize("words, left", [("", 1), ("Running", 2)])
def test_repeats_depend_on_what_is_kept(spark, words, left):
    [(out, _)] = cleaned(spark, repeated(4, words))
    assert sum(m["role"] == "tool" for m in out) == left


def test_different_calls_with_equal_results_stay(spark):
    chat = rows([said("user", "t"), call("a", given={"n": 1}, words=""), result("a", "1"), call("b", given={"n": 2}, words=""), result("b", "1"), said("user", "x"), said("user", "y")])
    [(out, removed)] = cleaned(spark, chat)
    assert len(out) == 7 and removed == 0


def test_empty_answers_and_results_go_with_their_calls(spark):
    chat = rows([said("user", "t"), said("assistant", "  "), call("a", words=""), result("a", " "), said("assistant", "one"), said("assistant", "two"), said("user", "x"), said("user", "y")])
    [(out, removed)] = cleaned(spark, chat)
    assert [m["role"] for m in out] == ["user", "assistant", "user", "user"]
    assert out[1]["parts"][0]["text"] == "one\n\ntwo" and removed == 2 + len('{"command":"x"}') + 1


def test_rich_parts_and_summaries_stay(spark):
    rich = said("assistant", [{"type": "reasoning", "text": "hm"}])
    chat = rows([said("user", "t"), rich, said("assistant", structural.SUMMARY_MARK + " s"), said("assistant", "after"), said("user", "x"), said("user", "y")])
    [(out, removed)] = cleaned(spark, chat)
    assert len(out) == 6 and removed == 0 and json.loads(out[1]["parts"][0]["raw"])["text"] == "hm"


def test_every_call_keeps_its_result(spark):
    rng = random.Random(7)
    chats = []
    for _ in range(300):
        chat, k = [said("user", "t")], 0
        for _ in range(rng.randrange(12)):
            ids = [f"i{k + j}" for j in range(rng.choice([1, 1, 2]))]
            k += len(ids)
            parts = [{"type": "tool-call", "toolCallId": i, "toolName": "t", "input": {"n": rng.randrange(2)}} for i in ids]
            chat.append(said("assistant", ([{"type": "text", "text": "w"}] if rng.random() < 0.4 else []) + parts))
            chat.append(said("tool", [{"type": "tool-result", "toolCallId": i, "toolName": "t", "output": {"type": "text", "value": rng.choice(["", "a", "b"])}} for i in ids]))
            if rng.random() < 0.3:
                chat.append(said(rng.choice(["user", "assistant"]), rng.choice(["", "m"])))
        chats.append(rows(chat + [said("user", "x"), said("user", "y")]))
    for before, (out, removed) in zip(chats, cleaned(spark, *chats)):
        parts = [p for m in out for p in m["parts"] or ()]
        calls = {p["call_id"] for p in parts if p["type"] == "tool-call"}
        results = {p["call_id"] for p in parts if p["type"] == "tool-result"}
        assert calls == results and removed >= 0
        start, end = structural.edges_of([m["role"] for m in before], 2)
        place = lambda ms: [{k: v for k, v in m.items() if k != "pos"} for m in ms]
        assert place(out[:start]) == place(before[:start]) and place(out[len(out) - (len(before) - end) :]) == place(before[end:])
        assert [m["pos"] for m in out] == list(range(len(out)))


def test_walk_sees_no_text(spark):
    """What is sent to Python has the same columns of figures and digests however long the texts are, and white space of any kind is blank."""
    chat = rows([said("user", "t"), said("assistant", "\u3000\n"), call("a"), result("a", "y" * 100_000), call("b"), result("b", "y" * 100_000), said("user", "x"), said("user", "y")])
    df = spark.createDataFrame(chat, SCHEMA)
    assert max(len(str(v)) for r in structural.skeleton(df, "m").collect() for v in r) == 64
    [(out, removed)] = cleaned(spark, chat)
    assert removed == 2 + 100_000 + len('{"command":"x"}') and [m["role"] for m in out] == ["user", "assistant", "tool", "assistant", "user", "user"]




@pytest.mark.parametrize("users, n, protected, want", [([0], 10, 2, (1, 5)), ([0], 10, 1, (1, 1)), ([0, 5], 10, 2, (1, 1)), ([0, 5, 8], 10, 2, (1, 5)), ([], 4, 2, (0, 0)), ([2], 4, 3, (3, 3))])
def test_region(spark, users, n, protected, want):
    chat = [said("user" if i in users else "assistant", "m") for i in range(n)]
    assert structural.edges_of([m["role"] for m in rows(chat)], protected) == want
    b = region.bounds(from_json(spark, {1: chat}), protected).first()
    assert (b.region_start, b.region_end) == want


# The texts of the published synthetic session.
TOPICS = ["schema", "validation", "discounts", "export", "taxes", "audit log", "caching"]
FILES = ["schema.ts", "validate.ts", "discount.ts", "export.ts", "tax.ts", "audit.ts", "cache.ts"]
READ = "\n".join(f"line {i}: export function helper{i}() {{ return {i * 11}; }} // module code with realistic padding" for i in range(260))
TESTS = "\n".join(f"  OK test case {i} passed ({'billing' if i % 7 == 0 else 'core'} suite, {12 + i % 90}ms)" for i in range(250))
QUOTED = "'x'"
BUILD = "\n".join(f"src/module{i % 9}.ts:{10 + i}:{5 + i % 3} - error TS2322: Type 'string' is not assignable to type 'number'.\n  {10 + i}   const result: number = compute({QUOTED if i % 2 == 0 else i});\n      {'~' * 14}" for i in range(300)) + "\n\nFound 300 errors in 9 files."


def session():
    ids = iter(range(1000))

    def tool(name, given, output):
        i = f"k{next(ids)}"
        return [call(i, name, given), result(i, output, name)]

    run = lambda: tool("power---bash", {"command": "npm test -- --no-color"}, TESTS)
    chat = [said("user", "Build the invoicing service: CRUD endpoints, discount handling, CSV export and full test coverage.")]
    for k, (topic, name) in enumerate(zip(TOPICS, FILES)):
        chat += [said("user", f"Requirement {k + 1}: adjust the {topic} part."), said("assistant", f"Understood. I will change the {topic} module and run the checks.")]
        chat += tool("power---file-read", {"filePath": f"src/{name}"}, READ) + run() + [said("assistant", f"Done with {topic}; tests green.")]
    chat += [said("user", "Add strict typing and fix the compile errors."), *tool("power---bash", {"command": "npx tsc --noEmit --no-color"}, BUILD)]
    chat += [said("user", "Re-run the suite to confirm nothing snaps."), *run(), *run(), said("user", "Export the final CSV with discounts applied.")]
    chat += tool("power---grep", {"pattern": "exportCsv", "filePattern": "src/**/*.ts"}, "src/export.ts:42: export function exportCsv()") + run()
    chat += [said("user", "Also document the API in README."), *tool("power---file-read", {"filePath": "README.md"}, READ), said("assistant", "Adding the endpoint list to README now.")]
    return chat


#: Marks of the published lengths, as what replaces a text counts in what was saved.
GOLDEN = passes.Marks(cut="brief: truncated", error="brief: error summary -", summary="[brief-condensed]", note="n" * 124)


def test_published_figures(spark):
    chat = session()
    df = from_json(spark, {1: chat})
    assert len(chat) == 67 and region.sizes(df).first().chars == 351_403
    out, report, _ = compact(df, Config(), marks=GOLDEN)
    r = report.first()
    assert (r.structural_removed, r.error_removed, r.truncate_removed) == (11_287, 45_440, 56_343)
    assert r.chars_before - r.chars_after == 113_070
    assert region.sizes(out).first().chars == 351_403 - 113_070


def test_summary_level(spark):
    df = from_json(spark, {1: session()})
    stub = "s" * 414
    config = Config(level="summarize", summarize=Summarize(afterTurns=8))
    out, report, keep = compact(df, config, generate=lambda p: stub, marks=GOLDEN)
    r = report.first()
    assert r.summarize_removed == 202_193 and r.chars_before - r.chars_after == 315_263 and r.summarizer == "local"
    assert region.sizes(out).first().chars == 351_403 - 315_263
    again = compact(df, config, generate=lambda p: 1 / 0, cache=spark.createDataFrame(keep.collect(), summarize.CACHE), marks=GOLDEN)[1].first()
    assert again.summarize_calls == 0 and again.summarize_removed == 202_193
    failed = compact(df, config, generate=lambda p: 1 / 0, marks=GOLDEN)[1].first()
    assert failed.summarize_failed and failed.summarize_removed == 0 and failed.summarize_calls == 1
    grown = compact(df, Config(level="summarize", summarize=Summarize(maxSummaryChars=10**6)), generate=lambda p: "x" * 400_000, marks=GOLDEN)[1].first()
    assert grown.summarize_calls == 1 and grown.summarized_ranges == 0 and not grown.summarize_failed
    off = compact(df, config, generate=lambda p: stub, disabled=df.select("conv_id").distinct(), marks=GOLDEN)[1].first()
    assert off.summarize_calls == 0


def test_one_summary_for_all_outputs(spark, tmp_path):
    """A generator that says something else each time is asked once, and its text is the same in messages, report and cache."""
    calls = str(tmp_path / "calls")

    def generate(prompt):
        import uuid

        said = uuid.uuid4().hex
        with open(calls, "a") as f:
            f.write(said + "\n")
        return said

    df = from_json(spark, {k: session() for k in (1, 2, 3)})
    settings = Config(level="summarize", summarize=Summarize(afterTurns=8))
    out, report, keep = compact(df, settings, generate=generate)
    put = {r.conv_id: r.text for r in out.filter("msg_id like 'summary-%'").collect()}
    assert sum(r.summarize_calls for r in report.collect()) == 3 and out.count() and report.count() == 3
    assert {r.conv_id: r.summary for r in keep.collect()} == put
    asked = open(calls).read().split()
    assert len(asked) == 3 and sorted(t[-32:] for t in put.values()) == sorted(asked)


def test_kept_summaries(spark):
    """Reused while the region ends where it ended, extended by a little without a user turn, not used after a change of settings."""
    settings = Summarize(afterTurns=1, minChars=100)
    chat = [said("user", "task"), said("assistant", "a" * 300), said("user", "more"), said("assistant", "b" * 300), said("assistant", "c" * 20), said("user", "x")]
    df = from_json(spark, {1: chat}).withColumns({"region_start": F.lit(1), "region_end": F.lit(5)})
    ids = [r.msg_id for r in df.orderBy("pos").collect()]

    def action(through, kept=settings):
        cache = spark.createDataFrame([(1, through, "s" * 50, "local", summarize.fingerprint(kept))], summarize.CACHE)
        out, result, keep = summarize.summarized(df, settings, lambda p: "fresh", cache)
        r = result.first()
        return r.action, r.summarize_removed, out.count(), [k.through_id for k in keep.collect()]

    assert action(ids[4]) == ("reuse", 574, 3, [ids[4]])
    assert action(ids[3]) == ("extend", 554, 4, [ids[4]])
    assert action(ids[1])[0] == "generate" and action("gone")[0] == "generate"
    assert action(ids[4], Summarize(afterTurns=1, minChars=100, maxSummaryChars=999))[0] == "generate"


def test_input_of_a_long_region(spark):
    """Head and tail of what was said, whatever lies between."""
    chat = [said("user", "task"), *(said("assistant", f"{k:05d} " + "w" * 494) for k in range(200)), said("user", "x")]
    df = from_json(spark, {1: chat}).withColumns({"region_start": F.lit(1), "region_end": F.lit(201)})
    raw = "\n\n".join("ASSISTANT:\n" + m["content"] for m in chat[1:201])
    got = summarize.regions(df).first().input
    assert got == f"[How the conversation began]\n{raw[:8000]}\n\n[How it went on most recently]\n{raw[-22000:]}"


def test_short_or_switched_off_stays(spark):
    chat = [said("user", "a"), said("assistant", ""), said("user", "b")]
    for config, messages in ((Config(), chat), (Config(enabled=False), session())):
        out, report, _ = compact(from_json(spark, {1: messages}), config)
        r = report.first()
        assert not r.touched and r.chars_before == r.chars_after and out.count() == len(messages)


def test_truncate_pass_shapes(spark):
    rows_ = json.dumps
    big = "\n".join(f"line {i}" for i in range(300))
    outputs = [{"type": "json", "value": {"stdout": big, "stderr": "w", "exitCode": 1}}, {"type": "json", "value": {"rows": ["x" * 50] * 3000}}, {"type": "error-json", "value": {"m": "y" * 90_000}}, {"type": "text", "value": big}]
    chat = [said("user", "t")]
    for i, o in enumerate(outputs):
        chat += [call(f"a{i}", given={"v": "z" * 3000}), said("tool", [{"type": "tool-result", "toolCallId": f"a{i}", "toolName": "t", "output": o}])]
    chat += [said("user", "x"), said("user", "y")]
    out, report, _ = compact(from_json(spark, {1: chat}), Config(maxContextChars=1))
    got = {r.pos: r for r in out.collect()}
    first = json.loads(got[2].parts[0].out)
    assert first["exitCode"] == 1 and first["stderr"] == "" and "condensed: truncated" in first["stdout"] and "line 299" not in first["stdout"][:100]
    assert got[4].parts[0].out_type == "text" and got[6].parts[0].out == rows_(outputs[2]["value"], separators=(",", ":")) and "300 lines" in got[8].parts[0].out
    assert json.loads(got[1].parts[1].input)["originalChars"] == 3008
    r = report.first()
    assert r.truncate_removed > 0 and r.touched


def test_ledger_math(spark):
    schema = "task string, at long, chars_before long, chars_after long, saved long, summarize_calls long"
    one = spark.createDataFrame([("a", 0, 1000, 900, 100, 0), ("b", 5, 1000, 700, 300, 1), ("a", 9, 1000, 800, 200, 0)], schema)
    r = ledger.measure(one).first()
    assert (r.runs, r.tasks, r.span_ms, r.saved, r.saved_tokens, r.mean_saved, r.median_saved, r.max_saved) == (3, 2, 9, 600, 150, 200, 200, 300)
    assert [x.task for x in ledger.top_tasks(one).collect()] == ["a", "b"]
    two = spark.createDataFrame([("a", k, 0, 0, v, 0) for k, v in enumerate((-2, -3))], schema)
    assert ledger.measure(two).first().median_saved == -2
    assert ledger.measure(one.limit(0)).count() == 0
