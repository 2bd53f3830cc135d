"""Registered queries over the test tables, and their SQL.

The tables have no tool messages, so inputs with tools are derived from them by
expressions that both sides state.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..config import Config, Errors, Summarize, Truncate
from ..functions import errors, text
from ..operators import archive, ledger, passes, region, sequential, structural, summarize
from ..sources.messages import PART, from_turns
from ..streaming import tools
from .compaction import compact

MARKS = passes.Marks()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_turns(table(spark, sf_dir, "conversations"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, a null text as an empty one."""
    return table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))


_DOCS = "(SELECT * REPLACE (coalesce(text, '') AS text) FROM documents)"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


# --- regions and sizes

_BOUNDS = """
    c AS (SELECT conv_id, turn, role, text, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS back FROM conversations),
    b AS (SELECT conv_id, CAST(max(n) AS INTEGER) AS n_messages, CAST(count(*) FILTER (role = 'user') AS INTEGER) AS user_turns, min(turn) FILTER (role = 'user') AS first, max(turn) FILTER (role = 'user' AND back = {p}) AS nth FROM c GROUP BY conv_id),
    bounds AS (SELECT conv_id, n_messages, user_turns,
        CAST(CASE WHEN first IS NULL THEN 0 ELSE greatest(first + 1, 1) END AS INTEGER) AS region_start,
        CAST(CASE WHEN first IS NULL THEN 0 ELSE greatest(coalesce(nth, n_messages - 5), first + 1) END AS INTEGER) AS region_end FROM b)"""


def _bounds(p: int):
    query(f"WITH {_BOUNDS.format(p=p)} SELECT * FROM bounds", f"region_bounds_p{p}")(lambda spark, d: region.bounds(messages(spark, d), p))


for _p in (1, 2, 3, 50):
    _bounds(_p)


@query(f"WITH {_BOUNDS.format(p=2)} SELECT c.conv_id, CAST(turn AS INTEGER) AS pos, role, length(text) AS chars FROM c JOIN bounds USING (conv_id) WHERE turn >= region_start AND turn < region_end")
def region_rows_p2(spark, d):
    return region.region_rows(messages(spark, d), 2).select("conv_id", "pos", "role", region.chars(F.col("kind"), F.col("text"), F.col("parts")).alias("chars"))


@query("SELECT conv_id, count(*) AS messages, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(floor(sum(length(text)) / 4.0 + 0.5) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def conv_sizes(spark, d):
    return region.sizes(messages(spark, d))


@query("SELECT conv_id, count(*) >= 4 AS long_enough, sum(length(text)) > 2000 AS large FROM conversations GROUP BY conv_id")
def compactable_gate(spark, d):
    s = region.sizes(messages(spark, d))
    return s.select("conv_id", (F.col("messages") >= 4).alias("long_enough"), (F.col("chars") > 2000).alias("large"))


# --- structural clean-up

_BLANKED = "CASE WHEN role = 'assistant' AND (conv_id + turn) % 5 = 0 THEN '  ' WHEN role = 'assistant' AND (conv_id + turn) % 7 = 0 THEN '[condensed-chat] x' ELSE text END"


@query(
    f"WITH {_BOUNDS.format(p=1)}, t AS (SELECT c.conv_id, turn, role, {_BLANKED} AS text, region_start, region_end FROM c JOIN bounds USING (conv_id)), "
    "g AS (SELECT *, turn >= region_start AND turn < region_end AND role = 'assistant' AND trim(text) = '' AS dropped FROM t) "
    "SELECT conv_id, count(*) FILTER (NOT dropped) AS kept, count(*) FILTER (dropped) AS dropped, CAST(coalesce(sum(length(text)) FILTER (dropped), 0) AS BIGINT) AS dropped_chars FROM g GROUP BY conv_id"
)
def structural_drop_empty(spark, d):
    m = from_turns(table(spark, d, "conversations").withColumn("text", F.expr(_BLANKED)))
    rows = structural.drop_empty(m, 1)
    return rows.groupBy("conv_id").agg(F.sum((~F.col("dropped")).cast("long")).alias("kept"), F.sum(F.col("dropped").cast("long")).alias("dropped"), F.sum(F.when(F.col("dropped"), F.col("chars")).otherwise(0)).alias("dropped_chars"))


_SPOKEN = "CASE WHEN turn >= 2 AND (conv_id * 7 + turn) % 3 = 0 THEN 'assistant' ELSE role END"


@query(
    f"WITH conversations AS (SELECT conv_id, turn, {_SPOKEN} AS role, text FROM conversations), {_BOUNDS.format(p=1)}, "
    "r AS (SELECT c.*, region_start, region_end, lag(role) OVER (PARTITION BY c.conv_id ORDER BY turn) AS before FROM c JOIN bounds USING (conv_id)), "
    "i AS (SELECT *, sum(CASE WHEN turn >= region_start AND turn < region_end AND role = 'assistant' AND before = 'assistant' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM r) "
    "SELECT conv_id, CAST(min(turn) AS INTEGER) AS first_pos, count(*) AS messages, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS text_md5 FROM i WHERE role = 'assistant' GROUP BY conv_id, island"
)
def structural_merge(spark, d):
    c = table(spark, d, "conversations").withColumn("role", F.expr(_SPOKEN))
    return structural.merged_islands(from_turns(c), 1).select("conv_id", "first_pos", "messages", F.md5("text").alias("text_md5"))


_REPEATS = "lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type AND lag(floor(value / 20)) OVER (PARTITION BY user_id ORDER BY ts, event_id) = floor(value / 20)"


@query(f"WITH e AS (SELECT event_id, user_id, coalesce({_REPEATS}, false) AS repeated FROM events) SELECT user_id, count(*) AS calls, count(*) FILTER (repeated) AS repeated FROM e GROUP BY user_id")
def structural_dedupe_adjacent(spark, d):
    e = table(spark, d, "events").withColumn("bucket", F.floor(F.col("value") / 20))
    rows = structural.repeated_calls(e, "user_id", ["ts", "event_id"], ["event_type", "bucket"])
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("repeated").cast("long")).alias("repeated"))


def tool_log(spark, d) -> DataFrame:
    """A conversation per user: a task, then per event a call that stands alone and its result, then two user turns."""
    e = table(spark, d, "events")
    n = F.expr("row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)").cast("int")
    rows = e.select(F.col("user_id").alias("conv_id"), n.alias("k"), F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("tool"), F.floor(F.col("value") / 20).cast("string").alias("bucket"))
    null = F.lit(None).cast("string")

    def part(kind, call, tool, given, out_type, out):
        return F.array(F.struct(F.lit(kind).alias("type"), null.alias("text"), call.alias("call_id"), tool.alias("tool"), given.alias("input"), out_type.alias("out_type"), out.alias("out"), null.alias("raw"))).cast(f"array<{PART}>")

    call = part("tool-call", F.col("id"), F.col("tool"), F.concat(F.lit('{"n":'), F.col("bucket"), F.lit("}")), null, null)
    result = part("tool-result", F.col("id"), F.col("tool"), null, F.lit("text"), F.concat(F.lit("result "), F.col("bucket")))
    none = F.lit(None).cast(f"array<{PART}>")
    users = rows.groupBy("conv_id").agg(F.max("k").alias("k"))

    def turn(pos, text_):
        return users.select("conv_id", pos.cast("int").alias("pos"), F.concat_ws("-", F.lit("u"), "conv_id", pos).alias("msg_id"), F.lit("user").alias("role"), F.lit("string").alias("kind"), F.lit(text_).alias("text"), none.alias("parts"))

    calls = rows.select("conv_id", (2 * F.col("k") - 1).alias("pos"), F.concat(F.lit("c"), "id").alias("msg_id"), F.lit("assistant").alias("role"), F.lit("parts").alias("kind"), null.alias("text"), call.alias("parts"))
    results = rows.select("conv_id", (2 * F.col("k")).alias("pos"), F.concat(F.lit("r"), "id").alias("msg_id"), F.lit("tool").alias("role"), F.lit("parts").alias("kind"), null.alias("text"), result.alias("parts"))
    return calls.unionByName(results).unionByName(turn(F.lit(0), "do it")).unionByName(turn(2 * F.col("k") + 1, "next")).unionByName(turn(2 * F.col("k") + 2, "last"))


@query(
    f"WITH e AS (SELECT user_id, CAST(CAST(floor(value / 20) AS BIGINT) AS VARCHAR) AS b, coalesce({_REPEATS}, false) AS repeated FROM events) "
    "SELECT user_id AS conv_id, CAST(2 * count(*) + 3 AS INTEGER) AS n_before, 2 * count(*) FILTER (NOT repeated) + 3 AS n_after, CAST(coalesce(sum(6 + length(b) + 7 + length(b)) FILTER (repeated), 0) AS BIGINT) AS structural_removed FROM e GROUP BY user_id"
)
def structural_fold(spark, d):
    out = structural.structural(tool_log(spark, d), 2)
    return out.groupBy("conv_id").agg(F.first("n_before").alias("n_before"), F.count(F.lit(1)).alias("n_after"), F.first("structural_removed").alias("structural_removed"))


@query("SELECT DISTINCT user_id AS conv_id, CAST(0 AS BIGINT) AS orphans FROM events")
def pairing_invariant(spark, d):
    out = structural.structural(tool_log(spark, d), 2)
    lost = structural.orphans(out).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("conv_id").distinct().join(lost, "conv_id", "left").select("conv_id", F.coalesce("n", F.lit(0)).cast("long").alias("orphans"))


# --- truncation

_KB = "CAST(CAST(floor(length(text) / 1024.0 + 0.5) AS BIGINT) AS VARCHAR)"


def _cut_sql(max_lines: int, max_kb: int) -> str:
    head = -(-max_lines * 6 // 10)
    tail = max_lines - head
    return f"""
    WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM {_DOCS}),
    h AS (SELECT *, len(ls) AS n, len(ls) > {max_lines} AS long, array_to_string(ls[1:{head}], chr(10)) AS top, array_to_string(ls[len(ls) - {tail} + 1:len(ls)], chr(10)) AS bottom FROM l),
    b AS (SELECT *, CASE WHEN long THEN top || chr(10) || bottom ELSE text END AS body FROM h),
    m AS (SELECT *, '… [{MARKS.cut} ' || CASE WHEN long THEN n || ' lines → {max_lines} lines, ' ELSE '' END || {_KB} || ' KB → {max_kb} KB]{MARKS.suffix}' AS mark FROM b),
    g AS (SELECT *, greatest({max_kb * 1024} - length(mark) - 2, 1) AS budget FROM m),
    k AS (SELECT doc_id, text, CASE WHEN length(body) > {max_kb * 1024} THEN substring(body, 1, CAST(ceil(budget * 0.6) AS BIGINT)) || chr(10) || mark || chr(10) || right(body, budget - CAST(ceil(budget * 0.6) AS BIGINT))
        WHEN long THEN top || chr(10) || '… [{MARKS.cut} ' || n || ' lines → {max_lines}]{MARKS.suffix}' || chr(10) || bottom ELSE text END AS kept FROM g)
    SELECT doc_id, length(text) - length(kept) AS removed, md5(kept) AS kept_md5 FROM k"""


def _cut(spark, d, max_lines, max_kb):
    docs = documents(spark, d)
    kept = passes.truncated(F.col("text"), max_lines, max_kb, MARKS)
    return docs.select("doc_id", (text.u16len(F.col("text")) - text.u16len(kept)).alias("removed"), F.md5(kept).alias("kept_md5"))


query(_cut_sql(20, 20), "truncate_lines")(lambda spark, d: _cut(spark, d, 20, 20))
query(_cut_sql(200, 4), "truncate_kb")(lambda spark, d: _cut(spark, d, 200, 4))
query(_cut_sql(10, 2), "truncate_both")(lambda spark, d: _cut(spark, d, 10, 2))


@query(
    f"WITH i AS (SELECT doc_id, '{{\"doc\":' || doc_id || ',\"words\":\"' || regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g') || '\"}}' AS input FROM {_DOCS}), "
    f"t AS (SELECT *, CASE WHEN length(input) > 2000 THEN '{{\"{MARKS.input_key}\":\"input truncated (not re-executable)\",\"originalChars\":' || length(input) || ',\"preview\":\"' || replace(substring(input, 1, 400), '\"', '\\\"') || '\"}}' ELSE input END AS kept FROM i) "
    "SELECT doc_id, length(input) - length(kept) AS removed, md5(kept) AS kept_md5 FROM t"
)
def truncate_input(spark, d):
    docs = documents(spark, d)
    given = F.concat(F.lit('{"doc":'), F.col("doc_id").cast("string"), F.lit(',"words":"'), F.regexp_replace("text", "[^A-Za-z0-9 ]", ""), F.lit('"}'))
    rows = docs.select("doc_id", given.alias("input"))
    kept = F.when(text.u16len(F.col("input")) > 2000, passes.trimmed_input(F.col("input"), MARKS)).otherwise(F.col("input"))
    return rows.select("doc_id", (text.u16len(F.col("input")) - text.u16len(kept)).alias("removed"), F.md5(kept).alias("kept_md5"))


# --- secrets and tools

_WS_SQL = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def _masked_sql(column: str) -> str:
    for pattern, by in text.SECRETS:
        p = pattern.replace(r"[\s]", f"[{_WS_SQL}]").replace(r"[^\s", f"[^{_WS_SQL}").replace(r"@\s]", f"@{_WS_SQL}]").replace(r"&\s]", f"&{_WS_SQL}]")
        column = f"regexp_replace({column}, '{p.replace(chr(39), chr(39) * 2)}', '{by.replace('$', chr(92))}', 'g')"
    return column


_SECRET = "concat(text, ' password: ', doc_id, 'x key sk-', substring(md5(CAST(doc_id AS VARCHAR)), 1, 20), ' url postgres://u:p', doc_id, '@h/db?sig=', doc_id, '&sig=a', doc_id)"


@query(f"WITH s AS (SELECT doc_id, {_SECRET} AS t FROM {_DOCS}), m AS (SELECT doc_id, {_masked_sql('t')} AS m FROM s) SELECT doc_id, length(m) AS chars, md5(m) AS masked_md5 FROM m")
def mask_secrets(spark, d):
    s = documents(spark, d).select("doc_id", F.expr(_SECRET.replace("AS VARCHAR", "AS STRING")).alias("t"))
    m = s.select("doc_id", text.mask_secrets(F.col("t")).alias("m"))
    return m.select("doc_id", text.u16len(F.col("m")).alias("chars"), F.md5("m").alias("masked_md5"))


_TOOLS = ["bash", "power---bash", "bashful", "read-file", "SHELL", "my-cmd", "cmd-x", "npm test", "Node", "nodejs", "pytest-run", "grep", "run-tests", ""]


@query("SELECT t AS tool, regexp_matches(t, '(?i)(bash$|shell|terminal|powershell|cmd$|exec|npm|pnpm|yarn|gradle|maven|dotnet|pytest|vitest|jest|tsc|node$|test-runner|run-tests)') AS is_command FROM (VALUES " + ", ".join(f"('{t}')" for t in _TOOLS) + ") v(t)")
def command_tool_class(spark, d):
    return spark.createDataFrame([(t,) for t in _TOOLS], "tool string").select("tool", text.is_command_tool(F.col("tool")).alias("is_command"))


_OUTPUT = "CASE event_id % 4 WHEN 0 THEN concat('{\"stdout\":\"', event_type, '\",\"exitCode\":1}') WHEN 1 THEN concat('{\"stdout\":\"', event_type, '\",\"stderr\":\"k', user_id, '\"}') WHEN 2 THEN concat('{\"stdout\":\"\",\"stderr\":\"e', user_id, '\"}') ELSE props END"


@query(
    f"WITH o AS (SELECT event_id, {_OUTPUT} AS j FROM events), s AS (SELECT event_id, coalesce(json_extract_string(j, '$.stdout'), '') AS o, coalesce(json_extract_string(j, '$.stderr'), '') AS e FROM o) "
    "SELECT event_id, CASE WHEN o = '' AND e = '' THEN NULL WHEN e <> '' THEN o || chr(10) || e ELSE o END AS output FROM s"
)
def extract_output(spark, d):
    return table(spark, d, "events").select("event_id", text.output_text(F.lit("json"), F.expr(_OUTPUT)).alias("output"))


# --- error summaries, on logs made of the tables' rows

_TSC_LOG = "concat('build ', o_orderkey, chr(10), 'src/m', o_custkey, '.ts:', o_orderkey % 90 + 1, ':', o_orderkey % 7 + 1, ' - error TS', 2000 + o_custkey % 900, ': Type ', o_orderstatus, ' is wrong.', chr(10), o_orderkey % 90 + 1, '   const x = 1;', chr(10), '      ~~~~', chr(10), chr(10), repeat(concat('src/n.ts:1:2 - error TS1: again', chr(10)), CAST(o_orderkey % 3 AS INT)), 'done')"


@query(
    f"WITH l AS (SELECT o_orderkey, {_TSC_LOG.replace(' AS INT)', ' AS INTEGER)')} AS t, o_custkey, o_orderstatus FROM orders) "
    "SELECT o_orderkey, 'error TS' || (2000 + o_custkey % 900) || ': Type ' || o_orderstatus || ' is wrong.' || chr(10) || 'at src/m' || o_custkey || '.ts:' || (o_orderkey % 90 + 1) || ':' || (o_orderkey % 7 + 1) || chr(10) || '  ' || (o_orderkey % 90 + 1) || '   const x = 1;' || chr(10) || '        ~~~~' || CASE WHEN o_orderkey % 3 > 0 THEN chr(10) || '(+' || (o_orderkey % 3) || ' more tsc error entries)' ELSE '' END AS body, CAST(len(string_split(t, chr(10))) AS INTEGER) AS lines FROM l"
)
def error_tsc(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.expr(_TSC_LOG).alias("t"))
    return rows.select("o_orderkey", errors.summary(F.col("t")).alias("body"), F.size(F.split("t", "\n", -1)).alias("lines"))


_PY_LOG = "concat('run', chr(10), 'Traceback (most recent call last):', chr(10), '  File \"/a/main.py\", line 3, in <module>', chr(10), '    go()', chr(10), '  File \"/a/f', user_id, '.py\", line ', event_id % 100, ', in ', event_type, chr(10), '    x = ', event_id, chr(10), 'ValueError: bad ', event_type, chr(10), 'tail')"


@query("SELECT event_id, 'ValueError: bad ' || event_type || chr(10) || 'at /a/f' || user_id || '.py:' || (event_id % 100) || ' in ' || event_type || chr(10) || '  x = ' || event_id AS body FROM events")
def error_python(spark, d):
    return table(spark, d, "events").select("event_id", errors.summary(F.expr(_PY_LOG)).alias("body"))


_JEST_LOG = "concat('  ✕ ', event_type, ' works', chr(10), '  ● ', event_type, ' block', chr(10), '    at run (node:internal/x.js:1:2)', chr(10), '    at it (/src/t', user_id, '.ts:', event_id % 50, ':7)', chr(10))"


@query("SELECT event_id, 'failed tests: ' || event_type || ' works' || chr(10) || 'failure blocks: ' || event_type || ' block' || chr(10) || 'at /src/t' || user_id || '.ts:' || (event_id % 50) || ':7 (it)' AS body FROM events")
def error_jest(spark, d):
    return table(spark, d, "events").select("event_id", errors.summary(F.expr(_JEST_LOG)).alias("body"))


_NODE_LOG = "concat('x', chr(10), 'TypeError: ', event_type, chr(10), '    at inner (/x/node_modules/y.js:1:2)', chr(10), CASE WHEN event_id % 2 = 0 THEN concat('    at own (/src/o', user_id, '.js:3:4)', chr(10)) ELSE '' END)"


@query("SELECT event_id, 'TypeError: ' || event_type || chr(10) || CASE WHEN event_id % 2 = 0 THEN 'at /src/o' || user_id || '.js:3:4 (own)' ELSE 'at /x/node_modules/y.js:1:2 (inner)' END AS body FROM events")
def error_node(spark, d):
    return table(spark, d, "events").select("event_id", errors.summary(F.expr(_NODE_LOG)).alias("body"))


_PLAIN_LOG = "CASE event_id % 3 WHEN 0 THEN concat('a', chr(10), 'DiskFailure: ', event_type, chr(10), 'b') WHEN 1 THEN concat('Error: ', event_type) ELSE concat('TypeError: ', event_type, chr(13), chr(10), 'x') END"


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'DiskFailure: ' || event_type END AS body FROM events")
def error_generic(spark, d):
    return table(spark, d, "events").select("event_id", errors.summary(F.expr(_PLAIN_LOG)).alias("body"))


# --- ledgers: line items as runs, with a task per supplier

_RECORDS = 'SELECT l_suppkey AS task, epoch_ms(l_shipdate) + l_orderkey * 10 + l_linenumber AS "at", CAST(floor(l_extendedprice) AS BIGINT) AS chars_before, CAST(floor(l_extendedprice) - floor(l_extendedprice * l_discount) AS BIGINT) AS chars_after, CAST(floor(l_extendedprice * l_discount) AS BIGINT) AS saved, l_partkey % 3 = 0 AS called, l_partkey, l_orderkey, l_linenumber FROM lineitem'


def records(spark, d) -> DataFrame:
    item = table(spark, d, "lineitem")
    before, saved = F.floor("l_extendedprice"), F.floor(F.col("l_extendedprice") * F.col("l_discount"))
    by = F.col("l_partkey") % 4
    return item.select(
        F.col("l_suppkey").alias("task"), (text.epoch_ms("l_shipdate") + F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), before.alias("chars_before"), (before - saved).alias("chars_after"), saved.alias("saved"),
        *(F.when(by == k, saved).otherwise(0).alias(p) for k, p in enumerate(ledger.PASSES)), (F.col("l_partkey") % 3 == 0).cast("long").alias("summarize_calls"), F.when(F.col("l_partkey") % 3 == 0, "local").otherwise("none").alias("summarizer"),
        "l_orderkey", "l_linenumber",
    )


@query(
    f"WITH r AS ({_RECORDS}) SELECT count(*) AS runs, count(DISTINCT task) AS tasks, max(\"at\") - min(\"at\") AS span_ms, CAST(sum(chars_before) AS BIGINT) AS chars_before, CAST(sum(chars_after) AS BIGINT) AS chars_after, CAST(sum(saved) AS BIGINT) AS saved, "
    "CAST(floor(sum(saved) / 4.0 + 0.5) AS BIGINT) AS saved_tokens, CAST(floor(sum(saved) / count(*) + 0.5) AS BIGINT) AS mean_saved, CAST(floor(median(saved) + 0.5) AS BIGINT) AS median_saved, max(saved) AS max_saved, count(*) FILTER (called) AS summarize_calls FROM r"
)
def measure_summary(spark, d):
    return ledger.measure(records(spark, d))


@query(f"WITH r AS ({_RECORDS}) SELECT task, count(*) AS runs, CAST(sum(saved) AS BIGINT) AS saved, min(\"at\") AS first_at FROM r GROUP BY task")
def measure_by_task(spark, d):
    return ledger.by_task(records(spark, d))


@query(f"WITH r AS ({_RECORDS}) SELECT task, count(*) AS runs, CAST(sum(saved) AS BIGINT) AS saved, min(\"at\") AS first_at FROM r GROUP BY task ORDER BY saved DESC, first_at, task LIMIT 5")
def measure_top_tasks(spark, d):
    return ledger.top_tasks(records(spark, d))


@query(
    f"WITH r AS ({_RECORDS}) SELECT task, count(*) AS passes, "
    + ", ".join(f"CAST(coalesce(sum(saved) FILTER (l_partkey % 4 = {k}), 0) AS BIGINT) AS {p}" for k, p in enumerate(ledger.PASSES))
    + ", CAST(sum(chars_before) AS BIGINT) AS chars_before, CAST(sum(chars_after) AS BIGINT) AS chars_after, count(*) FILTER (called) AS summarize_calls, max(CASE WHEN called THEN 'local' END) AS last_summarizer, max(\"at\") AS last_run_at FROM r GROUP BY task"
)
def task_stats_rollup(spark, d):
    return ledger.task_stats(records(spark, d))


_SO_FAR = 'OVER (PARTITION BY task ORDER BY "at", l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING)'


@query(f"WITH r AS ({_RECORDS}) SELECT task, \"at\", l_orderkey, l_linenumber, count(*) {_SO_FAR} AS passes_so_far, CAST(sum(saved) {_SO_FAR} AS BIGINT) AS saved_so_far, CAST(sum(chars_before) {_SO_FAR} AS BIGINT) AS before_so_far FROM r")
def task_stats_running(spark, d):
    return ledger.running_stats(records(spark, d), "l_orderkey", "l_linenumber").select("task", "at", "l_orderkey", "l_linenumber", "passes_so_far", "saved_so_far", "before_so_far")


@query("SELECT user_id, event_id % 4 AS generation, event_id AS line, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 4 DESC, event_id DESC) = 1")
def stats_latest(spark, d):
    e = table(spark, d, "events").select("user_id", (F.col("event_id") % 4).alias("generation"), F.col("event_id").alias("line"), "event_type", "value")
    return ledger.latest(e, "user_id", ["generation", "line"])


@query("SELECT event_id, user_id AS task FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 97 = 0)")
def stats_reset(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("task"))
    return ledger.reset(e, e.filter("event_id % 97 = 0"))


@query(
    f"WITH r AS ({_RECORDS}) SELECT task, CASE WHEN sum(chars_before) > 0 THEN true ELSE false END AS measured, CAST(greatest(sum(chars_before) - sum(chars_after), 0) AS BIGINT) AS saved_total FROM r GROUP BY task"
)
def stats_headline(spark, d):
    return ledger.headline(ledger.repaired(ledger.task_stats(records(spark, d)))).select("task", "measured", "saved_total")


_PRICES = [(0, "a", "m0", 3e-6), (1, "b", "m0", 5e-6), (2, "a", "m1", 0.0), (3, "b", "m1", 1e-6), (4, "c", "m2", 2e-6), (5, "c", "m2", 9e-6)]


@query(
    "WITH p(place, provider, model, per_token) AS (VALUES " + ", ".join(f"({a}, '{b}', '{c}', CAST({e} AS DOUBLE))" for a, b, c, e in _PRICES) + "), "
    "u AS (SELECT s_suppkey AS task, chr(97 + CAST(s_suppkey % 4 AS INTEGER)) AS provider, 'm' || (s_suppkey % 5) AS model, s_suppkey * 1000 AS saved_tokens FROM supplier), "
    "j AS (SELECT u.*, coalesce((SELECT min_by(per_token, place) FROM p WHERE p.provider = u.provider AND p.model = u.model), (SELECT min_by(per_token, place) FROM p WHERE p.model = u.model)) AS t FROM u), "
    "k AS (SELECT *, CASE WHEN t > 0 THEN t * 1000000 END AS m FROM j) SELECT task, round(coalesce(m, -1), 6) AS per_million, round(CASE WHEN saved_tokens > 0 AND m IS NOT NULL THEN saved_tokens / 1000000 * m ELSE 0 END, 6) AS saved_usd FROM k"
)
def saved_cost(spark, d):
    prices = spark.createDataFrame(_PRICES, "place int, provider string, model string, per_token double")
    s = table(spark, d, "supplier").withColumn("k", F.col("s_suppkey"))
    use = s.select(F.col("k").alias("task"), F.expr("chr(97 + k % 4)").alias("provider"), F.expr("concat('m', k % 5)").alias("model"), (F.col("k") * 1000).alias("saved_tokens"))
    out = ledger.with_cost(use, prices)
    return out.select("task", F.round(F.coalesce("per_million", F.lit(-1.0)), 6).alias("per_million"), F.round("saved_usd", 6).alias("saved_usd"))


@query(
    "SELECT s_suppkey AS task, CASE WHEN u <= 0 THEN '$0.00' WHEN u < 0.01 THEN printf('$%.4f', u) ELSE printf('$%.2f', u) END AS usd FROM (SELECT s_suppkey, (s_suppkey - 3) * 0.00131 AS u FROM supplier)"
)
def usd_format(spark, d):
    amount = ((F.col("s_suppkey") - 3) * F.lit(Decimal("0.00131"))).cast("double")  # SQL's literal is a decimal
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("task"), F.when(F.col("s_suppkey").isNotNull(), text.usd(amount)).alias("usd"))


# --- archive

_NOW = 1_725_000_000_000


@query(
    f"WITH f AS (SELECT doc_id, {_NOW} - doc_id * 2600000 - (doc_id * 7919) % 977 AS mtime, n_chars AS size FROM documents), "
    f"o AS (SELECT *, {_NOW} - mtime > 2 * 86400000 AS old FROM f), y AS (SELECT *, sum(size) OVER () AS total, total - coalesce(sum(size) OVER (ORDER BY mtime, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o WHERE NOT old) "
    "SELECT doc_id, CASE WHEN total > 100000 AND before > 60000 THEN 'cap' END AS reason FROM y UNION ALL SELECT doc_id, 'age' FROM o WHERE old"
)
def archive_retention(spark, d):
    files = table(spark, d, "documents").select(F.format_string("%012d", "doc_id").alias("path"), (F.lit(_NOW) - F.col("doc_id") * 2_600_000 - (F.col("doc_id") * 7919) % 977).alias("mtime"), F.col("n_chars").alias("size"))
    return archive.retention(files, _NOW, 100_000, 60_000, 2).select(F.col("path").cast("long").alias("doc_id"), "reason")


# --- summaries

_SAID = f"WITH {_BOUNDS.format(p=1)}, s AS (SELECT c.* FROM c JOIN bounds USING (conv_id) WHERE turn >= region_start AND turn < region_end)"


def _regions(spark, d, protected=1):
    m = messages(spark, d)
    return m.join(region.bounds(m, protected).select("conv_id", "region_start", "region_end"), "conv_id")


@query(
    f"{_SAID}, g AS (SELECT conv_id, count(*) AS messages, CAST(sum(length(text)) AS BIGINT) AS region_chars, count(*) FILTER (role = 'user') AS region_turns, string_agg(upper(role) || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) FILTER (text <> '') AS raw FROM s GROUP BY conv_id) "
    f"SELECT conv_id, messages, region_chars, region_turns, md5({_masked_sql('raw')}) AS input_md5 FROM g"
)
def summarizer_input(spark, d):
    return summarize.regions(_regions(spark, d)).select("conv_id", "messages", "region_chars", "region_turns", F.md5("input").alias("input_md5"))


def _stub(prompt: str) -> str:
    return "What was asked and done, in short. " * 8


_STUB = len(_stub("")) + len(MARKS.note) + len(MARKS.summary) + 5


@query(
    f"{_SAID}, g AS (SELECT conv_id, count(*) AS messages, sum(length(text)) AS n, count(*) FILTER (role = 'user') AS turns FROM s GROUP BY conv_id), "
    "k AS (SELECT *, n >= 500 AND turns >= 2 AS due FROM g), "
    f"w AS (SELECT *, n - ({_STUB} + length('Compressed ' || messages || ' messages (≈ ' || CAST(floor(n / 4.0 + 0.5) AS BIGINT) || ' → {(len(_stub('')) + 2) // 4} tokens).')) AS saves FROM k) "
    "SELECT conv_id, CASE WHEN due THEN 'generate' ELSE 'none' END AS action, due AND saves > 0 AS swapped, CAST(CASE WHEN due AND saves > 0 THEN saves ELSE 0 END AS BIGINT) AS summarize_removed, CAST(due AS INTEGER) AS summarize_calls FROM w"
)
def summarize_stub(spark, d):
    _, result, _ = summarize.summarized(_regions(spark, d), Summarize(afterTurns=2, minChars=500), _stub)
    return result.select("conv_id", "action", "swapped", "summarize_removed", "summarize_calls")


# --- rules over time

_GATE = "WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), g AS (SELECT user_id, event_id, k, true AS open, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS f FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, g.f < 3, CASE WHEN g.f >= 3 THEN g.f WHEN event_type = 'purchase' THEN 0 WHEN event_type = 'error' THEN g.f + 1 ELSE g.f END FROM g JOIN e ON e.user_id = g.user_id AND e.k = g.k + 1) SELECT event_id, open FROM g"


def _runs(spark, d):
    return table(spark, d, "events").withColumns({"failed": F.col("event_type") == "error", "succeeded": F.col("event_type") == "purchase"})


@query(_GATE)
def failure_gate(spark, d):
    return sequential.failure_gate(_runs(spark, d), "user_id", ["ts", "event_id"]).select("event_id", "open")


def _throttle_sql(op: str, gap: int, due: str) -> str:
    return f"WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_ms(ts) AS t, {due} AS due, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS k FROM events), g AS (SELECT user_id, event_id, k, due AS emitted, CASE WHEN due THEN t END AS last FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, due AND (last IS NULL OR t - last {op} {gap}), CASE WHEN due AND (last IS NULL OR t - last {op} {gap}) THEN t ELSE last END FROM g JOIN e ON e.user_id = g.user_id AND e.k = g.k + 1) SELECT event_id, emitted FROM g"


def _timed(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", text.epoch_ms("ts").alias("at"), (F.col("value") >= 20).alias("due"))


@query(_throttle_sql(">", 36_000_000, "value >= 20"))
def log_throttle(spark, d):
    return sequential.throttled(_timed(spark, d), "user_id", "at", 36_000_000, True, "due", ["event_id"]).select("event_id", "emitted")


@query(_throttle_sql(">=", 86_400_000, "true"))
def persist_throttle(spark, d):
    return sequential.throttled(_timed(spark, d), "user_id", "at", 86_400_000, False, tie=["event_id"]).select("event_id", "emitted")


# --- the whole plan

def document_chats(spark, d) -> DataFrame:
    """A conversation per document, and one more for every third: a task, a call of a command tool, its result (the text; in the other one a compiler log), an answer, two user turns."""
    docs = documents(spark, d).select("doc_id", "text")
    docs = docs.withColumn("log", F.lit(False)).unionByName(docs.filter("doc_id % 3 = 0").select((-1 - F.col("doc_id")).alias("doc_id"), "text", F.lit(True).alias("log")))
    null = F.lit(None).cast("string")
    error = F.concat(F.lit("src/a.ts:1:2 - error TS1: x"), F.repeat(F.concat(F.lit("\nline "), F.col("doc_id").cast("string")), F.lit(2000)))
    output = F.when(F.col("log"), error).otherwise(F.col("text"))

    def struct(kind, given, out_type, out):
        return F.array(F.struct(F.lit(kind).alias("type"), null.alias("text"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("call_id"), F.lit("bash").alias("tool"), given.alias("input"), out_type.alias("out_type"), out.alias("out"), null.alias("raw"))).cast(f"array<{PART}>")

    none = F.lit(None).cast(f"array<{PART}>")
    rows = [("user", "string", F.lit("start"), none), ("assistant", "parts", null, struct("tool-call", F.lit('{"c":1}'), null, null)), ("tool", "parts", null, struct("tool-result", null, F.lit("text"), output)), ("assistant", "string", F.lit("done"), none), ("user", "string", F.lit("go on"), none), ("user", "string", F.lit("end"), none)]
    m = F.array(*(F.struct(F.lit(i).alias("pos"), F.concat_ws("-", "doc_id", F.lit(i)).alias("msg_id"), F.lit(r).alias("role"), F.lit(k).alias("kind"), t.alias("text"), p.alias("parts")) for i, (r, k, t, p) in enumerate(rows)))
    return docs.select(F.col("doc_id").alias("conv_id"), F.explode(m).alias("m")).select("conv_id", "m.*")


_SETTINGS = Config(maxContextChars=3000, truncate=Truncate(maxLines=20, maxKB=4), errors=Errors(minChars=8000))
_ERROR_MARK = f"… [{MARKS.error} 2001 lines → 2 lines]{MARKS.suffix}"


@query(
    _cut_sql(20, 4).rsplit("SELECT doc_id", 1)[0]
    + f", o AS (SELECT doc_id, text, kept, false AS log FROM k UNION ALL SELECT -1 - doc_id, text, kept, true FROM k WHERE doc_id % 3 = 0), s AS (SELECT doc_id, log, CASE WHEN log THEN 27 + 2000 * (6 + length(CAST(doc_id AS VARCHAR))) ELSE length(text) END AS size, length(text) - length(kept) AS cut, {len(_ERROR_MARK)} + 1 + length('error TS1: x') + 1 + length('at src/a.ts:1:2') AS summary FROM o), "
    "r AS (SELECT doc_id, size + 5 + 7 + 4 + 5 + 3 AS chars_before, CASE WHEN log THEN size - summary ELSE 0 END AS error_removed, CASE WHEN NOT log AND size + 24 > 3000 THEN greatest(cut, 0) ELSE 0 END AS truncate_removed FROM s) "
    "SELECT doc_id AS conv_id, CAST(6 AS INTEGER) AS n_before, chars_before, chars_before - error_removed - truncate_removed AS chars_after, CAST(0 AS BIGINT) AS structural_removed, error_removed, truncate_removed, error_removed + truncate_removed > 0 AS touched FROM r"
)
def pipeline_report(spark, d):
    _, report, _ = compact(document_chats(spark, d), _SETTINGS)
    return report.select("conv_id", "n_before", "chars_before", "chars_after", "structural_removed", "error_removed", "truncate_removed", "touched")


@query(
    "SELECT 'run' AS kind, CAST(conv_id AS VARCHAR) AS task, CAST(0 AS BIGINT) AS \"at\", chars_before, chars_after, chars_before - chars_after AS saved, structural_removed AS structural, error_removed AS error, truncate_removed AS truncate, "
    f"CAST(0 AS BIGINT) AS summarize, CAST(0 AS INTEGER) AS summarize_calls, 'none' AS summarizer FROM ({ORACLE['pipeline_report']}) r WHERE touched"
)
def run_records(spark, d):
    _, report, _ = compact(document_chats(spark, d), _SETTINGS)
    return ledger.run_records(report, F.lit(0))


@query(
    f"SELECT conv_id, CAST(m.pos AS INTEGER) AS pos, m.role, CAST(CASE WHEN m.pos = 2 THEN chars_after - 24 ELSE m.n END AS BIGINT) AS chars FROM ({ORACLE['pipeline_report']}) r, "
    "(VALUES (0, 'user', 5), (1, 'assistant', 7), (2, 'tool', 0), (3, 'assistant', 4), (4, 'user', 5), (5, 'user', 3)) m(pos, role, n)"
)
def compacted_messages(spark, d):
    out, _, _ = compact(document_chats(spark, d), _SETTINGS)
    return out.select("conv_id", "pos", "role", region.chars(F.col("kind"), F.col("text"), F.col("parts")).alias("chars"))


@query(
    ORACLE["summarize_stub"].replace("SELECT conv_id, CASE WHEN due", ", w2 AS (SELECT t.conv_id, w.* EXCLUDE (conv_id), t.n AS n_all, t.chars > 1000 AND t.n >= 4 AS large, t.chars FROM (SELECT conv_id, count(*) AS n, sum(length(text)) AS chars FROM conversations GROUP BY conv_id) t LEFT JOIN w USING (conv_id)) SELECT conv_id, CASE WHEN due").rsplit("SELECT conv_id", 1)[0]
    + "SELECT conv_id, CAST(n_all AS INTEGER) AS n_before, CAST(chars AS BIGINT) AS chars_before, CAST(chars - CASE WHEN large AND due AND saves > 0 THEN saves ELSE 0 END AS BIGINT) AS chars_after, CAST(CASE WHEN large AND due AND saves > 0 THEN saves ELSE 0 END AS BIGINT) AS summarize_removed, CAST(coalesce(large AND due, false) AS INTEGER) AS summarize_calls, CASE WHEN large AND due AND saves > 0 THEN 'local' ELSE 'none' END AS summarizer FROM w2"
)
def compact_summaries(spark, d):
    """The whole plan at the level of summaries."""
    settings = Config(level="summarize", maxContextChars=1000, protectedTurns=1, summarize=Summarize(afterTurns=2, minChars=500))
    _, report, _ = compact(messages(spark, d), settings, _stub)
    return report.select("conv_id", "n_before", "chars_before", "chars_after", "summarize_removed", "summarize_calls", "summarizer")


# --- other scalar functions

_URLS = ["http://10.0.0.1:11434", "http://localhost:1", "https://h.example", "http://127.0.0.1/x", "no url", "http://h.example/a?b", "ftp://x", "http://[::1]:80/"]


@query("SELECT u AS url, u LIKE 'http://%' AND NOT regexp_matches(u, '^http://(localhost|127\\.0\\.0\\.1|0\\.0\\.0\\.0|\\[::1\\])') AS plain_remote FROM (VALUES " + ", ".join(f"('{u}')" for u in _URLS) + ") v(u)")
def plain_remote_url(spark, d):
    return spark.createDataFrame([(u,) for u in _URLS], "url string").select("url", text.is_plain_remote_url(F.col("url")).alias("plain_remote"))


@query("SELECT page_id, substring(regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g'), 1, 80) || '-' || substring(sha1(url), 1, 8) AS name FROM pages")
def safe_names(spark, d):
    return table(spark, d, "pages").select("page_id", text.safe_name(F.col("url")).alias("name"))


@query(f"SELECT doc_id, CAST(floor((n_chars - 1000) / 4.0 + 0.5) AS BIGINT) AS tokens, md5(trim(concat(' ', chr(9), text, chr(160), chr(10)), concat(' ', chr(9), chr(10), chr(160), chr(13)))) AS trimmed_md5 FROM {_DOCS}")
def number_and_trim(spark, d):
    padded = F.concat(F.lit(" \t"), F.col("text"), F.lit(chr(160) + "\n"))
    return documents(spark, d).select("doc_id", text.half_up((F.col("n_chars") - 1000) / 4).alias("tokens"), F.md5(text.trim(padded)).alias("trimmed_md5"))


# --- streams, run to the end of what is there

def drained(stream: DataFrame) -> DataFrame:
    """All output of a stream over the files that exist now, written to the shared folder together with the stream's state."""
    spark = stream.sparkSession
    to = shared.scratch(spark)
    stream.writeStream.format("parquet").option("path", f"{to}/out").option("checkpointLocation", f"{to}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{to}/out")


def _stream(spark, d, name):
    # a stream reads folders, so a table that is one file is given as a pattern
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parquet*")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'ValueError: bad ' || event_type END AS first_line FROM events")
def stream_tool_errors(spark, d):
    e = _stream(spark, d, "events")
    tool = F.when(F.col("event_id") % 2 == 0, "bash").otherwise("read")
    events = e.select("event_id", F.col("user_id").cast("string").alias("task"), F.col("event_id").cast("string").alias("call_id"), tool.alias("tool"), F.to_json(F.struct(F.expr(_PY_LOG).alias("stdout"))).alias("raw"))
    out = drained(tools.rewritten(events, min_chars=10).select("event_id", "summary"))
    return out.select("event_id", F.get(F.split("summary", "\n", -1), F.lit(1)).alias("first_line"))


@query(_GATE.replace("ORDER BY ts, event_id", "ORDER BY event_id"))
def stream_failure_gate(spark, d):
    e = _stream(spark, d, "events")
    runs = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("failed"), (F.col("event_type") == "purchase").alias("succeeded"))
    return drained(tools.gate(runs)).select(F.col("seq").alias("event_id"), "open")
