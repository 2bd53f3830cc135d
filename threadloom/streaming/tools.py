"""Tool events as a stream: errors rewritten at the source, and the gate of failing summaries."""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import errors
from ..functions.text import event_text, is_command_tool, let, mask_secrets, safe_name, u16len
from ..operators.passes import Marks
from ..operators.sequential import FAILURES

#: Rows of a key that are sorted in memory, and that are read at once from a run or given back at once.
RUN, BLOCK = 1 << 21, 1 << 10
ROW = np.dtype([("none", "?"), ("seq", "i8"), ("failed", "?"), ("succeeded", "?")])


def rewritten(events: DataFrame, min_chars: int = 8000, context: int = 8, archive: bool = True, marks: Marks = Marks()) -> DataFrame:
    """`events` (task, call_id, tool, raw output as JSON) with summary, archive_name and archive_text.

    A map without state, for batches and streams.  summary is null where the
    event stays as it is; the archived text is the masked one.
    """
    name = F.concat(safe_name(F.col("task")), F.lit("/"), safe_name(F.col("call_id")), F.lit(".txt"))
    suffix = F.concat(F.lit(" - full output: "), name) if archive else F.lit(marks.suffix)

    def summed(masked: Column) -> Column:
        return let(errors.summary(masked, context), lambda body: F.when(body.isNotNull(), F.struct(errors.marked(masked, body, marks.error, suffix).alias("summary"), masked.alias("masked"))))

    asked = is_command_tool(F.col("tool"))
    hit = F.when(asked, let(event_text(F.col("raw")), lambda t: F.when(u16len(t) >= min_chars, let(mask_secrets(t), summed))))
    rows = events.withColumn("__hit", hit)
    kept = F.when(F.lit(archive), F.col("__hit.masked"))
    return rows.withColumns({"summary": F.col("__hit.summary"), "archive_name": F.when(kept.isNotNull(), name), "archive_text": kept}).drop("__hit")


def in_order(frames: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """Rows of a key as tuples of ROW in the order of seq, nulls last, in portions of BLOCK.

    Frames come in any order.  Of more than RUN rows sorted runs are kept in a
    temporary file of the task and merged.
    """
    held, n, runs = [], 0, []

    def run() -> np.ndarray:
        rows = np.concatenate(held) if held else np.empty(0, ROW)
        return rows[np.lexsort([rows[c] for c in reversed(ROW.names)])]

    def read(at: int, end: int) -> Iterator[tuple]:
        for k in range(at, end, BLOCK):
            file.seek(k * ROW.itemsize)
            yield from np.frombuffer(file.read((min(k + BLOCK, end) - k) * ROW.itemsize), ROW).tolist()

    with tempfile.SpooledTemporaryFile(max_size=1) as file:  # a file when something is written
        for frame in frames:
            rows = np.empty(len(frame), ROW)
            for c in ROW.names:
                rows[c] = frame[c].to_numpy()
            held.append(rows)
            n += len(rows)
            if n >= RUN:
                at = runs[-1][1] if runs else 0
                runs.append((at, at + n))
                file.write(run().tobytes())
                held, n = [], 0
        last = run()
        merged = heapq.merge(*(read(*r) for r in runs), (row for k in range(0, n, BLOCK) for row in last[k : k + BLOCK].tolist()))
        while rows := list(islice(merged, BLOCK)):
            yield rows


def gate(runs: DataFrame, limit: int = FAILURES) -> DataFrame:
    """key, seq, open for a stream of key, seq, failed, succeeded; the state of a key is its failures in a row.

    Runs of a key are taken in the order of seq within a micro-batch, however
    they come there, and micro-batches in the order in which they come: a run of
    a later one counts when it arrives.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, off = state.get if state.exists else (0, False)
        for rows in in_order(frames):
            opened = []
            for _, _, failed, succeeded in rows:
                opened.append(not off)
                failures = 0 if succeeded else failures + failed
                off = off or failures >= limit
            none, seq, _, _ = zip(*rows)
            yield pd.DataFrame({"key": np.full(len(rows), key[0]), "none": none, "seq": seq, "open": opened})
        state.update((int(failures), bool(off)))

    no = F.lit(False)
    # without nulls, so that pandas keeps whole numbers as they are
    rows = runs.select("key", F.col("seq").isNull().alias("none"), F.coalesce("seq", F.lit(0)).alias("seq"), F.coalesce("failed", no).alias("failed"), F.coalesce("succeeded", no).alias("succeeded"))
    out = rows.groupBy("key").applyInPandasWithState(step, "key long, none boolean, seq long, open boolean", "failures int, off boolean", "append", GroupStateTimeout.NoTimeout)
    return out.select("key", F.when(~F.col("none"), F.col("seq")).alias("seq"), "open")
