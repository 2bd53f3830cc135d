"""Sum-of-squares packing of token sequences (operator 9).

A document goes where the sum, over residual gaps, of the squared number of
open bins with that gap becomes smallest.  Only the counts of open bins per gap
decide, so a group of pieces is packed with one array of max_len counters.
Pieces of exactly max_len fill a sequence by themselves and never reach a
packer; the others are dealt by a hash of their identity to groups of about
GROUP pieces, whose number follows the number of pieces, and each group is
packed by one task, longest piece first.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import prepare, settle, tidied

GROUP = 8192


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, placed in the given order; lengths are 1 to capacity.

    Placing an item of length s into a bin of gap g changes the sum by
    2 * (n[g - s] - n[g]) + 2, where bins without a gap don't count.  Of equal
    changes the smallest gap wins, and an open bin wins over a new one.  Once as
    many bins are open as the total length needs at least, a further one is
    opened only for an item that fits nowhere.
    """
    n = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    opened, least = 0, -(-int(lengths.sum()) // capacity)
    far = np.int64(1 << 40)
    for i, s in enumerate(lengths.tolist()):
        here = n[s:]
        change = 2 * (n[: capacity + 1 - s] - here) + 2
        change[0] = 1 - 2 * here[0]  # exactly full: the bin leaves the counts
        change[here == 0] = far
        g = int(change.argmin())
        fresh = 2 * n[capacity - s] + 1 if s < capacity else 0
        if change[g] == far or opened < least and fresh < change[g]:
            b, gap, opened = opened, capacity, opened + 1
        else:
            gap = g + s
            b = stacks[gap].pop()
            n[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            stacks[gap - s].append(b)
            n[gap - s] += 1
    return bins, offsets


def pieces(docs: DataFrame, vocabulary: str, end_id: int, max_len: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and end_id, cut into max_len at most."""
    prepare(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    @tidied
    def run(batches):
        e, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for r, ids in enumerate(e.rows(batch.column(1))):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * max_len)):
                    part = ids[at : at + 4 * max_len]
                    row.append(r)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names)

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, max_len: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its sequence_id and its offset in that sequence.

    A null or empty text is the single end id.  Repeated rows and null ids are
    packed like any other; ties in length are placed by doc_id and piece.  An
    empty table gives no rows; columns other than id and text are not read.
    """
    cut = settle(pieces(docs, vocabulary, end_id, max_len, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()))
    short = cut.filter(F.col("length") < max_len)
    groups = max(1, -(-short.count() // GROUP))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "uid"], ascending=[False, True, True, True])
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), max_len)
        return pdf.assign(sequence_id=pdf["g"].to_numpy() * np.int64(1 << 32) + bins, offset=offsets).drop(columns=["g", "uid"])

    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    dealt = short.withColumn("g", F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("long"))
    packed = dealt.groupBy("g").applyInPandas(run, out)
    whole = cut.filter(F.col("length") == max_len).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(whole)
