"""Exact duplicates by exchange of Golomb-coded fingerprints (operator 7).

1. Every partition digests its normalised texts; the digests are kept in the
   checkpoint folder, the texts are not.
2. A partition sends each owner of a range of fingerprints its sorted
   fingerprints of that range, as Golomb-coded differences.
3. An owner answers each sender with a bitmap: which of the fingerprints it sent
   also occur elsewhere, or more than once.
4. Rows whose bit is set are suspects.  A Bloom filter of fixed size over their
   fingerprints keeps the texts of other rows from moving; suspects are shuffled
   and grouped by their bytes, after partial aggregation where they are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, attach_groups, flat, lower_ascii, prepare, settle, tidied

#: Fingerprints per owner, about.
OWNED = 500_000
#: The Bloom filter is FILTER_BLOCKS bitmaps of 32,768 bits, 1 MiB in all, whatever the input.
FILTER_BLOCKS = 256


def golomb(values: np.ndarray, span: int) -> bytes:
    """Sorted values from 0 to span as Golomb-coded differences; the divisor is a power of two (Rice)."""
    n = len(values)
    mean = span // max(n, 1)
    k = max(0, int(mean * 69 // 100).bit_length() - 1)
    gaps = np.diff(values.astype(U64), prepend=U64(0))
    q = (gaps >> U64(k)).astype(np.int64)
    unary = np.zeros(int(q.sum()) + n, np.uint8)
    unary[np.cumsum(q + 1) - 1] = 1
    rest = np.zeros(0, np.uint8)
    if k:
        bits = np.unpackbits((gaps & U64((1 << k) - 1)).astype(">u8").view(np.uint8).reshape(n, 8), axis=1)[:, 64 - k :]
        rest = np.packbits(bits)
    return np.array([n, k, len(unary)], "<i8").tobytes() + np.packbits(unary).tobytes() + rest.tobytes()


def ungolomb(blob: bytes) -> np.ndarray:
    n, k, size = np.frombuffer(blob, "<i8", 3).tolist()
    at = 24 + (size + 7) // 8
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(blob[24:at], np.uint8), count=size))
    gaps = (np.diff(ends, prepend=-1) - 1).astype(U64) << U64(k)
    if k:
        bits = np.zeros((n, 64), np.uint8)
        bits[:, 64 - k :] = np.unpackbits(np.frombuffer(blob[at:], np.uint8), count=n * k).reshape(n, k)
        gaps |= np.packbits(bits, axis=1).view(">u8").ravel().astype(U64)
    return np.cumsum(gaps, dtype=U64)


def normalised(column: pa.Array) -> list[bytes]:
    buf, at = flat(column)
    raw, at = lower_ascii(buf).tobytes(), at.tolist()
    return [raw[i:j] for i, j in zip(at[:-1], at[1:])]


def _digested(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    @tidied
    def run(batches):
        for batch in batches:
            hashes = [hashlib.sha256(t) for t in normalised(batch.column(1))]
            fp = np.frombuffer(b"".join([h.digest()[:8] for h in hashes]), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), pa.array([h.hexdigest() for h in hashes], pa.string())], ["doc_id", "fp", "sha"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, fp long, sha string")
    return settle(rows.withColumns({"uid": F.monotonically_increasing_id(), "part": F.spark_partition_id()}))


def suspects(digests: DataFrame, owners: int) -> DataFrame:
    """`digests` with a boolean `suspect`: its fingerprint occurs in another row too."""
    span = -(-(1 << 64) // owners)

    def unsigned(fp: np.ndarray) -> np.ndarray:
        return fp.astype(np.int64).view(U64)

    @tidied
    def send(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            part, fp = batch.column("part").to_numpy(), unsigned(batch.column("fp").to_numpy())
            for p in np.unique(part).tolist():
                held.setdefault(p, []).append(fp[part == p])
        for p, found in held.items():
            fp = np.sort(np.concatenate(found))
            owner = (fp // U64(span)).astype(np.int64)
            who, first = np.unique(owner, return_index=True)
            blobs = [golomb(x - U64(o * span), span) for o, x in zip(who.tolist(), np.split(fp, first[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(np.full(len(who), p, np.int32)), pa.array(blobs, pa.binary())], ["owner", "part", "blob"])

    def answer(t: pa.Table) -> pa.Table:
        sent = [ungolomb(b) for b in t.column("blob").to_pylist()]
        every = np.concatenate(sent)
        order = np.argsort(every, kind="stable")
        v = every[order]
        same = v[1:] == v[:-1]
        twice = np.zeros(len(v), bool)
        twice[1:] |= same
        twice[:-1] |= same
        out = np.zeros(len(v), bool)
        out[order] = twice
        bits = np.split(out, np.cumsum([len(s) for s in sent])[:-1])
        return pa.table([t.column("part"), t.column("owner"), pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())], ["part", "owner", "bits"])

    def mark(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        fp = unsigned(rows["fp"].to_numpy())
        order = np.argsort(fp, kind="stable")
        counts = np.bincount((fp // U64(span)).astype(np.int64), minlength=owners) if len(fp) else []
        bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=int(counts[o])) for o, b in sorted(zip(answers["owner"].tolist(), answers["bits"].tolist()))]
        out = np.zeros(len(rows), bool)
        out[order] = np.concatenate(bits).astype(bool) if bits else False
        return rows.assign(suspect=out)

    blobs = digests.select("part", "fp").mapInArrow(send, "owner long, part int, blob binary")
    bitmaps = blobs.groupBy("owner").applyInArrow(answer, "part int, owner long, bits binary")
    return digests.groupBy("part").cogroup(bitmaps.groupBy("part")).applyInPandas(mark, "doc_id long, fp long, sha string, uid long, part int, suspect boolean")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of `docs`.

    Texts are equal when identical after lower-casing A-Z only; null counts as
    empty.  The row with the largest doc_id stays, a null id being smaller than
    any; of repeated rows with that id exactly one stays.  An empty table gives
    no rows; columns other than id and text are not read.
    """
    prepare(docs.sparkSession)
    digests = _digested(docs, id_col, text_col)
    total = digests.count()
    marked = settle(suspects(digests, max(2, -(-total // OWNED))))
    doubtful = marked.filter("suspect")
    filter_bits = FILTER_BLOCKS * 32768
    place = F.pmod(F.col("fp"), F.lit(filter_bits))
    filled = doubtful.groupBy(F.floor(place / 32768).cast("int").alias("block")).agg(F.bitmap_construct_agg(F.pmod(place, F.lit(32768))).alias("bits")).collect()
    bloom = np.zeros(filter_bits // 8, np.uint8)
    for r in filled:
        bloom[r.block * 4096 : (r.block + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    bloom = docs.sparkSession.sparkContext.broadcast(bloom.tobytes())

    @tidied
    def read(batches):
        bits = np.frombuffer(bloom.value, np.uint8)
        for batch in batches:
            texts = normalised(batch.column(1))
            hashes = [hashlib.sha256(t) for t in texts]
            at = np.frombuffer(b"".join([h.digest()[:8] for h in hashes]), ">i8").astype(np.int64) % filter_bits
            rows = np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([hashes[r].hexdigest() for r in rows.tolist()], pa.string()), pa.array([texts[r] for r in rows.tolist()], pa.binary())], ["doc_id", "sha", "norm"])

    moved = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(read, "doc_id long, sha string, norm binary")
    classes = settle(moved.groupBy("sha", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1").drop("norm"))
    classes = classes.groupBy("sha").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    joined = attach_groups(doubtful, classes, "sha", "group_size", total).unionByName(marked.filter("not suspect").withColumns({"keep_id": F.lit(None).cast("long"), "group_size": F.lit(None).cast("long")}))
    alone = F.col("group_size").isNull()
    rows = joined.withColumns({"keep_id": F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")), "group_size": F.coalesce("group_size", F.lit(1)).cast("long")})
    again = marked.groupBy("sha", "doc_id").agg(F.max("uid").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("sha").alias("sha2"), F.col("doc_id").alias("id2"), "last")
    rows = rows.join(again, (rows.sha == again.sha2) & rows.doc_id.eqNullSafe(again.id2), "left")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("last").isNull() | (F.col("uid") == F.col("last")))
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))
