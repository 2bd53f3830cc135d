"""Document fingerprints by content-defined chunking (operator 2).

A gear hash of the last 32 bytes picks the boundaries; they are normalised: up
to the wanted size a boundary needs seven zero bits, beyond it five.  A
fingerprint is the set of a text's chunk digests with the chunks' lengths, so an
insertion changes the chunks around it and no others.  Likeness is containment:
the length of shared chunks over the length of the smaller set.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, prepare, span_hashes, tidied

LEAST, WANTED, MOST = 32, 64, 256
HARD, EASY = 7, 5
#: Bytes of text per range of ids, about, until there are RANGES of them; they are read as streams, so larger ones take no more memory.
RANGE_BYTES, RANGES = 12 << 20, 10_000
_GEAR = (mix(np.arange(1001, 1257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_ENTRY = np.dtype([("digest", ">u4"), ("length", ">u2")])


def gear(buf: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of the 32 bytes that end there: the sum of their values, each shifted by its distance."""
    h = _GEAR[buf]
    for step in (1, 2, 4, 8, 16):
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint32(step)
        h = h + shifted
    return h


def chunk_ends(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and end of every chunk, in order; all rows are walked at once, a chunk per step."""
    h = gear(buf)
    easy = np.flatnonzero(h >> np.uint32(32 - EASY) == 0) + 1
    hard = np.append(easy[h[easy - 1] >> np.uint32(32 - HARD) == 0], len(buf) + MOST)
    easy = np.append(easy, len(buf) + MOST)
    row = np.flatnonzero(np.diff(at))
    pos, end = at[row], at[row + 1]
    rows, ends = [], []
    while len(row):
        top = np.minimum(pos + MOST, end)
        middle = np.minimum(pos + WANTED, top)
        a = hard[np.searchsorted(hard, pos + LEAST)]
        b = easy[np.searchsorted(easy, middle)]
        cut = np.where(a < middle, a, np.where(b < top, b, top))
        rows.append(row)
        ends.append(cut)
        on = cut < end
        row, pos, end = row[on], cut[on], end[on]
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, ends = np.concatenate(rows), np.concatenate(ends)
    order = np.argsort(ends, kind="stable")
    return rows[order], ends[order]


def chunk_sets(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (digest, length) of each row, ascending, and each row's first entry."""
    row, ends = chunk_ends(buf, at)
    starts = np.concatenate([[0], ends[:-1]])
    digest = (span_hashes(buf, starts, ends) >> np.uint64(32)).astype(np.uint64)
    key = np.unique(row.astype(np.uint64) << np.uint64(41) | digest << np.uint64(9) | (ends - starts).astype(np.uint64))
    out = np.zeros(len(key), _ENTRY)
    out["digest"] = key >> np.uint64(9) & np.uint64(0xFFFFFFFF)
    out["length"] = key & np.uint64(511)
    return out, np.searchsorted(key >> np.uint64(41), np.arange(len(at), dtype=np.uint64))


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Length of shared chunks over that of the smaller set; two empty sets are alike, an empty one and another are not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    x = a["digest"].astype(np.uint64) << np.uint64(16) | a["length"]
    y = b["digest"].astype(np.uint64) << np.uint64(16) | b["length"]
    place = np.minimum(np.searchsorted(y, x), len(y) - 1)
    shared = a["length"][y[place] == x].sum(dtype=np.int64)
    return float(shared / min(a["length"].sum(dtype=np.int64), b["length"].sum(dtype=np.int64)))


def fingerprint(entries: np.ndarray) -> str:
    return base64.b64encode(entries.tobytes()).decode()


def parse(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), _ENTRY)


def flatten(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next text.

    The next document is the one of the next smaller doc_id, for the last the
    first; null ids come last, repeated ids in the order of a hash of their texts.
    A null text is empty; a single row is its own next.  An empty table gives no
    rows; columns other than id and text are not read.  An id that many rows have,
    and null, are dealt to several ranges by that hash; the driver holds a few
    numbers for each of RANGES ranges at most.  A text is looked at whole, with
    some 40 bytes of a worker's memory per byte.
    """
    spark = docs.sparkSession
    prepare(spark)
    text = F.coalesce(docs[text_col], F.lit(""))
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    seen = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("named")).first()
    ranges = min(RANGES, max(1, -(-seen["bytes"] // RANGE_BYTES)))
    bounds, parts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    nulls = max(1, ranges * (seen["n"] - seen["named"]) // max(seen["n"], 1))
    if ranges > 1:
        at = docs.agg(F.percentile_approx("doc_id", [float(k) / ranges for k in range(1, ranges)], F.lit(20 * ranges)).alias("q")).first()["q"]
        bounds, parts = np.unique(np.array(at or [], np.int64), return_counts=True)
    below = np.concatenate([[0], np.cumsum(parts)])

    def ranged(ids: pa.Array, hashes: pa.Array) -> np.ndarray:
        """Ranges ascend with the id, and descend with the hash where an id has several; those of null are negative."""
        none = ids.is_null().to_numpy(zero_copy_only=False)
        i = ids.fill_null(0).to_numpy(zero_copy_only=False)
        share = (hashes.to_numpy().astype(np.float64) + 2.0**63) / 2.0**64
        k = np.searchsorted(bounds, i, "right")
        out = below[k]
        if len(bounds):
            same = (k > 0) & (bounds[np.maximum(k - 1, 0)] == i)
            own = parts[np.maximum(k - 1, 0)]
            out = np.where(same, out - np.minimum((share * own).astype(np.int64), own - 1), out)
        return np.where(none, -1 - np.minimum((share * nulls).astype(np.int64), nulls - 1), out)

    @tidied
    def first_of(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(ranged(*batch.columns)), *batch.columns], ["range", "doc_id", "hash"])

    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("after"), "hash", "doc_id"))
    tops = docs.select("doc_id", "hash").mapInArrow(first_of, "range long, doc_id long, hash long").groupBy("range").agg(first.alias("top")).orderBy(F.desc("range")).collect()
    # the first document of a range follows the last one of the range above; that of the highest range follows the very last
    follows = {(r["top"]["doc_id"], r["top"]["hash"]): tops[k - 1]["range"] for k, r in enumerate(tops)}

    @tidied
    def deal(batches):
        handed = set()
        for batch in batches:
            where = pa.array(ranged(batch.column(0), batch.column(1)))
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            extra = []
            for k, key in enumerate(keys):  # of equal rows one is enough
                if key in follows and key not in handed:
                    handed.add(key)
                    extra.append(k)
            rows = pa.array([*range(len(keys)), *extra], pa.int64())
            target = [*where.to_pylist(), *(follows[keys[k]] for k in extra)]
            yield pa.RecordBatch.from_arrays([pa.array(target, pa.int64()), pa.array([False] * len(keys) + [True] * len(extra)), *(batch.column(c).take(rows) for c in range(3))], ["range", "next_range", "doc_id", "hash", "text"])

    dealt = docs.mapInArrow(deal, "range long, next_range boolean, doc_id long, hash long, text string")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def done(rows):
        """Results of all rows but the last, whose successor isn't known yet."""
        pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[1]]
        plain = [r[3] for r in rows]
        changed = [edited(a[3], b[3]) for a, b in pairs]
        entries, first = chunk_sets(*flatten(plain + changed))
        sets = np.split(entries, first[1:-1])
        at = {id(r): k for k, r in enumerate(rows)}
        out = []
        for k, (a, b) in enumerate(pairs):
            own, new, following = sets[at[id(a)]], sets[len(plain) + k], sets[at[id(b)]]
            out.append((a[2], len(a[3]), hashlib.sha256(changed[k].encode("utf-8")).hexdigest(), fingerprint(own), fingerprint(new), containment(own, new), containment(own, following)))
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names)

    @tidied
    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("range", "next_range", "doc_id", "text"))):
                if held and row[0] != held[-1][0]:  # the last of a range is the first of the next one, seen as a successor only
                    yield done(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
                if size > 1 << 20:
                    yield done(held)
                    held, size = held[-1:], len(row[3])
        if held:
            yield done(held)

    spread = dealt.repartition(max(1, len(tops)), "range").sortWithinPartitions("range", "next_range", F.desc_nulls_last("doc_id"), "hash", "text")
    return spread.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
