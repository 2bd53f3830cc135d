"""Near duplicates by consistent weighted sampling (operator 1).

A document is the weighted set of its five-word shingles.  A shingle weighs
(1 + ln tf) * idf.  Improved consistent weighted sampling draws K samples of the
set, each equal for two documents with the probability of their weighted Jaccard
similarity; bands of three samples give candidates, and a candidate is a link
when the weighted Jaccard similarity of the two sets is 0.8 or more.

idf falls with ln df from 1, for shingles of a thousandth of all documents and
rarer ones, to 0.5 for one that all have, so that the text which a large group
shares still counts.  Only the common shingles need a table.  As a document of b
bytes has b / 2 + 1 shingles at most, less than MOST_COMMON shingles are in more
than (bytes / 2 + N) / MOST_COMMON documents; where texts are so long that this
is over a thousandth, it is where idf begins to fall.  So the table that is
broadcast has a bound that neither the number nor the length of texts moves.

Equal word lists collapse into one node first.  In each band bucket every node
is compared with the bucket's smallest node; then, in buckets whose other nodes
are still in several components, the nodes outside the largest component are
compared with all others, in blocks, by their samples, and pairs that may be
similar are verified.  No pair within a component is looked at, and no bucket
meets in one task.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, attach_groups, kept_by_workers, lower_ascii, mix, prepare, runs, settle, shingle_hashes, span_hashes, spans, tidied
from .exact import golomb, ungolomb

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 12, 3
K = BANDS * ROWS
#: Shingles of up to a COMMONth of all documents weigh alike; there are MOST_COMMON others at most; LEAST_IDF is that of a shingle in every document.
COMMON, MOST_COMMON, LEAST_IDF = 1000, 1_000_000, 0.5
#: Shingles per owner in counting, and per message.
OWNED, MESSAGE = 2_000_000, 2_000_000
#: Nodes of a block; pairs of blocks of a bucket are compared by one call each.
BLOCK = 512
#: Pairs of a leader that are verified together; its set is sent once for each such portion.
PORTION = 4096
#: Pairs whose samples agree less often are not verified: at similarity 0.8 that happens about once in 100,000.
AGREE = 0.5
#: Elements of sets that a task keeps unpacked.
UNPACKED = 1 << 21
FILTER_BITS = 1 << 23

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_lists(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (letters, digits, all beyond ASCII; A-Z lower-cased), and each row's first word."""
    starts, ends, first = spans(WORD[buf], at)
    return span_hashes(lower_ascii(buf), starts, ends), first


def contents(words: np.ndarray, first: np.ndarray) -> list[bytes]:
    raw, at = words.tobytes(), (first * 8).tolist()
    return [hashlib.blake2b(raw[i:j], digest_size=16).digest() for i, j in zip(at[:-1], at[1:])]


def shingle_sets(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row in ascending order, how often each occurs, and each row's first one."""
    h, at = shingle_hashes(words, first, WIDTH)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    where = np.flatnonzero(new)
    return h[where], np.diff(np.append(where, len(h))), np.searchsorted(row[where], np.arange(len(at)))


_TABLES: list[np.ndarray] = []
kept_by_workers(_TABLES.clear)


def _tables() -> list[np.ndarray]:
    if not _TABLES:
        u = (np.arange(65536) + 0.5) / 65536
        x = np.linspace(0, 25, 400_001)
        gamma = np.interp(u, 1 - np.exp(-x) * (1 + x), x)  # quantiles of Gamma(2, 1)
        _TABLES[:] = [gamma.astype(np.float32), np.log(u).astype(np.float32), u.astype(np.float32)]
    return _TABLES


def samples(h: np.ndarray, weight: np.ndarray, at: np.ndarray) -> np.ndarray:
    """K samples of 32 bits for each row of weighted elements; rows must not be empty.

    For an element of weight w and the k-th draws r, c ~ Gamma(2, 1) and b ~ U(0, 1):
    t = floor(ln w / r + b), ln a = ln c - r (t - b + 1); the element of the least a
    and its t are the sample.
    """
    gamma, log, uniform = _tables()
    out = np.zeros((len(at) - 1, K), np.uint32)
    lw = np.log(weight).astype(np.float32)
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + 32768, "right")) - 1)
        part, w, begin = h[at[i] : at[j]], lw[at[i] : at[j]], at[i:j] - at[i]
        for k in range(K):
            x = mix(part ^ U64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            r, b = gamma[x & U64(0xFFFF)], uniform[x >> U64(16) & U64(0xFFFF)]
            c = -(log[x >> U64(32) & U64(0xFFFF)] + log[x >> U64(48)])
            t = np.floor(w / r + b)
            a = np.log(c) - r * (t - b + 1)
            bits = a.view(np.int32).astype(np.int64)
            bits = np.where(bits < 0, ~bits, bits | 0x80000000) & 0xFFFFFFFF  # in the order of the floats
            name = (part ^ t.astype(np.int64).view(U64) * U64(0x9E3779B97F4A7C15)) >> U64(32)
            out[i:j, k] = np.minimum.reduceat(bits.astype(U64) << U64(32) | name, begin).astype(np.uint32)
        i = j
    return out


def _bands() -> Column:
    """Bucket keys of a node's sketch: K samples of 16 bits, enough to tell them apart, as pairs are verified on the sets."""
    cuts = [F.xxhash64(F.lit(b), F.substring("sketch", 2 * b * ROWS + 1, 2 * ROWS)) for b in range(BANDS)]
    return F.explode(F.when(F.col("sketch").isNotNull(), F.array(*cuts)))


def rare(total: int, volume: int) -> float:
    """Up to how many documents a shingle is in when its idf is 1, for `total` documents of `volume` bytes."""
    return max((total + COMMON) / COMMON, (volume / 2 + total) / MOST_COMMON)


def common_shingles(docs: DataFrame, total: int, volume: int) -> tuple[np.ndarray, np.ndarray]:
    """The upper 48 bits of shingles of more than rare() documents, ascending, and their idf.

    Every shingle of every document is counted: partitions send owners of hash
    ranges their sorted distinct shingles, Golomb-coded, with their counts.
    """
    owners = max(2, -(-volume // (6 * OWNED)))
    span = -(-(1 << 48) // owners)
    least = rare(total, volume)

    def message(held):
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        owner = (keys // U64(span)).astype(np.int64)
        who, first = np.unique(owner, return_index=True)
        blobs = [golomb(x - U64(o * span), span) for o, x in zip(who.tolist(), np.split(keys, first[1:]))]
        tallies = [zlib.compress(c.astype("<u4").tobytes(), 1) for c in np.split(counts, first[1:])]
        return pa.RecordBatch.from_arrays([pa.array(who), pa.array(blobs, pa.binary()), pa.array(tallies, pa.binary())], ["owner", "blob", "counts"])

    @tidied
    def send(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, buf, at in runs(batch.column(0)):
                h, _, _ = shingle_sets(*word_lists(buf, at))
                held.append(h >> U64(16))
                size += len(h)
                if size >= MESSAGE:
                    yield message(held)
                    held, size = [], 0
        if size:
            yield message(held)

    def count(t: pa.Table) -> pa.Table:
        keys = np.concatenate([ungolomb(b) for b in t.column("blob").to_pylist()])
        counts = np.concatenate([np.frombuffer(zlib.decompress(b), "<u4") for b in t.column("counts").to_pylist()]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        df = np.add.reduceat(counts, first)
        many = df > least
        owner = U64(t.column("owner")[0].as_py() * span)
        return pa.table([pa.array((keys[first][many] + owner).astype(np.int64)), pa.array(df[many])], ["key", "df"])

    sent = docs.select("text").mapInArrow(send, "owner long, blob binary, counts binary")
    found = sent.groupBy("owner").applyInArrow(count, "key long, df long").toPandas()
    keys, df = found["key"].to_numpy().astype(U64), found["df"].to_numpy().astype(float)
    order = np.argsort(keys)
    fall = np.log(df[order] / least) / max(np.log(max(total, 1) / least), 1e-9)
    return keys[order], 1 - (1 - LEAST_IDF) * np.minimum(fall, 1)


def weights(h: np.ndarray, tf: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    keys, idf = table
    w = 1 + np.log(tf)
    if not len(keys):
        return w
    key = h >> U64(16)
    place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return w * np.where(keys[place] == key, idf[place], 1.0)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    return float(shared / max(a[1].sum() + b[1].sum() - shared, 1e-12))


def _packed(h: np.ndarray, w: np.ndarray) -> bytes:
    """The upper 40 bits of ascending hashes, enough to tell two documents' shingles apart, and the weights."""
    return h.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes() + zlib.compress(w.astype("<f4").tobytes(), 1)


def _unpacked(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, 3:] = np.frombuffer(blob, np.uint8, 5 * n).reshape(n, 5)
    return wide.view(">u8").ravel().astype(U64), np.frombuffer(zlib.decompress(blob[5 * n :]), "<f4").astype(float)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of `pairs` whose `sets` (node, n, blob) have the similarity.

    A node that is the `a` of many pairs has its set sent once for every PORTION
    of them, so no task gets all of its partners.
    """

    @tidied
    def run(batches):
        last = (None, None)
        for t in batches:
            c = [x.to_pylist() for x in t.columns]
            ok = []
            for a, n, x, m, y in zip(c[0], c[2], c[3], c[4], c[5]):
                if last[0] != a:
                    last = (a, _unpacked(x, n))
                ok.append(similarity(last[1], _unpacked(y, m)) >= THRESHOLD)
            yield pa.RecordBatch.from_arrays(t.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    hubs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PORTION).cast("int").alias("portions")).filter("portions > 1")
    dealt = pairs.join(hubs, "a", "left").withColumn("portion", F.coalesce(F.pmod(F.xxhash64("b"), F.col("portions")).cast("int"), F.lit(0)))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("blob").alias("blob_b"))
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("blob").alias("blob_a")).join(hubs, "a", "left")
    left = left.withColumn("portion", F.explode(F.sequence(F.lit(0), F.coalesce("portions", F.lit(1)) - 1)))
    both = dealt.drop("portions").join(right, "b").join(left, ["a", "portion"])
    return both.select("a", "b", "n_a", "blob_a", "n_b", "blob_b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of `edges` (a, b) is connected with.

    Labels go along edges and jump to their own label's label, so the number of
    rounds is a logarithm of the longest path.  All rows are a few numbers; where
    a node has very many edges, adaptive execution splits its part of a join.
    """
    edges = settle(edges.select("a", "b"))
    both = settle(edges.union(edges.select("b", "a")).distinct())
    if both.isEmpty():
        return both.toDF("node", "root")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("before"))
        further = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = settle(lower.join(further, "root", "left").select("node", F.least("root", F.coalesce("far", "root")).alias("root"), "before"))
        changed = not new.filter("root < before").isEmpty()
        labels = new.select("node", "root")
        if not changed:
            return labels


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, table) -> DataFrame:
    """node, n, blob of the nodes in `wanted`: their texts are read again, a fixed-size filter keeps the others away."""
    named = settle(wanted.select("node").distinct().join(nodes.select("node", "content"), "node"))
    slot = F.pmod(F.xxhash64("content"), F.lit(FILTER_BITS))
    filled = named.groupBy(F.floor(slot / 32768).cast("int").alias("block")).agg(F.bitmap_construct_agg(F.pmod(slot, F.lit(32768))).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in filled:
        bits[r.block * 4096 : (r.block + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    held = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    @tidied
    def read(batches):
        import xxhash

        mask = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            for _, _, buf, at in runs(batch.column(0)):
                words, first = word_lists(buf, at)
                names = contents(words, first)
                place = np.array([xxhash.xxh64_intdigest(x, 42) for x in names], U64) % U64(FILTER_BITS)
                rows = np.flatnonzero(mask[place >> U64(3)] >> (place & U64(7)).astype(np.uint8) & 1)
                n, blobs = [], []
                for r in rows.tolist():
                    own = words[first[r] : first[r + 1]]
                    h, tf, _ = shingle_sets(own, np.array([0, len(own)]))
                    n.append(len(h))
                    blobs.append(_packed(h, weights(h, tf, table.value)))
                yield pa.RecordBatch.from_arrays([pa.array([names[r] for r in rows.tolist()], pa.binary()), pa.array(n, pa.int32()), pa.array(blobs, pa.binary())], ["content", "n", "blob"])

    found = docs.select("text").mapInArrow(read, "content binary, n int, blob binary")
    return settle(found.groupBy("content").agg(F.first("n").alias("n"), F.first("blob").alias("blob")).join(named, "content").select("node", "n", "blob"))


def _across(members: DataFrame) -> DataFrame:
    """Links (a, b) between the roots of members (bucket, main, many, few, node, root, sketch, n, blob) of one bucket.

    The `few` members whose root isn't the bucket's main one are held against
    each other and against the `many` others, a pair of blocks at a time.  Pairs
    whose samples agree often are verified there, those that agree most first,
    and pairs that links found before connect are passed over; so a call gives
    fewer links than it has members, and no row for any other pair.
    """
    first, second = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("few", "many"))
    mine = F.col("root") != F.col("main")
    own = F.when(mine, F.pmod(F.xxhash64("node"), first)).otherwise(first + F.pmod(F.xxhash64("node"), second)).cast("int")
    dealt = members.withColumns({"own": own, "first": first, "all": first + second})
    other = F.explode(F.when(F.col("own") < F.col("first"), F.sequence(F.lit(0), F.col("all") - 1)).otherwise(F.sequence(F.lit(0), F.col("first") - 1)))
    dealt = dealt.withColumn("other", other).select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root", "sketch", "n", "blob")

    def compare(t: pa.Table) -> pa.Table:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        own, node, root = (t.column(c).to_numpy() for c in ("own", "node", "root"))
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), "<u2").reshape(-1, K)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        others = sketch[right]
        found = []
        for x in left.tolist():
            agree = (others == sketch[x]).mean(1)
            near = (agree >= AGREE) & (root[right] != root[x])
            if i == j:
                near &= node[right] > node[x]
            found.append(np.stack([agree[near], np.full(near.sum(), x), right[near]], 1))
        found = np.concatenate([np.zeros((0, 3)), *found])
        found = found[np.argsort(-found[:, 0], kind="stable")]
        names, group = np.unique(root, return_inverse=True)
        parent = list(range(len(names)))

        def top(g: int) -> int:
            while parent[g] != g:
                parent[g] = parent[parent[g]]
                g = parent[g]
            return g

        n, blob = t.column("n").to_pylist(), t.column("blob")
        sets: dict[int, tuple] = {}
        held, a, b = 0, [], []
        for x, y in found[:, 1:].astype(np.int64).tolist():
            p, q = top(group[x]), top(group[y])
            if p == q:
                continue
            if held > UNPACKED:
                sets, held = {}, 0
            for k in (x, y):
                if k not in sets:
                    sets[k] = _unpacked(blob[k].as_py(), n[k])
                    held += n[k]
            if similarity(sets[x], sets[y]) >= THRESHOLD:
                parent[p] = q
                a.append(min(root[x], root[y]))
                b.append(max(root[x], root[y]))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def content(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """`docs` with a column that names each text's word list, as near_rows does."""

    @F.pandas_udf("binary")
    def named(texts: pd.Series) -> pd.Series:
        names = []
        for _, _, buf, at in runs(pa.array(texts, pa.large_string(), from_pandas=True)):
            names += contents(*word_lists(buf, at))
        return pd.Series(names, dtype=object)

    return docs.withColumn(name, named(F.col(text_col)))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, class_size, kept for every row of `docs`.

    A class is a connected set of documents of which linked ones have the
    similarity; class_id is its smallest doc_id, and one row of each class is
    kept, one with that id.  Null ids count as larger than any; ids may be
    repeated, within a class and in several.  Texts without words, null and
    empty ones included, are one class; a text of less than five words is a
    single shingle.  An empty table gives no rows.
    """
    return near_rows(docs, id_col, text_col).drop("content")


def near_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """near_groups with content, which names a row's word list: with doc_id it tells the kept rows of all classes apart."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    seen = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    total = seen["n"]
    table = spark.sparkContext.broadcast(common_shingles(docs, total, seen["bytes"]))

    @tidied
    def sketch(batches):
        for batch in batches:
            names, drawn = [], []
            for _, _, buf, at in runs(batch.column(1)):
                words, first = word_lists(buf, at)
                own = contents(words, first)
                names += own
                place = {x: r for r, x in enumerate(own) if first[r] < first[r + 1]}  # equal texts of a run are sketched once
                rows = list(place.values())
                size = np.diff(first)[rows]
                begin = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
                h, tf, begin = shingle_sets(np.concatenate([words[:0], *(words[first[r] : first[r + 1]] for r in rows)]), begin)
                s = samples(h, weights(h, tf, table.value), begin).astype("<u2") if rows else []
                known = {x: s[k].tobytes() for k, x in enumerate(place)}
                drawn += [known.get(x) for x in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.binary()), pa.array(drawn, pa.binary())], ["doc_id", "content", "sketch"])

    rows = settle(docs.mapInArrow(sketch, "doc_id long, content binary, sketch binary").withColumn("uid", F.monotonically_increasing_id()))
    nodes = settle(rows.groupBy("content").agg(F.min("uid").alias("node"), F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "uid")).alias("least"), F.first("sketch").alias("sketch")))
    buckets = nodes.select("node", _bands().alias("bucket"))
    shared = settle(buckets.groupBy("bucket").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("size")).filter("size > 1"))
    members = settle(attach_groups(buckets, shared, "bucket", "size", total * BANDS, how="inner"))
    pairs = settle(members.filter("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct())
    sets = _sets(docs, nodes, members, table)
    roots = components(verified(pairs, sets))
    # leaders have been compared with all others of their buckets
    rest = members.filter("node != leader").join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    apart = rest.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max_by("root", "n").alias("main"), F.max("n").alias("many"), F.sum("n").alias("size"))
    apart = settle(apart.filter("size > many").withColumn("few", F.col("size") - F.col("many")))
    left = attach_groups(rest, apart, "bucket", "size", total * BANDS, how="inner").drop("size")
    found = _across(left.join(nodes.select("node", "sketch"), "node").join(sets, "node"))
    joined = components(found)
    new = joined.join(roots, "node", "left_anti")
    roots = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(new)
    classes = nodes.select("content", "node", "copies", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = classes.groupBy("root").agg(F.min("least").alias("least"), F.sum("copies").alias("class_size"))
    whole = whole.select("root", F.col("least.doc_id").alias("class_id"), F.col("least.uid").alias("keep"), "class_size")
    classes = settle(attach_groups(classes.drop("least"), whole, "root", "class_size", total).select("content", "copies", "class_id", "class_size", "keep"))
    out = attach_groups(rows.select("doc_id", "content", "uid"), classes, "content", "copies", total)
    return out.select("doc_id", "class_id", "class_size", (F.col("uid") == F.col("keep")).alias("kept"), "content")
