"""Language-model scoring with Elias-Fano tries (operator 10).

The model is of order 3: p(x | v w) = (c(v w x) + MU[1] p(x | w)) / (c(v w) + MU[1])
and p(x | w) = (c(w x) + MU[0] p(x)) / (c(w) + MU[0]), with
p(x) = (c(x) + 0.1) / (N + 0.1 (V + 1)); the first token of a text has a bigram
only.  Its trie is cut by first word into shards, so that no task holds more than
a bounded part of it however large the corpus is.  Documents are read once, into
blocks of about a million tokens kept in the checkpoint folder.  A block sends
each owner of a hash range its sorted distinct words with their counts, and gets
back each word's id, small for frequent words, and its count in the whole corpus;
then it sends each shard a trie of its bigrams and trigrams and gets quantised
probabilities, in the order sent.  A shard merges these tries into its own:
words, pointers and successors are Elias-Fano sequences in a mapped buffer, the
smoothed probabilities are bytes.  Every n-gram that is asked for is searched on
the encoded levels, among the successors of its context.  The successors of a
frequent word are dealt to all shards.
"""

from __future__ import annotations

import mmap
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, bytes_hash, lower_ascii, mix, prepare, runs, settle, settle_by, span_hashes, spans, tidied

#: Weight of the lower order, in tokens, of bigrams and of trigrams.
MU = (10.0, 2.0)
#: Tokens of a block, words of an owner and tokens of a shard, about.
BLOCK, OWNED, SHARD = 1_000_000, 2_000_000, 1_000_000
#: Probabilities are kept in steps of 1 / STEPS of a decimal power at most, down to 254 of them; the largest code is "not there".
STEPS = 32
ABSENT = 255
#: Searches done together.
TOGETHER = 1 << 15
END = bytes_hash(b"\n")  # no word has this byte
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: SELECT[b, k]: place of the k-th one in byte b, from its highest bit.
SELECT = np.zeros((256, 8), np.int64)
for _b in range(256):
    _ones = [k for k in range(8) if _b >> (7 - k) & 1]
    SELECT[_b, : len(_ones)] = _ones


def _z(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a).tobytes(), codec="zstd", asbytes=True)


def _unz(b: bytes, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(b, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _planes(a: np.ndarray) -> bytes:
    """Numbers below 2**32, their bytes of equal weight together, the lowest first."""
    return _z(a.astype("<u4").view(np.uint8).reshape(-1, 4).T)


def _unplanes(b: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(_unz(b, "u1", 4 * n).reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def ef_encode(values: np.ndarray) -> bytes:
    """Ascending values from 0: a header, high bits as a unary bit vector, low bits packed."""
    n = len(values)
    v = values.astype(U64)
    top = int(v[-1]) if n else 0
    low = max(0, (top // max(n, 1)).bit_length() - 1)
    high = (v >> U64(low)).astype(np.int64)
    unary = np.zeros(n + (int(high[-1]) if n else 0) + 1, np.uint8)
    unary[high + np.arange(n)] = 1
    cells, wide = b"", -(-low // 8)
    if low and n:
        rows = (v & U64((1 << low) - 1)).astype(">u8").view(np.uint8).reshape(n, 8)[:, 8 - wide :]
        cells = np.packbits(np.unpackbits(rows, axis=1)[:, 8 * wide - low :]).tobytes()
    return np.array([n, low, len(unary)], "<i8").tobytes() + np.packbits(unary).tobytes() + cells


def ef_decode(blob) -> np.ndarray:
    """All values of ef_encode()'s bytes; for what has been sent, the model itself is searched as it is."""
    n, low, size = np.frombuffer(blob, "<i8", 3).tolist()
    cells = (size + 7) // 8
    v = (np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, cells, 24), count=size)) - np.arange(n)).astype(U64) << U64(low)
    if low and n:
        wide = -(-low // 8)
        bits = np.zeros((n, 8 * wide), np.uint8)
        bits[:, 8 * wide - low :] = np.unpackbits(np.frombuffer(blob, np.uint8, (n * low + 7) // 8, 24 + cells), count=n * low).reshape(n, low)
        rows = np.zeros((n, 8), np.uint8)
        rows[:, 8 - wide :] = np.packbits(bits, axis=1)
        v |= rows.view(">u8").ravel().astype(U64)
    return v.astype(np.int64)


class Sequence:
    """An encoded sequence that is read in place, by rank and select over 128 bits of its high part at a time."""

    def __init__(self, blob):
        self.n, self.low, size = np.frombuffer(blob, "<i8", 3).tolist()
        cells = (size + 7) // 8
        self.high = np.frombuffer(blob, np.uint8, cells, 24)
        self.cells = np.frombuffer(blob, np.uint8, (self.n * self.low + 7) // 8, 24 + cells)
        self.zeros = size - self.n
        ones = np.add.reduceat(np.bitwise_count(self.high), np.arange(0, cells, 16), dtype=np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)[:-1]])  # before each 128 bits
        self.none = np.arange(len(self.ones)) * 128 - self.ones

    def _select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Place of the k-th bit of that kind, from 0."""
        before = self.ones if bit else self.none
        part = np.searchsorted(before, k, "right") - 1
        at = np.minimum(part[:, None] * 16 + np.arange(16), len(self.high) - 1)
        block = self.high[at] if bit else ~self.high[at]
        seen = np.cumsum(np.bitwise_count(block), axis=1, dtype=np.int64)
        rest = k - before[part]
        byte = (seen <= rest[:, None]).sum(1)
        row = np.arange(len(k))
        own = block[row, byte]
        rest = rest - (seen[row, byte] - np.bitwise_count(own))
        return part * 128 + byte * 8 + SELECT[own, rest]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.int64)
        bit = i * self.low
        at = np.minimum((bit >> 3)[:, None] + np.arange(8), len(self.cells) - 1)
        word = self.cells[at].view(">u8").ravel().astype(U64)
        return ((word << (bit & 7).astype(U64)) >> U64(64 - self.low)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self._select(i, 1) - i) << self.low | self._low(i)

    def find(self, start: np.ndarray, end: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Index of each value among those from its start to its end, or -1."""
        high = value >> self.low
        inside = (high < self.zeros) & (start < end)
        high = np.where(inside, high, 0)
        lo = np.where(high > 0, self._select(np.maximum(high - 1, 0), 0) - (high - 1), 0)
        hi = np.where(inside, self._select(high, 0) - high, 0)
        lo, hi = np.maximum(lo, start), np.minimum(hi, end)
        want, last = value & ((1 << self.low) - 1), np.maximum(hi, lo)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        hit = np.flatnonzero(lo < last)
        hit = hit[self._low(lo[hit]) == want[hit]]
        out = np.full(len(value), -1)
        out[hit] = lo[hit]
        return out


def _bases(successors: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """What is added to the successors of each context, so that a level ascends: one more than the level's last value before."""
    some = starts[1:] > starts[:-1]
    span = np.zeros(len(some), np.int64)
    span[some] = successors[starts[1:][some] - 1] + 1
    total = np.cumsum(span)
    if len(total) and int(total[-1]) >= 1 << 56:
        raise OverflowError("a level's successors don't fit 56 bits")
    return total - span


PARTS = 8


def trie_bytes(words: np.ndarray, starts: np.ndarray, seconds: np.ndarray, starts2: np.ndarray, thirds: np.ndarray, *codes: np.ndarray) -> bytes:
    """A trie as it is sent and kept: words, the range of each one's successors, the successors; their ranges and successors in turn; up to three rows of codes."""
    levels = [words, starts, seconds + np.repeat(_bases(seconds, starts), np.diff(starts)), starts2, thirds + np.repeat(_bases(thirds, starts2), np.diff(starts2))]
    parts = [*map(ef_encode, levels), *(c.astype(np.uint8).tobytes() for c in codes)]
    parts += [b""] * (PARTS - len(parts))
    return np.array([len(p) for p in parts], "<i8").tobytes() + b"".join(parts)


class Trie:
    """The bytes of a trie, mapped and searched as they are; mapped from a file in memory, as executors' folders are not to be used."""

    def __init__(self, data: bytes):
        file = os.memfd_create("trie")
        try:
            os.ftruncate(file, len(data))
            self.map = mmap.mmap(file, len(data))
        finally:
            os.close(file)
        self.map[:] = data
        self.at = (8 * PARTS + np.concatenate([[0], np.cumsum(np.frombuffer(data, "<i8", PARTS))])).tolist()
        self.opened: dict[int, Sequence] = {}

    def part(self, k: int) -> memoryview:
        return memoryview(self.map)[self.at[k] : self.at[k + 1]]

    def level(self, k: int) -> Sequence:
        if k not in self.opened:
            self.opened[k] = Sequence(self.part(k))
        return self.opened[k]

    def codes(self, k: int) -> np.ndarray:
        return np.frombuffer(self.part(5 + k), np.uint8)

    def find_words(self, words: np.ndarray) -> np.ndarray:
        """Number of each word, or -1."""
        level = self.level(0)
        return self._searched(lambda w: level.find(np.zeros(len(w), np.int64), np.full(len(w), level.n), w), words)

    def find(self, k: int, parents: np.ndarray, which: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Number of words[i] among the successors of parents[which[i]], -1 where there is none; k is 2 for bigrams, 3 for trigrams.

        A parent's pointers and the last value before its range are read once.
        """
        pointers, level = self.level(2 * k - 3), self.level(2 * k - 2)
        if not len(words) or not level.n:
            return np.full(len(words), -1)

        def ranges(p):
            known = np.maximum(p, 0)
            start, end = pointers.get(known), pointers.get(known + 1)
            base = np.where(start > 0, level.get(np.maximum(start - 1, 0)) + 1, 0)
            return np.stack([start, np.where(p < 0, start, end), base])

        start, end, base = self._searched(ranges, parents)
        return self._searched(lambda i, w: level.find(start[i], end[i], base[i] + w), which, words)

    @staticmethod
    def _searched(search, *queries: np.ndarray) -> np.ndarray:
        n = len(queries[0])
        found = [search(*(q[i : i + TOGETHER] for q in queries)) for i in range(0, n, TOGETHER)]
        return np.concatenate(found, axis=-1) if found else search(*queries)


def sent(data: bytes) -> tuple[np.ndarray, ...]:
    """Words, starts, seconds, starts2, thirds of a trie that a block has sent."""
    ends = (8 * PARTS + np.cumsum(np.frombuffer(data, "<i8", PARTS))).tolist()
    view = memoryview(data)
    words, starts, seconds, starts2, thirds = (ef_decode(view[i:j]) for i, j in zip([8 * PARTS, *ends], ends[:5]))

    def plain(values, at):
        before = np.where(at[:-1] > 0, values[np.maximum(at[:-1] - 1, 0)] + 1, 0) if len(values) else np.zeros(len(at) - 1, np.int64)
        return values - np.repeat(before, np.diff(at))

    return words, starts, plain(seconds, starts), starts2, plain(thirds, starts2)


def _blocks(docs: DataFrame, held: str) -> DataFrame:
    """block, docs, held, sizes, vocab, counts, tokens, often: texts as numbers of words, and each number's place among the block's ascending word hashes."""

    def block(ids, out, sizes, hashes):
        h, size, out = np.concatenate(hashes), np.concatenate(sizes), np.array(out, bool)
        vocab, tokens = np.unique(h, return_inverse=True)
        counts = np.bincount(tokens[~np.repeat(out, size)], minlength=len(vocab)).astype("<u4")
        often = np.argsort(-np.bincount(tokens, minlength=len(vocab)), kind="stable")  # frequent words get small numbers
        number = np.empty(len(vocab), np.int64)
        number[often] = np.arange(len(vocab))
        arrays = [pa.array([ids], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in (out.astype(np.uint8).tobytes(), size.astype("<u4").tobytes(), ef_words(vocab), _z(counts), _planes(number[tokens]), _planes(often)))]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([len(vocab)]), pa.array([len(tokens)])], ["docs", "held", "sizes", "vocab", "counts", "tokens", "often", "n_vocab", "n_tokens"])

    @tidied
    def run(batches):
        ids, out, sizes, hashes, total = [], [], [], [], 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            flags = batch.column(2).to_pylist()
            for i, j, buf, at in runs(batch.column(1)):
                low = lower_ascii(buf)
                s, e, first = spans(~SPACE[low], at)
                h = np.insert(span_hashes(low, s, e), first[1:], U64(END))
                ids += names[i:j]
                out += flags[i:j]
                sizes.append(np.diff(first) + 1)
                hashes.append(h)
                total += len(h)
                if total >= BLOCK:
                    yield block(ids, out, sizes, hashes)
                    ids, out, sizes, hashes, total = [], [], [], [], 0
        if ids:
            yield block(ids, out, sizes, hashes)

    rows = docs.select("doc_id", "text", F.coalesce(F.col(held), F.lit(False)).alias("held")).mapInArrow(run, "docs array<long>, held binary, sizes binary, vocab binary, counts binary, tokens binary, often binary, n_vocab long, n_tokens long")
    return settle_by(rows.withColumn("block", F.monotonically_increasing_id()), "block")


def ef_words(hashes: np.ndarray) -> bytes:
    """64-bit hashes; their first bit goes apart, so that each half fits 63 bits."""
    split = int(np.searchsorted(hashes, U64(1 << 63)))
    a = ef_encode(hashes[:split])
    return np.array([len(a)], "<i8").tobytes() + a + ef_encode(hashes[split:] - U64(1 << 63))


def words_ef(blob: bytes) -> np.ndarray:
    k = int(np.frombuffer(blob, "<i8", 1)[0])
    return np.concatenate([ef_decode(blob[8 : 8 + k]).astype(U64), ef_decode(blob[8 + k :]).astype(U64) + U64(1 << 63)])


def _unigrams(blocks: DataFrame, owners: int) -> DataFrame:
    """block, owner, ids, counts, n, and in one row of each owner its words and tokens of training."""
    span = -(-(1 << 64) // owners)

    def send(batches):
        for batch in batches:
            for b, vocab, counts, n in zip(*(batch.column(c).to_pylist() for c in ("block", "vocab", "counts", "n_vocab"))):
                vocab, counts = words_ef(vocab), _unz(counts, "<u4", n)
                who, first = np.unique((vocab // U64(span)).astype(np.int64), return_index=True)
                cut = first[1:]
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array([b] * len(who), pa.int64()), pa.array([ef_words(x) for x in np.split(vocab, cut)], pa.binary()), pa.array([_z(x) for x in np.split(counts, cut)], pa.binary())], ["owner", "block", "words", "counts"])

    def answer(t: pa.Table) -> pa.Table:
        owner = t.column("owner")[0].as_py()
        held = [words_ef(x) for x in t.column("words").to_pylist()]
        counts = [_unz(x, "<u4", len(s)) for x, s in zip(t.column("counts").to_pylist(), held)]
        words, inverse = np.unique(np.concatenate(held), return_inverse=True)
        c = np.bincount(inverse, np.concatenate(counts)).astype(np.int64)
        number = np.empty(len(words), np.int64)  # the most frequent word of an owner is its first
        number[np.argsort(-c, kind="stable")] = np.arange(len(words))
        at = np.cumsum([0, *map(len, held)])
        places = [inverse[i:j] for i, j in zip(at[:-1], at[1:])]
        n = len(held)
        return pa.table([t.column("block"), pa.array([owner] * n, pa.int64()), pa.array([_planes(number[p]) for p in places], pa.binary()), pa.array([_z(c[p].astype("<i8")) for p in places], pa.binary()), pa.array([len(p) for p in places], pa.int64()), pa.array([int((c > 0).sum()), *[0] * (n - 1)], pa.int64()), pa.array([int(c.sum()), *[0] * (n - 1)], pa.int64())], ["block", "owner", "ids", "counts", "n", "types", "tokens"])

    sent = blocks.select("block", "vocab", "counts", "n_vocab").mapInArrow(tidied(send), "owner long, block long, words binary, counts binary")
    return settle_by(sent.groupBy("owner").applyInArrow(answer, "block long, owner long, ids binary, counts binary, n long, types long, tokens long"), "block")


def _known(t: pa.Table, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and corpus counts of a block's words, in the order of its vocabulary."""
    ids, counts = [], []
    for owner, places, c, n in sorted(zip(*(t.column(k).to_pylist() for k in ("owner", "ids", "counts", "n")))):
        ids.append(_unplanes(places, n) * owners + owner)
        counts.append(_unz(c, "<i8", n))
    return np.concatenate(ids), np.concatenate(counts)


def _numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, and the place of each key among them."""
    order = np.argsort(key)
    ascending = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ascending[1:] != ascending[:-1]
    place = np.empty(len(key), np.int64)
    place[order] = np.cumsum(new) - 1
    return ascending[new], place


class Grams:
    """The distinct bigrams and trigrams of a block, in the order in which its shards' tries hold them.

    Words are numbered in the order of their ids; a text begins after an end.
    """

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray, shards: int, heavy: float):
        by_id = np.argsort(ids)
        number = np.empty(len(ids), np.int64)
        number[by_id] = np.arange(len(ids))
        self.ids, self.counts = ids[by_id], counts[by_id]
        self.tokens = tokens = number[tokens]
        self.first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[self.first] = tokens[sizes[0] - 1]
        self.context = before
        distinct, place = _numbered(before << 32 | tokens)
        v, w = distinct >> 32, distinct & 0xFFFFFFFF
        a, b = self.ids[v].astype(U64), self.ids[w].astype(U64)
        spread = np.where(self.counts[v] > heavy, mix(b + U64(1)), U64(0))
        shard = mix(a * U64(2) + U64(1) ^ spread) % U64(shards)
        order = np.argsort(shard.astype(np.uint16 if shards < 1 << 16 else np.int64), kind="stable")
        self.shard, self.v, self.w = shard[order].astype(np.int64), v[order], w[order]
        again = np.empty(len(order), np.int64)
        again[order] = np.arange(len(order))
        self.bigram = again[place]  # of each token
        self.inner = np.ones(len(tokens), bool)
        self.inner[self.first] = False
        follows = np.flatnonzero(self.inner)
        distinct, self.trigram = _numbered(self.bigram[follows - 1] << 32 | tokens[follows])  # of each token but the first ones
        self.parent, self.x = distinct >> 32, distinct & 0xFFFFFFFF
        self.shards, begin = np.unique(self.shard, return_index=True)
        self.cut2 = np.append(begin, len(self.shard))
        self.cut3 = np.searchsorted(self.parent, self.cut2)


def score(docs: DataFrame, held: str = "held_out", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of `docs`.

    Learns from rows whose boolean column `held` isn't true.  A null or empty
    text is its end alone.  Repeated rows each count and each give a row; an
    empty table gives none.  Words are known by 64-bit hashes.  A text belongs to
    one block whatever its length, and takes about 150 bytes of a worker's memory
    per token there.  Each factor of the model is within half a step of its
    exact value, so a score is within a step per token.
    """
    spark = docs.sparkSession
    prepare(spark)
    blocks = _blocks(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), docs[held].alias("held")), "held")
    sizes = blocks.agg(F.coalesce(F.sum("n_vocab"), F.lit(0)).alias("words"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).first()
    owners, shards = max(2, -(-sizes["words"] // OWNED)), max(1, -(-sizes["tokens"] // SHARD))
    unigrams = _unigrams(blocks, owners)
    seen = unigrams.agg(F.coalesce(F.sum("types"), F.lit(0)).alias("v"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()
    types, trained = seen["v"], seen["n"]
    heavy = max(1000.0, trained / shards / 16)
    unit = trained + 0.1 * (types + 1)
    steps = min(STEPS, int((ABSENT - 2) / np.log10(trained + 100)))  # the least probability, one of all tokens, has a code

    def coded(p: np.ndarray) -> np.ndarray:
        return np.minimum(np.round(-steps * np.log10(np.maximum(p, 1e-30))), ABSENT - 1).astype(np.uint8)

    def value(codes: np.ndarray) -> np.ndarray:
        return np.where(codes == ABSENT, 0.0, 10.0 ** (-codes.astype(float) / steps))

    def opened(t: pa.Table, answers: pa.Table):
        row = {c: t.column(c)[0].as_py() for c in t.column_names}
        tokens = _unplanes(row["often"], row["n_vocab"])[_unplanes(row["tokens"], row["n_tokens"])]
        sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
        return row, sizes, Grams(tokens, sizes, *_known(answers, owners), shards, heavy)

    def ask(t: pa.Table, answers: pa.Table) -> pa.Table:
        row, sizes, g = opened(t, answers)
        learn = ~np.repeat(np.frombuffer(row["held"], np.uint8).astype(bool), sizes)
        n2 = np.bincount(g.bigram[learn], minlength=len(g.v)).astype("<u4")
        n3 = np.bincount(g.trigram[learn[g.inner]], minlength=len(g.x)).astype("<u4")
        seconds, thirds = g.ids[g.w], g.ids[g.x]
        out = []
        for k in range(len(g.shards)):
            i, j, a, b = g.cut2[k], g.cut2[k + 1], g.cut3[k], g.cut3[k + 1]
            v = g.v[i:j]
            new = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            starts2 = np.concatenate([[0], np.cumsum(np.bincount(g.parent[a:b] - i, minlength=j - i))])
            levels = trie_bytes(g.ids[v[new]], np.append(new, j - i), seconds[i:j], starts2, thirds[a:b])
            out.append((levels, _z(n2[i:j]), _z(n3[a:b]), _z(g.counts[v[new]].astype("<i8"))))
        return pa.table([pa.array(g.shards), pa.array([row["block"]] * len(g.shards), pa.int64()), *(pa.array(list(x), pa.binary()) for x in zip(*out))], ["shard", "block", "trie", "n2", "n3", "c"])

    def answer(t: pa.Table) -> pa.Table:
        asked = [sent(b) for b in t.column("trie").to_pylist()]

        def joined(name, kind, k):
            return np.concatenate([_unz(x, kind, len(a[k])) for x, a in zip(t.column(name).to_pylist(), asked)]).astype(np.int64)

        c2, c3, totals = joined("n2", "<u4", 2), joined("n3", "<u4", 4), joined("c", "<i8", 0)
        words, where = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
        total = np.zeros(len(words), np.int64)
        total[where] = totals
        bits = int(max(int(a[k].max(initial=0)) for a in asked for k in (2, 4))).bit_length()
        mask = (1 << bits) - 1
        number = np.repeat(where, np.concatenate([np.diff(a[1]) for a in asked]))
        pairs, pair = _numbered(number << bits | np.concatenate([a[2] for a in asked]))
        n2 = np.bincount(pair, c2, len(pairs)).astype(np.int64)
        parent = np.repeat(pair, np.concatenate([np.diff(a[3]) for a in asked]))
        triples, triple = _numbered(parent << bits | np.concatenate([a[4] for a in asked]))
        n3 = np.bincount(triple, c3, len(triples)).astype(np.int64)
        sizes2, sizes3 = [len(a[2]) for a in asked], [len(a[4]) for a in asked]
        del asked, c2, c3, number, parent
        # the model: what has been seen in training
        learnt2, learnt3 = n2 > 0, n3 > 0
        of, w = pairs >> bits, pairs & mask
        up, x = triples >> bits, triples & mask
        there = np.flatnonzero(learnt2)
        kept = np.unique(of[there])
        renumbered = np.cumsum(learnt2) - 1
        own = up[learnt3]
        model = trie_bytes(
            words[kept], np.append(np.searchsorted(of[there], kept), len(there)), w[there],
            np.searchsorted(renumbered[own], np.arange(len(there) + 1)), x[learnt3],
            coded(n2[there] / (total[of[there]] + MU[0])), coded(MU[1] / (n2[there] + MU[1])), coded(n3[learnt3] / (n2[own] + MU[1])),
        )
        trie = Trie(model)
        # every distinct n-gram that was asked for is searched once
        found2 = trie.find(2, trie.find_words(words), of, w)
        found3 = trie.find(3, found2, up, x)
        first, back, second = (np.append(trie.codes(k), np.uint8(none)) for k, none in enumerate((ABSENT, 0, ABSENT)))
        out2, out_back, out3 = first[found2][pair], back[found2][pair], second[found3][triple]
        at2, at3 = np.cumsum([0, *sizes2]), np.cumsum([0, *sizes3])
        blobs = [_z(np.concatenate([out2[i:j], out_back[i:j], out3[k:m]])) for i, j, k, m in zip(at2, at2[1:], at3, at3[1:])]
        return pa.table([t.column("block"), t.column("shard"), pa.array(blobs, pa.binary())], ["block", "shard", "codes"])

    def finish(t: pa.Table, answers: pa.Table) -> pa.Table:
        codes = answers.filter(pc.is_valid(answers.column("codes")))
        row, sizes, g = opened(t, answers.filter(pc.is_null(answers.column("codes"))))
        own = dict(zip(codes.column("owner").to_pylist(), codes.column("codes").to_pylist()))
        bigrams, backs, trigrams = [], [], []
        for k, s in enumerate(g.shards.tolist()):
            n, m = int(g.cut2[k + 1] - g.cut2[k]), int(g.cut3[k + 1] - g.cut3[k])
            got = _unz(own[s], "u1", 2 * n + m)
            bigrams.append(got[:n])
            backs.append(got[n : 2 * n])
            trigrams.append(got[2 * n :])
        c = g.counts[g.tokens]
        p = (c + 0.1) / unit
        q = value(np.concatenate(bigrams))[g.bigram] + MU[0] / (g.counts[g.context] + MU[0]) * p
        follows = np.flatnonzero(g.inner)
        q[follows] = value(np.concatenate(trigrams))[g.trigram] + value(np.concatenate(backs))[g.bigram[follows - 1]] * q[follows]
        k = len(sizes)
        return pa.table(
            [pa.array(row["docs"], pa.int64()), pa.array(np.frombuffer(row["held"], np.uint8).astype(bool)), pa.array(sizes), pa.array(np.add.reduceat((c > 0).astype(np.int64), g.first)), pa.array(np.full(k, trained)), pa.array(np.add.reduceat(np.log10(p), g.first)), pa.array(np.add.reduceat(np.log10(q), g.first))],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    plain = unigrams.select("block", "owner", "ids", "counts", "n")
    texts = blocks.select("block", "docs", "held", "sizes", "tokens", "often", "n_vocab", "n_tokens")
    asked = texts.drop("docs").groupBy("block").cogroup(plain.groupBy("block")).applyInArrow(ask, "shard long, block long, trie binary, n2 binary, n3 binary, c binary")
    found = settle(asked.groupBy("shard").applyInArrow(answer, "block long, shard long, codes binary"))
    null = F.lit(None)
    both = plain.withColumn("codes", null.cast("binary")).unionByName(found.select("block", F.col("shard").alias("owner"), null.cast("binary").alias("ids"), null.cast("binary").alias("counts"), null.cast("long").alias("n"), "codes"))
    return texts.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(docs: DataFrame) -> DataFrame:
    """`docs` with held_out: crc32(doc_id) mod 10 is 0; a null id isn't held out."""
    return docs.withColumn("held_out", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0, F.lit(False)))
