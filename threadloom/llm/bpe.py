"""BPE encoding by forced boundaries, and decoding (operator 8).

Two neighbouring bytes that never stand side by side inside any token of the
vocabulary can't end up in one token, so a cut between them is certain whatever
the merges do.  Together with the boundaries of the pre-tokenizer these cuts
give short fragments; each distinct fragment is encoded once and independently
and a text's ids are the concatenation.  The ids are those of the tokenizers
library: its own BPE model encodes the fragments, and the character classes of
its pre-tokenizer are read from it, one probe per code point.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kept_by_workers, prepare, runs, tidied

LETTER, NUMBER, SPACE, OTHER, UNKNOWN = 0, 1, 2, 3, 255
#: Fragments kept per worker in each of two generations, some 200 bytes each; only speed depends on it.
CACHED = 120_000


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], spare = chr(spare), spare + 1
    return out


class Encoder:
    """Encodes flat runs of texts; one per worker and vocabulary file.

    Two vocabularies are understood: plain byte-level BPE, where every byte of a
    text belongs to a token, and word-end BPE, where text is normalised, numbers
    stand alone and white space is dropped.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(vocabulary)
        t.no_truncation()
        t.no_padding()
        spec = json.loads(open(vocabulary, encoding="utf-8").read())
        self.words = bool(spec["model"].get("end_of_word_suffix"))
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.letters = byte_letters()
        back = {c: b for b, c in self.letters.items()}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: s.encode() for s, i in self.added.items()}
        self.joined = np.zeros((256, 256), bool)
        for token, i in spec["model"]["vocab"].items():
            ended = bool(self.suffix) and token.endswith(self.suffix)
            raw = bytes(back[c] for c in (token[: -len(self.suffix)] if ended else token) if c in back)
            self.bytes_of.setdefault(i, raw + b" " if ended else raw)
            b = np.frombuffer(raw, np.uint8)
            self.joined[b[:-1], b[1:]] = True
        self.decimal = {i: b"%d," % i for i in self.bytes_of}
        self.special = re.compile("|".join(map(re.escape, self.added))) if self.added else None
        self.marks = [s.encode() for s in self.added]
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self.lower = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x300):
            if len(s := chr(c).lower()) == 1:
                self.lower[c] = ord(s)
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def classes(self, points: np.ndarray) -> np.ndarray:
        kind = self.kind[points]
        if (kind == UNKNOWN).any():
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
            for c in np.unique(points[kind == UNKNOWN]).tolist():
                s = chr(c)
                if len(cut("a" + s)) == 1 and (not self.words or len(cut(s)) == 1):
                    k = LETTER
                elif len(cut("!" + s)) == 1 and (not self.words or len(cut(s)) == 1):
                    k = OTHER
                elif len(cut("1" + s)) == (2 if self.words else 1) and len(cut(s)) == 1:
                    k = NUMBER
                else:
                    k = SPACE
                self.kind[c] = k
            kind = self.kind[points]
        return kind

    def known(self, raw: bytes) -> bytes:
        """A fragment's ids as little-endian 32 bits."""
        found = self.new.get(raw)
        if found is None:
            found = self.old.get(raw)
            if found is None:
                found = array("I", [t.id for t in self.tokenizer.model.tokenize(raw.decode("latin-1").translate(self.letters))]).tobytes()
            if len(raw) <= 64:
                if len(self.new) >= CACHED:
                    self.old, self.new = self.new, {}
                self.new[raw] = found
        return found

    def cuts(self, points: np.ndarray, kind: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where tokens of the pre-tokenizer start, for each code point; rows begin at `at`."""
        n = len(points)
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        start = edge[:n].copy()
        start[1:] |= kind[1:] != kind[:-1]
        if self.words:
            start |= kind == NUMBER
        else:
            space = kind == SPACE
            ended = np.ones(n, bool)  # the next code point is in another row or isn't white space
            ended[:-1] = edge[1:n] | ~space[1:]
            follows = np.zeros(n, bool)  # something stands right after it in its row
            follows[:-1] = ~edge[1:n]
            final = space & ended & follows
            start |= final
            glued = np.flatnonzero(final & (points == 32)) + 1
            start[glued] = False
        quote = np.flatnonzero((points == 39) & start)
        if len(quote):
            row_end = np.zeros(n + 2, bool)
            row_end[at] = True
            padded = np.concatenate([points, np.zeros(3, points.dtype)])
            a, b = padded[quote + 1], padded[quote + 2]
            one = np.isin(a, [ord(c) for c in "stmd"]) & ~row_end[quote + 1]
            two = np.zeros(len(quote), bool)
            for x, y in ("re", "ve", "ll"):
                two |= (a == ord(x)) & (b == ord(y))
            two &= ~row_end[quote + 1] & ~row_end[np.minimum(quote + 2, n + 1)]
            start[quote[one | two] + 1] = False
            after = np.concatenate([quote[one] + 2, quote[two & ~one] + 3])
            start[after[after < n]] = True
        return start

    def encode_run(self, buf: np.ndarray, at: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The ids of distinct fragments, each fragment's number among them, and each row's first fragment."""
        raw = buf.tobytes()
        if self.words:
            raw, buf, at = self.normalised(raw, buf, at)
        if not len(buf):
            return [], np.zeros(0, np.int64), np.zeros(len(at), np.int64)
        lead = (buf & 0xC0) != 0x80
        places = np.flatnonzero(lead)
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        if self.words:
            points = self.lower[points]
        kind = self.classes(points)
        start = self.cuts(points, kind, np.searchsorted(places, at))
        if self.words:
            keep = np.repeat(kind != SPACE, np.diff(np.append(places, len(buf))))
            begins = np.zeros(len(buf), bool)
            begins[places[start & (kind != SPACE)]] = True
            buf = np.frombuffer(points.tobytes().decode("utf-32-le").encode("utf-8"), np.uint8)
            position = np.concatenate([[0], np.cumsum(keep)])
            begins, buf, at = begins[keep], buf[keep], position[at]
        else:
            begins = np.zeros(len(buf), bool)
            begins[places[start]] = True
            begins[1:] |= ~self.joined[buf[:-1], buf[1:]]
        edges = np.flatnonzero(begins)
        offsets = np.append(edges, len(buf)).astype(np.int64)
        array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(buf))])
        coded = array.dictionary_encode()
        return list(map(self.known, coded.dictionary.to_pylist())), coded.indices.to_numpy(zero_copy_only=False), np.searchsorted(edges, at)

    def normalised(self, raw: bytes, buf: np.ndarray, at: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Rows with code points from U+0300, or whose lower case changes length, normalised by the library."""
        odd = np.flatnonzero((buf >= 0xCC) | (buf == 0xC4))
        if not len(odd):
            return raw, buf, at
        rows = np.unique(np.searchsorted(at, odd, "right") - 1)
        parts = []
        size = np.diff(at).copy()
        done = 0
        for r in rows.tolist():
            text = self.tokenizer.normalizer.normalize_str(raw[at[r] : at[r + 1]].decode("utf-8")).encode("utf-8")
            parts += [raw[done : at[r]], text]
            done, size[r] = at[r + 1], len(text)
        raw = b"".join([*parts, raw[done:]])
        return raw, np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum(size)])

    def rows(self, column: pa.Array) -> Iterator[bytes]:
        """For each text: its ids as little-endian 32 bits."""
        for found, index, first in self.coded(column):
            for i, j in zip(first[:-1], first[1:]):
                yield b"".join([found[k] for k in index[i:j]])

    def texts(self, column: pa.Array) -> Iterator[tuple[int, bytes, bytes]]:
        """For each text: count of ids, the ids as decimals joined by commas, and the bytes they decode to."""
        for found, index, first in self.coded(column):
            ids = [np.frombuffer(x, "<u4").tolist() for x in found]
            decimals = [b"".join([self.decimal[i] for i in x]) for x in ids]
            decoded = [b"".join([self.bytes_of[i] for i in x]) for x in ids]
            for i, j in zip(first[:-1], first[1:]):
                own = index[i:j]
                yield sum([len(ids[k]) for k in own]), b"".join([decimals[k] for k in own])[:-1], b"".join([decoded[k] for k in own])

    def coded(self, column: pa.Array) -> Iterator[tuple[list[bytes], list[int], list[int]]]:
        """Runs of texts as encode_run() gives them; a run with added tokens text by text."""
        for _, _, buf, at in runs(column, 1 << 20):
            raw = buf.tobytes() if self.marks else b""
            if any(m in raw for m in self.marks):
                for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
                    own = self.with_added(raw[i:j].decode("utf-8"))
                    yield own, list(range(len(own))), [0, len(own)]
            else:
                found, index, first = self.encode_run(buf, at)
                yield found, index.tolist(), first.tolist()

    def with_added(self, text: str) -> list[bytes]:
        """A text that may hold added tokens: what stands between them is encoded by itself."""
        out, done = [], 0
        for m in [*self.special.finditer(text), None]:
            piece = np.frombuffer(text[done : m.start() if m else None].encode("utf-8"), np.uint8)
            found, index, _ = self.encode_run(piece, np.array([0, len(piece)]))
            out += [found[k] for k in index.tolist()]
            if m:
                out.append(np.array([self.added[m[0]]], "<u4").tobytes())
                done = m.end()
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD, ids outside the vocabulary are left out."""
        return b"".join(self.bytes_of.get(i, b"") for i in ids).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}
kept_by_workers(_ENCODERS.clear)


def encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded string per row of `docs`.

    A null text is empty; an empty text has no ids and decodes to the empty
    string.  Repeated rows, null ids and ties each give their own row; other
    columns are not read.  An empty table gives no rows.  A text is encoded whole
    in one worker, which takes some 40 bytes of memory per byte of it.
    """
    prepare(docs.sparkSession)

    @tidied
    def run(batches):
        e = encoder(vocabulary)
        for batch in batches:
            got = list(e.rows(batch.column(1)))
            flat = np.frombuffer(b"".join(got), "<u4").astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in got])]).astype(np.int32)
            decoded = [e.decode(np.frombuffer(x, "<u4").tolist()) for x in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode() with only digests of its results leaving the worker.

    Null, empty and very long texts, repeated rows, null ids, clashing columns
    and empty tables are as there.
    """
    prepare(docs.sparkSession)

    @tidied
    def run(batches):
        e = encoder(vocabulary)
        for batch in batches:
            n, ids, texts = [], [], []
            for count, decimals, decoded in e.texts(batch.column(1)):
                n.append(count)
                ids.append(hashlib.sha256(decimals).hexdigest())
                texts.append(hashlib.sha256(decoded.decode("utf-8", "replace").encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
