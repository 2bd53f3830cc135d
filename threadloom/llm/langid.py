"""Language identification by character models (operator 4).

For every language an interpolated Kneser-Ney model of characters is fitted on a
bounded sample of labelled texts.  All languages share one set of tables: per
order, the 64-bit hashes of the n-grams in ascending order and, beside them, a
matrix of log-probabilities with a column per language, already interpolated.
A character costs one search of the highest order; only what isn't found there
goes on to a lower order with the back-off weights of its context.  The language
of the lowest cross-entropy per character is chosen; a text whose cross-entropy
lies above the calibrated limit of its language is marked as rejected.  The limit
narrows with the square root of the text's length.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, column, prepare, runs, settle, tidied

ORDER = 4
#: Texts and bytes per language that models are fitted on, and as many again to calibrate rejection, about; languages that are learnt, the most frequent ones.
SAMPLE, SAMPLE_BYTES, LANGUAGES = 1500, 4 << 20, 256
#: A text of n letters is rejected when its cross-entropy is above the language's by MARGIN nats and Z / sqrt(n), Z being
#: this quantile of what the calibration texts need beyond half the margin.
QUANTILE, MARGIN = 0.999, 1.2
UNDETERMINED = "und"

_KEYS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], U64)
_POINTS: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _POINTS:
        letter, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                letter[c] = True
                if len(t := s.lower()) == 1:
                    lower[c] = ord(t)
        lower[~letter] = 32
        _POINTS[:] = [letter, lower]
    return _POINTS


def symbols(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters with one space for every run of other characters, ORDER - 1 spaces before each row.

    Returns the symbols, where rows begin, and the rows' counts of letters.
    """
    letter, lower = _tables()
    points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    at = lead[at]
    is_letter = letter[points]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    keep[first] = is_letter[first]
    total = np.concatenate([[0], np.cumsum(keep)])[at]
    letters = np.concatenate([[0], np.cumsum(is_letter)])[at]
    n = len(at) - 1
    out = np.full(total[-1] + n * (ORDER - 1), 32, np.uint32)
    row = np.repeat(np.arange(n), np.diff(total))
    out[np.arange(total[-1]) + (row + 1) * (ORDER - 1)] = lower[points[keep]]
    return out, total + np.arange(n + 1) * (ORDER - 1), np.diff(letters)


def grams(points: np.ndarray, order: int) -> np.ndarray:
    """Hash of the `order` symbols that end at each place; the first order - 1 are meaningless."""
    p = points.astype(U64)
    out = p * _KEYS[0]
    for k in range(1, order):
        out[k:] += p[:-k] * _KEYS[k]
    return out


def hash_rows(chars: np.ndarray) -> np.ndarray:
    """grams() of rows of characters, the last column being where the gram ends."""
    out = np.zeros(len(chars), U64)
    for k in range(chars.shape[1]):
        out += chars[:, chars.shape[1] - 1 - k].astype(U64) * _KEYS[k]
    return out


@dataclass
class Model:
    languages: list[str]
    keys: list[np.ndarray] = field(default_factory=list)  # by order from 1: sorted hashes of n-grams
    logp: list[np.ndarray] = field(default_factory=list)  # a row per n-gram, a column per language
    contexts: list[np.ndarray] = field(default_factory=list)  # by order from 1: sorted hashes of contexts (none at order 1)
    back: list[np.ndarray] = field(default_factory=list)  # log of the back-off weight
    floor: np.ndarray | None = None  # log-probability of an unknown character
    usual: np.ndarray | None = None  # cross-entropy of calibration texts
    needed: np.ndarray | None = None  # what they need beyond it, times the root of their lengths

    def limit(self, best: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The cross-entropy above which texts of that language and length are rejected."""
        if self.usual is None:
            return np.full(len(best), np.inf)
        return self.usual[best] + MARGIN + self.needed[best] / np.sqrt(np.maximum(letters, 1))

    def score(self, points: np.ndarray) -> np.ndarray:
        """Log-probabilities of each symbol, a column per language."""
        return self._score([grams(points, m) for m in range(1, ORDER + 1)], np.arange(len(points)), ORDER)

    def _score(self, hashes: list[np.ndarray], at: np.ndarray, order: int) -> np.ndarray:
        if order == 0:
            return np.broadcast_to(self.floor, (len(at), len(self.languages)))
        keys, want = self.keys[order - 1], hashes[order - 1][at]
        place = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        out = self.logp[order - 1][place]
        missed = np.flatnonzero(keys[place] != want)
        if len(missed):
            lower = self._score(hashes, at[missed], order - 1)
            if order > 1:
                ctx = hashes[order - 2][np.maximum(at[missed] - 1, 0)]
                c = np.minimum(np.searchsorted(self.contexts[order - 1], ctx), len(self.contexts[order - 1]) - 1)
                seen = self.contexts[order - 1][c] == ctx
                lower = lower + np.where(seen[:, None], self.back[order - 1][c], 0)
            out[missed] = lower
        return out


def fit(languages: list[str], chars: np.ndarray, lang: np.ndarray, count: np.ndarray) -> Model:
    """A model from n-grams of the highest order (a row of characters each), their language's number and their count."""
    n = len(languages)
    model = Model(languages)
    levels = []
    value = count.astype(float)
    while True:  # from the highest order down; below it, counts are of distinct left neighbours
        h = hash_rows(chars)
        keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        c = np.zeros((len(keys), n))
        np.add.at(c, (inverse, lang), value)
        levels.append((keys, chars[first], c))
        if chars.shape[1] == 1:
            break
        g, lang = np.nonzero(c)
        chars, value = chars[first][g][:, 1:], np.ones(len(g))
    below = None
    for order, (keys, chars, c) in enumerate(reversed(levels), 1):
        ones, twos = (c == 1).sum(0), (c == 2).sum(0)
        discount = np.clip(ones / np.maximum(ones + 2 * twos, 1), 0.1, 0.95)
        if order == 1:
            total = np.maximum(c.sum(0), 1)
            unknown = 1 / (len(keys) + 1)
            weight = discount * (c > 0).sum(0) / total
            p = np.maximum(c - discount, 0) / total + weight * unknown
            p = np.maximum(p, 1e-9)
            model.floor = np.log(np.maximum(weight * unknown, 1e-9)).astype(np.float32)
            model.contexts.append(np.zeros(0, U64))
            model.back.append(np.zeros((0, n), np.float32))
        else:
            contexts, inverse = np.unique(hash_rows(chars[:, :-1]), return_inverse=True)
            total, kinds = np.zeros((len(contexts), n)), np.zeros((len(contexts), n))
            np.add.at(total, inverse, c)
            np.add.at(kinds, inverse, c > 0)
            back = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1)
            lower = below[1][np.searchsorted(below[0], hash_rows(chars[:, 1:]))]
            p = np.maximum(c - discount, 0) / np.maximum(total, 1)[inverse] + back[inverse] * lower
            model.contexts.append(contexts)
            model.back.append(np.log(back).astype(np.float32))
        below = (keys, p)
        model.keys.append(keys)
        model.logp.append(np.log(p).astype(np.float32))
    return model


def _ngrams(docs: DataFrame) -> DataFrame:
    """lang, hi, lo, n: how often each gram of ORDER characters occurs, from columns text and lang."""

    @tidied
    def run(batches):
        for batch in batches:
            names = batch.column(1).to_pylist()
            for i, j, buf, at in runs(batch.column(0)):
                points, begin, _ = symbols(buf, at)
                p = points.astype(np.int64)
                packed = [np.zeros(len(p), np.int64) for _ in range(2)]
                for k in range(ORDER):  # 21 bits a character, two characters a number
                    packed[k // 2][ORDER - 1 :] = packed[k // 2][ORDER - 1 :] << 21 | p[k : len(p) - ORDER + 1 + k]
                ok = np.ones(len(p), bool)
                for k in range(ORDER - 1):
                    ok[np.minimum(begin[:-1] + k, len(p) - 1)] = False
                row = np.searchsorted(begin, np.flatnonzero(ok), "right") - 1
                frame = pd.DataFrame({"lang": pd.Series(names[i:j], dtype=object).to_numpy()[row], "hi": packed[0][ok], "lo": packed[1][ok]})
                yield pa.RecordBatch.from_pandas(frame.groupby(["lang", "hi", "lo"]).size().rename("n").reset_index(), preserve_index=False)

    return docs.select("text", "lang").mapInArrow(run, "lang string, hi long, lo long, n long").groupBy("lang", "hi", "lo").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from rows of text, lang and doc_id; about 2 * sample texts of each language are read, and 2 * SAMPLE_BYTES bytes.

    Half of them fit the models and half set the limits of rejection.  Rows
    without text or language teach nothing, nor do languages beyond the LANGUAGES
    most frequent ones.
    """
    spark = docs.sparkSession
    docs = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    most = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    part = {r["lang"]: min(1.0, 2 * sample / r["n"], 2 * SAMPLE_BYTES / max(r["bytes"], 1)) for r in most}
    languages = sorted(part)
    if not languages:
        return Model([])
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, part[k])])[F.col("lang")]
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) / 1_000_000
    chosen = docs.filter(draw < share)
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)) == 0
    found = _ngrams(chosen.filter(half)).toPandas()
    if found.empty:
        return Model([])
    number = {k: i for i, k in enumerate(languages)}
    mask = (1 << 21) - 1
    hi, lo = found["hi"].to_numpy(), found["lo"].to_numpy()
    chars = np.stack([hi >> 21, hi & mask, lo >> 21, lo & mask], axis=1).astype(np.uint32)
    model = fit(languages, chars, found["lang"].map(number).to_numpy(), found["n"].to_numpy())
    got = predict(chosen.filter(~half).withColumnRenamed("lang", "truth"), spark.sparkContext.broadcast(model), keep=["truth"])
    got = settle(got.filter((F.col("truth") == F.col("lang_pred")) & (F.col("letters") > 0)).select("truth", "entropy", F.col("letters").cast("double").alias("n")))
    usual = got.groupBy("truth").agg((F.sum(F.col("entropy") * F.col("n")) / F.sum("n")).alias("usual"))
    excess = (F.col("entropy") - F.col("usual") - MARGIN / 2) * F.sqrt("n")
    model.usual, model.needed = np.full(len(languages), np.inf), np.zeros(len(languages))
    for r in got.join(F.broadcast(usual), "truth").groupBy("truth").agg(F.first("usual").alias("usual"), F.percentile(excess, F.lit(QUANTILE)).alias("needed")).collect():
        model.usual[number[r["truth"]]], model.needed[number[r["truth"]]] = r["usual"], max(r["needed"], 0.0)
    return model


def predict(docs: DataFrame, model, keep: list[str] | None = None, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Columns `keep` of `docs` with lang_pred, score, entropy (nats a character), letters and rejected, their names after `prefix`.

    `model` is a broadcast Model.  A null or empty text, or one without a
    letter, is `und` with score 0, null entropy, and rejected.  Where the model
    knows no language, every text is `und`, and those with letters are not
    rejected, as nothing was calibrated.  The score is the share of the chosen
    language in the likelihoods, taken per character and raised to the length of
    up to 50 of them.  A text takes some 60 bytes of a worker's memory per
    character, and 8 more for each language.  An empty table gives no rows.
    """
    keep = ["doc_id"] if keep is None else keep
    prepare(docs.sparkSession)
    inner = [f"__{k}" for k in range(len(keep))]  # names may hold dots, which Python functions over batches don't take
    chosen = docs.select(column(text_col).alias("__text"), *(column(c).alias(k) for c, k in zip(keep, inner)))
    out = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields[1:]), f"{prefix}lang_pred string", f"{prefix}score double", f"{prefix}entropy double", f"{prefix}letters long", f"{prefix}rejected boolean"])
    names = [*inner, *(prefix + c for c in ("lang_pred", "score", "entropy", "letters", "rejected"))]

    @tidied
    def run(batches):
        m = model.value
        for batch in batches:
            parts = []
            for _, _, buf, at in runs(batch.column(0)):
                points, begin, letters = symbols(buf, at)
                n, size = len(at) - 1, np.diff(begin) - (ORDER - 1)
                sums = np.zeros((n, max(1, len(m.languages))))
                if m.languages and len(points):
                    p = m.score(points)
                    for k in range(ORDER - 1):
                        p[begin[:-1] + k] = 0
                    sums = np.add.reduceat(p, begin[:-1], axis=0, dtype=np.float64)
                mean = -sums / np.maximum(size, 1)[:, None]
                best = mean.argmin(1)
                low = mean[np.arange(n), best]
                share = 1 / np.exp(np.maximum(-60, -(mean - low[:, None]) * np.minimum(size, 50)[:, None])).sum(1)
                none = (letters == 0) | (not m.languages)
                rejected = (letters == 0) | ~none & (low > m.limit(best, letters))
                parts.append((none, best, np.where(none, 0, share), low, letters, rejected))
            if not parts:
                continue
            none, best, score, low, letters, rejected = (np.concatenate(x) for x in zip(*parts))
            known = pa.array([*m.languages, UNDETERMINED], pa.string())
            pred = known.take(pa.array(np.where(none, len(m.languages), best)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pred, pa.array(score), pa.array(low, mask=none), pa.array(letters.astype(np.int64)), pa.array(rejected)], names)

    return chosen.mapInArrow(run, out).toDF(*keep, *names[len(keep) :])


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2


def fitted(docs: DataFrame):
    """A broadcast model learnt from rows that aren't held out; its size is bounded by the sample's."""
    prepare(docs.sparkSession)
    model = train(docs.select("doc_id", "text", "lang").filter(F.coalesce(~held_out(F.col("doc_id")), F.lit(True))))
    return docs.sparkSession.sparkContext.broadcast(model)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and entropy, letters and rejected, for every row.

    Learns from rows with a language whose crc32(doc_id) mod 4 isn't 2 (a null
    id counts as not held out).  Repeated rows each give a row; an empty table
    gives none; without any labelled text everything is `und`.  Ties between
    languages go to the first in alphabetical order.
    """
    model = fitted(docs)
    flag = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return predict(docs, model).select("doc_id", flag.alias("held_out"), "lang_pred", "score", "entropy", "letters", "rejected")
