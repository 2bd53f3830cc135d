"""Quality by hierarchical empirical Bayes (operator 5).

A logistic classifier on features of a document's form gives its own evidence.
Hosts and paths get posteriors by grouped aggregation: a path's mean is shrunk
towards its host's, a host's towards the global prior, each with the strength
that the spread between sites supports (method of moments), so that sites with
few documents stay near their parent.  A document's evidence and its path's
posterior, without the document's own share in it, are added as log-odds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_groups, mix, prepare, runs, settle, span_hashes, spans, tidied

#: Labelled rows that the classifier is fitted on, about; statistics of sites use all rows.
SAMPLE = 20_000
#: A document is kept above this probability, or above the lower one that keeps all but SPARED of the labelled good ones.
THRESHOLD, SPARED = 0.5, 0.002
#: How much of a site's log-odds counts.
SITE_WEIGHT = 0.5
STRENGTH = (1.0, 1000.0)

FEATURES = ["log_words", "word_length", "upper", "symbols", "marks", "digits", "spaces", "distinct", "top_word", "lines", "same_lines", "long_words", "bars"]


def _sums(inside: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(inside)])[at])


def features(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text of a run."""
    n = len(at) - 1
    size = np.maximum(np.diff(at), 1)
    upper = (buf >= 65) & (buf <= 90)
    letter = upper | (buf >= 97) & (buf <= 122) | (buf >= 128)
    digit = (buf >= 48) & (buf <= 57)
    space = np.isin(buf, np.frombuffer(b" \t\r\n\f\v", np.uint8))
    mark = np.isin(buf, np.frombuffer(b".,;:'\"?-", np.uint8))
    symbol = ~(letter | digit | space | mark)
    starts, ends, first = spans(~space, at)
    words = np.maximum(np.diff(first), 1)
    lengths = np.concatenate([[0], np.cumsum(ends - starts)])
    long = np.concatenate([[0], np.cumsum(ends - starts > 30)])

    def repeats(starts, ends, first):
        """Distinct spans of each row, and the largest count of one."""
        row = np.repeat(np.arange(n), np.diff(first))
        key = span_hashes(buf, starts, ends) ^ mix(row + 1)
        _, where, count = np.unique(key, return_index=True, return_counts=True)
        top = np.zeros(n, np.int64)
        np.maximum.at(top, row[where], count)
        return np.bincount(row[where], minlength=n), top

    kinds, top = repeats(starts, ends, first)
    lines = spans(buf != 10, at)
    line_kinds, _ = repeats(*lines)
    n_lines = np.maximum(np.diff(lines[2]), 1)
    return np.stack(
        [
            np.log1p(np.diff(first)), np.diff(lengths[first]) / words, _sums(upper, at) / np.maximum(_sums(letter, at), 1), _sums(symbol, at) / size,
            _sums(mark, at) / words, _sums(digit, at) / size, _sums(space, at) / size, kinds / words / (1 + 1 / np.sqrt(words)), top / words,
            np.log1p(n_lines), 1 - line_kinds / n_lines, np.diff(long[first]) / words, _sums(buf == 124, at) / words,
        ],
        axis=1,
    )


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the intercept

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.clip(np.c_[z, z * z, np.ones(len(z))] @ self.weights, -12, 12)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> Classifier:
    """Logistic regression on features and their squares by Newton's method with a ridge."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    c = Classifier(mean, scale, np.zeros(2 * x.shape[1] + 1))
    z = np.clip((x - mean) / scale, -8, 8)
    z = np.c_[z, z * z, np.ones(len(z))]
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ c.weights, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * c.weights)
        c.weights = c.weights + step
        if np.abs(step).max() < 1e-6:
            break
    return c


def _shrinkage(sites: DataFrame, prior: str) -> float:
    """Strength of a Beta prior around `prior` that the spread of the sites' means n, y supports."""
    r = sites.agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.pow(F.col("y") / F.col("n") - F.col(prior), 2)).alias("spread"),
        F.sum(F.col(prior) * (1 - F.col(prior))).alias("noise"),
        F.sum(F.col("n") * F.col(prior) * (1 - F.col(prior))).alias("within"),
    ).first()
    if not r["n"] or not r["within"]:
        return STRENGTH[1]
    between = max(r["spread"] - r["noise"], 0.0) / r["n"]
    return float(min(max(r["within"] / r["n"] / between - 1 if between else STRENGTH[1], STRENGTH[0]), STRENGTH[1]))


def assess(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """doc_id, host, path, evidence, host_posterior, path_posterior, probability, kept for every row of `docs`.

    `labels` has doc_id and quality (0 or 1); several labels of a document are
    averaged, rows without id or label ignored.  A null host or path is a site
    of its own.  An empty text has the features of no words; without any label,
    or labels of one kind only, evidence is even and everything is kept.
    Repeated rows each give a row.
    """
    spark = docs.sparkSession
    prepare(spark)

    @tidied
    def run(batches):
        for batch in batches:
            x = np.concatenate([np.zeros((0, len(FEATURES))), *(features(buf, at) for _, _, buf, at in runs(batch.column(0)))])
            flat = pa.array(x.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)], ["doc_id", "host", "path", "x"])

    chosen = docs.select(docs["text"], docs["doc_id"].cast("long").alias("doc_id"), docs[host].cast("string").alias("host"), docs[path].cast("string").alias("path"))
    rows = chosen.mapInArrow(run, "doc_id long, host string, path string, x array<double>")
    rows = settle(rows.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.concat_ws("/", F.coalesce("host", F.lit("")), F.coalesce("path", F.lit("")))}))
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("label"))
    rows = settle(rows.join(known, "doc_id", "left"))
    labelled = rows.filter(F.col("label").isNotNull())
    there = labelled.count()
    draw = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1_000_000)) / 1_000_000
    taken = labelled.filter(draw < min(1.0, sample / max(there, 1))).select("x", "label").toPandas()
    y = (taken["label"].to_numpy(float) >= 0.5).astype(float)
    model = None
    if len(set(y.tolist())) == 2:
        model = fit(np.stack(taken["x"].to_numpy()), y)

    @tidied
    def weigh(frames):
        for f in frames:
            odds = model.log_odds(np.stack(f["x"].to_numpy())) if model and len(f) else np.zeros(len(f))
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "host": f["host"], "path": f["path"], "label": f["label"], "odds": odds})

    scored = settle(rows.mapInPandas(weigh, "doc_id long, host string, path string, label double, odds double").withColumn("own", F.coalesce("label", 1 / (1 + F.exp(-F.col("odds"))))))
    total = scored.agg(F.count(F.lit(1)).alias("n"), F.avg("own").alias("m")).first()
    prior = min(max(total["m"] or 0.5, 1e-3), 1 - 1e-3)
    paths = settle(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("own").alias("y")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).withColumn("prior", F.lit(prior))
    s = _shrinkage(hosts, "prior")
    hosts = settle(hosts.withColumn("host_mean", (F.col("y") + s * prior) / (F.col("n") + s)))
    sites = attach_groups(paths, hosts.select("host", "host_mean", F.col("n").alias("host_n")), "host", "host_n", total["n"])
    t = _shrinkage(sites, "host_mean")
    sites = settle(sites.select("path", "host_mean", F.col("n").alias("path_n"), F.col("y").alias("path_y")))
    out = attach_groups(scored, sites, "path", "path_n", total["n"])
    mean = (F.col("path_y") - F.col("own") + t * F.col("host_mean")) / (F.col("path_n") - 1 + t)
    bounded = F.least(F.greatest(mean, F.lit(1e-3)), F.lit(1 - 1e-3))
    shift = F.log(bounded / (1 - bounded)) - float(np.log(prior / (1 - prior)))
    out = settle(out.withColumn("path_posterior", mean).withColumn("probability", 1 / (1 + F.exp(-(F.col("odds") + SITE_WEIGHT * shift)))))
    low = out.filter(F.col("label") >= 0.5).agg(F.percentile_approx("probability", F.lit(SPARED), F.lit(10_000))).first()[0]
    limit = min(THRESHOLD, low if low is not None else 0.0)
    return out.select("doc_id", F.col("host"), F.col("path"), (1 / (1 + F.exp(-F.col("odds")))).alias("evidence"), F.col("host_mean").alias("host_posterior"), "path_posterior", "probability", (F.col("probability") >= (limit if model else -1.0)).alias("kept"))
