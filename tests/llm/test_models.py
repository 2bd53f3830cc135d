"""Language ID, quality, language-model scores."""

import collections
import math
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.llm import langid, ngram, quality

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SYLLABLES = {"aa": ["ka", "mi", "to", "ru"], "bb": ["schn", "ung", "ein", "ber"], "cc": ["ció", "ña", "que", "do"]}


def text(lang, r, n=40):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def labelled(spark):
    r = random.Random(2)
    rows = [(i, text(lang, r), lang, "s") for i, lang in enumerate(r.choice(sorted(SYLLABLES)) for _ in range(240))]
    rows += [(1000, None, "aa", "s"), (1001, "12 !!", "bb", "s"), (1002, "", None, None), (1003, text("aa", r, 20_000), None, None), (None, text("bb", r), None, None), (5, rows[5][1], rows[5][2], "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("score", F.lit("clash"))


def test_language_id(spark):
    docs = labelled(spark)
    got = langid.identify(docs).collect()
    assert len(got) == docs.count()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    for r in got:
        if r.doc_id in (1000, 1001, 1002):
            assert r.lang_pred == "und" and r.score == 0 and r.rejected
        elif r.doc_id is None:
            assert r.lang_pred == "bb" and not r.held_out
        else:
            assert r.lang_pred == (truth[r.doc_id] or "aa") and 0.9 < r.score <= 1 and not r.rejected
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    foreign = spark.createDataFrame([(1, "xyz wvu zzxx yyww vvxx zyx " * 5, None, None)], "doc_id long, text string, lang string, source string")
    assert langid.predict(foreign, langid.fitted(docs)).first().rejected


def test_language_id_without_labels(spark):
    docs = labelled(spark).withColumn("lang", F.lit(None).cast("string"))
    got = langid.identify(docs).collect()
    assert {r.lang_pred for r in got} == {"und"}
    assert all(r.rejected == (r.letters == 0) for r in got)  # nothing was calibrated
    assert langid.identify(docs.limit(0)).count() == 0


def test_probabilities_add_up_to_one():
    r = random.Random(1)
    seen = collections.Counter()
    for lang, name in enumerate(sorted(SYLLABLES)):
        s = "   " + text(name, r, 300)
        for i in range(len(s) - 3):
            seen[lang, s[i : i + 4]] += 1
    chars = np.array([[ord(c) for c in g] for _, g in seen], np.uint32)
    m = langid.fit(sorted(SYLLABLES), chars, np.array([k for k, _ in seen]), np.array(list(seen.values())))
    alphabet = np.unique(chars)
    for context in ("   ", "kam", "ung", "xyz"):
        rows = np.array([[*map(ord, context), c] for c in alphabet], np.uint32)
        p = np.exp(np.stack([m.score(row)[-1] for row in rows])).sum(0)  # but for unknown characters
        assert (p <= 1.001).all() and (p > 0.9).all()


class KneserNey:
    """Interpolated Kneser-Ney of one language, from the definition; `alphabet` is that of all languages."""

    def __init__(self, grams, alphabet):
        self.count = {langid.ORDER: dict(grams)}
        for m in range(langid.ORDER - 1, 0, -1):
            self.count[m] = collections.Counter(g[1:] for g in self.count[m + 1])
        self.unknown = 1 / (len(alphabet) + 1)
        self.total, self.kinds, self.discount = {}, {}, {}
        for m, count in self.count.items():
            self.total[m], self.kinds[m] = collections.Counter(), collections.Counter()
            for g, c in count.items():
                self.total[m][g[:-1]] += c
                self.kinds[m][g[:-1]] += 1
            ones, twos = (sum(c == k for c in count.values()) for k in (1, 2))
            self.discount[m] = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.95)

    def p(self, gram):
        m, context = len(gram), gram[:-1]
        if not m:
            return self.unknown
        if not self.total[m][context]:
            return self.p(gram[1:])
        d, total = self.discount[m], self.total[m][context]
        return max(self.count[m].get(gram, 0) - d, 0) / total + d * self.kinds[m][context] / total * self.p(gram[1:])


def test_models_are_kneser_ney():
    r = random.Random(3)
    seen = {name: collections.Counter() for name in sorted(SYLLABLES)}
    for name, grams in seen.items():
        s = "   " + text(name, r, 200)
        grams.update(s[i : i + langid.ORDER] for i in range(len(s) - langid.ORDER + 1))
    rows = [(k, g, c) for k, grams in enumerate(seen.values()) for g, c in grams.items()]
    model = langid.fit(list(seen), np.array([[ord(c) for c in g] for _, g, _ in rows], np.uint32), np.array([k for k, _, _ in rows]), np.array([c for _, _, c in rows]))
    alphabet = {c for _, g, _ in rows for c in g}
    truth = [KneserNey(grams, alphabet) for grams in seen.values()]
    for t in (text("aa", r, 20), text("bb", r, 20), "kaxq mi zzzz ung\u4e2d"):
        t = "   " + t
        got = model.score(np.array([ord(c) for c in t], np.uint32))
        for i in range(langid.ORDER - 1, len(t)):
            want = [m.p(t[i - langid.ORDER + 1 : i + 1]) for m in truth]
            assert np.allclose(np.exp(got[i]), np.maximum(want, 1e-9), rtol=1e-3), (t[: i + 1], want)


def test_languages_that_were_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id").filter("held_out and truth is not null and letters > 0").collect()
    assert len(got) > 200 and sum(r.lang_pred == r.truth for r in got) >= 0.99 * len(got)


def shrunk(sites):
    """Strength of a Beta prior by the method of moments, from (n, y, prior) of sites."""
    n = sum(x[0] for x in sites)
    spread = sum(a * (b / a - c) ** 2 for a, b, c in sites) - sum(c * (1 - c) for _, _, c in sites)
    within = sum(a * c * (1 - c) for a, _, c in sites) / n
    return min(max(within / (spread / n) - 1, 1.0), 1000.0) if spread > 0 else 1000.0


def test_posteriors_are_recomputed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    known = {r.doc_id: float(r.quality) for r in labels.collect()}
    got = quality.assess(docs, labels).collect()
    own = [known.get(r.doc_id, r.evidence) for r in got]
    prior = sum(own) / len(own)
    hosts, paths = collections.defaultdict(lambda: [0, 0.0]), collections.defaultdict(lambda: [0, 0.0])
    for r, y in zip(got, own):
        for site in (hosts[r.host], paths[r.host, r.path]):
            site[0] += 1
            site[1] += y
    s = shrunk([(n, y, prior) for n, y in hosts.values()])
    mean = {h: (y + s * prior) / (n + s) for h, (n, y) in hosts.items()}
    t = shrunk([(n, y, mean[h]) for (h, _), (n, y) in paths.items()])
    logit = lambda p: math.log(p / (1 - p))
    for r, y in zip(got, own):
        n, total = paths[r.host, r.path]
        p = (total - y + t * mean[r.host]) / (n - 1 + t)
        assert math.isclose(r.host_posterior, mean[r.host], rel_tol=1e-6) and math.isclose(r.path_posterior, p, rel_tol=1e-6)
        odds = logit(min(max(r.evidence, 1e-7), 1 - 1e-7)) + quality.SITE_WEIGHT * (logit(min(max(p, 1e-3), 1 - 1e-3)) - logit(prior))
        assert math.isclose(r.probability, 1 / (1 + math.exp(-odds)), rel_tol=1e-3)


def test_quality_of_labels_that_were_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.assess(docs, labels.filter("crc32(cast(doc_id as string)) % 2 = 0")).join(labels, "doc_id").filter("crc32(cast(doc_id as string)) % 2 = 1").collect()
    good, bad = ([r.kept for r in got if r.quality == q] for q in (1, 0))
    print("held out: good kept", sum(good), len(good), "bad rejected", len(bad) - sum(bad), len(bad))
    assert sum(good) >= 0.98 * len(good) and len(bad) - sum(bad) >= 0.5 * len(bad)


def test_quality(spark):
    r = random.Random(4)
    good = lambda: ". ".join(text("aa", r, 12).capitalize() for _ in range(6))
    bad = lambda: "!!! ".join(text("aa", r, 12).upper() for _ in range(6))
    rows, labels = [], []
    for i in range(200):
        ok = i % 4 != 0
        rows.append((i, good() if ok else bad(), "aa", f"s{i % 5}"))
        if i % 2 == 0:
            labels.append((i, int(ok), 0))
    rows += [(900, None, None, None), (901, "", "aa", "s0"), (902, good() * 300, "aa", "rare"), (None, good(), "aa", "s1"), (3, rows[3][1], "aa", "s3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"label": F.lit("x"), "odds": F.lit(1)})
    marks = spark.createDataFrame([*labels, (None, 1, 0), (2, None, 0), (0, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality.assess(docs, marks).collect()
    assert len(got) == len(rows)
    wrong = [g.doc_id for g in got if g.doc_id is not None and g.doc_id < 200 and g.kept != (g.doc_id % 4 != 0)]
    assert not wrong
    assert all(0 <= g.path_posterior <= 1 for g in got)
    assert all(g.kept for g in quality.assess(docs, marks.limit(0)).collect())
    assert quality.assess(docs.limit(0), marks).count() == 0


def test_sparse_sites_stay_near_the_prior(spark):
    sites = spark.createDataFrame([(1.0, 1.0, 0.5), (1000.0, 900.0, 0.5), (1000.0, 200.0, 0.5)], "n double, y double, prior double")
    s = quality._shrinkage(sites, "prior")
    assert 1 <= s < 20 and abs((1 + s * 0.5) / (1 + s) - 0.5) < abs((900 + s * 0.5) / (1000 + s) - 0.5)


def brute(rows, mu=ngram.MU):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + ["\n"] for _, t, _ in rows]
    c, b, d = collections.Counter(), collections.Counter(), collections.Counter()
    for (_, _, held), t in zip(rows, tokens):
        if not held:
            c.update(t)
            b.update(zip(["\n", *t], t))
            d.update(zip(["\n", *t], t, t[1:]))
    n, v = sum(c.values()), len(c)

    def p(w):
        return (c[w] + 0.1) / (n + 0.1 * (v + 1))

    def q(u, w):
        return (b[u, w] + mu[0] * p(w)) / (c[u] + mu[0])

    def r(u, v, w):
        return (d[u, v, w] + mu[1] * q(v, w)) / (b[u, v] + mu[1])

    return [(len(t), sum(c[w] > 0 for w in t), n, sum(math.log10(p(w)) for w in t), math.log10(q("\n", t[0])) + sum(math.log10(r(*x)) for x in zip(["\n", *t], t, t[1:]))) for t in tokens]


def test_scores(spark, monkeypatch):
    r = random.Random(6)
    rows = [(i, text("cc", r, r.randrange(60)), i % 5 == 0) for i in range(150)]
    rows += [(200, None, False), (201, "", True), (202, "  A b\tA B ", False), (203, "the the " * 3000, False), (None, "ka", False), (7, rows[7][1], False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").withColumn("score", F.lit("x"))
    for size, dealt in ((ngram.BLOCK, ngram.OWNED), (900, 700)):
        monkeypatch.setattr(ngram, "BLOCK", size)
        monkeypatch.setattr(ngram, "OWNED", dealt)
        monkeypatch.setattr(ngram, "SHARD", dealt)
        got = sorted((g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 6), g.score) for g in ngram.score(df).collect())
        want = sorted((a, b, c, round(d, 6), e) for a, b, c, d, e in brute(rows))
        assert [g[:4] for g in got] == [w[:4] for w in want]
        assert all(abs(g[4] - w[4]) <= g[0] / ngram.STEPS for g, w in zip(got, want))
    assert ngram.score(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 62) - 1), max_size=200))
def test_elias_fano_round_trip(values):
    v = np.sort(np.array(values, np.int64))
    assert (ngram.ef_decode(ngram.ef_encode(v)) == v).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), min_size=1, max_size=300), st.lists(st.integers(0, 1 << 40), max_size=30), st.integers(0, 300), st.integers(0, 300))
def test_elias_fano_search(values, others, start, end):
    v = np.unique(np.array(values, np.int64))
    e = ngram.Sequence(ngram.ef_encode(v))
    assert (e.get(np.arange(len(v))) == v).all()
    start, end = sorted((min(start, len(v)), min(end, len(v))))
    ask = np.concatenate([v, np.array(others, np.int64)])
    got = e.find(np.full(len(ask), start), np.full(len(ask), end), ask)
    known = {int(x): k for k, x in enumerate(v) if start <= k < end}
    assert got.tolist() == [known.get(int(x), -1) for x in ask]


def test_trie_search():
    rng = np.random.default_rng(0)
    words = np.sort(rng.choice(10**6, 50, replace=False))

    def successors(n, most):
        sizes = rng.integers(0, most, n)
        return np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([np.zeros(0, np.int64), *(np.sort(rng.choice(10**5, k, replace=False)) for k in sizes)])

    starts, seconds = successors(50, 30)
    starts2, thirds = successors(len(seconds), 4)
    data = ngram.trie_bytes(words, starts, seconds, starts2, thirds, rng.integers(0, 255, len(seconds)))
    for x, y in zip(ngram.sent(data), (words, starts, seconds, starts2, thirds)):
        assert (x == y).all()
    t = ngram.Trie(data)
    numbers = t.find_words(np.concatenate([words, [3, 10**7]]))
    assert numbers.tolist() == [*range(50), -1, -1]
    of = np.repeat(np.arange(50), np.diff(starts))
    known = {(int(a), int(b)): k for k, (a, b) in enumerate(zip(of, seconds))}
    ask = [*known, *((int(a), int(b)) for a, b in zip(rng.integers(0, 52, 400), rng.integers(0, 10**6, 400)))]
    a, b = np.array(ask).T
    found = t.find(2, numbers, a, b)
    assert found.tolist() == [known.get(k, -1) for k in ask]
    up = np.repeat(np.arange(len(seconds)), np.diff(starts2))
    known = {(int(a), int(b)): k for k, (a, b) in enumerate(zip(up, thirds))}
    ask = [*known, *((int(a), int(b)) for a, b in zip(rng.integers(0, len(found), 400), rng.integers(0, 10**6, 400)))]
    a, b = np.array(ask).T
    assert t.find(3, found, a, b).tolist() == [known.get((int(found[x]), y), -1) if found[x] >= 0 else -1 for x, y in zip(a.tolist(), b.tolist())]
