"""Near duplicates, exact duplicates and fingerprints against brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import exact, fingerprints, neardup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode().lower())
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def links(rows):
    """Pairs of rows whose weighted sets have a Jaccard similarity of 0.8, over all pairs that share a shingle."""
    n, size = len(rows), sum(len((t or "").encode()) for _, t in rows)
    sets = [shingles(t) for _, t in rows]
    df = collections.Counter(k for s in sets for k in s)
    rare = max((n + 1000) / 1000, (size / 2 + n) / 1_000_000)

    def idf(k):
        return 1 - 0.5 * min(1, math.log(df[k] / rare) / math.log(n / rare)) if df[k] > rare else 1.0

    weighted = [{k: (1 + math.log(c)) * idf(k) for k, c in s.items()} for s in sets]
    total = [sum(w.values()) for w in weighted]
    where = collections.defaultdict(list)
    for a, w in enumerate(weighted):
        shared = collections.Counter()
        for k, x in w.items():
            for b in where[k]:
                shared[b] += min(x, weighted[b][k])
            where[k].append(a)
        yield from ((b, a) for b, x in shared.items() if x >= 0.8 * (total[a] + total[b] - x) - 1e-9)
    empty = [a for a, s in enumerate(sets) if not s]
    yield from zip(empty, empty[1:])


def classes(rows):
    root = {k: k for k in range(len(rows))}

    def top(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in links(rows):
        root[top(a)] = top(b)
    groups = collections.defaultdict(list)
    for k in range(len(rows)):
        groups[top(k)].append(k)
    return {tuple(sorted(g)) for g in groups.values()}


def test_near_groups(frame, prose):
    rng = random.Random(3)
    texts = [prose(i) for i in range(12)]
    for i in range(6):
        w = texts[i].split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [texts[0].upper(), texts[1], texts[1], None, "", "!!", "two words", "Two  words.", "x " * 3000]
    rows = list(enumerate(texts)) + [(None, texts[2])]
    got = neardup.near_groups(frame(rows)).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.class_id].append(r)
    want = classes(rows)
    assert sorted(len(v) for v in by.values()) == sorted(map(len, want))
    for members in by.values():
        assert sum(r.kept for r in members) == 1 and all(r.class_size == len(members) for r in members)
        ids = tuple(sorted(rows.index((r.doc_id, texts[r.doc_id])) if r.doc_id is not None else len(texts) for r in members))
        assert ids in want


def test_near_groups_of_a_large_group(frame, prose):
    """Copies of one text, each with edits of its own: many are similar to few others only."""
    rng = random.Random(5)
    base = prose(1, 100).split()
    rows = []
    for i in range(120):
        w = list(base)
        for k in rng.sample(range(len(w)), rng.choice([0, 1, 1, 2, 2])):
            w[k] = f"e{i}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.class_id for r in neardup.near_groups(frame(rows)).collect()}
    members = collections.defaultdict(list)
    for i, c in got.items():
        members[c].append(i)
    assert {tuple(sorted(m)) for m in members.values()} == classes(rows)


def test_near_groups_where_one_group_dominates(frame, prose, monkeypatch):
    """Nine tenths of all rows are one text with a word changed; blocks are small, so that most comparisons cross them."""
    rng = random.Random(8)
    base = prose(1, 100).split()
    rows = []
    for i in range(900):
        w = list(base)
        w[rng.randrange(len(w))] = f"e{i}"
        rows.append((i, " ".join(w)))
    rows += [(i, prose(i, 100)) for i in range(900, 1000)]
    want = classes(rows)
    for block in (neardup.BLOCK, 64):
        monkeypatch.setattr(neardup, "BLOCK", block)
        monkeypatch.setattr(neardup, "PORTION", 8 * block)
        got = {r.doc_id: r.class_id for r in neardup.near_groups(frame(rows)).collect()}
        pairs = list(links(rows))
        assert sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)
        members = collections.defaultdict(list)
        for i, c in got.items():
            members[c].append(i)
        of = {i: set(g) for g in want for i in g}
        assert all(set(m) <= of[m[0]] for m in members.values())  # nothing unlinked is joined
        assert max(map(len, members.values())) >= 0.9 * max(map(len, want))


def test_near_groups_of_a_table(spark):
    """Every link among all pairs of a whole table, and no other class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    members = collections.defaultdict(list)
    place = {i: k for k, (i, _) in enumerate(rows)}
    for r in neardup.near_groups(docs).collect():
        members[r.class_id].append(place[r.doc_id])
    assert {tuple(sorted(m)) for m in members.values()} == classes(rows)


def test_near_groups_of_long_texts(frame, prose):
    t = prose(1, 60_000)
    rows = [(1, t), (2, t + " and more"), (3, prose(2, 60_000)), (4, None)]
    got = {r.doc_id: r.class_id for r in neardup.near_groups(frame(rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_near_groups_keep_a_row_of_each_class(frame, prose):
    """Null and repeated ids that hold unlike texts."""
    near = prose(3).rsplit(" ", 1)[0] + " changed"
    rows = [(None, prose(1)), (None, prose(2)), (None, prose(2)), (3, prose(3)), (5, near), (5, prose(4)), (5, prose(5)), (6, prose(5))]
    got = neardup.near_groups(frame(rows)).collect()
    assert sorted((r.class_id is None, r.class_id or 0, r.class_size, r.doc_id or 0) for r in got if r.kept) == [(False, 3, 2, 3), (False, 5, 1, 5), (False, 5, 2, 5), (True, 0, 1, 0), (True, 0, 2, 0)]


def test_near_groups_of_a_repeated_line(frame, prose):
    """A line repeated in one of two copies: shingles are shared, their frequencies are not."""
    rows = []
    for i in range(40):
        w = prose(i, 300).split()
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:100] + w[100:110] * 40 + w[110:]))]
    got = {r.doc_id: r.class_id for r in neardup.near_groups(frame(rows)).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_near_groups_of_nothing(frame):
    assert neardup.near_groups(frame([])).count() == 0


def test_samples_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    a, b = [], []
    h = neardup.mix(np.arange(300, dtype=np.uint64))
    for _ in range(60):
        h = neardup.mix(h + np.uint64(1))
        w = rng.uniform(0.2, 3, 300)
        at = np.array([0, 200, 400])
        s = neardup.samples(np.concatenate([h[:200], h[100:]]), np.concatenate([w[:200], w[100:]]), at)
        a.append((s[0] == s[1]).mean())
        b.append(w[100:200].sum() / w.sum())
    assert abs(np.mean(a) - np.mean(b)) < 0.03


@pytest.mark.parametrize("owners", [2, 7])
def test_exact_groups(frame, owners, prose, monkeypatch):
    monkeypatch.setattr(exact, "OWNED", 30 // owners)
    a = prose(1)
    rows = [(1, a), (2, a.upper()), (3, "É"), (4, "é"), (5, None), (6, ""), (7, a), (7, a), (8, "b"), (9, "B"), (None, "b"), (None, "alone"), (10, "y" * 50_000)]
    got = exact.exact_groups(frame(rows)).collect()
    assert len(got) == len(rows)
    norm = lambda t: (t or "").translate(LOWER)
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    seen = collections.Counter()
    for r in got:
        ids = sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
        seen[r.text_sha256] += r.kept
    assert set(seen.values()) == {1}
    assert exact.exact_groups(frame([])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 63) - 1), max_size=300))
def test_golomb_round_trip(values):
    v = np.sort(np.array(values, np.uint64))
    assert (exact.ungolomb(exact.golomb(v, 1 << 63)) == v).all()


def gear_chunks(data):
    """Chunks of one text, byte by byte."""
    gear = [int(x) for x in fingerprints._GEAR]
    out, start = [], 0
    while start < len(data):
        end = min(start + fingerprints.MOST, len(data))
        for i in range(start + fingerprints.LEAST, end):
            h = 0
            for b in range(max(0, i - 32), i):
                h = (h << 1) + gear[data[b]] & 0xFFFFFFFF
            bits = fingerprints.HARD if i - start < fingerprints.WANTED else fingerprints.EASY
            if h >> (32 - bits) == 0:
                end = i
                break
        out.append(data[start:end])
        start = end
    return out


def likeness(a, b):
    a, b = (set(gear_chunks(t.encode())) for t in (a, b))
    if not a or not b:
        return float(len(a) == len(b))
    size = lambda s: sum(map(len, s))
    return size(a & b) / min(size(a), size(b))


def test_neighbours(spark, frame, prose, monkeypatch):
    same = prose(4, 400)
    rows = [(10, prose(1, 300)), (9, same), (8, same), (7, None), (6, "é" * 10), (5, ""), (5, "a"), (2, prose(2, 2000)), (None, "null id"), (None, "another"), (None, None)]
    rows += [(4, prose(30 + i, 60)) for i in range(20)] + [(4, prose(30, 60))] * 2 + [(None, prose(60 + i, 60)) for i in range(12)] + [(100 + i, prose(80 + i, 50)) for i in range(30)]
    hashed = spark.createDataFrame([(t or "",) for _, t in rows], "t string").distinct().selectExpr("t", "xxhash64(t) AS h")
    hashes = {r.t: r.h for r in hashed.collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1] or ""], r[1] or ""))
    want = []
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        c = len(t) // 3
        e = t[: len(t) - c] + n[:c]
        want.append((i or -1, len(t), hashlib.sha256(e.encode()).hexdigest(), round(likeness(t, e), 9), round(likeness(t, n), 9)))
    for size in (fingerprints.RANGE_BYTES, 4000, 600):
        monkeypatch.setattr(fingerprints, "RANGE_BYTES", size)
        got = fingerprints.compare_neighbours(frame(rows)).collect()
        assert sorted((r.doc_id or -1, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(want)
        by = {r.doc_id: r for r in got}
        assert by[9].fingerprint == by[8].fingerprint and by[9].near_next == 1.0
    assert fingerprints.compare_neighbours(frame([])).count() == 0


def test_chunks_resist_shifts(prose):
    t = prose(9, 2000)
    entries, at = fingerprints.chunk_sets(*fingerprints.flatten([t, "inserted " + t, ""]))
    a, b, none = np.split(entries, at[1:-1])
    assert fingerprints.containment(a, b) > 0.95 and len(none) == 0
    rows, ends = fingerprints.chunk_ends(*fingerprints.flatten([t]))
    sizes = np.diff(np.concatenate([[0], ends]))
    assert sizes.max() <= fingerprints.MOST and sizes[:-1].min() >= fingerprints.LEAST and ends[-1] == len(t.encode())
    assert (fingerprints.parse(fingerprints.fingerprint(a)) == a).all()
