"""Tokens, packing, licences, web archives."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.llm import bpe, licences, packing, warc
from threadloom.llm.queries import tokenizer_file

BYTE, WORD = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {v: Tokenizer.from_file(v) for v in (BYTE, WORD)}


def ids(vocabulary, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in bpe.encoder(vocabulary).rows(pa.array(texts, pa.string()))]


ODD = ["", " ", "  a  b", "x's y'll z're 's 'st  's\n's \t's", "don't!'s", "trail  ", "\n\n a", "12 3 456a", "é’s ñ'm", "İstanbul Σας", "ﬁ Ⅷ é", "中文字 한국어", "😀😀 x", "<|endoftext|>", "a<|endoftext|> b<|startoftext|>", " 　 x", "\x85\x1c", "'S 'LL", "a" * 3000, "'", "''s"]


@pytest.mark.parametrize("vocabulary", [BYTE, WORD])
def test_ids_are_the_library_s(library, vocabulary):
    t = library[vocabulary]
    assert ids(vocabulary, ODD) == [x.ids for x in t.encode_batch(ODD, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(list("ab'srelv  \n\t12!?é"))), max_size=40), max_size=4))
def test_ids_of_any_text(library, texts):
    for v in (BYTE, WORD):
        assert ids(v, texts) == [x.ids for x in library[v].encode_batch(texts, add_special_tokens=False)]


def test_decode(library):
    t = library[BYTE]
    e = bpe.encoder(BYTE)
    rng = random.Random(1)
    for _ in range(200):
        some = [rng.randrange(50_257) for _ in range(rng.randrange(9))]
        assert e.decode(some) == t.decode(some, skip_special_tokens=False)


def test_digests(frame, library):
    rows = [(i, x) for i, x in enumerate(ODD)] + [(90, None), (None, "x"), (3, "again"), (91, "long text " * 9000)]
    got = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(frame(rows), BYTE).collect())
    want = []
    for _, x in rows:
        e = library[BYTE].encode(x or "", add_special_tokens=False).ids
        want.append((len(e), hashlib.sha256(",".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(library[BYTE].decode(e, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.digests(frame([]), BYTE).count() == 0
    full = {r.doc_id: r for r in bpe.encode(frame([(1, "a b"), (2, None)]), BYTE).collect()}
    assert full[1].decoded == "a b" and full[2].ids == []


def test_packing(frame, library, prose):
    rows = [(i, prose(i, 5 + 37 * i % 900)) for i in range(40)] + [(50, None), (51, ""), (52, prose(3, 6000)), (None, "x"), (1, "again")]
    got = packing.pack(frame(rows), WORD, max_len=512).collect()
    want = []
    for i, x in rows:
        e = library[WORD].encode(x or "", add_special_tokens=False).ids + [0]
        want += [(i, k, a, len(e[a : a + 512]), zlib.crc32(np.array(e[a : a + 512], "<u4").tobytes())) for k, a in enumerate(range(0, len(e), 512))]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 512
    assert len(bins) <= 1.02 * -(-sum(r.length for r in got) // 512) + 1
    assert packing.pack(frame([]), WORD).count() == 0


def test_rule_of_sum_of_squares():
    """Each placement is the best by the definition, tried out."""
    rng = np.random.default_rng(5)
    for _ in range(20):
        lengths, cap = rng.integers(1, 21, 30), 20
        bins, offsets = packing.sum_of_squares(lengths, cap)
        least = -(-int(lengths.sum()) // cap)
        gaps: dict[int, int] = {}

        def squares(g):
            n = np.bincount([x for x in g.values() if x], minlength=cap + 1)
            return int((n * n).sum())

        for s, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist()):
            fits = [k for k, g in gaps.items() if g >= s]
            scores = {k: squares(gaps | {k: gaps[k] - s}) for k in fits}
            fresh = squares(gaps | {-1: cap - s})
            assert cap - gaps.get(b, cap) == o
            if b in gaps:
                assert scores[b] == min(scores.values()) and (len(gaps) >= least or scores[b] <= fresh)
            else:
                assert not fits or len(gaps) < least and fresh < min(scores.values())
            gaps[b] = gaps.get(b, cap) - s


def brute_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, names = [], set()
    for p, name in licences.BASE.items():
        q = p.split()
        for i in range(len(w) - len(q) + 1):
            if w[i : i + len(q)] == q:
                places.append(i)
                names.add(name)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(names))


LICENCES = [
    ("All rights reserved. ALL RIGHTS RESERVED", "reserved"), ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"), ("This is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"), ("Licensed under the Apache License 2.0", "apache-2.0"),
    ("Licensed under the Apache License, Version 2.0 now", "apache-2.0"), ("Licensed under some Apache License, Version 2.0", ""), ("Released under the MIT License.", "mit"), ("under the mit license", "mit"), ("licensed under the apache license version 3", ""),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and its files, to deal in the Software without restriction", "mit"), (None, ""), ("", ""), ("cc byé general public", ""), ("cc", ""), ("x " * 40_000 + "cc by", "cc-by"),
]


def test_licences(frame):
    got = {r.doc_id: r for r in licences.scan(frame([(i, t) for i, (t, _) in enumerate(LICENCES)])).collect()}
    for i, (t, labels) in enumerate(LICENCES):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(t), t
        assert r.labels == labels and 0 <= r.score <= 1, t
    assert licences.scan(frame([])).count() == 0


def as_pattern(template):
    """A template as a regular expression over words that end in a space each."""
    out = ""
    for k, piece in enumerate(re.split(r"<<(.*?)>>", template)):
        if k % 2 == 0:
            out += "".join(re.escape(w) + " " for w in licences.words_of(piece))
        elif piece.startswith("var"):
            out += "(?:[^ ]+ ){0,%s}" % re.search(r"max=(\d+)", piece)[1]
        else:
            out += "(?:" if piece == "beginOptional" else ")?"
    return re.compile(out)


def instance(template, r):
    """A text that the template accepts."""
    out, skipped = [], 0
    for k, piece in enumerate(re.split(r"<<(.*?)>>", template)):
        if k % 2 == 0:
            out += [] if skipped else [r.choice([w, w.upper(), w + ","]) for w in licences.words_of(piece)]
        elif piece.startswith("var"):
            out += [r.choice(["the", "authors", "software"]) for _ in range(r.randrange(7))]
        elif piece == "beginOptional":
            skipped += 1 if skipped or r.random() < 0.5 else 0
        else:
            skipped -= 1 if skipped else 0
    return " ".join(out)


def test_templates_against_patterns(frame, prose):
    """Every accepted place of every template, in instances, instances with an edit, and two of them in a row."""
    r = random.Random(11)
    texts = [prose(1), "", None]
    for _, template in licences.TEMPLATES:
        whole = instance(template, r)
        w = instance(template, r).split()
        edited = list(w)
        edited[r.randrange(len(w))] = "edited"
        texts += [f"Some text. {whole}. More text.", " ".join(edited), whole + " " + " ".join(w), " ".join(w[:-1]), " ".join(w) * 2]
    texts.append(" ".join(instance(t, r) + " " + prose(3, 2000) for _, t in licences.TEMPLATES))
    got = {x.doc_id: x for x in licences.scan(frame(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        words = licences.words_of(text or "")
        line, at = "".join(w + " " for w in words), np.cumsum([0, *(len(w) + 1 for w in words)]).tolist()
        want = []
        for label, template in licences.TEMPLATES:
            pattern = as_pattern(template)
            for k in range(len(words)):
                ends = [j for j in range(k + 1, len(words) + 1) if pattern.fullmatch(line, at[k], at[j])] if pattern.match(line, at[k]) else []
                if ends:
                    want.append((label, k, ends[-1]))
        assert sorted((p.label, p.first, p.end) for p in got[i].places) == sorted(want)
        assert set(got[i].labels.split(",")) - {""} == {x[0] for x in want} | (set(got[i].base_labels.split(",")) - {""})


def test_licences_of_repeated_rows(frame):
    rows = [(None, "Licensed under CC BY 4.0"), (1, "cc by"), (1, "cc by"), (2, "x " * 100_000 + "all rights reserved"), (None, None)]
    got = sorted((r.doc_id or 0, r.n_words, r.n_base, r.first_word, r.labels) for r in licences.scan(frame(rows)).collect() if r.n_words)
    assert got == [(0, 6, 1, 2, "cc-by,cc-by-4.0"), (1, 2, 1, 0, "cc-by"), (1, 2, 1, 0, "cc-by"), (2, 100_003, 1, 100_000, "reserved")]


def test_optional_parts_and_variables():
    a = licences.compile_template("x", "one two <<beginOptional>>three <<beginOptional>>four<<endOptional>><<endOptional>> <<var;max=2>> five")
    h = lambda s: [licences.bytes_hash(w) for w in s.split()]
    for s, ok in [("one two five", True), ("one two three five", True), ("one two three four five", True), ("one two a b five", True), ("one two a b c five", False), ("one three five", False), ("one two", False)]:
        assert (a.match(h(s), 0) > 0) == ok, s
    with pytest.raises(ValueError):
        licences.compile_template("x", "a b <<beginOptional>> c")


def test_arc_versions_and_errors():
    r = [warc.ArcRecord("http://a/", "1.2.3.4", "20010203040506", "text/html", {}, b"HTTP/1.0 200 OK\r\n\r\nhi\n"), warc.ArcRecord("http://b/x", "1.2.3.4", "2001", "text/plain", {"Result-code": "404"}, b"")]
    for version in (1, 2):
        data = warc.write_arc(r, version)
        back = list(warc.read_arc(data))
        assert [(x.url, x.date, x.content) for x in back] == [(x.url, x.date, x.content) for x in r]
        with pytest.raises(ValueError):
            list(warc.read_arc(data[:-10] if version == 1 else data.replace(b"http://b/x 1", b"http://b/x1")))
    assert back[1].fields["Result-code"] == "404" and warc.warc_date("2001") == "2001-01-01T00:00:00Z"
    out = list(warc.read_warc(warc.to_warc(back[0]) + warc.to_warc(back[1]) + warc.to_warc(back[0], "<urn:uuid:x>")))
    assert [h["warc-type"] for h, _ in out] == ["response", "resource", "revisit"] and out[2][1] == b"HTTP/1.0 200 OK\r\n\r\n"
    assert out[0][0]["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"hi\n").digest()).decode()


def test_web_round_trip(spark):
    rows = [(5, "http://a/ b", "<p>x</p>"), (3, "http://c/", "<p>x</p>"), (9, None, "<p>x</p>"), (1, "u", None), (2, "u", ""), (4, "u", "é\r\n\r\nWARC/1.1\r\n\n"), (6, "u", "z" * 300_000), (None, "n", "<p>x</p>"), (7, "n", "alone"), (4, "u", "é\r\n\r\nWARC/1.1\r\n\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"sha": F.lit("x"), "bytes": F.lit(1)})
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    by: dict = {}
    for i, _, h in rows:
        by.setdefault(h or "", []).append(i)
    first = {h: min((i for i in v if i is not None), default=None) for h, v in by.items()}
    want = sorted(((str(i), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if i == first[h or ""] else "revisit", None if i == first[h or ""] else first[h or ""]) for i, _, h in rows), key=str)
    assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want
    assert warc.round_trip(pages, least=10**9).filter("record_type != 'response'").count() == 0
    assert warc.round_trip(pages.limit(0)).count() == 0
