"""Licence scans by template automata (operator 6).

Templates are wording with markup: `<<beginOptional>>` ... `<<endOptional>>`
encloses words that may be left out, and `<<var;max=N>>` stands for up to N
words of any kind.  A template is compiled into an automaton over words, and a
place in a text is accepted when every mandatory word matches exactly.  The
automata run only where the first two words of some template stand, and only
those whose first two words they are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bytes_hash, lower_ascii, prepare, runs, span_hashes, spans, tidied

#: Phrases that any scan reports, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_WARRANTY = """this software is provided by <<var;max=12>> as is and any express or implied warranties including but not limited to the implied
warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var;max=12>> be liable for any direct indirect incidental special exemplary or consequential damages
including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability
whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""
_SOURCE = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
<<beginOptional>>1<<endOptional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
<<beginOptional>>2<<endOptional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
and or other materials provided with the distribution"""
_NAMES = """<<beginOptional>>3<<endOptional>> neither the name of <<var;max=12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"""
_GNU = """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {}
of the license <<beginOptional>>or at your option any later version<<endOptional>> this program is distributed in the hope that it will be useful but without any warranty
without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"""

#: Wording that must match as it stands in the public licences and in the notes by which texts refer to them; fixed values.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license <<beginOptional>>version<<endOptional>> 2.0"),
    ("apache-2.0", """licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at
        <<beginOptional>>http www apache org licenses license 2.0<<endOptional>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
        without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"""),
    ("cc-by-4.0", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> cc by 4.0"),
    ("cc-by-4.0", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> creative commons attribution 4.0 <<beginOptional>>international<<endOptional>> <<beginOptional>>license<<endOptional>>"),
    ("cc-by-nc-4.0", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> cc by nc 4.0"),
    ("cc-by-nc-4.0", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> creative commons attribution noncommercial 4.0 <<beginOptional>>international<<endOptional>> <<beginOptional>>license<<endOptional>>"),
    ("cc-by-sa-4.0", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> cc by sa 4.0"),
    ("cc-by-sa-4.0", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> creative commons attribution sharealike 4.0 <<beginOptional>>international<<endOptional>> <<beginOptional>>license<<endOptional>>"),
    ("gpl-2.0", "licensed under the gnu general public license <<beginOptional>>version<<endOptional>> 2"),
    ("gpl-2.0", _GNU.format(2)),
    ("gpl-3.0", "licensed under the gnu general public license <<beginOptional>>version<<endOptional>> 3"),
    ("gpl-3.0", _GNU.format(3)),
    ("mit", "<<beginOptional>>released<<endOptional>> <<beginOptional>>licensed<<endOptional>> under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software <<var;max=12>> to deal in the software without restriction"),
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software <<beginOptional>>and associated documentation files<<endOptional>> the software
        to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
        and to permit persons to whom the software is furnished to do so subject to the following conditions
        the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the software
        the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
        in no event shall <<var;max=12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software
        or the use or other dealings in the software"""),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<var;max=6>> disclaims all warranties with regard to this software
        including all implied warranties of merchantability and fitness in no event shall <<var;max=6>> be liable for any special direct indirect or consequential damages or any damages whatsoever
        resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"""),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-2-clause", f"{_SOURCE} {_WARRANTY}"),
    ("bsd-3-clause", f"{_SOURCE} {_NAMES} {_WARRANTY}"),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
        permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions
        <<beginOptional>>1<<endOptional>> the origin of this software must not be misrepresented you must not claim that you wrote the original software
        if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required
        <<beginOptional>>2<<endOptional>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software
        <<beginOptional>>3<<endOptional>> this notice may not be removed or altered from any source distribution"""),
    ("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software
        either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"""),
]
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 256)]] = True
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARKUP = re.compile(r"<<(.*?)>>", re.S)


def words_of(text: str) -> list[str]:
    return _WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


@dataclass
class Automaton:
    """States are numbers; moves[s] are (word hash, or None for any word, next state), skips[s] states reached without a word."""

    label: str
    moves: list[list[tuple[int | None, int]]]
    skips: list[list[int]]

    def closure(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for t in self.skips[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def match(self, words: list[int], at: int) -> int:
        """Where the longest accepted run of words from `at` ends, or -1."""
        final, end = len(self.moves) - 1, -1
        states = self.closure({0})
        for i in range(at, len(words) + 1):
            if final in states:
                end = i
            if i == len(words):
                break
            states = self.closure({t for s in states for w, t in self.moves[s] if w is None or w == words[i]})
            if not states:
                break
        return end

    def starts(self) -> tuple[set[int], set[int]]:
        """Possible first and second words; a start with any word is not allowed."""
        first, second = set(), set()
        for s in self.closure({0}):
            for w, t in self.moves[s]:
                first.add(w)
                second |= {v for u in self.closure({t}) for v, _ in self.moves[u]}
        if None in first | second or not second:
            raise ValueError(f"template of {self.label} must begin with two words")
        return first, second


def compile_template(label: str, template: str) -> Automaton:
    moves: list[list] = [[]]
    skips: list[list] = [[]]
    opened: list[int] = []

    def state() -> int:
        moves.append([])
        skips.append([])
        return len(moves) - 1

    for k, piece in enumerate(_MARKUP.split(template)):
        last = len(moves) - 1
        if k % 2 == 0:
            for w in words_of(piece):
                new = state()
                moves[new - 1].append((bytes_hash(w), new))
        elif piece.startswith("beginOptional"):
            skips[last].append(state())
            opened.append(last)
        elif piece.startswith("endOptional"):
            new = state()
            skips[last].append(new)
            skips[opened.pop()].append(new)
        elif piece.startswith("var"):
            most = re.search(r"max=(\d+)", piece)
            chain = [state() for _ in range(int(most[1]) if most else 20)]
            end = state()
            for a, b in zip([last, *chain], [*chain, end]):
                if b != end:
                    moves[a].append((None, b))
                skips[a].append(end)
        else:
            raise ValueError(f"unknown markup in template of {label}: {piece}")
    if opened:
        raise ValueError(f"optional part of {label} has no end")
    return Automaton(label, moves, skips)


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, base: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places per row of `docs`.

    A null text is empty: no words, no labels (empty strings), score 0, no
    places.  The score is the share of the words that a phrase or an accepted
    template covers; places are (label, first word, word after the last) of the
    templates, of each the longest run of words that it accepts at its start.
    Repeated rows and null ids give a row each, an empty table gives none, and
    columns other than id and text are not read.  A text is looked at whole, with
    some 60 bytes of a worker's memory per byte.
    """
    prepare(docs.sparkSession)
    base = BASE if base is None else base
    phrases = [([bytes_hash(w) for w in p.split()], name) for p, name in base.items()]
    automata = [compile_template(*t) for t in (TEMPLATES if templates is None else templates)]
    starts = [a.starts() for a in automata]
    firsts = np.array(sorted({w for f, _ in starts for w in f}), np.uint64)
    seconds = np.array(sorted({w for _, s in starts for w in s}), np.uint64)
    longest = max((len(a.moves) for a in automata), default=1)
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label:string,first:long,end:long>>"

    @tidied
    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for _, _, buf, at in runs(batch.column(1)):
                low = lower_ascii(buf)
                s, e, first = spans(_WORD[low], at)
                h = span_hashes(low, s, e)
                n = np.diff(first)
                end = np.repeat(first[1:], n)  # of each word: where its text's words end
                found: dict[int, list[tuple[int, int, str, bool]]] = {}
                for wanted, name in phrases:
                    k = len(wanted)
                    hit = np.flatnonzero(h[: len(h) - k + 1] == np.uint64(wanted[0])) if len(h) >= k else np.zeros(0, int)
                    for o in range(1, k):
                        hit = hit[h[hit + o] == np.uint64(wanted[o])]
                    hit = hit[hit + k <= end[hit]]
                    for w, r in zip(hit.tolist(), (np.searchsorted(first, hit, "right") - 1).tolist()):
                        found.setdefault(r, []).append((w - int(first[r]), w - int(first[r]) + k, name, True))
                near = np.flatnonzero(np.isin(h[:-1], firsts) & np.isin(h[1:], seconds)) if len(h) > 1 else np.zeros(0, int)
                for w, r in zip(near.tolist(), (np.searchsorted(first, near, "right") - 1).tolist()):
                    a, b = int(first[r]), int(first[r + 1])
                    own = h[w : min(b, w + longest)].tolist()
                    for m, (one, two) in zip(automata, starts):
                        if len(own) > 1 and own[0] in one and own[1] in two and (stop := m.match(own, 0)) > 0:
                            found.setdefault(r, []).append((w - a, w - a + stop, m.label, False))
                for r in range(len(at) - 1):
                    got = found.get(r, [])
                    b = sorted(x for x in got if x[3])
                    t = [x for x in got if not x[3]]
                    covered = {w for x in got for w in range(x[0], x[1])}
                    out.append((int(n[r]), len(b), b[0][0] if b else None, b[-1][0] if b else None, ",".join(sorted({x[2] for x in b})), ",".join(sorted({x[2] for x in got})), len(covered) / n[r] if n[r] else 0.0, [{"label": x[2], "first": x[0], "end": x[1]} for x in sorted(t)]))
            cols = list(zip(*out)) if out else [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)
