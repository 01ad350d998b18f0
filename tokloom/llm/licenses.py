"""License scan by template-markup matching.

A license is a template: text with ``<<beginOptional>>...<<endOptional>>`` around wording that may be absent and
``<<var;name=...;original=...;match=...>>`` where wording may be replaced; ``match`` holds a word pattern and optional bounds, as in
``[0-9.]+{1,3}``, or ``.{0,40}`` for any words. Each is compiled into a token automaton over words (runs of letters and digits, in lower
case, so case, white space and punctuation are free, as license matching guidelines have it). A passage is accepted if its words lead from the start to an accepting state, that is,
if all mandatory wording is there exactly and in order, with nothing in between but what is optional or replaceable.

Every template has an anchor: up to four mandatory words in a row, which stand in a passage at a distance from its begin that the template bounds. Hashes of the words of many documents are looked up among the anchors
at once, and only where an anchor stands are the automata run, from the few words at which the passage may begin. That loses nothing. The whole text is read. It is a map, with no shuffle;
templates are a fixed list of a few hundred kilobytes, broadcast. Full texts are in the folder ``templates``, one to a file; a folder of one's own can be given instead.

Rows: null and empty texts hold no license. The earliest passage of each license is reported. Repeated rows are reported alike. A very long text is read whole, its words as numbers. Extra columns are of no matter; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokloom.llm import words as W
from tokloom.llm.words import Finder
from tokloom.session import prepare

#: Public license notices, by identifier.
TEMPLATES = {
    "Apache-2.0-notice": """<<beginOptional>><<var;name="subject";match=".{1,4}">> is <<endOptional>>Licensed under the Apache License, Version 2.0<<beginOptional>> (the "License");
you may not use this file except in compliance with the License. You may obtain a copy of the License at http<<beginOptional>>s<<endOptional>>://www.apache.org/licenses/LICENSE-2.0<<endOptional>>""",
    "MIT-notice": """Released under the <<var;name="kind";match="[a-z]+{0,1}">> MIT License""",
    "GPL-3.0-notice": """<<beginOptional>>This <<var;name="subject";match="[a-z]+{1,3}">> is <<endOptional>>licensed under the GNU General Public License<<beginOptional>>,<<endOptional>> version 3<<beginOptional>> or
<<beginOptional>>(at your option) <<endOptional>>any later version<<endOptional>>""",
    "CC-BY-NC-4.0-notice": """Licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>Creative Commons <<endOptional>>CC BY-NC 4.0<<beginOptional>> International<<endOptional>><<beginOptional>> License<<endOptional>>""",
    "MIT": """<<beginOptional>>MIT License <<endOptional>><<beginOptional>>Copyright <<beginOptional>>(c) <<endOptional>><<var;name="copyright";match=".{1,40}">> <<endOptional>>
Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name="software";match="[a-z]+{1,6}">> and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph) <<endOptional>>shall
be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name="holders";match=".{1,20}">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE""",
    "ISC": """<<beginOptional>>ISC License <<endOptional>><<beginOptional>>Copyright <<beginOptional>>(c) <<endOptional>><<var;name="copyright";match=".{1,40}">> <<endOptional>>
Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="author";match=".{1,10}">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
<<var;name="author";match=".{1,10}">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE""",
}

_COPIES = 'Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed'
_FSF = f"""Copyright <<beginOptional>>(C) <<endOptional>><<var;name="years";match="[0-9]+{{1,3}}">> Free Software Foundation, Inc<<var;name="address";match=".{{0,20}}">> {_COPIES}"""
_CLAUSES = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<beginOptional>>1. <<endOptional>>Redistributions of
source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2. <<endOptional>>Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. """
_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY <<var;name="by";match=".{1,16}">> AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;name="holders";match=".{1,16}">> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"""
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}


def _gnu(kind: str, version: str) -> dict[str, str]:
    """The notice for source files, and the line 'licensed under', of a GNU license."""
    return {
        "header": f"""is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation,
<<beginOptional>>either <<endOptional>>version {version} of the License""",
        "notice": f"licensed under the GNU {kind}General Public License<<beginOptional>> v<<endOptional>><<beginOptional>> version<<endOptional>> {version}",
    }


#: Further public licenses: full wording, notices, and of long licenses, as -head, the title with the first sentences. The SQL goes over TEMPLATES alone.
MORE = {
    "BSD-2-Clause": _CLAUSES + _DISCLAIMER,
    "BSD-3-Clause": _CLAUSES + """<<beginOptional>>3. <<endOptional>>Neither the name of <<var;name="organization";match=".{1,16}">> nor the names of <<var;name="its";match=".{0,3}">> contributors may be used to endorse or promote products derived from
this software without specific prior written permission. """ + _DISCLAIMER,
    "Apache-2.0-head": """Apache License Version 2.0, January 2004 <<beginOptional>>http<<beginOptional>>s<<endOptional>>://www.apache.org/licenses/ <<endOptional>>TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION""",
    "GPL-2.0-head": f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 {_FSF}",
    "GPL-3.0-head": f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 {_FSF}",
    "LGPL-2.1-head": f"GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 {_FSF}",
    "LGPL-3.0-head": f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 {_FSF}",
    "AGPL-3.0-head": f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 {_FSF}",
    "MPL-2.0-head": """Mozilla Public License Version 2.0 <<beginOptional>>1. <<endOptional>>Definitions <<beginOptional>>1.1. <<endOptional>>"Contributor" means each individual or legal entity""",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0""",
    "CC0-1.0-notice": "CC0 1.0 <<beginOptional>>Universal<<endOptional>>",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE""",
}
for _id, _kind, _version in (("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3")):
    MORE |= {f"{_id}-{k}": t for k, t in _gnu(_kind, _version).items() if f"{_id}-{k}" not in TEMPLATES}
for _id, _kind in _CC.items():
    for _version in ("3.0", "4.0"):
        MORE[f"CC-{_id}-{_version}"] = f"Creative Commons {_kind} {_version}"
        if (_name := f"CC-{_id}-{_version}-notice") not in TEMPLATES:
            MORE[_name] = f"Licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>><<beginOptional>>Creative Commons <<endOptional>>CC {_id} {_version}"

_MARK = re.compile(r"<<beginOptional>>|<<endOptional>>|<<var;(.*?)>>", re.S)
_WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")
_INSIDE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_BOUNDS = re.compile(r"(.*?)\{(\d+),(\d+)\}$")


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class Passages:
    """The words of a batch of lower-case texts; those of text d are from at[d] to at[d + 1]."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray
    hash: np.ndarray

    def __getitem__(self, i: int) -> str:
        return self.raw[self.start[i] : self.end[i]].tobytes().decode()


def passages(column: pa.Array) -> Passages:
    raw, at = W.string_buffers(pc.utf8_lower(column))
    inside = _INSIDE[raw]
    edge = np.ones(len(raw) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[at] = True
    edge = np.flatnonzero(edge)
    run = inside[edge[:-1]]
    start, end = edge[:-1][run], edge[1:][run]
    return Passages(raw, start, end, np.searchsorted(start, at), W.run_hashes(raw, start, end))


@dataclass
class Automaton:
    """States are numbers; state 0 begins. word[s]: {word: next}; free[s]: [(pattern or None for any word, next)]; skip[s]: next states without a word."""

    name: str
    word: list[dict[str, int]] = field(default_factory=lambda: [{}])
    free: list[list[tuple[re.Pattern | None, int]]] = field(default_factory=lambda: [[]])
    skip: list[list[int]] = field(default_factory=lambda: [[]])
    accept: int = 0
    anchor: tuple[str, ...] = ()  # mandatory words in a row
    least: int = 0  # words that may stand in a passage before the anchor
    most: int = 0
    regex: str = ""  # the same language, each word with a blank before it

    def state(self) -> int:
        self.word.append({})
        self.free.append([])
        self.skip.append([])
        return len(self.word) - 1

    def closure(self, states: set[int]) -> set[int]:
        found, todo = set(states), list(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return found

    def at(self, text, i: int, end: int) -> int:
        """Words of the longest passage accepted at word i, and before ``end``; 0 if there is none."""
        now, best = self.closure({0}), 0
        for k in range(i, end):
            w, after = text[k], set()
            for s in now:
                if (n := self.word[s].get(w)) is not None:
                    after.add(n)
                after.update(n for p, n in self.free[s] if p is None or p.fullmatch(w))
            now = self.closure(after)
            if not now:
                break
            if self.accept in now:
                best = k + 1 - i
        return best

    def search(self, text, anchors, begin: int, end: int) -> tuple[int, int] | None:
        """(first word, words) of the earliest passage between two words, of those around the anchors at the given words, in order."""
        tried = begin
        for hit in anchors:
            for i in range(max(tried, hit - self.most), hit - self.least + 1):
                if n := self.at(text, i, end):
                    return i, n
            tried = max(tried, hit - self.least + 1)
        return None

    def find(self, text: list[str]) -> tuple[int, int] | None:
        """The same of a list of words."""
        k = len(self.anchor)
        return self.search(text, [i for i in range(len(text)) if tuple(text[i : i + k]) == self.anchor], 0, len(text))


def compile_template(name: str, template: str) -> Automaton:
    a, at, open_at, depth = Automaton(name), 0, [], 0
    now, regex = 0, []
    low = high = 0  # words that may stand before this place
    rows: list[list[tuple[str, int, int]]] = [[]]  # mandatory words in a row, with these bounds

    def wording(part: str) -> None:
        nonlocal now, low, high
        for w in tokens(part):
            after = a.state()
            a.word[now][w] = after
            now = after
            regex.append(" " + w)
            if not depth:
                rows[-1].append((w, low, high))
                low += 1
            high += 1

    def split() -> None:
        """A fresh state, so that what leaves the old one stays apart."""
        nonlocal now
        after = a.state()
        a.skip[now].append(after)
        now = after

    for m in _MARK.finditer(template):
        wording(template[at : m.start()])
        rows.append([])
        at = m.end()
        if m[0] == "<<beginOptional>>":
            split()
            open_at.append(now)
            depth += 1
            regex.append("(?:")
        elif m[0] == "<<endOptional>>":
            split()
            a.skip[open_at.pop()].append(now)
            depth -= 1
            regex.append(")?")
        else:
            match = re.search(r'match="(.*?)"', m[1], re.S)
            found = _BOUNDS.match(match[1] if match else ".{1,1}")
            kind, few, many = (found[1], int(found[2]), int(found[3])) if found else (match[1], 1, 1)
            low, high = low + few * (not depth), high + many
            pattern = None if kind == "." else re.compile(kind)
            split()
            first = [now]
            for _ in range(many):
                after = a.state()
                a.free[first[-1]].append((pattern, after))
                first.append(after)
            end = a.state()
            for s in first[few:]:
                a.skip[s].append(end)
            now = end
            regex.append("(?: " + ("[^ ]+" if kind == "." else kind) + f"){{{few},{many}}}")
    wording(template[at:])
    grams = [row[i : i + 4] for row in rows for i in range(max(1, len(row) - 3)) if row]
    assert not open_at and grams, f"{name}: unbalanced markup or no mandatory word"
    # as many words as can be, then as near the begin as can be
    best = min(grams, key=lambda g: (-len(g), g[0][2] - g[0][1], g[0][2]))
    a.anchor, a.least, a.most = tuple(w for w, _, _ in best), best[0][1], best[0][2]
    a.accept, a.regex = now, "".join(regex)
    return a


def load_templates(folder: str | Path | None = None) -> dict[str, str]:
    """Template of each license: those of this module and the full texts of the package, or the files <id>.txt of a folder."""
    folder_of = Path(folder) if folder else Path(__file__).with_name("templates")
    files = {f.stem: f.read_text(encoding="utf-8") for f in sorted(folder_of.glob("*.txt"))}
    return files if folder else TEMPLATES | MORE | files


@lru_cache(8)
def _compiled(templates: tuple[tuple[str, str], ...]) -> tuple[list[Automaton], dict[int, tuple[Finder, dict[int, list[Automaton]]]]]:
    """(automata, for each length of an anchor what finds it and whose it is)."""
    automata, by = [compile_template(n, t) for n, t in templates], {}
    for k in sorted({len(a.anchor) for a in automata}):
        own: dict[int, list[Automaton]] = {}
        for a in automata:
            if len(a.anchor) == k:
                w = passages(pa.array([" ".join(a.anchor)]))
                own.setdefault(int(W.ngrams(W.Words(w.hash, w.start, w.end, w.at), k, short=False)[0][0]), []).append(a)
        known = np.sort(np.array(list(own), np.uint64))
        by[k] = Finder(known), {i: own[int(g)] for i, g in enumerate(known)}
    return automata, by


def scan(docs: DataFrame, templates: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license_id, first_word) of every license that a document holds."""
    spark = prepare(docs.sparkSession)
    given = tuple((load_templates() if templates is None else templates).items())
    _compiled(given)  # a wrong template fails here, not in a task
    shared = spark.sparkContext.broadcast(given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, anchors = _compiled(shared.value)
        for b, _, _ in W.slices(batches, 1):
            w = passages(b.column(1))
            row, name, first = [], [], []
            for k, (find, own) in anchors.items():
                grams, word, _ = W.ngrams(W.Words(w.hash, w.start, w.end, w.at), k, short=False)
                at, which = find(grams)
                at = word[at]
                doc = np.searchsorted(w.at, at, "right") - 1
                order = np.lexsort((at, which, doc))
                new = np.flatnonzero(np.r_[True, (np.diff(doc[order]) != 0) | (np.diff(which[order]) != 0)][: len(order)])
                for some in np.split(order, new[1:]) if len(order) else ():
                    d, begin, end = int(doc[some[0]]), int(w.at[doc[some[0]]]), int(w.at[doc[some[0]] + 1])
                    for a in own[int(which[some[0]])]:
                        if hit := a.search(w, at[some].tolist(), begin, end):
                            row.append(d)
                            name.append(a.name)
                            first.append(hit[0] - begin)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(name, pa.string()), pa.array(first, pa.int32())], names=["doc_id", "license_id", "first_word"])

    kind = dict(docs.dtypes)[doc_id]
    return docs.where(F.col(text).isNotNull()).select(doc_id, text).mapInArrow(run, f"doc_id {kind}, license_id string, first_word int")


def _sql() -> str:
    """The same by regular expressions over the words, each with a blank before it."""
    automata = [compile_template(n, t) for n, t in TEMPLATES.items()]
    values = ", ".join(f"('{a.name}', '{a.regex}')" for a in automata)
    return f"""
WITH normal AS (SELECT doc_id, regexp_replace(' ' || regexp_replace(lower(text), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g') || ' ', '  +', ' ', 'g') AS t FROM documents),
     templates(license_id, r) AS (VALUES {values})
SELECT doc_id, license_id, CAST(length(p) - length(replace(p, ' ', '')) AS INTEGER) AS first_word
FROM (SELECT doc_id, license_id, regexp_extract(t, '^(.*?)' || r || ' ', 1, 's') AS p FROM normal, templates WHERE regexp_matches(t, r || ' '))"""


SQL = _sql()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
