import random
import re
import time
from pathlib import Path

import numpy as np
import pytest
from tests.llm.conftest import PROSE, make

from tokloom.llm import decontaminate as D
from tokloom.llm import html, licenses
from tokloom.llm import words as W


def slow_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1, j + 1] = max(0, h[i, j] + (D.MATCH if x == y else D.MISMATCH), h[i, j + 1] + D.GAP, h[i + 1, j] + D.GAP)
    return h.max()


def test_alignment_against_the_plain_recurrence():
    rng = np.random.default_rng(2)
    a = [rng.integers(1, 6, rng.integers(1, 20)).astype(np.uint64) for _ in range(60)]
    b = [rng.integers(1, 6, rng.integers(1, 30)).astype(np.uint64) for _ in range(60)]
    assert D.align(a, b).tolist() == [slow_align(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)]


def hashed(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return W.words(raw, np.array([0, len(raw)])).hash.tolist()


def brute_leaks(docs, items):
    out = set()
    for i, t in docs:
        for k, q in items:
            if t and q and (b := hashed(q)) and slow_align(b, hashed(t)) >= D.THRESHOLD * D.MATCH * len(b):
                out.add((i, k))
    return out


@pytest.mark.parametrize("part_words", [D.PART_WORDS, 60])
def test_leaks_against_brute_force(spark, part_words):
    rng = random.Random(9)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "su", "ta") for b in ("ran", "bel", "dor", "fin", "gus", "hop", "jet")]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, text(rng.randrange(20, 40))) for k in range(12)]
    docs = []
    for d in range(60):
        t = text(rng.randrange(10, 120))
        if d % 3 == 0:
            copy = list(items[d % 12][1])
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if d % 2:
                del copy[rng.randrange(len(copy))]
            t[5:5] = copy
        docs.append((d, " ".join(t)))
    items = [(k, " ".join(q).capitalize() + ".") for k, q in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in D.leaks(make(spark, docs), bench, part_words=part_words).collect()}
    true = brute_leaks(docs, items)
    assert found <= true and len(found) >= 0.9 * len(true) and len(true) >= 20
    kept = {r["doc_id"] for r in D.remove_leaks(make(spark, docs, extra=True), bench, part_words=part_words).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in found}


def test_leaks_of_odd_rows(spark, odd, odd_rows, empty):
    bench = spark.createDataFrame([(1, PROSE), (2, None), (3, ""), (4, PROSE), (None, "another text"), (6, "..."), (7, "x")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in D.leaks(odd, bench).collect()}
    whole = {i for i, t in odd_rows if t and ("quick" in t or "slow" in t)}
    assert found == {(i, k) for i in whole for k in (1, 4)} | {(17, None), (8, 7), (9, 7)}
    out = D.remove_leaks(odd, bench)
    assert out.columns == odd.columns and {r["doc_id"] for r in out.collect()} == {i for i, _ in odd_rows} - {1, 2, 13, 8, 9}.union({i for i in whole if i is not None}) - {None} | {None}
    assert D.leaks(empty, bench).count() == 0 and D.remove_leaks(empty, bench).count() == 0
    none = bench.limit(0)
    assert D.leaks(odd, none).count() == 0 and D.remove_leaks(odd, none).count() == len(odd_rows)


@pytest.mark.parametrize("verbatim", [False, True])
@pytest.mark.parametrize("every", [4, 5, 6])
def test_leaks_with_an_edit_in_every_few_words(spark, every, verbatim):
    items = [(k, [f"i{k}w{j}" for j in range(24 + k)]) for k in range(6)]
    edited = [(k, " ".join(["before", *(f"new{j}" if j % every == every - 1 else x for j, x in enumerate(q)), "after"])) for k, q in items]
    texts = [(k, " ".join(q)) for k, q in items]
    docs = edited + ([(100 + k, t) for k, t in texts] if verbatim else [])
    true = brute_leaks(docs, texts)
    assert {(k, k) for k, _ in items} <= true
    assert {(r["doc_id"], r["item_id"]) for r in D.leaks(make(spark, docs), spark.createDataFrame(texts, "item_id long, text string")).collect()} == true


def test_passages_left_out_cannot_reach_the_threshold():
    rng = np.random.default_rng(4)
    size = rng.integers(3, 20, 40)
    items = D.Items(list(range(40)), [" ".join(f"w{x}" for x in rng.integers(0, 30, n)) for n in size])
    raw = np.frombuffer(" ".join(f"w{x}" for x in rng.integers(0, 30, 3000)).encode(), np.uint8)
    w = W.words(raw, np.array([0, len(raw)]))
    item, begin = rng.integers(0, 40, 2500), rng.integers(0, 2900, 2500)
    end = begin + rng.integers(1, 60, 2500)
    shared = D.shared_words(items, item, w, begin, end)
    for k in range(0, 2500, 9):
        a, b = items.words[items.at[item[k]] : items.at[item[k] + 1]].tolist(), w.hash[begin[k] : end[k]].tolist()
        assert shared[k] == sum(x in b for x in a) and slow_align(a, b) <= D.MATCH * shared[k]


def test_leaks_of_long_and_repetitive_texts(spark, monkeypatch):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(8, 30)))) for k in range(8)] + [(8, "a b c a b c d e f a b c"), (9, "a a a a a a")]
    docs = [(0, "a b c " * 900), (1, "a " * 3000), (2, " ".join(rng.choice(vocabulary) for _ in range(1500)))]
    for k, q in items[:8]:
        w = q.split()
        w[len(w) // 2] = "edited"
        t = [rng.choice(vocabulary) for _ in range(700)]
        t[350:350] = w
        docs.append((10 + k, " ".join(t)))
    true = brute_leaks(docs, items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, D.leaks(make(spark, docs), bench).collect()))
    assert {(d, k) for d, k, _ in whole} <= true and {(10 + k, k) for k in range(8)} <= {(d, k) for d, k, _ in whole}
    # in strips of texts and of passages, and in blocks of seeds
    items_, find = D.Items(*zip(*items, strict=True)), None
    find = D.Finder(items_.known)

    def direct():
        out = []
        for d, t in docs:
            raw = np.frombuffer(t.encode(), np.uint8)
            _, i, s = D._matches(items_, find, raw, np.array([0, len(raw)]))
            out += [(d, items_.ids[k], round(float(x), 4)) for k, x in zip(i, s, strict=True)]
        return sorted(out)

    assert direct() == whole
    for name, value in (("WIDTH", 40), ("SEEDS", 50)):
        monkeypatch.setattr(D, name, value)
        assert direct() == whole, name
    monkeypatch.setattr(W, "CHUNK", 1500)
    assert direct() == whole


def test_long_texts_cost_no_more_than_their_length():
    items = D.Items([0, 1], ["a b c a b c d e f", "the quick brown fox jumps over"])
    find, began = D.Finder(items.known), time.perf_counter()
    texts = ["a b c " * 200000, *["a b the quick brown"] * 300]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    doc, item, _ = D._matches(items, find, raw, np.r_[0, np.cumsum([len(t) for t in texts])])
    assert (0, 0) in set(zip(doc.tolist(), item.tolist(), strict=True)) and time.perf_counter() - began < 10


def test_leaks_of_the_tables(spark, sf_dir):
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    plain = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    whole = {(d["doc_id"], b["item_id"]) for d in docs.collect() for b in bench.collect() if plain(b["text"]) in plain(d["text"])}
    assert whole <= {(r["doc_id"], r["item_id"]) for r in D.leaks(docs, bench).collect()}


PAGE = """<!DOCTYPE html><html><head><title>No</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a>b">Home</a><li><a href=x>About</a></ul></nav>
<!-- <p>hidden</p> --><article><p>First paragraph, long enough; it has marks, and more of them. Yes, really, a long one.<p>Second paragraph &amp; its text: also long, also marked, and so it counts.</article>
<div class=ad>Buy now</div><footer>&copy; us</footer><style>p{}</style></body></html>"""


def test_content_of_a_page():
    text, paths, nodes, chosen = html.content(PAGE)
    assert text.split("\n") == ["First paragraph, long enough; it has marks, and more of them. Yes, really, a long one.", "Second paragraph & its text: also long, also marked, and so it counts."]
    assert (nodes, chosen) == (6, 2) and paths == 4


@pytest.mark.parametrize(
    "outlier",
    [
        "<p>Short, but <b>{}</b> goes on.",
        "<section><div>{}</div></section>",
    ],
)
def test_one_long_path_does_not_drop_the_paragraphs(outlier):
    ordinary = [f"Paragraph {k} has some words, and a few marks; it is an ordinary one." for k in range(30)]
    long = "words and, more words; " * 80
    page = f"<body><nav><a href=x>Home</a></nav><article><h2>Head</h2>{outlier.format(long)}<h3>Part</h3>{''.join(f'<p>{x}</p>' for x in ordinary)}</article><div>Buy now</div><footer>Us</footer></body>"
    kept = html.content(page)[0].split("\n")
    assert set(ordinary) <= set(kept) and long.strip() in kept and not {"Home", "Buy now", "Us"} & set(kept)


def test_inline_tags_share_the_lot_of_their_paragraph():
    page = f"<body><nav><ul><li><a>Home</a></ul></nav><article>{'<p>One, two and <b>bold</b> three; four, <i>thin <b>or</b> so</i> and five.' * 9}</article><div><b>Buy</b></div></body>"
    kept = html.content(page)[0].split("\n")
    assert kept.count("bold") == kept.count("or") == kept.count("thin") == 9 and not {"Home", "Buy"} & set(kept)


@pytest.mark.parametrize(
    ("page", "content"),
    [
        ("<head><title>T</title><p>Text, all of it.", "Text, all of it."),
        ("<html><head><meta charset=x><link href=y><title>T</title><style>a, b</style><script>c, d</script>Text, all of it.", "Text, all of it."),
        ("<head><title>T</title><svg><path/></svg><p>Text, all of it.", "Text, all of it."),
        ("<head><title>T</title></head><body><p>Before, <svg class='i' viewBox=\"0 0 9 9\" />after.", "Before,\nafter."),
        ("<p>Before, <svg/>after.", "Before,\nafter."),
        ("<p>Before, <svg><text>no, not this</text></svg>after.", "Before,\nafter."),
    ],
)
def test_pages_that_leave_tags_out(spark, page, content):
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    assert html.extract(df).first()["content"] == content


def slow_closing(html_text):
    """Text nodes and the names of the tags around them, with every closing rule a walk over the open tags."""
    stack, out = [], []

    def close(name):
        while stack and stack.pop() != name:
            pass

    for end, name, text in re.findall(r"<(/?)(\w+)>|([^<]+)", html_text):
        if text:
            out.append("/".join(stack)) if text.strip() else None
            continue
        if end:
            close(name) if name in stack else None
            continue
        if name in html._BLOCK and "p" in stack:
            close("p")
        for other in html._CLOSES.get(name, ()):
            for top in reversed(stack):
                if top == other:
                    close(other)
                    break
                if top in html._SCOPE:
                    break
        stack.append(name)
    return out


def test_tags_close_each_other_as_a_plain_walk_has_it():
    rng = random.Random(4)
    for _ in range(400):
        page = "".join(rng.choice(["<dl>", "<dt>", "<dd>", "<ul>", "<li>", "<p>", "<b>", "</b>", "</dl>", "</ul>", "</li>", "<div>", "</div>", "<table>", "<tr>", "<td>", "</table>", "word, "]) for _ in range(40))
        names = slow_closing(page)
        seen = {}
        assert html.text_nodes(page)[0] == [html.text_nodes(page)[0][k] for k in range(len(names))] and len(html.text_nodes(page)[0]) == len(names)
        for p, n in zip(html.text_nodes(page)[0], names, strict=True):
            assert seen.setdefault(p, n) == n
        assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("page", ["<dl><dd><dl>" + "<b>" * 150000 + "<dt>x" * 120000, "<!" * 500000, "<script>" + "</script" * 130000, "<a b='" * 160000, "<a " * 330000, "&amp" * 250000, "<p>" * 330000])
def test_a_megabyte_of_odd_markup_takes_seconds(page):
    began = time.perf_counter()
    html.content(page)
    assert len(page) > 900000 and time.perf_counter() - began < 6


def slow_ratios(html_text):
    """Paths by joined names with a plain stack; for markup that closes all it opens."""
    stack, seen, out = [], {}, []
    for tag, text in re.findall(r"<(/?\w+)[^>]*>|([^<]+)", html_text):
        if tag.startswith("/"):
            stack.pop()
        elif tag:
            stack.append(tag)
        elif text.strip():
            p = "/".join(stack)
            n, size, marks = seen.get(p, (0, 0, 0))
            seen[p] = (n + 1, size + len(text.strip()), marks + sum(c in ".,;:!?" for c in text))
            out.append((p, text.strip()))
    paths = list(seen)

    def smooth(v):
        k, side, r = len(v), np.exp(-0.5 / html.SIGMA**2), []
        for i in range(k):
            near = [(v[j], 1 if j == i else side) for j in (i - 1, i, i + 1) if 0 <= j < k]
            r.append(sum(a * b for a, b in near) / sum(b for _, b in near))
        return np.array(r)

    fused = smooth([seen[p][1] / seen[p][0] for p in paths]) * smooth([seen[p][2] / seen[p][0] for p in paths])
    good = {p for p, f in zip(paths, fused, strict=True) if f >= html.SHARE * fused.std()}
    return "\n".join(t for p, t in out if p in good)


def test_ratios_against_a_plain_version():
    rng = random.Random(6)

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return " ".join(rng.choice(["word", "and,", "so.", "text"]) for _ in range(rng.randrange(1, 30)))
        tag = rng.choice(["div", "span", "section", "b"])
        return "".join(f"<{tag}>{tree(depth - 1)}</{tag}>" for _ in range(rng.randrange(1, 4)))

    for _ in range(40):
        page = f"<body>x,{tree(4)}</body>"
        assert html.content(page)[0] == slow_ratios(page)


def test_pages_of_odd_rows(spark):
    deep = "<div>" * 20000 + "text, here." + "</div>" * 20000
    pages = [(1, None), (2, ""), (3, "plain, text."), (4, "<p"), (5, "<<<>>> & < b"), (6, deep), (7, "<p>" + "a, " * 300000), (8, "<script>never closed"), (9, PAGE), (9, PAGE), (None, "<b>x</b>")]
    df = spark.createDataFrame([(i, "u", h, 1) for i, h in pages], "page_id long, url string, html string, content int")
    out = html.extract(df).collect()
    assert len(out) == len(pages) and out[8] == out[9] and out[0]["content"] is None and out[1]["n_nodes"] == 0
    assert out[2]["content"] == "plain, text." and out[5]["content"] == "text, here." and len(out[6]["content"]) > 899990 and out[7]["content"] is None and out[10]["content"] == "x"
    assert html.extract(df.limit(0)).count() == 0


def test_automaton_accepts_exactly_the_template():
    a = licenses.compile_template("t", 'The <<beginOptional>>very <<beginOptional>>most <<endOptional>><<endOptional>>free <<var;name="x";match="[0-9.]+{1,2}">> license<<beginOptional>> text<<endOptional>>')
    yes = {"the free 1 license": 4, "The very free 1.0 LICENSE text": 7, "the very most free 2 license": 6, "the free 1 license granted": 4}
    no = ["the most free 1 license", "the free license", "the free one license", "the free 1 2 3 license", "the free 1 big license", "free 1 license"]
    for t, n in yes.items():
        assert a.find(licenses.tokens(t)) == (0, n), t
    for t in no:
        assert a.find(licenses.tokens(t)) is None, t
    assert a.find(licenses.tokens("so the the free 7 license")) == (2, 4) and (a.anchor, a.least, a.most) == (("the",), 0, 0)


def test_automata_against_regular_expressions():
    rng = random.Random(8)
    for name, template in licenses.TEMPLATES.items():
        a = licenses.compile_template(name, template)
        r = re.compile(a.regex + "(?= )")
        base = licenses.tokens(re.sub(r"<<(begin|end)Optional>>", " ", re.sub(r"<<var.*?>>", "someone", template)))
        for _ in range(60):
            t = ["before"] * rng.randrange(3) + [w for w in base if rng.random() > 0.01] + ["after"]
            m, hit = r.search("".join(f" {w}" for w in t) + " "), a.find(t)
            assert (m is None) == (hit is None)
            if m:
                assert m.string[: m.start()].count(" ") == hit[0]


def test_licenses_of_odd_rows(spark, odd, empty):
    assert licenses.scan(odd).count() == 0 and licenses.scan(empty).count() == 0
    docs = make(spark, [(1, "x " * 200000 + "Licensed under the\nAPACHE License, Version 2.0"), (1, "Released under the MIT license."), (None, "released under the mit license"), (2, "licensed under the Apache license, version 2"), (3, None)], extra=True)
    found = sorted(((r["doc_id"], r["license_id"], r["first_word"]) for r in licenses.scan(docs).collect()), key=str)
    assert found == [(1, "Apache-2.0-notice", 200000), (1, "MIT-notice", 0), (None, "MIT-notice", 0)]


BSD = """Copyright (c) 2013, Some One. All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT OWNER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC = """Copyright (c) 2020 Some One. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
GNU = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."


def test_common_licenses_are_found(spark):
    texts = {
        "BSD-2-Clause": BSD.format(""),
        "BSD-3-Clause": BSD.format("3. Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "),
        "GPL-2.0-header": GNU.format("program", "", 2), "GPL-3.0-header": GNU.format("program", "", 3), "LGPL-2.1-header": GNU.format("library", "Lesser ", "2.1"), "LGPL-3.0-header": GNU.format("library", "Lesser ", 3), "AGPL-3.0-header": GNU.format("program", "Affero ", 3),
        "GPL-2.0-notice": "Licensed under the GNU General Public License version 2.", "AGPL-3.0-notice": "licensed under the GNU Affero General Public License, v3".replace("v3", "version 3"),
        "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy", "CC0-1.0-notice": "Dedicated under CC0 1.0 Universal.", "ISC": ISC,
        "CC-BY-4.0-notice": "Licensed under CC BY 4.0.", "CC-BY-SA-3.0-notice": "licensed under a Creative Commons CC BY-SA 3.0 license", "CC-BY-SA-4.0": "under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "Unlicense": licenses.MORE["Unlicense"] + ". For more information, please refer to <http://unlicense.org/>",
        "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    }
    for name, file in (("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3.0", "LGPL-3"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"), ("BSD-3-Clause", "BSD")):
        if (path := Path("/usr/share/common-licenses") / file).exists():
            texts[f"{name} in full"] = path.read_text()
    names = list(texts)
    docs = make(spark, [(k, f"before. {texts[n]} after.") for k, n in enumerate(names)])
    found = {(names[r["doc_id"]], r["license_id"]) for r in licenses.scan(docs).collect()}
    assert {(n, n.removesuffix(" in full")) for n in names} <= found
    assert all(n == x for n, x in found if not n.endswith(" in full"))
    # an altered or missing word anywhere in the mandatory wording, and an ending of another kind
    rng, altered = random.Random(3), []
    for n in names:
        if n.removesuffix(" in full") in ("BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense", "Apache-2.0", "GPL-3.0", "LGPL-3.0"):
            words = texts[n].split()
            last = len(words) - 30 if "full" not in n else len(words) // 2
            for _ in range(4):
                free = {"copyright", "holders", "owner", "contributors", "regents", "university", "foundation"}  # may stand where wording is replaceable
                k = rng.choice([i for i in range(50, last) if len(words[i]) > 6 and words[i].strip(".,;").lower() not in free])
                altered += [(n, " ".join([*words[:k], "altered", *words[k + 1 :]])), (n, " ".join(words[:k] + words[k + 1 :]))]
    altered.append(("ISC", ISC[: ISC.index(" IN NO EVENT")] + " Commercial use is forbidden."))
    found = {(r["doc_id"], r["license_id"]) for r in licenses.scan(make(spark, [(k, t) for k, (_, t) in enumerate(altered)])).collect()}
    assert not {(k, n.removesuffix(" in full")) for k, (n, _) in enumerate(altered)} & found, [altered[k] for k, n in found if altered[k][0].removesuffix(" in full") == n][:1]


def test_templates_of_a_folder(spark, tmp_path):
    (tmp_path / "own.txt").write_text("my <<beginOptional>>very <<endOptional>>own license")
    docs = make(spark, [(1, "under MY own License."), (2, "my very own licence"), (3, "x, my very own license")])
    own = licenses.load_templates(tmp_path)
    assert sorted(map(tuple, licenses.scan(docs, own).collect())) == [(1, "own", 1), (3, "own", 1)] and "GPL-3.0" in licenses.load_templates()
    with pytest.raises(AssertionError):
        licenses.scan(docs, {"x": "<<beginOptional>>all of it<<endOptional>>"})


def test_licenses_against_the_expressions_of_the_templates(spark, sf_dir):
    """Every document and every template of TEMPLATES, by a plain search."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules = [(n, re.compile(licenses.compile_template(n, t).regex + "(?= )")) for n, t in licenses.TEMPLATES.items()]
    want = set()
    for r in docs.collect():
        plain = "".join(f" {w}" for w in licenses.tokens(r["text"])) + " "
        want |= {(r["doc_id"], n, plain[: m.start()].count(" ")) for n, rule in rules if (m := rule.search(plain))}
    assert {tuple(r) for r in licenses.scan(docs, licenses.TEMPLATES).collect()} == want and want
