"""Main content of web pages by tag-path ratios.

Every text node of a page lies at the end of a root-to-leaf path of tags. For each path, in order of first appearance, the length of its text and its number of punctuation
marks are aggregated and divided by its number of nodes: the text ratio and the punctuation ratio. Both are smoothed over neighbouring paths with a Gaussian
kernel, then fused as a product. Paths whose fused ratio reaches SHARE of the standard deviation of the page's ratios are content; their nodes, in order, are the
page's text, one line each. For the deviation, a ratio above CAP times that of the median character of the page counts as so much, so that one long node on a path of its own does not
lift the threshold over the ordinary paragraphs. Inline tags inside a paragraph, heading, item or cell share its lot: if the path of one is content, all are.

It is a map over pages, with no shuffle. Markup is read by one regular expression; comments, scripts, styles, templates and the head are no content; the head ends, without a tag of its own, at the first text or tag that may not stand in it. Tags close
each other as HTML5 says for paragraphs, items and cells, attribute values may hold brackets, and entities are resolved. Paths are interned and the places of open tags kept by name, so a tag is opened
and closed in the same time at any depth, and a comment or raw text that nothing ends goes to the end of the page: the time grows with the page's length. The whole page is read.

Rows: a null or empty page, or one without text, gives content null and zero counts. Where no node holds punctuation the text ratio decides alone. Repeated rows are extracted alike; a very long page is read whole; an empty table gives an empty result;
extra columns are of no matter.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokloom.session import prepare

SIGMA, SHARE, CAP = 0.5, 0.5, 4.0
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[A-Za-z][^<>]*+>", re.S)
_RAW = {n: re.compile(rf"</{n}\b[^>]*+(?:>|\Z)|\Z", re.I) for n in ("script", "style", "template", "noscript", "textarea", "svg", "iframe")}
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HEAD = frozenset("head base link meta title style script noscript template".split())
_BLOCK = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption summary address".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code dfn del em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
_SCOPE = frozenset("ul ol dl table select body html article section div".split())
_DELETE_PUNCTUATION = {ord(c): None for c in ".,;:!?¿¡…—、。，；：！？"}


def text_nodes(html: str) -> tuple[list[int], list[int], list[str]]:
    """(path number, that of its block, text) of each text node outside the head, in order; paths are numbered by first
    appearance. The block of a path of inline tags in one of _TEXT is the path of that, of others it is the path itself."""
    paths: dict[tuple[int, str], int] = {}
    stack: list[tuple[str, int, int]] = []
    opened: dict[str, list[int]] = defaultdict(list)  # where in the stack the tags of a name are
    scopes: list[int] = [-1]  # and those that an end of an item or cell does not reach over
    at, out_path, out_block, out_text = 0, [], [], []

    def close(name: str) -> None:
        while stack:
            top = stack.pop()[0]
            opened[top].pop()
            if top in _SCOPE:
                scopes.pop()
            if top == name:
                return

    def text(raw: str) -> None:
        if not raw or raw.isspace():
            return
        if stack and stack[-1][0] == "head":
            close("head")
        if not opened["head"]:
            clean = " ".join(unescape(raw).split())
            if clean:
                _, path, block = stack[-1] if stack else ("", 0, 0)
                out_path.append(path)
                out_block.append(block or path)
                out_text.append(clean)

    while m := _MARKUP.search(html, at):
        text(html[at : m.start()])
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if opened[name]:
                close(name)
            continue
        if opened["head"] and name not in _HEAD:
            close("head")
        if name in _RAW and not (name == "svg" and m[3].rstrip().endswith("/")):
            at = _RAW[name].search(html, at).end()
            continue
        if name in _BLOCK and opened["p"]:
            close("p")
        for other in _CLOSES.get(name, ()):
            if opened[other] and opened[other][-1] > scopes[-1]:
                close(other)
        if name not in _VOID and not m[3].rstrip().endswith("/"):
            key = (stack[-1][1] if stack else 0, name)
            path = paths.setdefault(key, len(paths) + 1)
            stack.append((name, path, path if name in _TEXT else stack[-1][2] if stack and name in _INLINE else 0))
            opened[name].append(len(stack) - 1)
            if name in _SCOPE:
                scopes.append(len(stack) - 1)
    text(html[at:])
    return out_path, out_block, out_text


def _smooth(x: np.ndarray) -> np.ndarray:
    side = np.exp(-0.5 / SIGMA**2)
    padded = np.pad(x, 1)
    weight = np.pad(np.ones(len(x)), 1)
    total = padded[1:-1] + side * (padded[:-2] + padded[2:])
    return total / (weight[1:-1] + side * (weight[:-2] + weight[2:]))


def content(html: str) -> tuple[str | None, int, int, int]:
    """(content, paths with text, text nodes, content nodes) of a page."""
    path, block, texts = text_nodes(html)
    if not texts:
        return None, 0, 0, 0
    number: dict[int, int] = {}
    index = np.array([number.setdefault(p, len(number)) for p in path])
    size = np.array([len(t) for t in texts], float)
    marks = np.array([len(t) - len(t.translate(_DELETE_PUNCTUATION)) for t in texts], float)
    nodes, total = np.bincount(index), np.bincount(index, size)
    length, punctuation = _smooth(total / nodes), _smooth(np.bincount(index, marks) / nodes)
    fused = length * punctuation if marks.any() else length
    order = np.argsort(fused)
    weight = np.cumsum(total[order])
    median = fused[order[np.searchsorted(weight, weight[-1] / 2)]]
    good = {b for b, c in zip(block, (fused >= SHARE * np.minimum(fused, CAP * median).std())[index], strict=True) if c}
    chosen = np.array([b in good for b in block])
    return "\n".join(t for t, c in zip(texts, chosen, strict=True) if c), len(number), len(texts), int(chosen.sum())


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [content(h) if h else (None, 0, 0, 0) for h in (x.as_py() for x in b.column(1))]
        text, paths, nodes, chosen = zip(*found, strict=True) if found else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string()), *(pa.array(x, pa.int32()) for x in (paths, nodes, chosen))], names=["page_id", "content", "n_paths", "n_nodes", "n_content_nodes"])


def extract(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, content, n_paths, n_nodes, n_content_nodes) of each page."""
    prepare(pages.sparkSession)
    kind = dict(pages.dtypes)[page_id]
    return pages.select(F.col(page_id).alias("page_id"), F.col(html).alias("html")).mapInArrow(_run, f"page_id {kind}, content string, n_paths int, n_nodes int, n_content_nodes int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
