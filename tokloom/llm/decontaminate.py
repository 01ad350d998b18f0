"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every word n-gram of an item is a seed, however rare or common in the corpus, so every run of GRAM unedited words holds one, also beside edited words and where
verbatim copies of the item are in the corpus too. One pass over the corpus finds the seeds in each document
and aligns the item with the passage around them by Smith-Waterman over words (match 2, mismatch and gap -1). The score is divided by that of the item with itself;
a document with a score of at least THRESHOLD has leaked the item, in whole, in part, edited or paraphrased. A passage that holds too few words of the item, in any order, to
score as much is not aligned; this leaves out no leak.

The pass is a map: nothing is shuffled, and only flagged pairs leave it. The benchmark side is broadcast in parts of at most PART_WORDS
words; a larger benchmark is worked off part by part, each with a pass of its own, so what a worker holds does not grow. There is no cap on candidates: seeds are worked off in blocks of SEEDS,
a text longer than a chunk in strips that share more words than an alignment can span, and a passage longer than WIDTH words in strips likewise, so that memory is bounded and no score changes.

Rows: null and empty texts match nothing; items that are null or without a word are left out, and one of fewer than GRAM words is one seed of all its words and is
found only where it stands alone or by its whole run. Repeated rows count each and are flagged alike; items of equal text are reported each. A very long text is read whole. An empty table of documents or items gives no leaks. Extra columns are of no matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokloom.llm import words as W
from tokloom.llm.rows import positional
from tokloom.llm.words import Finder
from tokloom.session import prepare

GRAM, THRESHOLD, PART_WORDS = 3, 0.5, 1 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words around the seeds' diagonal, as a share of the item, that a passage may hold beside the item's length.
MARGIN = 0.5
#: Words of passages, with their padding, that are aligned side by side.
AREA = 1 << 15
#: Words of a passage that are aligned at a time, or WIDE times the item's if that is more; the next strip begins SPAN times the item's before the end, for a match gains 2 and a gap costs 1,
#: so that an alignment of positive score spans at most that.
WIDTH, WIDE, SPAN = 4096, 8, 3
#: Places of seeds that are worked on at a time.
SEEDS = 1 << 19


class Items:
    """The words of a part of the benchmark; item i has those from at[i] to at[i + 1]."""

    def __init__(self, ids: list, texts: list[str]):
        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        w = W.words(raw, np.r_[0, np.cumsum([len(t.encode()) for t in texts])].astype(np.int64))
        has = np.diff(w.at) > 0
        self.ids = [x for x, h in zip(ids, has, strict=True) if h]
        self.words, self.at = w.hash, np.r_[w.at[:-1][has], w.at[-1]]
        # items of fewer words than GRAM are sought by grams of their own length
        size = np.diff(self.at)
        self.lengths = sorted({min(int(n), GRAM) for n in size})
        gram, item, pos = [], [], []
        for n in self.lengths:
            g, first, before = W.ngrams(W.Words(self.words, self.words, self.words, self.at), n, short=False)
            of = np.repeat(np.arange(len(size)), np.diff(before))
            use = np.minimum(size, GRAM)[of] == n
            gram.append(g[use])
            item.append(of[use])
            pos.append((first - self.at[of])[use])
        self.gram, self.item, self.pos = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((gram, np.uint64), (item, np.int64), (pos, np.int64)))
        # of a gram that an item holds at several places, the first and the last
        order = np.lexsort((self.pos, self.item, self.gram))
        self.gram, self.item, self.pos = self.gram[order], self.item[order], self.pos[order]
        new = np.flatnonzero(np.r_[True, (self.gram[1:] != self.gram[:-1]) | (self.item[1:] != self.item[:-1])][: len(order)])
        self.last = np.maximum.reduceat(self.pos, new) if len(new) else self.pos
        self.gram, self.item, self.pos = self.gram[new], self.item[new], self.pos[new]
        self.known, self.kind = np.unique(self.gram, return_inverse=True)


def _grams(w: W.Words, lengths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for n in lengths:
        g, first, _ = W.ngrams(w, n, short=False)
        yield g, first


def align(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman scores of the pairs (a[k], b[k]), all side by side: one vector step for each word of the longest a
    and, for gaps along b, a running maximum."""
    n, la, lb = len(a), max(map(len, a)), max(map(len, b))
    A, B = np.zeros((n, la), np.uint64), np.ones((n, lb), np.uint64)
    va, vb = np.zeros((n, la), bool), np.zeros((n, lb), bool)
    for k in range(n):
        A[k, : len(a[k])], va[k, : len(a[k])] = a[k], True
        B[k, : len(b[k])], vb[k, : len(b[k])] = b[k], True
    best, row = np.zeros(n, np.int32), np.zeros((n, lb + 1), np.int32)
    slope = np.arange(lb + 1, dtype=np.int32) * -GAP
    for j in range(la):
        same = (A[:, j : j + 1] == B) & va[:, j : j + 1] & vb
        new = np.zeros_like(row)
        np.maximum(row[:, :-1] + np.where(same, np.int32(MATCH), np.int32(MISMATCH)), row[:, 1:] + GAP, out=new[:, 1:])
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + slope, axis=1) - slope
        best = np.maximum(best, np.where(va[:, j], row.max(axis=1), 0))
    return best


def _spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, place) of every place of the runs from begin[k] to end[k]."""
    size = end - begin
    return np.repeat(np.arange(len(size)), size), np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)


def _runs(cost: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of at least one that cost ``most`` together, or one that costs more."""
    total, a = np.r_[0, np.cumsum(cost)], 0
    while a < len(cost):
        b = max(a + 1, int(np.searchsorted(total, total[a] + most, "right")) - 1)
        yield slice(a, b)
        a = b


def shared_words(items: Items, item: np.ndarray, w: W.Words, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words of each item that its passage, from begin to end, holds in any place; no alignment matches more."""
    out = np.zeros(len(item), np.int64)
    for part in _runs(np.diff(items.at)[item] + end - begin, AREA * 8):
        (a, i), (b, j) = _spread(items.at[item[part]], items.at[item[part] + 1]), _spread(begin[part], end[part])
        key = lambda word, pair: word + W.mix(pair.astype(np.uint64) + np.uint64(1))
        held = np.isin(key(items.words[i], a), key(w.hash[j], b))
        out[part] = np.bincount(a[held], minlength=len(out[part]))
    return out


def _scores(items: Items, w: W.Words, item: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Score of each item with its passage, from begin to end, over that of the item with itself; 0 where it cannot reach THRESHOLD."""
    size = np.diff(items.at)[item]
    width = np.maximum(WIDTH, WIDE * size)
    strips = np.maximum(1, -(-(end - begin - SPAN * size) // (width - SPAN * size)))
    of, nth = _spread(np.zeros(len(strips), np.int64), strips)
    item, size, width = item[of], size[of], width[of]
    begin = begin[of] + nth * (width - SPAN * size)
    end = np.minimum(begin + width, end[of])
    score = np.zeros(len(of))
    able = np.flatnonzero(end - begin >= THRESHOLD * size)
    able = able[shared_words(items, item[able], w, begin[able], end[able]) >= THRESHOLD * size[able]]
    able = able[np.argsort((end - begin)[able], kind="stable")]
    while len(able):
        # widths are in order: as many as stay below AREA when padded to the last
        few = max(1, int(np.searchsorted((end - begin)[able] * np.arange(1, len(able) + 1), AREA, "right")))
        now, able = able[:few], able[few:]
        a = [items.words[items.at[k] : items.at[k + 1]] for k in item[now]]
        b = [w.hash[x:y] for x, y in zip(begin[now], end[now], strict=True)]
        score[now] = align(a, b) / (MATCH * np.array([len(x) for x in a]))
    return np.maximum.reduceat(score, np.cumsum(strips) - strips) if len(score) else score


def _best(doc: np.ndarray, item: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row, of the highest score, for each document and item."""
    order = np.lexsort((-score, item, doc))
    doc, item, score = doc[order], item[order], score[order]
    first = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])][: len(doc)]
    return doc[first], item[first], score[first]


def matches(items: Items, find: Finder, w: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, score) of the pairs at or above THRESHOLD."""
    where, which = [], []
    for g, first in _grams(w, items.lengths):
        at, i = find(g)
        where.append(first[at])
        which.append(i)
    none = np.zeros(0, np.int64)
    at, i = (np.concatenate(x) if x else none for x in (where, which))
    if not len(at):
        return none, none, np.zeros(0)
    size_of, found = np.diff(items.at), []
    seeds = np.bincount(items.item, np.bincount(i, minlength=len(items.known))[items.kind], len(size_of)).astype(np.int64)
    for block in _runs(seeds, SEEDS):
        entry = np.flatnonzero((items.item >= block.start) & (items.item < block.stop))
        low, high = (np.searchsorted(items.kind[entry], i, side) for side in ("left", "right"))
        of, seed = _spread(low, high)
        seed, place = entry[seed], at[of]
        item, doc = items.item[seed], np.searchsorted(w.at, place, "right") - 1
        size = size_of[item]
        pad = np.ceil(size * MARGIN).astype(np.int64)
        begin = np.maximum(place - items.last[seed] - pad, w.at[doc])
        end = np.minimum(place - items.pos[seed] + size + pad, w.at[doc + 1])
        order = np.lexsort((begin, item, doc))
        doc, item, begin, end = doc[order], item[order], begin[order], end[order]
        # windows of one item that overlap by most are one passage
        new = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (begin[1:] > begin[:-1] + np.ceil(size_of[item[1:]] * MARGIN / 2))][: len(doc)]
        starts = np.flatnonzero(new)
        if not len(starts):
            continue
        end = np.maximum.reduceat(end, starts)
        doc, item, begin = doc[starts], item[starts], begin[starts]
        score = _scores(items, w, item, begin, end)
        ok = score >= THRESHOLD
        found.append((doc[ok], item[ok], score[ok]))
    return _best(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else (none, none, np.zeros(0))


def _matches(items: Items, find: Finder, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of texts; a text longer than a chunk is read in strips that share all words of an alignment and of the windows that lead to it."""
    if len(at) > 2 or len(raw) <= W.CHUNK or not len(items.known):
        return matches(items, find, W.words(raw, at))
    longest = int(np.diff(items.at).max())
    return _best(*(np.concatenate(x) for x in zip(*(matches(items, find, w) for _, _, w in W.strips(raw, 2 * SPAN * longest)), strict=True)))


def parts(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", part_words: int = PART_WORDS) -> Iterator[Items]:
    """The benchmark, read once and in order, in parts of at most about ``part_words`` words."""
    ids, texts, n = [], [], 0
    for r in benchmark.where(F.col(text).isNotNull()).select(item_id, text).orderBy(item_id, text).toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        n += len(r[1]) // 2
        if n >= part_words:
            yield Items(ids, texts)
            ids, texts, n = [], [], 0
    if ids:
        yield Items(ids, texts)


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", part_words: int = PART_WORDS) -> DataFrame:
    """(doc_id, item_id, score) of every document that holds an item of the benchmark."""
    spark = prepare(docs.sparkSession)
    kinds = f"doc_id {dict(docs.dtypes)[doc_id]}, item_id {dict(benchmark.dtypes)['item_id']}, score double"

    def found(items: Items) -> DataFrame:
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shared.value
            find, kind = Finder(items.known), None
            ids = pa.array(items.ids)
            for rows, raw, at in W.slices(batches, 1):
                doc, item, score = _matches(items, find, raw, at)
                kind = rows.column(0).type
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(doc)).cast(kind), ids.take(pa.array(item)), pa.array(np.round(score, 4))], names=["doc_id", "item_id", "score"])

        return docs.select(doc_id, text).mapInArrow(run, kinds)

    all_parts = [found(p) for p in parts(benchmark, part_words=part_words)]
    return reduce(DataFrame.union, all_parts) if all_parts else spark.createDataFrame([], kinds)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", part_words: int = PART_WORDS) -> DataFrame:
    """``docs`` without the documents that hold an item of the benchmark."""
    spark = prepare(docs.sparkSession)
    column, names = docs.columns.index(text), docs.columns
    rows = positional(docs)
    schema = T.StructType(rows.schema.fields)
    for p in parts(benchmark, part_words=part_words):
        shared = spark.sparkContext.broadcast(p)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            find = Finder(items.known)
            for batch, raw, at in W.slices(batches, column):
                keep = np.ones(batch.num_rows, bool)
                keep[_matches(items, find, raw, at)[0]] = False
                yield batch.filter(pa.array(keep))

        rows = rows.mapInArrow(run, schema)
    return rows.toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
