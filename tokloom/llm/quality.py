"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters of WIDTH bytes slide over the whole document; their sums are read from one table per byte position,
so a filter over bytes costs WIDTH table rows. Activations are max-pooled over overlapping chunks of CHUNK bytes, each
begun HALF a chunk after the one before (the last may be shorter). A dense layer reads the pooled filters of a chunk and its length; the hidden
units are pooled over chunks, by maximum and mean, and a logistic unit gives one probability that the document is good.
A text of one repeated word excites few filters, a text of shouted words excites others: both show in the pooled vector.

It is fitted on the driver on at most SAMPLE labelled documents, those with the least hash of doc_id, by Adam with
gradients through the pooling; every fifth of them is held out for the threshold. That bound is the parameter
``sample``. Documents are rejected if their probability is under the threshold: the largest value up to MIDDLE that
keeps KEEP of the held-out good documents.

Scoring is a map over the documents, with no shuffle. Rows: null and empty texts have probability null and
are kept; labels that are null, and label rows without a document, are left out of fitting. Where labels hold only one class, or none, every text has
probability 1 and is kept. Repeated rows are scored alike, and in fitting the least text of an id stands; a very long text is read whole, in spans;
an empty table gives an empty result; extra columns are of no matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokloom.llm import words as W
from tokloom.llm.rows import positional
from tokloom.session import prepare

WIDTH, FILTERS, HIDDEN, HALF, CHUNK = 6, 24, 12, 256, 512
SAMPLE, EPOCHS, RATE, BATCH_BYTES = 3000, 6, 0.01, 1 << 17
MIDDLE, KEEP = 0.5, 0.995
#: Bytes whose activations are held at a time.
SPAN = 1 << 13
REAL = np.float32


@dataclass
class Model:
    table: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    dense: np.ndarray  # (FILTERS + 1, HIDDEN)
    dense_bias: np.ndarray  # (HIDDEN,)
    out: np.ndarray  # (2 * HIDDEN + 1,), the last is the bias
    threshold: float = 0.0
    pairs: np.ndarray | None = None  # (WIDTH // 2, 65536, FILTERS): the table by two bytes at a time, for scoring

    def ready(self) -> Model:
        if self.pairs is None:
            self.pairs = (self.table[0::2, None, :, :] + self.table[1::2, :, None, :]).reshape(WIDTH // 2, 65536, FILTERS)
        return self

    def __getstate__(self) -> dict:
        return self.__dict__ | {"pairs": None}

    def parameters(self) -> list[np.ndarray]:
        return [self.table, self.bias, self.dense, self.dense_bias, self.out]


def _blocks(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each run of HALF bytes, runs before each document, bytes of each run); an empty text has none."""
    count = -(-np.diff(at) // HALF)
    before = np.r_[0, np.cumsum(count)]
    start = np.repeat(at[:-1] - before[:-1] * HALF, count) + np.arange(before[-1]) * HALF
    return start, before, np.minimum(HALF, np.repeat(at[1:], count) - start)


def convolve(m: Model, raw: np.ndarray, at: np.ndarray, arg: bool = False):
    """Maxima of the filters in each run of HALF bytes: (runs, FILTERS), and with ``arg`` the byte where each lies.

    Filters that reach over the end of their document see byte 0 there.
    """
    start, before, length = _blocks(raw, at)
    best = np.empty((len(start), FILTERS), REAL)
    where = np.empty((len(start), FILTERS), np.int64) if arg else None
    doc = np.repeat(np.arange(len(at) - 1), np.diff(before))
    step = max(1, SPAN // HALF)
    for low in range(0, len(start), step):
        high = min(low + step, len(start))
        a, b = int(start[low]), int(start[high - 1] + length[high - 1])
        act, row = np.empty((b - a, FILTERS), REAL), np.empty((b - a, FILTERS), REAL)
        seen = np.zeros(b - a + WIDTH, np.uint8)
        seen[: min(len(raw), b + WIDTH) - a] = raw[a : b + WIDTH]
        if m.pairs is None:
            by, table, stride = seen, m.table, 1
        else:  # indexed by a byte and, 256 times, the next
            by, table, stride = seen[:-1] + seen[1:].astype(np.uint16) * 256, m.pairs, 2
        np.take(table[0], by[: b - a], axis=0, out=act, mode="clip")
        for k in range(1, len(table)):
            np.take(table[k], by[k * stride : k * stride + b - a], axis=0, out=row, mode="clip")
            act += row
        first, last = at[doc[low] : doc[high - 1] + 1] - a, at[doc[low] + 1 : doc[high - 1] + 2] - a
        for q in range(1, WIDTH):  # positions q bytes before the end of their document, in this span
            p = (last - q)[last - q >= np.maximum(first, 0)]
            p = p[p < b - a]
            for k in range(q, WIDTH):  # what they see there is byte 0
                act[p] += m.table[k, 0] - m.table[k, seen[p + k]]
        cuts = start[low:high] - a
        np.maximum.reduceat(act, cuts, axis=0, out=best[low:high])
        if arg:
            for i in range(low, high):
                s = int(start[i]) - a
                where[i] = act[s : s + int(length[i])].argmax(axis=0) + start[i]
    return best, where, before, length


def _chunks(before: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chunks are pairs of neighbouring runs, a lone run makes one: (first run, second run, chunks before each document, bytes)."""
    runs = np.diff(before)
    count = np.where(runs > 1, runs - 1, runs)
    cb = np.r_[0, np.cumsum(count)]
    first = np.repeat(before[:-1] - cb[:-1], count) + np.arange(cb[-1])
    second = first + np.repeat((runs > 1).astype(np.int64), count)
    return first, second, cb, np.where(second > first, length[first] + length[second], length[first])


def _forward(m: Model, best: np.ndarray, before: np.ndarray, length: np.ndarray):
    first, second, cb, size = _chunks(before, length)
    takes = best[second] > best[first]
    pooled = np.maximum(np.where(takes, best[second], best[first]) + m.bias, 0)
    x = np.concatenate([pooled, np.log2(size / CHUNK)[:, None].astype(REAL)], axis=1)
    hidden = np.maximum(x @ m.dense + m.dense_bias, 0)
    top = np.maximum.reduceat(hidden, cb[:-1], axis=0)
    count = np.diff(cb)[:, None]
    doc = np.concatenate([top, np.add.reduceat(hidden, cb[:-1], axis=0) / count, np.ones((len(count), 1), REAL)], axis=1)
    return 1 / (1 + np.exp(-np.clip(doc @ m.out, -30, 30))), (first, second, cb, takes, x, hidden, top, count, doc)


def score(m: Model, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Probability of each text; none may be empty."""
    best, _, before, length = convolve(m, raw, at)
    return _forward(m, best, before, length)[0]


def _gradients(m: Model, raw: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    best, where, before, length = convolve(m, raw, at, arg=True)
    p, (first, second, cb, takes, x, hidden, top, count, doc) = _forward(m, best, before, length)
    g = (p - y) * weight
    out = doc.T @ g
    by = np.repeat(np.arange(len(y)), np.diff(cb))
    gh = g[by, None] * m.out[None, HIDDEN : 2 * HIDDEN] / count[by]
    is_top = hidden == top[by]
    gh += np.where(is_top, g[by, None] * m.out[None, :HIDDEN], 0) / np.maximum(1, np.add.reduceat(is_top.astype(REAL), cb[:-1], axis=0))[by]
    gh *= hidden > 0
    dense, dense_bias = x.T @ gh, gh.sum(axis=0)
    gp = (gh @ m.dense[:FILTERS].T) * (x[:, :FILTERS] > 0)
    run = np.where(takes, second[:, None], first[:, None])
    byte = where[run, np.arange(FILTERS)]
    table = np.zeros_like(m.table)
    end = at[1:][by][:, None]
    f = np.broadcast_to(np.arange(FILTERS), byte.shape)
    for k in range(WIDTH):
        inside = byte + k < end
        seen = np.where(inside, raw[np.minimum(byte + k, len(raw) - 1)], 0)
        np.add.at(table[k], (seen, f), gp)
    return [table, gp.sum(axis=0), dense, dense_bias, out]


def initial(seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    return Model(normal(0.4, WIDTH, 256, FILTERS), np.zeros(FILTERS, np.float32), normal(0.2, FILTERS + 1, HIDDEN), np.zeros(HIDDEN, np.float32), normal(0.3, 2 * HIDDEN + 1))


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)


def fit(texts: list[bytes], good: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Model:
    """A model of texts, of which none is empty, and their labels 0 or 1."""
    m, good = initial(seed), np.asarray(good, np.float32)
    held = np.arange(len(texts)) % 5 == 4
    if not 0 < good[~held].sum() < (~held).sum():
        m.out[:] = 0
        m.out[-1] = 30
        return m
    rng, train = np.random.default_rng(seed), np.flatnonzero(~held)
    share = good[train].mean()
    weight = np.where(good == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in m.parameters()]
    step, size = 0, np.array([len(t) for t in texts])
    for epoch in range(epochs):
        order = rng.permutation(train)
        cuts = np.flatnonzero(np.diff(np.cumsum(size[order]) // BATCH_BYTES)) + 1
        for part in np.split(order, cuts):
            step += 1
            raw, at = _joined([texts[i] for i in part])
            rate = RATE * (1 - epoch / epochs)
            for p, g, (a, b) in zip(m.parameters(), _gradients(m, raw, at, good[part], weight[part] / len(part)), moments, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    check = [i for i in np.flatnonzero(held) if good[i] == 1]
    if check:
        m.threshold = float(min(MIDDLE, np.quantile(score(m, *_joined([texts[i] for i in check])), 1 - KEEP)))
    return m


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the labelled documents of least hash, ``sample`` at most."""
    picked = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # of documents that share an id the least text; one row for each id reaches the driver
    rows = docs.where(F.length("text") > 0).select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = rows.toPandas().sort_values("doc_id").sample(frac=1, random_state=3)
    return fit([t.encode() for t in rows["text"]], rows["quality"].to_numpy())


def _probability(m: Model, column: int, keep: list[int]):
    """A mapInArrow function: the columns ``keep`` of the rows and the probability of the text in ``column``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m.ready()
        for rows, raw, at in W.slices(batches, column):
            full, p = np.diff(at) > 0, np.zeros(len(at) - 1)
            if full.any():
                p[full] = np.round(score(m, raw, np.r_[at[:-1][full], at[-1]]).astype(np.float64), 6)
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in keep), pa.array(p, mask=~full)], names=[*(f"c{i}" for i in keep), "p"])

    return run


def classify(docs: DataFrame, m: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, probability, keep) of each document."""
    prepare(docs.sparkSession)
    out = docs.select(doc_id, text).mapInArrow(_probability(m, 1, [0]), f"c0 {dict(docs.dtypes)[doc_id]}, p double").toDF("doc_id", "probability")
    return out.withColumn("keep", F.coalesce(F.col("probability") >= m.threshold, F.lit(True)))


def keep_good(docs: DataFrame, m: Model, text: str = "text") -> DataFrame:
    """``docs`` without the rejected ones."""
    prepare(docs.sparkSession)
    rows = positional(docs)
    run = _probability(m, docs.columns.index(text), list(range(len(docs.columns))))
    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField("p", T.DoubleType())])).where(F.col("p").isNull() | (F.col("p") >= m.threshold)).drop("p").toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
