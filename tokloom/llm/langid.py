"""Language of each word of code-switched text, by a linear-chain conditional random field.

States are the languages of the labelled documents. The score of a word in a state sums hashed features: its prefixes and
suffixes of one to three bytes, its byte bigrams and trigrams with its edges, the word itself, and its membership in a lexicon of each
language (all words that the fitting sample has five times or more, above 0.8 of them in one language). Learned transitions join
neighbouring words. Forward-backward gives each word's posterior; a word gets the state of the greatest one.

It is fitted on the driver by maximum conditional likelihood (Adam) on at most ``sample`` documents with a language, an equal share of each language,
those of least hash of doc_id: all their words in order, and code-switched texts made of all words of two of them by alternating runs.

The chain runs over all words of a chunk of documents at once, in the manner of a two-level scan: transfer matrices
of runs of words, then vectors into each run, then all runs side by side. A document longer than a chunk is read in strips, twice: once for
the transfer matrix of each strip, once for the posteriors between the messages that enter it. That is exact for documents of any length, no text is cut, and memory does not grow with a document but for its labels. Scoring is a map, with no shuffle. A word that has no letter takes the state that the chain gives it.

Rows: a null text, or one without a word, gives n_words 0, a null language and no spans. Repeated rows are labelled alike; an empty table gives an empty result; extra columns are of no
matter. Ties go to the first language in alphabetical order. Without a labelled document there are no states and every language is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokloom.llm import words as W
from tokloom.session import prepare

SLOTS, SAMPLE, EPOCHS, RATE, BATCH_WORDS, SEGMENT = 1 << 15, 1200, 3, 0.05, 20000, 25
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
_SHIFT = np.uint32(32 - 15)


@dataclass
class Model:
    langs: list[str]
    weight: np.ndarray  # (SLOTS, languages)
    step: np.ndarray  # (languages, languages), log
    start: np.ndarray  # (languages,), log
    lexicon: np.ndarray  # sorted word hashes
    owner: np.ndarray  # language of each of them
    boost: np.ndarray  # (languages, languages): owner, state


def features(raw: np.ndarray, at: np.ndarray) -> tuple[W.Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, per byte slots (2, bytes), which bytes are in a word, per word slots (words, 7))."""
    low = W.fold(raw)
    w = W.words(raw, at, low)
    n = len(raw)
    inside = np.zeros(n + 1, np.int8)
    inside[w.start] += 1  # no two words begin or end at one place
    inside[w.end] -= 1
    mask = np.cumsum(inside[:n]).astype(bool)
    b = np.zeros(n + 3, np.uint32)
    b[1 : n + 1] = np.where(mask, low, 0)  # what is not in a word is 0, so n-grams see the edges of words
    two = (b[:-1] + b[1:] * np.uint32(256)) * _A
    three = (b[:-2] + b[1:-1] * np.uint32(256) + b[2:] * np.uint32(65536)) * _B
    grams = np.stack([two[:n], three[:n]]) >> _SHIFT
    slots = np.empty((len(w.hash), 7), np.uint32)
    size = w.end - w.start
    for k in range(1, 4):
        pre, suf = np.full(len(size), 7 * k, np.uint32), np.full(len(size), 7 * k + 3, np.uint32)
        for j in range(k):
            pre = pre * np.uint32(257) + np.where(j < size, b[1 + w.start + np.minimum(j, size - 1)], 0).astype(np.uint32)
            suf = suf * np.uint32(257) + np.where(j < size, b[w.end - np.minimum(j, size - 1)], 0).astype(np.uint32)
        slots[:, 2 * k - 2], slots[:, 2 * k - 1] = pre * _C >> _SHIFT, suf * _C >> _SHIFT
    slots[:, 6] = (w.hash >> np.uint64(49)).astype(np.uint32)
    return w, grams, mask, slots


def emissions(m: Model, raw: np.ndarray, at: np.ndarray) -> tuple[W.Words, np.ndarray]:
    w, grams, mask, slots = features(raw, at)
    score = m.weight.take(slots[:, 0], axis=0)
    for k in range(1, slots.shape[1]):
        score += m.weight.take(slots[:, k], axis=0)
    if len(w.hash):
        each = m.weight.take(grams[0], axis=0)
        each += m.weight.take(grams[1], axis=0)
        each *= mask[:, None]
        # bytes between words add nothing, so sums from start to start are those of the words
        score += np.add.reduceat(each, w.start, axis=0) / (w.end - w.start)[:, None] * 3
        score += _lexicon(m, w)
    return w, score


def _lexicon(m: Model, w: W.Words) -> np.ndarray:
    if not len(m.lexicon):
        return np.zeros((len(w.hash), len(m.langs)), np.float32)
    i = np.minimum(np.searchsorted(m.lexicon, w.hash), len(m.lexicon) - 1)
    return np.where((m.lexicon[i] == w.hash)[:, None], m.boost.take(m.owner.take(i), axis=0), 0)


class _Chain:
    """Words in runs of equal length, side by side, the last one filled up; first marks the first word of each chain."""

    def __init__(self, m: Model, score: np.ndarray, first: np.ndarray):
        self.n, self.L = score.shape
        e = np.exp(score - score.max(axis=1, keepdims=True)).astype(np.float64)
        self.A, self.init = np.exp(m.step).astype(np.float64), np.exp(m.start).astype(np.float64)
        self.T = max(1, int(np.sqrt(self.n) / 3))  # a step over all runs costs more than one between runs
        self.B = -(-self.n // self.T)
        self.real = self.T - (self.B * self.T - self.n)  # words of the last run
        pad = self.T - self.real
        # by place in the run, then by run
        self.E = np.ascontiguousarray(np.concatenate([e, np.ones((pad, self.L))]).reshape(self.B, self.T, self.L).swapaxes(0, 1))
        self.resets = [np.flatnonzero(s) for s in np.concatenate([first, np.zeros(pad, bool)]).reshape(self.B, self.T).T]
        M = np.broadcast_to(np.eye(self.L), (self.B, self.L, self.L))
        for t in range(self.T):
            M = self.into(M, t)
        self.M = M

    def into(self, v: np.ndarray, t: int) -> np.ndarray:
        """One word on: v (B, L) or (B, L, L) are messages before word t of each run."""
        moved = (v.reshape(-1, self.L) @ self.A).reshape(v.shape)
        moved[self.resets[t]] = v[self.resets[t]].sum(axis=-1, keepdims=True) * self.init
        moved *= self.E[t] if v.ndim == 2 else self.E[t][:, None]
        moved /= moved.sum(axis=-1 if v.ndim == 2 else (-1, -2), keepdims=True)
        if t >= self.real:
            moved[-1] = v[-1]
        return moved

    def transfer(self) -> np.ndarray:
        """What moves a message over all words, up to scale: (L, L)."""
        out = np.eye(self.L)
        for x in self.M:
            out = out @ x
            out /= out.sum()
        return out

    def posteriors(self, enter: np.ndarray | None = None, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(posterior (words, L), forward messages (words, L) scaled to sum 1), between the message before the first word and the backward one after the last."""
        T, B, L = self.T, self.B, self.L
        into, v = np.empty((B, L)), np.full(L, 1 / L) if enter is None else enter
        for k in range(B):
            into[k] = v
            v = v @ self.M[k]
            v /= v.sum()
        alpha, v = np.empty((T, B, L)), into
        for t in range(T):
            v = self.into(v, t)
            alpha[t] = v

        back, u = np.empty((B, L)), np.ones(L) if leave is None else leave
        for k in range(B - 1, -1, -1):
            back[k] = u
            u = self.M[k] @ u  # the same product, up to scale, moves backward messages over a run
            u /= u.sum()
        post, u = np.empty((T, B, L)), back
        for t in range(T - 1, -1, -1):
            p = alpha[t] * u
            post[t] = p / p.sum(axis=1, keepdims=True)
            x = self.E[t] * u
            new = x @ self.A.T
            new[self.resets[t]] = (x[self.resets[t]] @ self.init)[:, None]
            new /= new.sum(axis=1, keepdims=True)
            if t >= self.real:
                new[-1] = u[-1]
            u = new
        return tuple(x.swapaxes(0, 1).reshape(-1, L)[: self.n] for x in (post, alpha))


def posteriors(m: Model, score: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(posterior (words, L), forward messages (words, L) scaled to sum 1)."""
    return _Chain(m, score, first).posteriors()


def _label_strips(m: Model, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state of each word, its posterior) of one long text."""

    def chain(a: int, b: int) -> _Chain | None:
        w, score = emissions(m, raw[a:b], np.array([0, b - a]))
        return _Chain(m, score, (np.arange(len(score)) == 0) & (k == at)) if len(w.hash) else None

    strips, at, matrices = [(a, b) for a, b, w in W.strips(raw, 0) if len(w.hash)], 0, []
    for k, (a, b) in enumerate(strips):
        matrices.append(chain(a, b).transfer())
    back, u = [None] * len(strips), np.ones(len(m.langs))
    for k in range(len(strips) - 1, -1, -1):
        back[k] = u
        u = matrices[k] @ u
        u /= u.sum()
    states, chances, v = [], [], np.full(len(m.langs), 1 / len(m.langs))
    for k, (a, b) in enumerate(strips):
        post, _ = chain(a, b).posteriors(v, back[k])
        best = np.round(post, 9).argmax(axis=1)
        states.append(best.astype(np.int16))
        chances.append(post[np.arange(len(best)), best].astype(np.float32))
        v = v @ matrices[k]
        v /= v.sum()
    return (np.concatenate(states).astype(np.int64), np.concatenate(chances)) if states else (np.zeros(0, np.int64), np.zeros(0))


def _first(w: W.Words) -> np.ndarray:
    first = np.zeros(len(w.hash), bool)
    first[w.at[:-1][np.diff(w.at) > 0]] = True
    return first


def label(m: Model, raw: np.ndarray, at: np.ndarray) -> tuple[W.Words, np.ndarray, np.ndarray]:
    """(words, state of each, its posterior)."""
    w, score = emissions(m, raw, at)
    if not len(w.hash):
        return w, np.zeros(0, np.int64), np.zeros(0)
    post, _ = posteriors(m, score, _first(w))
    best = np.round(post, 9).argmax(axis=1)
    return w, best, post[np.arange(len(best)), best]


def _edges(m: Model, score: np.ndarray, post: np.ndarray, alpha: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Expected transitions, summed: (L, L). The backward message of a word is its posterior over its forward one."""
    t = np.flatnonzero(~first)
    e = np.exp(score[t] - score[t].max(axis=1, keepdims=True))
    beta = post[t] / np.maximum(alpha[t], 1e-30)
    x = alpha[t - 1][:, :, None] * np.exp(m.step)[None] * (e * beta)[:, None, :]
    return (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def switched(texts: list[bytes], lang: np.ndarray, rng: np.random.Generator) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """Code-switched texts made from monolingual ones: runs of words of two texts in turn; (text, [(language, words)])."""
    out = []
    split = [t.split() for t in texts]
    for i in range(len(texts)):
        j = int(rng.integers(len(texts)))
        parts, spans, pos = [], [], [0, 0]
        source = (i, j)
        side = 0
        while any(pos[k] < len(split[source[k]]) for k in (0, 1)):
            if pos[side] == len(split[source[side]]):
                side = 1 - side
            run = split[source[side]][pos[side] : pos[side] + int(rng.integers(1, SEGMENT))]
            pos[side] += len(run)
            parts.append(b" ".join(run))
            spans.append((int(lang[source[side]]), len(parts[-1])))
            side = 1 - side
        out.append((b" ".join(parts), spans))
    return out


def _truth(w: W.Words, at: np.ndarray, spans: list[list[tuple[int, int]]]) -> np.ndarray:
    """State of each word, from runs of bytes of one language joined by a blank."""
    ends, owner = [], []
    for a, s in zip(at[:-1], spans, strict=True):
        for lang, size in s:
            a += size + 1
            ends.append(a)
            owner.append(lang)
    return np.array(owner)[np.searchsorted(np.array(ends), w.start, "right")]


def fit(texts: list[bytes], lang: list[str], epochs: int = EPOCHS, seed: int = 5) -> Model:
    langs = sorted(set(lang))
    y, L, rng = np.array([langs.index(x) for x in lang]), len(langs), np.random.default_rng(seed)
    zeros = lambda *s: np.zeros(s, np.float64)
    m = Model(langs, zeros(SLOTS, L), zeros(L, L), zeros(L), np.zeros(0, np.uint64), np.zeros(0, np.int64), zeros(L, L))
    if L > 1:
        raw, at = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
        w = W.words(raw, at)
        known, index = np.unique(w.hash, return_inverse=True)
        count = np.zeros((len(known), L))
        np.add.at(count, (index, y[w.doc]), 1)
        rate = (count + 0.1) / (count.sum(axis=0) + 1)
        rate /= rate.sum(axis=1, keepdims=True)
        ok = (rate.max(axis=1) > 0.8) & (count.sum(axis=1) >= 5)
        m.lexicon, m.owner = known[ok], rate[ok].argmax(axis=1)
        data = [(t, [(int(k), len(t))]) for t, k in zip(texts, y, strict=True)] + switched(texts, y, rng)
        params = [m.weight, m.step, m.start, m.boost]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        n, size = 0, np.array([len(t) for t, _ in data])
        for epoch in range(epochs):
            order = rng.permutation(len(data))
            for part in np.split(order, np.flatnonzero(np.diff(np.cumsum(size[order]) // (6 * BATCH_WORDS))) + 1):
                n += 1
                raw = np.frombuffer(b"".join(data[i][0] + b" " for i in part), np.uint8)
                at = np.r_[0, np.cumsum(size[part] + 1)].astype(np.int64)
                w, grams, mask, slots = features(raw, at)
                if not len(w.hash):
                    continue
                truth = _truth(w, at, [data[i][1] for i in part])
                score, first = emissions(m, raw, at)[1], _first(w)
                post, alpha = posteriors(m, score, first)
                g = post.copy()
                g[np.arange(len(g)), truth] -= 1
                g /= len(g)
                gw = np.zeros_like(m.weight)
                for s in range(L):
                    for k in range(slots.shape[1]):
                        gw[:, s] += np.bincount(slots[:, k], g[:, s], SLOTS)
                    each = np.zeros(len(raw))
                    each[mask] = np.repeat(g[:, s] / (w.end - w.start) * 3, w.end - w.start)
                    for k in range(2):
                        gw[:, s] += np.bincount(grams[k], each, SLOTS)
                inner = np.flatnonzero(~first)
                seen = np.zeros((L, L))
                np.add.at(seen, (truth[inner - 1], truth[inner]), 1)
                gt = (_edges(m, score, post, alpha, first) - seen) / len(g)
                i = np.minimum(np.searchsorted(m.lexicon, w.hash), max(0, len(m.lexicon) - 1))
                gb = np.zeros((L, L))
                if len(m.lexicon):
                    hit = m.lexicon[i] == w.hash
                    np.add.at(gb, m.owner[i[hit]], g[hit])
                rate = RATE * (1 - epoch / epochs)
                for p, x, (a, b) in zip(params, [gw, gt, g[first].sum(axis=0), gb], moments, strict=True):
                    a += 0.1 * (x - a)
                    b += 0.01 * (x * x - b)
                    p -= rate * (a / (1 - 0.9**n)) / (np.sqrt(b / (1 - 0.99**n)) + 1e-9)
    m.weight = m.weight.astype(np.float32)
    m.boost = m.boost.astype(np.float32)
    return m


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the documents of least hash of each language, ``sample`` at most, an equal share of each.

    Of an id that several rows have, the row of the least language and text stands. Which hashes are small enough to be among the least follows from the number of
    ids of each language, so that few rows are ordered, whatever the corpus.
    """
    has = docs.where("lang IS NOT NULL AND length(text) > 0")
    sizes = {r["lang"]: r["n"] for r in has.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).collect()}
    share = max(1, sample // max(1, len(sizes)))
    # of 2^20 classes of hashes as many as hold about twice the share, and 100 more
    limit = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1 << 20, (2 * share + 100) * (1 << 20) // max(n, 1) + 1))))) if sizes else None
    h = F.xxhash64("doc_id")
    near = has.select("doc_id", "lang", h.alias("h")).where(F.shiftrightunsigned(h, 44) < limit[F.col("lang")]) if sizes else has.select("doc_id", "lang", h.alias("h"))
    ids = near.groupBy("doc_id", "h").agg(F.min("lang").alias("lang")).withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 44), "h", "doc_id")))
    some = F.broadcast(ids.where(F.col("r") <= share).select(F.col("doc_id").alias("d"), F.col("lang").alias("l")))  # sample rows at most
    rows = has.join(some, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("lang") == F.col("l"))).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = rows.toPandas().sort_values("doc_id")
    return fit([t.encode() for t in rows["text"]], rows["lang"].tolist())


def _labelled(m: Model, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words before each text, state of each word, its posterior); without states, no word has one."""
    if m.langs and len(at) == 2 and len(raw) > W.CHUNK:
        state, p = _label_strips(m, raw)
        return np.array([0, len(state)]), state, p
    if m.langs:
        w, state, p = label(m, raw, at)
        return w.at, state, p
    return W.words(raw, at).at, np.zeros(0, np.int64), np.zeros(0)


def _rows(m: Model):
    L = len(m.langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in W.slices(batches, 1):
            n = rows.num_rows
            at, state, p = _labelled(m, raw, at)
            doc = np.repeat(np.arange(n), np.diff(at))[: len(state)]
            counts = np.bincount(doc * max(L, 1) + state, minlength=n * max(L, 1)).reshape(n, -1)
            cut = np.r_[True, (state[1:] != state[:-1]) | (doc[1:] != doc[:-1])][: len(state)]
            begin = np.flatnonzero(cut)
            size = np.diff(np.r_[begin, len(state)])
            before = np.searchsorted(begin, at if L else np.zeros(n + 1, np.int64))
            names = pa.array(m.langs or [""], pa.string())
            mean = np.add.reduceat(p, begin) / size if len(begin) else np.zeros(0)
            spans = pa.StructArray.from_arrays(
                [
                    names.take(pa.array(state[begin])),
                    pa.array((begin - np.repeat(at[:-1], np.diff(before)) if L else begin).astype(np.int32)),
                    pa.array(size.astype(np.int32)),
                    pa.array(np.round(mean, 4)),
                ],
                names=["lang", "first_word", "n_words", "p"],
            )
            total = np.diff(at)
            main = pa.array(counts.argmax(axis=1), mask=(total == 0) | (L == 0))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), names.take(main), pa.array(total.astype(np.int32)), pa.array(np.maximum(np.diff(before) - 1, 0).astype(np.int32)), pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), spans)],
                names=["doc_id", "lang", "n_words", "n_switches", "spans"],
            )

    return run


def identify(docs: DataFrame, m: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang of most words, n_words, n_switches, spans of words of one language) of each document."""
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)[doc_id]
    return docs.select(doc_id, text).mapInArrow(_rows(m), f"doc_id {kind}, lang string, n_words int, n_switches int, spans array<struct<lang: string, first_word: int, n_words: int, p: double>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))
