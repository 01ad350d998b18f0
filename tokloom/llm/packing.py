"""Best-fit packing of documents into contexts, with swap-based local search.

Documents are sized in tokens. One longer than a context fills whole contexts and leaves a rest. What is packed depends on the sizes of the rests alone, so the plan is made from
their histogram, of at most CONTEXT numbers whatever the corpus: bins of the same contents are one group with a multiplicity. Best-fit decreasing puts a size's documents
into the fullest bins with room, a group of bins at a time. Then local search exchanges one document for one, two for one, or moves one, between underfull bins; each step
raises the sum of squared fills, so it ends, and what drains away leaves bins empty, which vanish. It ends where no such exchange between any two bins raises it. A step is done for as many pairs of bins of
two groups as there are. All documents are packed together; there are no parts of the corpus.

The documents then take their places: they are numbered within their size, and the plan tells for each run of numbers its bins. Only (doc_id, n_tokens) is shuffled, by ranges, so that a size that many documents
have is not one task; the plan is broadcast, and grows with the context and not with the corpus.

Rows: a null or empty text takes no room and is in no bin. Repeated rows are packed each. Of equal sizes the one with the lesser doc_id takes the earlier place, null last; doc_id may be of any type
with an order. A very long text fills contexts of its own. Extra columns are of no matter; an empty table gives no bins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokloom.llm.tokens import RANKS, counted
from tokloom.plans.numbering import numbered
from tokloom.session import prepare, save

CONTEXT = 4096
#: Gains that are tried at a time.
STEP = 64
#: Bits for the number of a document within its size.
PLACES = 44

#: Bins of equal contents: how many, and {size: documents of it} in each.
Group = tuple[int, dict[int, int]]


def best_fit(counts: dict[int, int], capacity: int) -> list[Group]:
    """Best-fit decreasing of so many documents of each size."""
    groups: list[Group] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has r left

    def add(n: int, items: dict[int, int], left: int) -> None:
        nonlocal open_rooms
        if n:
            groups.append((n, items))
            room[left].append(len(groups) - 1)
            open_rooms |= 1 << left

    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        n = counts[size]
        while n:
            fits = open_rooms >> size
            if fits:
                left = size + (fits & -fits).bit_length() - 1
                g = room[left].pop()
                if not room[left]:
                    open_rooms &= ~(1 << left)
                bins, items = groups[g]
                groups[g] = (0, {})
            else:
                left, bins, items = capacity, n, {}
            each = left // size  # the fullest bin stays so until it takes no more
            whole = min(bins, n // each)
            rest = min(n - whole * each, each) if whole < bins else 0
            add(whole, items | {size: each}, left - each * size)
            if rest:
                add(1, items | {size: rest}, left - rest * size)
            if fits:
                add(bins - whole - bool(rest), items, left)
            n -= whole * each + rest
    return [(n, items) for n, items in groups if n]


class _Search:
    """Underfull bins in groups, and who has documents of a size."""

    def __init__(self, groups: list[Group], capacity: int):
        self.capacity, self.full = capacity, []
        self.bins: dict[tuple, int] = {}
        self.fill: dict[tuple, int] = {}
        self.owners: list[set[tuple]] = [set() for _ in range(capacity + 1)]
        #: the least fill of an underfull bin with a document of each size
        self.least = np.full(2 * capacity + STEP + 2, capacity + 1, np.int64)
        for n, items in groups:
            self.put(n, items)

    def put(self, n: int, items: dict[int, int]) -> tuple | None:
        key = tuple(sorted((s, c) for s, c in items.items() if c))
        fill = sum(s * c for s, c in key)
        if fill == self.capacity:
            self.full.append((n, dict(key)))
        elif fill and n:
            if key not in self.bins:
                self.bins[key], self.fill[key] = 0, fill
                for s, _ in key:
                    self.owners[s].add(key)
                    self.least[s] = min(self.least[s], fill)
            self.bins[key] += n
            return key
        return None

    def take(self, key: tuple, n: int) -> None:
        self.bins[key] -= n
        if not self.bins[key]:
            del self.bins[key]
            fill = self.fill.pop(key)
            for s, _ in key:
                self.owners[s].remove(key)
                if self.least[s] == fill:
                    self.least[s] = min((self.fill[k] for k in self.owners[s]), default=self.capacity + 1)

    def best(self, key: tuple) -> tuple[tuple[int, ...], int, tuple] | None:
        """(sizes given, size taken, giver) of the exchange for a bin of a group that gains most; of those the one that gives the fewest documents."""
        gives: dict[int, tuple[int, ...]] = {0: ()}
        for s, _ in key:
            gives.setdefault(s, (s,))
        for i, (a, n) in enumerate(key):
            for b in [a] * (n > 1) + [b for b, _ in key[i + 1 :]]:
                gives.setdefault(a + b, (a, b))
        given, fill = np.array(list(gives)), self.fill[key]
        gap = self.capacity - fill
        given = given[given < self.capacity]
        for top in range(gap, 0, -STEP):
            gain = np.arange(top, max(top - STEP, 0), -1)
            # the sum of squares rises by 2 gain (fill of taker - fill of giver + gain)
            able = self.least[given[:, None] + gain] < fill + gain
            for j in np.flatnonzero(able.any(axis=0)):
                for i in np.flatnonzero(able[:, j]):
                    taken = int(given[i] + gain[j])
                    for other in sorted(self.owners[taken], key=lambda k: (self.fill[k], k)):
                        if self.fill[other] >= fill + gain[j]:
                            break
                        if other != key or self.bins[key] > 1:
                            return gives[int(given[i])], taken, other
        return None

    def exchange(self, key: tuple, give: tuple[int, ...], taken: int, other: tuple) -> tuple | None:
        """Do it for all pairs of bins; the taker's new group, if it is underfull still."""
        n = self.bins[key] // 2 if other == key else min(self.bins[key], self.bins[other])
        to, back = dict(key), dict(other)
        to[taken] = to.get(taken, 0) + 1
        back[taken] -= 1
        for s in give:
            to[s] -= 1
            back[s] = back.get(s, 0) + 1
        self.take(key, n)
        self.take(other, n)
        self.put(n, back)
        return self.put(n, to)


def local_search(groups: list[Group], capacity: int) -> list[Group]:
    """Exchanges between underfull bins until none raises the sum of squared fills; empty bins are dropped."""
    state = _Search(groups, capacity)
    moved = True
    while moved:
        moved = False
        for key in sorted(state.bins, key=lambda k: (-state.fill[k], k)):
            while key in state.bins and (found := state.best(key)):
                moved, left = True, state.exchange(key, *found)
                if key not in state.bins and left:
                    key = left
    return sorted([(n, dict(k)) for k, n in state.bins.items()] + state.full, key=lambda g: (sorted(g[1].items(), reverse=True), g[0]), reverse=True)


def plan(counts: dict[int, int], capacity: int = CONTEXT) -> tuple[int, dict[str, np.ndarray]]:
    """(number of bins, runs of documents): of a run, of documents of one size from a number on, the first bin, documents to a bin and place in it."""
    groups = local_search(best_fit(counts, capacity), capacity)
    used: dict[int, int] = {}
    rows, bins = [], 0
    for n, items in groups:
        at = 0
        for s, c in sorted(items.items(), reverse=True):
            rows.append((s << PLACES | used.get(s, 0), bins, c, at))
            used[s] = used.get(s, 0) + n * c
            at += s * c
        bins += n
    key, first, each, at = np.array(sorted(rows), np.int64).reshape(-1, 4).T
    return bins, {"key": key, "bin": first, "each": each, "at": at}


def _place(bins: int, runs: dict[str, np.ndarray], capacity: int):
    names = ["bin_id", "doc_id", "first_token", "n_tokens", "bin_offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rest, full, r, before = b.column(0), *(b.column(k).to_numpy().astype(np.int64) for k in range(1, 5))
            some = np.flatnonzero(rest)
            key = rest[some] << PLACES | r[some]
            i = np.searchsorted(runs["key"], key, "right") - 1
            x, each = key - runs["key"][i], runs["each"][i]
            whole = np.repeat(np.arange(len(full)), full)
            nth = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
            columns = [
                np.r_[runs["bin"][i] + x // each, bins + before[whole] + nth],
                np.r_[full[some] * capacity, nth * capacity],
                np.r_[rest[some], np.full(len(whole), capacity)],
                np.r_[runs["at"][i] + x % each * rest[some], np.zeros(len(whole), np.int64)],
            ]
            first, *others = (pa.array(c.astype(np.int64)) for c in columns)
            yield pa.RecordBatch.from_arrays([first, ids.take(pa.array(np.r_[some, whole])), *others], names=names)

    return run


def pack(lengths: DataFrame, capacity: int = CONTEXT) -> DataFrame:
    """(bin_id, doc_id, first_token, n_tokens, bin_offset): pieces of documents in bins; ``lengths`` is a saved table (doc_id, n_tokens)."""
    prepare(lengths.sparkSession)
    n = F.col("n_tokens").cast("long")
    some = lengths.where("n_tokens > 0").select("doc_id", (n % capacity).alias("rest"), F.floor(n / capacity).alias("full"))
    counts = {r["rest"]: r["n"] for r in some.where("rest > 0").groupBy("rest").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    place = _place(*plan(counts, capacity), capacity)
    kind = dict(lengths.dtypes)["doc_id"]
    return numbered(some, "rest", ["doc_id"], "full").select("doc_id", "rest", "full", "r", "before").mapInArrow(place, f"bin_id long, doc_id {kind}, first_token long, n_tokens long, bin_offset long")


def pack_documents(docs: DataFrame, ranks: str = RANKS, capacity: int = CONTEXT) -> DataFrame:
    return pack(save(counted(docs.select("doc_id", "text"), ranks), "packing-lengths"), capacity)


def query(spark: SparkSession, sf_dir: str, ranks: str = RANKS) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks)
