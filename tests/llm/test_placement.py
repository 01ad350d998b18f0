import random
import time
from collections import Counter, defaultdict
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.conftest import make

from tokloom.llm import lengths, packing, sharding
from tokloom.llm import tokens as K
from tokloom.plans.numbering import numbered
from tokloom.operators import vectorized as V


def encoder():
    with open(K.RANKS, "rb") as f:
        return K.encoder(K.RANKS, f.read())


def test_histogram_against_plain_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = sorted(len(encoder().encode_ordinary(r["text"])) for r in docs.collect())
    h = lengths.query(spark, sf_dir).cache()
    for r in h.collect():
        x = r["length"]
        assert r["n_docs"] == n.count(x) and r["docs_up_to"] == sum(v <= x for v in n) and r["tokens_up_to"] == sum(v for v in n if v <= x)
        assert r["docs_longer"] == sum(v > x for v in n) and r["tokens_longer"] == sum(v for v in n if v > x) and r["truncated_total"] == sum(min(v, x) for v in n)
    assert tuple(lengths.total(h).first()) == (len(n), sum(n))
    shares = [0.0, 0.001, 0.25, 0.5, 0.9, 1.0]
    assert dict(map(tuple, lengths.quantiles(h, shares).collect())) == {s: n[max(1, int(np.ceil(s * len(n)))) - 1] for s in shares}
    limits = [0, 1, 100, 1234, 10**6]
    assert {r["context"]: (r["n_tokens"], r["n_cut"]) for r in lengths.truncated(h, limits).collect()} == {c: (sum(min(v, c) for v in n), sum(v > c for v in n)) for c in limits}


def test_lengths_of_odd_rows(odd, odd_rows, empty):
    out = K.counted(odd).collect()
    assert [r["n_tokens"] for r in out] == [None if t is None else len(encoder().encode_ordinary(t)) for _, t in odd_rows]
    h = lengths.histogram(K.counted(odd))
    assert h.agg({"n_docs": "sum"}).first()[0] == sum(t is not None for _, t in odd_rows)
    none = lengths.histogram(K.counted(empty))
    assert none.count() == 0 and tuple(lengths.total(none).first()) == (0, 0) and lengths.quantiles(none, [0.5]).count() == 0
    assert [tuple(r) for r in lengths.truncated(none, [5]).collect()] == [(5, 0, 0)]


def check_bins(rows, want, capacity):
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r["bin_id"]].append((r["bin_offset"], r["n_tokens"]))
        pieces[r["doc_id"]].append((r["first_token"], r["n_tokens"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at and n > 0
            at += n
        assert at <= capacity
    assert Counter({d: sum(n for _, n in p) for d, p in pieces.items()}) == Counter(want)
    return len(bins)


def contents(groups):
    return [[s for s, c in items.items() for _ in range(c)] for n, items in groups for _ in range(n)]


def plain_best_fit(sizes, capacity):
    """One document at a time."""
    bins = []
    for n in sorted(sizes, reverse=True):
        fits = [b for b in bins if sum(b) + n <= capacity]
        if fits:
            max(fits, key=sum).append(n)
        else:
            bins.append([n])
    return bins


def better(bins, capacity):
    """Some exchange, by trying all of them, that raises the sum of squared fills of underfull bins."""
    under = [b for b in bins if sum(b) < capacity]
    for t, d in permutations(range(len(under)), 2):
        taker, giver = under[t], under[d]
        for s in giver:
            for give in [(), *((x,) for x in taker), *combinations(taker, 2)]:
                gain = s - sum(give)
                if gain > 0 and sum(taker) + gain <= capacity and (sum(taker) + gain) ** 2 + (sum(giver) - gain) ** 2 > sum(taker) ** 2 + sum(giver) ** 2:
                    return taker, giver, give, s
    return None


def groups_of(bins):
    return [(n, dict(key)) for key, n in Counter(tuple(sorted(Counter(b).items())) for b in bins).items()]


def test_packing_against_plain_best_fit_and_all_exchanges():
    rng, raised = random.Random(1), 0
    for _ in range(150):
        cap = rng.choice([10, 20, 50])
        sizes = [rng.randrange(1, cap) for _ in range(rng.randrange(1, 40))]
        start = packing.best_fit(Counter(sizes), cap)
        assert sorted(map(sum, contents(start))) == sorted(map(sum, plain_best_fit(sizes, cap)))
        # from best fit, and from bins of one document each
        for before in (start, groups_of([[s] for s in sizes])):
            bins = contents(packing.local_search(before, cap))
            assert Counter(s for b in bins for s in b) == Counter(sizes) and max(map(sum, bins)) <= cap
            assert better(bins, cap) is None
            squares = lambda bins: sum(sum(b) ** 2 for b in bins)
            assert squares(bins) >= squares(contents(before)) and len(bins) <= len(contents(before))
            raised += squares(bins) > squares(contents(before))
    assert raised > 100


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ([[3, 4, 2], [8]], [[2, 8], [3, 4]]),  # two for one
        ([[6, 3], [7]], [[7, 3], [6]]),  # one for one
        ([[6], [4]], [[6, 4]]),  # a move, and the bin it empties is gone
        ([[6, 3], [5, 4], [4, 3, 2], [3]], [[6, 4], [5, 3, 2], [4, 3, 3]]),  # several, till a bin is empty
    ],
)
def test_each_exchange(before, after):
    assert better(before, 10)
    bins = contents(packing.local_search(groups_of(before), 10))
    assert sorted(map(sum, bins)) == sorted(map(sum, after)) and better(bins, 10) is None
    # the same for a thousand such bins at a time
    many = packing.local_search([(1000 * n, items) for n, items in groups_of(before)], 10)
    assert sum(n for n, _ in many) <= 1000 * len(after)


def test_local_search_saves_bins_of_middling_documents():
    counts = Counter(np.random.default_rng(0).integers(100, 200, 20000).tolist())
    start = packing.best_fit(counts, 410)
    assert sum(n for n, _ in packing.local_search(start, 410)) < 0.97 * sum(n for n, _ in start)


@pytest.mark.parametrize("size", [1, 3, 5])
def test_many_short_documents_take_no_time(size):
    began = time.perf_counter()
    bins, runs = packing.plan({size: 10**9})
    assert time.perf_counter() - began < 1 and bins <= -(-(10**9) // (4096 // size))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_packing_of_a_table(spark, kind):
    rng = random.Random(3)
    sizes = {d: rng.choice([rng.randrange(1, 60), rng.randrange(1, 400), 250]) for d in range(900)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens long").selectExpr(f"CAST(doc_id AS {kind}) doc_id", "n_tokens")
    rows = [r.asDict() | {"doc_id": int(r["doc_id"])} for r in packing.pack(df, 100).collect()]
    assert check_bins(rows, sizes, 100) == packing.plan(Counter(n % 100 for n in sizes.values() if n % 100), 100)[0] + sum(n // 100 for n in sizes.values())
    rests = defaultdict(list)
    for r in rows:
        if r["n_tokens"] < 100:
            rests[r["bin_id"]].append(r["n_tokens"])
    assert better(list(rests.values()), 100) is None
    assert len(rests) <= len(plain_best_fit([n % 100 for n in sizes.values() if n % 100], 100))


def test_packing_of_many_equal_rows(spark):
    df = spark.range(0, 3000, 1, 8).selectExpr("CAST(NULL AS long) doc_id", "CAST(if(id % 3 = 0, id % 7 + 1, 5) AS long) n_tokens")
    rows = packing.pack(df, 16).collect()
    want = Counter({None: df.agg({"n_tokens": "sum"}).first()[0]})
    check_bins(rows, want, 16)
    assert len({(r["bin_id"], r["bin_offset"]) for r in rows}) == 3000


def test_numbers_within_groups(spark):
    rng = random.Random(4)
    data = [(rng.randrange(4), rng.choice([None, 1, 1, 1, rng.randrange(50)]), rng.randrange(5)) for _ in range(4000)]
    df = spark.createDataFrame(data, "g int, k int, n long").repartition(6)
    out = numbered(df, "g", ["k"], "n").collect()
    by = defaultdict(list)
    for r in out:
        by[r["g"]].append((r["r"], r["k"]))
    for g, rows in by.items():
        rows.sort()
        assert [r for r, _ in rows] == list(range(len(rows)))
        keys = [(k is None, k or 0) for _, k in rows]
        assert keys == sorted(keys) and len(rows) == sum(x[0] == g for x in data)
    spans = sorted((r["before"], r["before"] + r["n"]) for r in out)
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and spans[-1][1] == sum(x[2] for x in data)
    assert numbered(df.limit(0), "g", ["k"]).count() == 0


def test_packing_of_odd_rows(odd, odd_rows, empty):
    want = Counter()
    for d, t in odd_rows:
        if t:
            want[d] += len(encoder().encode_ordinary(t))
    rows = packing.pack_documents(odd).collect()
    got = Counter()
    for r in rows:
        got[r["doc_id"]] += r["n_tokens"]
        assert r["bin_offset"] + r["n_tokens"] <= packing.CONTEXT
    assert got == want
    assert packing.pack_documents(empty).count() == 0


def brute_ring(keys, hashes, shards, vnodes, slack):
    """Turn by turn, key by key: each key not yet placed asks the shard of the point where it is."""
    positions, owner = sharding.ring(shards, vnodes)
    room = [max(1, -(-int(np.ceil((1 + slack) * len(keys))) // shards))] * shards
    arcs = defaultdict(list)
    for k, h in zip(keys, hashes, strict=True):
        arcs[int(np.searchsorted(positions, h)) % len(positions)].append((h, k is None, k or 0, k))
    todo = [(a, [k for *_, k in sorted(v)]) for a, v in sorted(arcs.items())]
    out, turn = [], 0
    while todo:
        left = []
        for a, ks in todo:
            s = int(owner[(a + turn) % len(owner)])
            n = min(len(ks), room[s])
            room[s] -= n
            out += [(k, s) for k in ks[:n]]
            if ks[n:]:
                left.append((a, ks[n:]))
        todo, turn = left, turn + 1
    return sorted(out, key=str)


def test_ring_against_key_by_key(spark):
    keys = [*range(500), None, None, 7, 7, 7]
    df = spark.createDataFrame([(k, 1, 2) for k in keys], "doc_id long, arc int, shard int")
    hashes = [r[0] for r in df.selectExpr("xxhash64(doc_id) h").collect()]
    for shards, vnodes, slack in ((5, 3, 0.0), (8, 20, 0.1), (1, 1, 0.0)):
        got = sorted(map(tuple, sharding.assign(df, shards=shards, vnodes=vnodes, slack=slack).collect()), key=str)
        assert got == brute_ring(keys, hashes, shards, vnodes, slack)
        assert max(Counter(s for _, s in got).values()) <= np.ceil(np.ceil((1 + slack) * len(keys)) / shards)


def test_a_key_that_most_rows_have(spark):
    df = spark.range(0, 5000, 1, 8).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN NULL ELSE CAST(id AS string) END AS doc_id")
    got = [r["shard"] for r in sharding.assign(df, shards=10, vnodes=20, slack=0.1).collect()]
    assert len(got) == 5000 and max(Counter(got).values()) <= 550
    plan = sharding.assign(df, shards=10, vnodes=20, slack=0.1)._jdf.queryExecution().toString()
    assert "row_number" not in plan


def test_a_new_shard_moves_few_keys(spark):
    df = spark.range(20000).withColumnRenamed("id", "doc_id")
    a, b = (dict(map(tuple, sharding.assign(df, shards=n).collect())) for n in (20, 21))
    moved = sum(a[k] != b[k] for k in a)
    assert moved < 0.25 * len(a) and max(Counter(b.values()).values()) <= 1.05 * 20000 / 21 + 1


def test_sharding_of_odd_rows(odd, odd_rows, empty):
    assert Counter(r["doc_id"] for r in sharding.assign(odd).collect()) == Counter(i for i, _ in odd_rows)
    assert sharding.assign(empty).count() == 0


def test_counts_of_long_blanks(spark):
    texts = [" " * 10**6, "\x01", " " * 10**6 + "\x01", "a" * 10**6, ("word and\n" * 10**5)]
    assert [r["n_tokens"] for r in K.counted(make(spark, list(enumerate(texts)))).collect()] == [10**6, 1, 10**6 + 1, len(encoder().encode_ordinary(texts[3])), len(encoder().encode_ordinary(texts[4]))]


def test_counts_and_pieces_against_another_encoder():
    rng = random.Random(5)
    parts = [*"aZéß1²٣ \t\n\r\u00a0\u2003'.,!-/中ſ\0\x01", "\U0001f600", "'s", "'RE", "'ll", "'ve", "  ", "\r\n", " '", "x" * 30, " the"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(5000)]
    with open(K.RANKS, "rb") as f:
        count = K._counter(K.RANKS, f.read())
    want = [encoder().encode_ordinary(t) for t in texts]
    assert count(pa.array([*texts, None])).to_pylist() == [*map(len, want), None]
    plain, fast = [t for t in texts if "\x01" not in t], K._loaded[("counter", K.RANKS)]
    ids, at = fast.encode(*V.buffers(pa.array(plain)))
    assert np.split(ids, at[1:-1])[0].tolist() == encoder().encode_ordinary(plain[0]) and ids.tolist() == [i for t in plain for i in encoder().encode_ordinary(t)]
    whole = "".join(plain)
    assert count(pa.array([whole])).to_pylist() == [len(encoder().encode_ordinary(whole))]
