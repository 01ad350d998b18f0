import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.conftest import PROSE, make

from tokloom.llm import exact_dedup, minhash
from tokloom.llm import words as W


def brute_copies(rows):
    groups = defaultdict(list)
    for i, t in rows:
        if t is not None:
            groups[t].append(i)
    out = []
    for ids in groups.values():
        ids.sort(key=lambda x: (x is None, x or 0))
        out += [(i, ids[0]) for i in ids[1:]]
    return sorted(out, key=str)


def test_copies_of_odd_rows(odd, odd_rows):
    assert sorted(map(tuple, exact_dedup.duplicates(odd).collect()), key=str) == brute_copies(odd_rows)


def test_copies_split_at_every_level(spark):
    base = "".join(random.Random(1).choice("abcd") for _ in range(40000))
    rows = [(k, base[:cut] + "X" + base[cut + 1 :]) for k, cut in enumerate([0, 31, 32, 511, 512, 4095, 4096, 32767, 32768, 39999])]
    rows += [(100 + k, t) for k, t in rows[::2]] + [(200, base), (201, base), (202, base[:-1]), (203, base[:512]), (204, base[:512])]
    assert sorted(map(tuple, exact_dedup.duplicates(make(spark, rows)).collect()), key=str) == brute_copies(rows)


def test_copies_beyond_broadcast(spark, odd, odd_rows, monkeypatch):
    monkeypatch.setattr("tokloom.llm.rows.BROADCAST_BYTES", 0)
    monkeypatch.setattr(exact_dedup, "small", lambda df, n: df)
    assert sorted(map(tuple, exact_dedup.duplicates(odd).collect()), key=str) == brute_copies(odd_rows)


def test_exact_deduplicate_keeps_one_row_each(odd, odd_rows):
    out = exact_dedup.deduplicate(odd)
    assert out.columns == odd.columns
    kept = sorted([(r["doc_id"], r["text"]) for r in out.collect()], key=str)
    dropped = brute_copies(odd_rows)
    assert len(kept) == len(odd_rows) - len(dropped)
    assert len({t for _, t in kept if t is not None}) == sum(t is not None for _, t in kept)
    assert {t for _, t in kept} == {t for _, t in odd_rows}
    assert (1, PROSE) in kept and (3, "") in kept and sum(t is None for _, t in kept) == 5


def test_empty_tables(empty):
    assert exact_dedup.duplicates(empty).count() == 0 and exact_dedup.deduplicate(empty).columns == empty.columns
    assert minhash.near_duplicates(empty).count() == 0 and minhash.deduplicate(empty).count() == 0


def shingles(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    g, _, _ = W.ngrams(W.words(raw, np.array([0, len(raw)])), minhash.NGRAM)
    return set(g.tolist())


def roots(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[find(a)] = find(b)
    return find


def test_words_and_ngrams_agree_with_a_plain_split():
    texts = ["The cat, the CAT", "", "a", "É é naïve", "日本"]
    data = [t.encode() for t in texts]
    w = W.words(np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum([len(d) for d in data])])
    assert np.diff(w.at).tolist() == [4, 0, 1, 3, 2]
    assert w.hash[0] == w.hash[2] and w.hash[1] == w.hash[3] and w.hash[0] != w.hash[1] and w.hash[5] == w.hash[6]
    assert len(shingles("a b")) == 1 and len(shingles("a b c d")) == 2 and not shingles("...")


def test_signature_estimates_similarity():
    rng = random.Random(3)
    a = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    b = a[:2200] + [f"v{rng.randrange(10**6)}" for _ in range(800)]
    texts = [" ".join(a).encode(), " ".join(b).encode()]
    grams, _, at = W.ngrams(W.words(np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]), minhash.NGRAM)
    m = minhash.minima(grams, at)
    x = (grams >> np.uint64(32)).astype(np.uint32)
    slow = np.stack([((x[at[d] : at[d + 1], None] ^ minhash._XOR) * minhash._MULTIPLY).min(axis=0) for d in range(2)], axis=1)
    assert (m == slow).all()
    sig = minhash.signatures(m)[0]
    s, t = shingles(" ".join(a)), shingles(" ".join(b))
    assert abs(minhash.similarity(sig[0], sig[1]) - len(s & t) / len(s | t)) < 0.15
    assert minhash.similarity(sig[0], sig[0]) == 1


def test_recall_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], shingles(r["text"])) for r in docs.collect()]
    true = [(a, b) for i, (a, s) in enumerate(rows) for b, t in rows[:i] if s and t and len(s & t) >= 0.5 * len(s | t)]
    find = roots((r["doc_id"], r["kept_doc_id"]) for r in minhash.near_duplicates(docs).collect())
    assert true and sum(find(a) == find(b) for a, b in true) >= 0.9 * len(true)
    found = {x for r in minhash.near_duplicates(docs).collect() for x in (r["doc_id"], r["kept_doc_id"])}
    loose = {x for i, (a, s) in enumerate(rows) for b, t in rows[:i] if s and t and len(s & t) >= 0.35 * len(s | t) for x in (a, b)}
    assert found <= loose


def test_recall_of_pairs_near_the_threshold(spark):
    rng = random.Random(12)
    docs, true = [], defaultdict(list)
    for k in range(28, 34):
        for _ in range(60):
            i = len(docs)
            base = [f"d{i}w{j}" for j in range(302)]
            edited = list(base)
            for j in rng.sample(range(100), k):  # words three apart or more lie in three shingles each
                edited[3 * j + 1] = f"d{i}new{j}"
            docs += [(i, " ".join(base)), (i + 1, " ".join(edited))]
            s, t = (shingles(x) for _, x in docs[-2:])
            true[k].append((i + 1, i, len(s & t) / len(s | t)))
    assert all(0.5 <= j <= 0.57 for rows in true.values() for *_, j in rows)
    found = {(r["doc_id"], r["kept_doc_id"]) for r in minhash.near_duplicates(make(spark, docs)).collect()}
    recall = {k: sum((a, b) in found for a, b, _ in rows) / len(rows) for k, rows in true.items()}
    assert min(recall.values()) >= 0.9, recall


def test_near_copies_of_odd_rows(odd, odd_rows):
    pairs = {(r["doc_id"], r["kept_doc_id"]) for r in minhash.near_duplicates(odd).collect()}
    assert {(2, 1), (13, 1), (None, 1), (11, 10), (12, 10), (9, 8)} <= pairs
    assert not {i for p in pairs for i in p} & {3, 4, 5, 6, 7, 14, 15, 16, 17, 18, 19}
    out = minhash.deduplicate(odd)
    assert out.columns == odd.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    gone = {(2, PROSE), (None, PROSE), (9, "x")}
    assert not gone & set(kept) and kept.count((1, PROSE)) == 1
    assert [i for i, _ in kept].count(18) == 2 and {i for i, _ in kept} >= {1, 3, 4, 5, 6, 7, 8, 10, 14, 15, 16, 17, 18, 19}


def test_long_candidate_lists_are_compared_in_blocks(spark, monkeypatch):
    words = PROSE.split()
    docs = make(spark, [(i, " ".join([*words[: i % 20], f"new{i}", *words[i % 20 + 1 :]])) for i in range(80)])
    whole = sorted(map(tuple, minhash.near_duplicates(docs).collect()))
    monkeypatch.setattr(minhash, "LIST", 7)
    assert sorted(map(tuple, minhash.near_duplicates(docs).collect())) == whole and len(whole) > 60


def test_a_band_that_most_documents_share(spark, monkeypatch):
    """Two thirds of the documents are near copies of one, in 400 different texts; the shuffled and the broadcast plan agree."""
    words = [f"w{i}" for i in range(120)]
    docs = make(spark, [(i, " ".join([*words[: i % 100], f"new{i}", *words[i % 100 + 1 :]])) for i in range(400)] + [(1000 + i, " ".join(f"d{i}x{j}" for j in range(60))) for i in range(200)]).repartition(6)
    found = sorted(map(tuple, minhash.near_duplicates(docs).collect()))
    assert {(a, b) for a, b, _ in found} == {(i, 0) for i in range(1, 400)}
    monkeypatch.setattr(minhash, "small", lambda df, n: df)
    monkeypatch.setattr(minhash, "BITMAP", 8)  # full
    assert sorted(map(tuple, minhash.near_duplicates(docs).collect())) == found


def test_ids_of_other_types(spark):
    rows = [("b", PROSE), ("a", PROSE + " indeed"), ("c", "something else entirely here"), (None, PROSE)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert {(r["doc_id"], r["kept_doc_id"]) for r in minhash.near_duplicates(docs).collect()} == {("b", "a"), (None, "a")}
    assert sorted(r["doc_id"] for r in minhash.deduplicate(docs).collect()) == ["a", "c"]
    assert sorted(map(tuple, exact_dedup.duplicates(docs).collect()), key=str) == [(None, "b")]


def test_hashes_that_agree_by_chance_are_told_apart(spark, monkeypatch):
    docs = make(spark, [(1, PROSE), (2, "something else entirely here, and more of it"), (3, PROSE), (4, PROSE.replace("quick", "slow"))])
    want = sorted(map(tuple, minhash.near_duplicates(docs).collect()))
    signed = minhash._sign

    def colliding(batches):
        for b in signed(batches):
            yield b.set_column(2, "f", pa.array([7] * b.num_rows, pa.int64()))

    monkeypatch.setattr(minhash, "_sign", colliding)
    assert sorted(map(tuple, minhash.near_duplicates(docs).collect())) == want and {(a, b) for a, b, _ in want} == {(3, 1), (4, 1)}


def test_long_texts_are_signed_in_strips(monkeypatch):
    rng = random.Random(8)
    text = " ".join(rng.choice([f"w{rng.randrange(400)}", "日本語", "x" * 300, "—", ","]) for _ in range(900))
    for t in (text, "a" * 900 + " b", "z" * 900 + " b c d", ", " * 600, "日本" * 500):
        raw = np.frombuffer(t.encode(), np.uint8)
        at = np.array([0, len(raw)])
        monkeypatch.setattr(W, "CHUNK", 1 << 20)
        whole, has = minhash._minima(raw, at)
        monkeypatch.setattr(W, "CHUNK", 256)
        strips, also = minhash._minima(raw, at)
        assert (has == also).all() and (whole is None) == (strips is None) and (whole is None or (whole == strips).all())


def test_near_dedup_keeps_one_of_repeated_rows(spark):
    docs = make(spark, [(1, PROSE), (1, PROSE), (2, "something else entirely here")])
    assert sorted(r["doc_id"] for r in minhash.deduplicate(docs).collect()) == [1, 2]


@pytest.mark.parametrize("n", [2, 7, 40])
def test_components_against_union_find(spark, n):
    rng = random.Random(n)
    edges = [(rng.randrange(n * 3), rng.randrange(n * 3)) for _ in range(n * 2)] + [(i, i + 1) for i in range(1000, 1000 + n)]
    edges = [e for e in edges if e[0] != e[1]]
    find = roots(edges)
    out = dict(map(tuple, minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    nodes = {x for e in edges for x in e}
    assert set(out) == nodes
    for x in nodes:
        assert out[x] == min(y for y in nodes if find(y) == find(x))
