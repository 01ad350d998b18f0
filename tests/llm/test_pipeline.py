"""The whole pipeline against plain versions of its stages, one document and one pair at a time."""

import random

import corpus_pipeline
import pytest
from tests.llm.conftest import make
from tests.llm.test_classifiers import slow_probability
from tests.llm.test_dedup import roots, shingles
from tests.llm.test_placement import check_bins, encoder
from tests.llm.test_text_operators import brute_leaks

from tokloom.llm import quality

VOCABULARY = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "su", "ta", "vo") for b in ("ran", "bel", "dor", "fin", "gus", "hop", "jet", "kin")]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """(folder, rows, items, labels): prose and junk, exact and near copies, leaked items, nulls and repeated rows."""
    rng = random.Random(21)
    prose = lambda n: [rng.choice(VOCABULARY) for _ in range(n)]
    text = lambda w: " ".join(w).capitalize() + "."
    rows = [(d, text(prose(rng.randrange(30, 90)))) for d in range(60)]
    rows += [(100 + d, " ".join([rng.choice(["BUY", "NOW", "$$$", "CLICK"])] * rng.randrange(10, 40))) for d in range(20)]
    rows += [(200 + d, rows[d][1]) for d in range(6)] + [(206, rows[0][1]), rows[7]]
    for d in range(10, 16):
        w = rows[d][1].split()
        w[len(w) // 2] = "changed"
        rows.append((300 + d, " ".join(w)))
    items = [(k, text(prose(rng.randrange(15, 30)))) for k in range(5)]
    for k, q in items[:4]:
        w = q.split()
        if k % 2:
            w[len(w) // 3] = "edited"
        rows.append((400 + k, text(prose(20) + w + prose(20))))
    rows += [(500, None), (501, ""), (None, text(prose(40)))]
    labels = [(d, 1, 0) for d in range(0, 60)] + [(100 + d, 0, 0) for d in range(20)] + [(9999, 1, 0), (None, 0, 1), (1, None, None)]
    d = str(tmp_path_factory.mktemp("corpus"))
    make(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, items


def plain(spark, d, rows, items):
    """What every stage but the last keeps, as rows (doc_id, text)."""
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    m = quality.train(read("documents"), read("labels"))
    p = {t: slow_probability(m, t.encode()) for _, t in rows if t}
    assert all(abs(v - m.threshold) > 1e-4 for v in p.values())
    now = [r for r in rows if not r[1] or p[r[1]] >= m.threshold]
    yield now
    first = {}
    for i, t in sorted((r for r in now if r[1] is not None), key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(t, i)
    now = [r for r in now if r[1] is None] + [(i, t) for t, i in first.items()]
    yield now
    grams = [shingles(t or "") for _, t in now]
    near = [(a, b) for a in range(len(now)) for b in range(a) if grams[a] and grams[b] and len(grams[a] & grams[b]) >= 0.5 * len(grams[a] | grams[b])]
    find, order = roots(near), sorted(range(len(now)), key=lambda k: (now[k][0] is None, now[k][0] or 0))
    kept, seen = [], set()
    for k in order:
        if find(k) not in seen:
            seen.add(find(k))
            kept.append(now[k])
    now = kept
    yield now
    leaked = {i for i, _ in brute_leaks(now, items)}
    yield [r for r in now if r[0] not in leaked]


def test_stages_against_plain_versions(spark, corpus):
    d, rows, items = corpus
    docs, sizes = spark.read.parquet(f"{d}/documents.parquet"), [len(rows)]
    columns = docs.columns
    for (_, stage), want in zip(corpus_pipeline.STAGES, plain(spark, d, rows, items), strict=False):
        docs = stage(spark, docs, d)
        assert docs.columns == columns
        assert sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str) == sorted(want, key=str)
        sizes.append(len(want))
    assert len(corpus_pipeline.STAGES) == 5 and sizes == sorted(set(sizes), reverse=True)  # every stage drops something
    n = {i: len(encoder().encode_ordinary(t)) for i, t in want if t}
    check_bins(corpus_pipeline.run(spark, d).collect(), n, 4096)


def test_pipeline_of_odd_rows(spark, odd, odd_rows, empty, corpus, tmp_path):
    for docs, some in ((odd, True), (empty, False)):
        d = str(tmp_path / str(some))
        docs.write.parquet(f"{d}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{corpus[0]}/{t}.parquet").limit(100 * some).write.parquet(f"{d}/{t}.parquet")
        out = corpus_pipeline.run(spark, d).collect()
        assert bool(out) == some and {r["doc_id"] for r in out} <= {i for i, _ in odd_rows}
