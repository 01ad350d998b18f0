"""Near-duplicates by b-bit MinHash.

The shingles of a document are its word n-grams. PERMUTATIONS multiplicative permutations of 32-bit shingle hashes
give as many minima, kept in full only while the band hashes are made; of each minimum the low BITS bits are packed
into the signature, 160 bytes for 320 minima of 4 bits. Documents that share all ROWS minima of one of the bands are
candidates. Two signatures agree in a slot with probability J + (1 - J) / 2^BITS, so the count of equal slots, an xor
and a bit count, gives an estimate of the Jaccard similarity J corrected for chance. Pairs estimated at ACCEPT or
more, which is THRESHOLD less MARGIN standard errors of the estimate, are near-duplicates, so that a pair of THRESHOLD is not left to the toss of its estimate; the groups are the connected components, and the least doc_id of each stays.

Scale: documents with the same minima become one node, so thousands of copies cost one signature; nodes whose 64-bit hash of all minima is equal and whose signatures differ are told apart. Members of a band
are counted with partial sums before they are shuffled, so that a band that many documents share is no hot task, and only bands of two or more go on. Candidate
lists of several bands that are equal as sets are compared once. Inside a list, components are searched with vectorized one-against-rest
comparisons that leave out what was already reached: exact, linear for a list of near-copies. There is no cap on a
list: one of more than LIST members is compared block against block, in as many pieces. Components across lists are found by alternating large and small stars over saved edge tables.
A pair of J 0.50 becomes a candidate and is accepted with probability 0.97, one of 0.52 with 0.99, of 0.54 with 0.999; so is one of 0.45 with 0.60, of 0.40 with 0.08, of 0.35 with 0.001.

Rows: null texts and texts without a word have no signature and are nobody's near-duplicate. A text of fewer than
n words is one shingle. Rows that are equal in doc_id and text are one document; of them one row stays. A null
doc_id is last in order; ids may be of any type with an order. A very long text is signed in parts of whole words. Extra columns and their names are of no matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokloom.llm import words as W
from tokloom.llm.rows import drop_rows, small, text_key
from tokloom.session import prepare, save

PERMUTATIONS, BITS, BANDS, ROWS, NGRAM, THRESHOLD = 320, 4, 80, 4, 3, 0.5
#: Standard errors of the estimate at THRESHOLD by which a pair may fall below it.
MARGIN = 2.0
_equal = THRESHOLD + (1 - THRESHOLD) / 2**BITS
ACCEPT = THRESHOLD - MARGIN * (_equal * (1 - _equal) / PERMUTATIONS) ** 0.5 / (1 - 2.0**-BITS)
#: Shingles whose permutations are computed at a time.
BLOCK = 4096
#: Members of a candidate list that are compared in one piece; a longer list is cut into blocks, and each pair of blocks is a piece of its own.
LIST = 20000
#: Bits of the bitmap that keeps most bands of one member from being shuffled with their member: 8 MB.
BITMAP = 26

_rng = np.random.default_rng(7)
_MULTIPLY = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
_XOR = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)
_FOLD = _rng.integers(0, 2**64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_ALL = _rng.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_LOW = np.uint64(0x1111111111111111)


def minima(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(PERMUTATIONS, documents) minima of the 32-bit hashes between at[d] and at[d + 1]; each document has some."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    n, out = len(at) - 1, np.full((PERMUTATIONS, len(at) - 1), 0xFFFFFFFF, np.uint32)
    for low in range(0, len(x), BLOCK):
        high = min(low + BLOCK, len(x))
        first, last = int(np.searchsorted(at, low, "right")) - 1, int(np.searchsorted(at, high, "left"))
        starts = np.maximum(at[first:min(last, n)], low) - low
        h = (x[None, low:high] ^ _XOR[:, None]) * _MULTIPLY[:, None]
        part = np.minimum.reduceat(h, starts, axis=1)
        np.minimum(out[:, first : first + len(starts)], part, out=out[:, first : first + len(starts)])
    return out


def signatures(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed low bits (documents, words), band hashes (documents, BANDS), hash of all minima) of minima."""
    low = (m.T & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(m.shape[1], -1, 64 // BITS)
    packed = np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=2)
    wide = m.T.astype(np.uint64)
    bands = np.zeros((m.shape[1], BANDS), np.uint64)
    for r in range(ROWS):
        bands += W.mix(wide[:, r : BANDS * ROWS : ROWS] + np.uint64(r + 1)) * _FOLD[:, r]
    whole = np.zeros(m.shape[1], np.uint64)
    for k in range(PERMUTATIONS):
        whole += W.mix(wide[:, k] + np.uint64(k)) * _ALL[k]
    return packed, W.mix(bands).view(np.int64), W.mix(whole).view(np.int64)


def _minima(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """(minima, which documents have some). A text longer than a chunk is read in strips that share NGRAM - 1 words."""
    if len(at) == 2 and len(raw) > W.CHUNK:
        out = None
        for _, _, w in W.strips(raw, NGRAM - 1):
            grams, _, before = W.ngrams(w, NGRAM, short=False)
            if len(grams):
                m = minima(grams, before)
                out = m if out is None else np.minimum(out, m)
        if out is not None:
            return out, np.ones(1, bool)
    grams, _, before = W.ngrams(W.words(raw, at), NGRAM)
    has = np.diff(before) > 0
    return minima(grams, np.r_[before[:-1][has], before[-1]]) if has.any() else None, has


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, raw, at in W.slices(batches, 2):
        m, has = _minima(raw, at)
        if m is None:
            continue
        packed, bands, whole = signatures(m)
        keep, width = pa.array(has), packed.shape[1] * 8
        yield pa.RecordBatch.from_arrays(
            [
                rows.column(0).filter(keep),
                rows.column(1).filter(keep),
                pa.array(whole),
                pa.Array.from_buffers(pa.binary(), len(whole), [None, pa.py_buffer((np.arange(len(whole) + 1) * width).astype(np.int32)), pa.py_buffer(packed.tobytes())]),
                pa.ListArray.from_arrays(pa.array(np.arange(len(whole) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel())),
            ],
            names=["id", "h", "f", "sig", "bands"],
        )


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected estimate of J from packed signatures along the last axis."""
    x = a ^ b
    for s in (1, 2):
        x = x | (x >> np.uint64(s))
    equal = PERMUTATIONS - np.bitwise_count(x & _LOW).sum(axis=-1, dtype=np.int64)
    chance = 2.0**-BITS
    return (equal / PERMUTATIONS - chance) / (1 - chance)


def _linked(f: np.ndarray, sig: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges that join the components of one candidate list."""
    rest = np.arange(len(f))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = similarity(sig[rest], sig[at]) >= ACCEPT
            for k in rest[near]:
                yield int(f[at]), int(f[k])
            queue += rest[near].tolist()
            rest = rest[~near]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(0)
        size = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        f = flat.field(0).to_numpy()
        sig = W.string_buffers(flat.field(1))[0].view(np.uint64).reshape(len(f), -1)
        at = np.r_[0, np.cumsum(size)]
        two = at[:-1][size == 2]
        near = similarity(sig[two], sig[two + 1]) >= ACCEPT
        a, b = [f[two[near]]], [f[two[near] + 1]]
        for k in np.flatnonzero(size > 2):
            if pairs := list(_linked(f[at[k] : at[k + 1]], sig[at[k] : at[k + 1]])):
                x, y = np.array(pairs, np.int64).T
                a.append(x), b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b), by alternating large and small stars; root is the least node."""

    def star(e: DataFrame, name: str, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        joined = both.join(least, "u").withColumn("m", F.least("m", "u"))
        if large:
            out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return save(out.where("a <> b").distinct(), name)

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now, last = edges, None
    while True:
        now = star(star(now, "star-large", True), "star-small", False)
        if (s := state(now)) == last:
            break
        last = s
    # at the end every node but a root has the one edge to its root
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _copies(sigs: DataFrame) -> DataFrame:
    """(f, c, low, high) of the nodes of several documents; low and high differ where signatures do."""
    sig = F.xxhash64("sig")
    return save(sigs.groupBy("f").agg(F.count(F.lit(1)).alias("c"), F.min(sig).alias("low"), F.max(sig).alias("high")).where("c > 1"), "minhash-copies")


def _bitmap(busy: DataFrame) -> np.ndarray:
    """2^BITMAP bits, of fixed size whatever the corpus, with one at the first bits of the hash of each busy band. Where it fills up, more goes on to the join that decides."""
    words = busy.select(F.shiftrightunsigned("b", 64 - BITMAP).alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(s & 63 AS int)))").alias("x")).toArrow()
    bits = np.zeros(1 << BITMAP - 6, np.int64)
    bits[words.column("w").to_numpy()] = words.column("x").to_numpy()
    return bits.view(np.uint8)


def _hits(bitmap):
    """From (f, bands) to (f, b) of the bands that may be busy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = batch.column(1).flatten().to_numpy()
            slot = bands.view(np.uint64) >> np.uint64(64 - BITMAP)
            hit = np.flatnonzero(bitmap.value[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hit // BANDS)), pa.array(bands[hit])], names=["f", "b"])

    return run


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A saved table (id, h, root, sig) of the documents of all near-duplicate groups; h is text_key."""
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)[doc_id]
    has = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), text_key(F.col(text)).alias("h"), F.col(text).alias("t"))
    sigs = save(has.mapInArrow(_sign, f"id {kind}, h long, f long, sig binary, bands array<long>"), "minhash-signatures")
    copies = _copies(sigs)
    chance = copies.where("low <> high").select("f", F.lit(True).alias("shared"))
    if not chance.isEmpty():  # of 10^11 documents a few hundred are expected to share an f and no signature
        f = F.when(F.col("shared"), F.xxhash64("f", "sig")).otherwise(F.col("f"))
        sigs = save(sigs.join(small(chance, 16), "f", "left").withColumn("f", f).drop("shared"), "minhash-signatures")
        copies = _copies(sigs)
    nodes = save(sigs.select("f", "sig", "bands").dropDuplicates(["f"]), "minhash-nodes")
    # bands of two nodes or more, by partial counts: a band's members are counted and hashed as a set, never gathered in one row or task
    members = nodes.select("f", F.explode("bands").alias("b"))
    busy = save(members.groupBy("b").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("b"), "minhash-busy")
    near = nodes.select("f", "bands").mapInArrow(_hits(docs.sparkSession.sparkContext.broadcast(_bitmap(busy))), "f long, b long")
    pairs = save(near.join(small(busy, 8), "b"), "minhash-bands")
    # of bands with equal members one goes on
    sets = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("f")).alias("x"), F.bit_xor(F.xxhash64("f", F.lit(1))).alias("y"))
    lists = sets.groupBy("c", "x", "y").agg(F.min("b").alias("b")).select("b", F.ceil(F.col("c") / LIST).cast("int").alias("n"))
    members = pairs.join(lists, "b").select(F.col("b").alias("k"), "n", "f").withColumn("i", F.pmod(F.xxhash64("f"), "n").cast("int"))
    # block i is compared with itself and with every other block j: pieces (i, i) and (i, j)
    pieces = members.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("k", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "f")
    candidates = pieces.join(nodes.select("f", "sig"), "f").groupBy("k", "i", "j").agg(F.collect_list(F.struct("f", "sig")).alias("l")).select("l")
    edges = save(candidates.mapInArrow(_verify, "a long, b long").distinct(), "minhash-edges")
    roots = components(edges)
    copies = copies.select("f")
    grouped = copies.join(roots, copies["f"] == roots["node"], "full").select(F.coalesce("f", "node").alias("f"), F.coalesce("root", "f").alias("root"))
    return save(sigs.select("id", "h", "f", "sig").join(grouped, "f").select("id", "h", "root", "sig"), "minhash-groups")


def _kept(found: DataFrame) -> DataFrame:
    return found.groupBy("root").agg(F.min_by(F.struct("id", "h", "sig"), F.struct(F.col("id").isNull(), "id", "h")).alias("k"))


def _similarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (W.string_buffers(batch.column(i))[0].view(np.uint64).reshape(batch.num_rows, -1) for i in (2, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(similarity(a, b), 4))], names=["doc_id", "kept_doc_id", "similarity"])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kept_doc_id, similarity to it, estimated): a row for each document that has a near-duplicate which stays."""
    found = groups(docs, doc_id, text).distinct()
    pairs = found.join(_kept(found), "root").where("NOT (id <=> k.id AND h = k.h)").select("id", F.col("k.id").alias("kept"), "sig", F.col("k.sig").alias("ksig"))
    kind = dict(docs.dtypes)[doc_id]
    return pairs.mapInArrow(_similarity, f"doc_id {kind}, kept_doc_id {kind}, similarity double")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates."""
    found = groups(docs, doc_id, text)
    rows = found.groupBy("root", "id", "h").agg(F.count(F.lit(1)).alias("c"))
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "h")).alias("k"))
    flagged = save(rows.join(kept, "root").select("id", "h", "c", (F.col("id").eqNullSafe(F.col("k.id")) & (F.col("h") == F.col("k.h"))).alias("stays")), "minhash-rows")
    return drop_rows(docs, flagged.where("NOT stays").select("id", "h"), flagged.where("stays AND c > 1").select("id", "h"), doc_id, text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
