"""Set-based plans: corpora cut into texts, distinct-piece encoding, decoding by join, flat batches, counters and statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StructField, StructType

from tokloom.encoding import Encoding, worker_encoding
from tokloom.functions.grammars import pieces
from tokloom.functions.tokens import encode_ordinary
from tokloom.functions.unicode import nfc
from tokloom.operators.bpe import merge_counts, split
from tokloom.operators.trie import Trie
from tokloom.plans.numbering import numbered
from tokloom.session import prepare, save

#: A vocabulary is broadcast if its tokens, with what a hash table adds to each, stay below so many bytes; beyond, its joins shuffle.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 64
#: The most frequent pieces, of at most so many bytes each, that the set plan joins by broadcast: 2^16 of them are 26 MB at most. All others are joined by a shuffle, with little skew.
FREQUENT, FREQUENT_BYTES = 1 << 16, 64


def paragraphs(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys..., pos, text): the parts between blank lines that are not empty."""
    return df.select(*keys, F.posexplode(F.filter(F.split(F.col(text), "\n\n"), lambda x: x != "")).alias("pos", "text"))


def lines(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys..., pos, text): lines without their ends; what follows the last end is a line only if it is not empty."""
    all_lines = F.split(F.col(text), "\r?\n")
    return df.select(*keys, F.posexplode(F.when(F.element_at(all_lines, -1) == "", F.slice(all_lines, 1, F.size(all_lines) - 1)).otherwise(all_lines)).alias("pos", "text"))


def vocabulary(spark: SparkSession, encoding: Encoding) -> DataFrame:
    """(token, id), hinted for broadcast if its size allows."""
    table = pa.table({"token": pa.array(encoding.ranks.keys(), pa.binary()), "id": pa.array(encoding.ranks.values(), pa.int32())})
    return _hinted(spark.createDataFrame(table.to_pandas(), "token binary, id int"), encoding.ranks)


def _hinted(df: DataFrame, tokens: Iterable[bytes]) -> DataFrame:
    return F.broadcast(df) if sum(len(t) + ROW_BYTES for t in tokens) <= BROADCAST_BYTES else df


def piece_table(found: DataFrame, encoding: Encoding) -> DataFrame:
    """(piece, n, ids, hit) of the distinct pieces of ``found``: those that are tokens by a join, the rest by merges."""
    spark = prepare(found.sparkSession)
    distinct = found.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).withColumn("token", F.col("piece").cast("binary"))
    looked = distinct.join(vocabulary(spark, encoding), "token", "left").select("piece", "n", "id")
    return looked.mapInArrow(_merge(encoding.shared(spark)), "piece string, n long, ids array<int>, hit boolean")


def _merge(blob):
    """Pieces that are tokens and pieces to be merged in one pass, since the pieces would be cut and counted again for each of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_encoding(blob.value).encode_pieces
        for b in batches:
            hit = b.column(2).is_valid()
            for rows, known in ((b.filter(hit), True), (b.filter(pc.invert(hit)), False)):
                piece, n, i = rows.columns
                ids = pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1, dtype=np.int32)), i) if known else encode(piece)
                yield pa.RecordBatch.from_arrays([piece, n, ids, pa.array(np.full(len(i), known))], names=["piece", "n", "ids", "hit"])

    return run


def set_runs(df: DataFrame, text: str, encoding: Encoding, *keys: str) -> DataFrame:
    """(keys..., first, ids): the ids of runs of successive pieces, in no order, by encoding each distinct piece once and joining it back; first is the place of a run's first piece.

    The frequent pieces are joined by broadcast, so that none is a hot task of the shuffle that joins the others. Those that follow each other are put together before anything else is shuffled; each of the others is a run.
    """
    source = df.withColumn(text, nfc(F.col(text))) if encoding.nfc else df
    found = pieces(source, text, encoding.grammar, *keys)
    table = save(piece_table(found, encoding).select("piece", "n", "ids"), "pieces")
    some = table.where(F.octet_length("piece") <= FREQUENT_BYTES).orderBy(F.desc("n"), "piece").limit(FREQUENT)
    near = found.join(F.broadcast(some.select("piece", "ids")), "piece", "left")
    far = near.where("ids IS NULL").drop("ids").join(table.select("piece", "ids"), "piece")
    rows = near.select(*keys, F.col("pos").alias("first"), "ids")
    return rows.mapInArrow(_packed(rows.schema), rows.schema).union(far.select(*keys, F.col("pos").alias("first"), "ids"))


def _new_keys(columns: list[pa.Array]) -> np.ndarray:
    """Whether each row's keys are others than those of the row before; the first row's are not."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        if pa.types.is_nested(c.type):
            x = c.to_pylist()
            new[1:] |= [a != b for a, b in zip(x, x[1:], strict=False)]
        else:
            null = c.is_null().to_numpy(zero_copy_only=False)
            differ = pc.not_equal(c[1:], c[:-1]).fill_null(False).to_numpy(zero_copy_only=False)
            new[1:] |= differ | (null[1:] != null[:-1])
    return new


def _packed(schema: StructType):
    """Puts the ids of successive pieces of a text together, for mapInArrow over (keys..., first, ids); rows with null ids are dropped."""
    names, kind = schema.names, to_arrow_type(schema["ids"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            *keys, first, ids = (b.column(n) for n in names)
            here, place = ids.is_valid().to_numpy(zero_copy_only=False), first.to_numpy()
            if not here.any():
                continue
            begin = np.r_[True, ~here[:-1] | (place[1:] != place[:-1] + 1)]
            if keys:
                begin |= _new_keys(keys)
            begin = np.flatnonzero(here & begin)
            size = np.where(here, ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
            offsets = np.r_[0, np.cumsum(size)][np.r_[begin, len(here)]].astype(np.int32)
            runs = pa.ListArray.from_arrays(pa.array(offsets), ids.flatten()).cast(kind)
            yield pa.RecordBatch.from_arrays([*(k.take(pa.array(begin)) for k in (*keys, first)), runs], names=names)

    return run


def encode_set(df: DataFrame, text: str, encoding: Encoding, *keys: str) -> DataFrame:
    """(keys..., pos, id): a row for each token, by encoding each distinct piece once and joining it back.

    What is shuffled to be put in order within the keys, which should name few rows, is runs of ids, not tokens; ``token_rows`` gives the same without a shuffle.
    """
    runs = set_runs(df, text, encoding, *keys)
    ordered = runs.repartition(*keys) if keys else runs.repartition(1)
    schema = StructType([*(runs.schema[k] for k in keys), StructField("pos", IntegerType()), StructField("id", IntegerType())])
    return ordered.sortWithinPartitions(*keys, "first").mapInArrow(_laid_out(schema), schema)


def _laid_out(schema: StructType):
    """A row for each id of the runs (keys..., first, ids), in order, with its place among those of its keys, for mapInArrow."""
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            *keys, _, ids = b.columns
            size = ids.value_lengths().to_numpy().astype(np.int64)
            before = np.cumsum(size) - size
            new = np.zeros(len(size), bool)
            if keys:
                new = _new_keys(keys)
                new[0] = last is not None and [k[0].as_py() for k in keys] != last
            # tokens of the row's keys before the row
            start = np.maximum.accumulate(np.where(new, before, -1))
            at = np.where(start >= 0, before - start, before + count)
            last, count = [k[-1].as_py() for k in keys], int(at[-1] + size[-1])
            row = np.repeat(np.arange(len(size)), size)
            pos = (np.arange(len(row)) + np.repeat(at - before, size)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(k.take(pa.array(row)) for k in keys), pa.array(pos), ids.flatten()], names=names)

    return run


def token_rows(df: DataFrame, text: str, encoding: Encoding, *keys: str, every: bool = False) -> DataFrame:
    """(keys..., pos, id): a row for each token, by the row plan; no shuffle. With ``every``, an empty text is a row of null pos, and a null text one of pos 0 and a null id."""
    ids = encode_ordinary(F.col(text), encoding)
    rows = F.posexplode_outer(F.coalesce(ids, F.array(F.lit(None).cast("int")))) if every else F.posexplode(ids)
    return df.select(*keys, rows.alias("pos", "id"))


def token_histogram(df: DataFrame, text: str, encoding: Encoding, longest_match: bool = False) -> DataFrame:
    """(id, n): how often each token occurs; nothing is joined back to the texts. With ``longest_match`` the distinct pieces are encoded by longest matches with backtracking."""
    source = df.withColumn(text, nfc(F.col(text))) if encoding.nfc else df
    found = pieces(source, text, encoding.grammar)
    table = found.groupBy("piece").agg(F.count(F.lit(1)).alias("n")) if longest_match else piece_table(found, encoding)
    if longest_match:
        table = by_piece(table, encoding, lambda e, p, trie: (trie.encode(p),), "ids array<int>")
    return table.select("n", F.explode("ids").alias("id")).groupBy("id").agg(F.sum("n").alias("n"))


def by_piece(table: DataFrame, encoding: Encoding, f: Callable, columns: str) -> DataFrame:
    """``table`` with further columns, which ``f`` gives as a tuple from the encoding, the bytes of column piece, and a trie that each task keeps."""
    blob = encoding.shared(prepare(table.sparkSession))
    more = StructType.fromDDL(columns)
    schema, at = StructType([*table.schema, *more]), table.columns.index("piece")
    kinds = [to_arrow_type(c.dataType) for c in more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = worker_encoding(blob.value)
        trie = Trie(e.ranks)
        for b in batches:
            out = [f(e, p.encode() if isinstance(p, str) else p, trie) for p in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds))], names=schema.names)

    return table.mapInArrow(run, schema)


def longest_prefixes(table: DataFrame, encoding: Encoding) -> DataFrame:
    """(piece, id): the longest token that begins each distinct piece, a string or binary, by a join on its beginnings."""
    v = vocabulary(table.sparkSession, encoding).select("token", "id")
    longest = max(map(len, encoding.ranks))
    cut = table.select("piece", F.col("piece").cast("binary").alias("b")).where("octet_length(b) > 0")
    cut = cut.select("piece", "b", F.explode(F.expr(f"sequence(1, least(octet_length(b), {longest}))")).alias("k"))
    return cut.join(v, F.expr("substring(b, 1, k)") == F.col("token")).groupBy("piece").agg(F.max_by("id", "k").alias("id"))


def splits(spark: SparkSession, encoding: Encoding) -> DataFrame:
    """(id, left, right): the two tokens that merges make each token of, (id, id) where they are not two; tokens of several bytes with (id, id) are never made by merges."""
    tokens = vocabulary(spark, encoding).withColumnRenamed("token", "piece").repartition(spark.sparkContext.defaultParallelism)
    return by_piece(tokens, encoding, lambda e, p, trie: split(p, e.ranks), "left int, right int").select("id", "left", "right")


def first_pairs(table: DataFrame, encoding: Encoding) -> DataFrame:
    """(piece, first, second, valid): the longest token that begins each piece, the longest one after it, and whether merges leave them beside each other; pieces that one token covers are left out."""

    def pair(e: Encoding, p: bytes, trie: Trie) -> tuple:
        first = trie.next_match(p)
        size = len(trie.tokens[first]) if p else 0
        second = trie.next_match(p, size) if size < len(p) else None
        return first, second, None if second is None else trie.valid(first, second)

    return by_piece(table, encoding, pair, "first int, second int, valid boolean").where("second IS NOT NULL")


def merge_profile(df: DataFrame, text: str, encoding: Encoding) -> DataFrame:
    """One row: merges and lookups of the encoding by merges, and next_match, is_valid, tokens and backtrack of that by longest matches, over all pieces."""

    def count(e: Encoding, p: bytes, trie: Trie) -> tuple:
        _, merges, lookups = merge_counts(p, e.ranks)
        before = trie.n.copy()
        trie.encode(p)
        return merges, lookups, *(trie.n[k] - before[k] for k in names)

    names = ["next_match", "nm_steps", "is_valid", "tokens", "backtrack"]
    table = pieces(df, text, encoding.grammar).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    counts = by_piece(table, encoding, count, ", ".join(f"{k} long" for k in ["merges", "lookups", *names]))
    return counts.agg(*(F.coalesce(F.sum(F.col("n") * F.col(k)), F.lit(0)).alias(k) for k in ["merges", "lookups", *names]))


def decode_set(tokens: DataFrame, encoding: Encoding, *keys: str) -> DataFrame:
    """(keys..., bytes, invalid_id) of (keys..., pos, id): by a join on id; bytes is null where an id is unknown, and invalid_id the first such. A row of null pos is no token: keys with no other row have empty bytes."""
    spark = prepare(tokens.sparkSession)
    table = pa.table({"id": pa.array(encoding.by_id.keys(), pa.int64()), "token": pa.array(encoding.by_id.values(), pa.binary())}).to_pandas()
    by_id = _hinted(spark.createDataFrame(table, "id long, token binary"), encoding.by_id.values())
    joined = tokens.withColumn("id", F.col("id").cast("long")).join(by_id, "id", "left")
    parts = F.array_sort(F.collect_list(F.struct("pos", F.hex("token").alias("h"))))
    out = joined.groupBy(*keys).agg(parts.alias("parts"), F.min_by("id", F.when(F.col("token").isNull(), F.col("pos"))).alias("bad"), F.count_if(F.col("token").isNull() & F.col("pos").isNotNull()).alias("n_bad"))
    whole = F.unhex(F.array_join(F.transform("parts", lambda x: x["h"]), ""))
    return out.select(*keys, F.when(F.col("n_bad") == 0, whole).alias("bytes"), F.when(F.col("n_bad") > 0, F.col("bad")).alias("invalid_id"))


def flat_offsets(counts: DataFrame, key: str, n: str) -> DataFrame:
    """(key, start, end): where each text's tokens lie when all are laid end to end in order of a key of any type.

    Every row has its place: a null key is last, equal keys are in any order, a null count is 0.
    """
    rows = _flat(counts, key, n)
    return rows.select(key, F.col("before").alias("start"), (F.col("before") + F.col("_n")).alias("end"))


def flat_index(counts: DataFrame, key: str, n: str) -> DataFrame:
    """(i, offset), n + 1 rows for n texts: where the i-th text begins, and at the end their total; (0, 0) alone for none."""
    rows = _flat(counts, key, n)
    total = rows.agg(F.count(F.lit(1)).alias("i"), F.coalesce(F.sum("_n"), F.lit(0)).alias("offset"))
    return rows.select(F.col("r").alias("i"), F.col("before").alias("offset")).union(total)


def flat_tokens(df: DataFrame, text: str, encoding: Encoding, key: str) -> DataFrame:
    """(at, id): the tokens of all texts, laid end to end in order of a key; a null text has none."""
    ids = df.select(F.col(key).alias("_k"), encode_ordinary(F.col(text), encoding).alias("ids")).withColumn("_n", F.coalesce(F.size("ids"), F.lit(0)).cast("long"))
    rows = numbered(save(ids, "flat"), None, ["_k"], "_n")
    return rows.select("before", F.posexplode("ids").alias("pos", "id")).select((F.col("before") + F.col("pos")).alias("at"), "id")


def _flat(counts: DataFrame, key: str, n: str) -> DataFrame:
    return numbered(save(counts.select(key, F.coalesce(F.col(n), F.lit(0)).cast("long").alias("_n")), "flat"), None, [key], "_n")


def profile(df: DataFrame, text: str, encoding: Encoding) -> DataFrame:
    """One row of counters over all pieces: pieces, single_byte, whole_hit, merged, tokens, and the distinct pieces."""
    t = piece_table(pieces(df, text, encoding.grammar), encoding).withColumn("size", F.octet_length("piece"))
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    return t.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("pieces"),
        total(F.col("size") == 1).alias("single_byte"),
        total((F.col("size") > 1) & F.col("hit")).alias("whole_hit"),
        total(~F.col("hit")).alias("merged"),
        F.coalesce(F.sum(F.col("n") * F.size("ids")), F.lit(0)).alias("tokens"),
        F.count(F.lit(1)).alias("distinct_pieces"),
    )


def differences(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of (keys, pos) whose value differs between two encodings of the same texts, or is missing in one."""
    on = [*keys, "pos"]
    both = a.select(*on, F.col(value).alias("_a")).join(b.select(*on, F.col(value).alias("_b")), on, "full")
    return both.where("NOT (_a <=> _b)")


def list_differences(runs: DataFrame, lists: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n_different, n_tokens): places at which the ids of ``runs`` (keys..., first, ids), in order of first, and of ``lists`` (keys..., ids) differ or one has none, and the tokens of the latter.

    Both are shuffled once, as lists; no token is a row.
    """
    both = runs.select(*keys, "first", "ids").union(lists.select(*keys, F.lit(-1), "ids"))
    parts = F.sort_array(F.collect_list(F.struct("first", "ids")))
    ids = lambda keep: F.flatten(F.transform(F.filter("_r", keep), lambda x: F.coalesce(x["ids"], F.array().cast("array<int>"))))
    a = both.groupBy(*keys).agg(parts.alias("_r")).select(*keys, ids(lambda x: x["first"] >= 0).alias("_a"), ids(lambda x: x["first"] < 0).alias("_b"))
    different = F.size(F.filter(F.zip_with("_a", "_b", lambda x, y: ~x.eqNullSafe(y)), lambda x: x))
    return a.select(*keys, F.when(F.col("_a") == F.col("_b"), 0).otherwise(different).alias("n_different"), F.size("_b").alias("n_tokens"))


def next_prefixes(spark: SparkSession, encoding: Encoding) -> DataFrame:
    """(id, prefix_id): the longest token that is a proper prefix of each token, by a join on prefixes; null where there is none."""
    v = vocabulary(spark, encoding)
    cut = v.select("id", F.explode(F.expr("CASE WHEN octet_length(token) > 1 THEN sequence(1, octet_length(token) - 1) ELSE array() END")).alias("k"), "token")
    shorter = vocabulary(spark, encoding).select(F.col("token").alias("p"), F.col("id").alias("prefix_id"))
    best = cut.join(shorter, F.expr("substring(token, 1, k)") == F.col("p")).groupBy("id").agg(F.max_by("prefix_id", "k").alias("prefix_id"))
    return v.select("id").join(best, "id", "left")


def statistics(df: DataFrame, column: str) -> DataFrame:
    """(n, least, median, mean, stdev, cv): of timings or counts; stdev is that of a sample, cv its percentage of the mean."""
    c = F.col(column)
    return df.agg(F.count(c).alias("n"), F.min(c).alias("least"), F.median(c).alias("median"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("stdev"), (100 * F.stddev_samp(c) / F.avg(c)).alias("cv"))


def rates(df: DataFrame, n_bytes: str, seconds: str) -> DataFrame:
    """``df`` with mb_s and mib_s, megabytes of 10^6 and of 2^20 bytes a second; null where no time passed."""
    return df.withColumns({"mb_s": F.try_divide(F.col(n_bytes), F.col(seconds) * 1e6), "mib_s": F.try_divide(F.col(n_bytes), F.col(seconds) * 2**20)})


def throughput(n_bytes: int, seconds: float) -> dict[str, float]:
    """MB/s of 10^6 and MiB/s of 2^20 bytes."""
    return {"mb_s": n_bytes / seconds / 1e6, "mib_s": n_bytes / seconds / 2**20}
