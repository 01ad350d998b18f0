"""Exact dedup by distributed MSD radix partitioning.

A document is the byte string (length, bytes). Groups start from the length and the first bytes and are split again
and again by the next, ever longer, run of bytes. A group of one is finished: its document has no copy. A group whose
documents have ended is a group of copies. No digest decides equality: all bytes of every reported pair were compared.

The first split moves HEAD bytes of each document. Only documents that share these go on, with row numbers given in a
saved table. Each further split moves the next run of bytes of the documents that are still in a group, so all splits
together move each surviving text about twice. Groups are aggregated with map-side partial sums, so that one that
millions share is no hot task, and AQE splits a skewed join back.

Rows: a null text has no copies and stays. Empty texts are copies of each other. Of equal texts the row with the least
doc_id stays, null ids last; rows that are equal in doc_id and text count as copies, too. A very long text is compared in runs of at most MOST bytes. Ids may be of any type with an order. Other columns and their names
are of no matter. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokloom.llm.rows import positional, small
from tokloom.session import prepare, save

HEAD, FIRST, GROWTH, MOST = 32, 512, 8, 4 << 20


def _head(rows: DataFrame, text: str) -> DataFrame:
    return rows.withColumns({"__n": F.octet_length(text), "__s": F.substring(F.col(text).cast("binary"), 1, HEAD)})


def _split(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows (rid, id, n, by...) to (rid, id, n, g) for the groups of two or more; g is a row number of the group."""
    groups = rows.groupBy(*by).agg(F.min("rid").alias("g2"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    return rows.join(groups, by).select("rid", "id", "n", F.col("g2").alias("g"))


def radix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(keys, rows, copies). keys: heads that documents share; rows: the documents with such a head, columns c0...,
    and rid; copies: (rid, id, kept_rid, kept_id) of each row that is a copy of a kept one."""
    prepare(docs.sparkSession)
    at = {c: f"c{i}" for i, c in reversed(list(enumerate(docs.columns)))}
    t, i = at[text], at[doc_id]
    heads = _head(positional(docs).where(F.col(t).isNotNull()), t)
    keys = save(heads.groupBy("__n", "__s").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("__n", "__s"), "radix-keys")
    rows = save(heads.join(small(keys, 64), ["__n", "__s"], "left_semi").withColumn("rid", F.monotonically_increasing_id()), "radix-rows")
    texts = rows.select("rid", F.col(i).alias("id"), F.col("__n").alias("n"), F.col(t).cast("binary").alias("t"))

    off, ended = FIRST, []
    state = save(_split(texts.select("rid", "id", "n", F.substring("t", 1, off).alias("s")), ["n", "s"]), "radix-0")
    while True:
        ended.append(state.where(F.col("n") <= off))
        active = state.where(F.col("n") > off)
        if active.isEmpty():
            break
        width = min(off * (GROWTH - 1), MOST)
        part = texts.where(F.col("n") > off).select("rid", F.substring("t", off + 1, width).alias("s"))
        state = save(_split(active.join(part, "rid"), ["g", "s"]), f"radix-{off}")
        off += width
    groups = reduce(DataFrame.union, ended)
    order = F.struct(F.col("id").isNull().alias("z"), "id", "rid")
    kept = groups.groupBy("g").agg(F.min(order).alias("k"))
    copies = groups.join(kept, "g").where("rid <> k.rid").select("rid", "id", F.col("k.rid").alias("kept_rid"), F.col("k.id").alias("kept_id"))
    return keys, rows, copies


def duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kept_doc_id): a row for each document that is a copy of the one that stays."""
    return radix(docs.select(doc_id, text), doc_id, text)[2].select(F.col("id").alias("doc_id"), F.col("kept_id").alias("kept_doc_id"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts."""
    at = {c: f"c{i}" for i, c in reversed(list(enumerate(docs.columns)))}
    keys, rows, copies = radix(docs, doc_id, text)
    data = [f"c{i}" for i in range(len(docs.columns))]
    alone = _head(positional(docs), at[text]).join(small(keys, 64), ["__n", "__s"], "left_anti").select(data)
    return alone.union(rows.join(small(save(copies.select("rid"), "radix-copies"), 8), "rid", "left_anti").select(data)).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
SELECT doc_id, kept_doc_id FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept_doc_id,
         row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) AS rn
  FROM documents WHERE text IS NOT NULL)
WHERE rn > 1"""
