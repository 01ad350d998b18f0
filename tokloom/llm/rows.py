"""Row identity and keep/drop helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A join side is broadcast only if its rows, at their width and what a hash table adds, stay below this; beyond it, the join shuffles.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 64


def positional(df: DataFrame) -> DataFrame:
    """The rows with columns c0, c1, ...: names of the caller can then clash with nothing."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, a saved table, with a broadcast hint if it is small; else without one, and the join is a shuffled one."""
    return F.broadcast(df) if df.count() * (row_bytes + ROW_BYTES) <= limit else df


def text_key(text: Column) -> Column:
    """64 bits of a text, which with doc_id name a row."""
    return F.xxhash64(text)


def drop_rows(docs: DataFrame, dropped: DataFrame, repeated: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows named by ``dropped``, and one row only for each named by ``repeated``.

    Both are saved tables with columns (id, h): doc_id, which may be null, and text_key(text).
    """
    names, at = docs.columns, {c: f"c{i}" for i, c in reversed(list(enumerate(docs.columns)))}
    rows = positional(docs).withColumn("__h", text_key(F.col(at[text])))

    def match(d: DataFrame, right: DataFrame, how: str) -> DataFrame:
        r = small(right, 24)
        return d.join(r, d[at[doc_id]].eqNullSafe(r["id"]) & (d["__h"] == r["h"]), how)

    # a null text has no key, matches nothing and stays
    kept = match(rows, dropped, "left_anti")
    if repeated.isEmpty():
        return kept.drop("__h").toDF(*names)
    once = match(kept, repeated, "left_semi").dropDuplicates([at[doc_id], "__h"])
    return match(kept, repeated, "left_anti").union(once).drop("__h").toDF(*names)
