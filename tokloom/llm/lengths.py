"""Exact length histogram of the documents in tokens.

Documents are encoded whole and aggregated by encoded length, with map-side partial sums: one number per distinct
length leaves each task. Sums over the sorted histogram, whose size is bounded by the longest document and not by the
number of documents, answer totals, quantiles and truncated totals for every context limit exactly.

Rows: null texts have no length and are left out; an empty text has length 0. A very long text is counted whole, in parts that end where pieces do. Repeated rows count each; documents of one length are one row. Extra columns are of no matter; an
empty table gives an empty histogram, of total 0 and without quantiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokloom.llm.tokens import RANKS, counted


def histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """A row for each length: n_docs of it; docs_up_to and tokens_up_to it; docs_longer and tokens_longer than it (suffix sums);
    truncated_total, the tokens left if every document is cut at it."""
    counts = lengths.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))
    up = Window.orderBy("length")
    after = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    tokens = F.col("length") * F.col("n_docs")
    h = counts.withColumns({"docs_up_to": F.sum("n_docs").over(up), "tokens_up_to": F.sum(tokens).over(up)})
    h = h.withColumns({"docs_longer": F.coalesce(F.sum("n_docs").over(after), F.lit(0)), "tokens_longer": F.coalesce(F.sum(tokens).over(after), F.lit(0))})
    return h.withColumn("truncated_total", F.col("tokens_up_to") + F.col("length") * F.col("docs_longer"))


def total(h: DataFrame) -> DataFrame:
    """(n_docs, n_tokens) of the whole."""
    return h.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum(F.col("length") * F.col("n_docs")), F.lit(0)).alias("n_tokens"))


def quantiles(h: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the least length that at least this share of the documents do not exceed."""
    asked = h.sparkSession.createDataFrame([(float(s),) for s in shares], "share double")
    n = h.agg(F.sum("n_docs").alias("n"))
    return asked.crossJoin(n).join(h, F.col("docs_up_to") >= F.greatest(F.ceil(F.col("share") * F.col("n")), F.lit(1))).groupBy("share").agg(F.min("length").alias("length"))


def truncated(h: DataFrame, limits: list[int]) -> DataFrame:
    """(context, n_tokens, n_cut): tokens that are left and documents that are cut at each context limit."""
    asked = h.sparkSession.createDataFrame([(int(x),) for x in limits], "context long")
    n = F.least("length", "context") * F.col("n_docs")
    cut = F.when(F.col("length") > F.col("context"), F.col("n_docs")).otherwise(0)
    return asked.join(h, F.lit(True), "left").groupBy("context").agg(F.coalesce(F.sum(n), F.lit(0)).alias("n_tokens"), F.coalesce(F.sum(cut), F.lit(0)).alias("n_cut"))


def query(spark: SparkSession, sf_dir: str, ranks: str = RANKS) -> DataFrame:
    return histogram(counted(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks))
