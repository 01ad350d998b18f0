"""The same operators on streams. All are stateless per row, so a stream needs no watermark, and a batch gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tokloom.encoding import Encoding
from tokloom.functions.tokens import count_tokens, encode_ordinary


def read(spark: SparkSession, path: str, schema: StructType, **options: str) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def encoded(stream: DataFrame, text: str, encoding: Encoding, *keys: str) -> DataFrame:
    """(keys..., ids, n_tokens) of a stream."""
    return stream.select(*keys, encode_ordinary(F.col(text), encoding).alias("ids")).withColumn("n_tokens", F.size("ids"))


def counted(stream: DataFrame, text: str, encoding: Encoding, *keys: str) -> DataFrame:
    return stream.select(*keys, count_tokens(F.col(text), encoding).alias("n_tokens"))


def write(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, exactly once; ends when what is there now has been read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
