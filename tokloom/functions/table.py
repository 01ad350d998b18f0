"""A table function: tokens(text) as rows, for LATERAL joins in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tokloom.encoding import Encoding, sliced, worker_encoding
from tokloom.session import prepare


def register_tokens(spark: SparkSession, encoding: Encoding, name: str = "tokens") -> None:
    """``SELECT ... FROM docs, LATERAL tokens(text)`` gives (pos, id, bytes, start, end); start and end count bytes of the normalized text.

    ``LATERAL tokens_ids(text)`` gives (pos, id) alone, much faster: whole Arrow columns are encoded, by the function tokens_list, and Spark makes rows of the lists.
    """
    prepare(spark)
    blob = encoding.shared(spark)

    # a table function over whole Arrow columns cannot stand in a lateral join
    @F.udtf(returnType="pos int, id int, bytes binary, start int, end int", useArrow=True)
    class Tokens:
        def eval(self, text: str) -> Iterator[tuple]:
            if text is None:
                return
            e, at = worker_encoding(blob.value), 0
            for pos, i in enumerate(e.encode_ordinary(text)):
                token = e.by_id[i]
                yield pos, i, token, at, at + len(token)
                at += len(token)

    spark.udtf.register(name, Tokens)

    @F.arrow_udf("array<int>")
    def ids(column: pa.Array) -> pa.Array:
        return sliced(column, worker_encoding(blob.value).encode_column)

    spark.udf.register(f"{name}_list", ids)
    # a generator alone in its SELECT: any more between it and the text, and Spark joins the texts
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_ids(text STRING) RETURNS TABLE (pos INT, id INT) RETURN SELECT posexplode({name}_list(text)) AS (pos, id)")
