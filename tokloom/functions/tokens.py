"""Encode, count and decode as column functions: one Arrow pass per text, in workers that keep the vocabulary."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tokloom.encoding import Encoding, allowed_ids, sliced, worker_encoding
from tokloom.session import prepare


def _session() -> SparkSession:
    return prepare(SparkSession.active())


def encode_ordinary(text: Column, encoding: Encoding) -> Column:
    """array<int>; null for a null text, [] for an empty one."""
    blob = encoding.shared(_session())

    @F.arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        return sliced(column, worker_encoding(blob.value).encode_column)

    return run(text)


def count_tokens(text: Column, encoding: Encoding) -> Column:
    """The number of ids; no list of them leaves the worker."""
    blob = encoding.shared(_session())

    @F.arrow_udf("int")
    def run(column: pa.Array) -> pa.Array:
        return sliced(column, worker_encoding(blob.value).count_column)

    return run(text)


def try_encode(text: Column, encoding: Encoding, allowed: str | Iterable[str] | None = None) -> Column:
    """struct(ids, error_token, error_offset): the permissive form of ``encode``; ids is null where a special token is not allowed."""
    blob = encoding.shared(_session())
    allowed_ids(encoding.specials, allowed)  # a wrong argument fails here, not in a task
    names = allowed if allowed is None or isinstance(allowed, str) else list(allowed)

    @F.arrow_udf("struct<ids: array<int>, error_token: string, error_offset: int>")
    def run(column: pa.Array) -> pa.Array:
        encode = worker_encoding(blob.value).encode_special_column
        return sliced(column, lambda c: pa.StructArray.from_arrays(encode(c, names), ["ids", "error_token", "error_offset"], mask=c.is_null()))

    return run(text)


def encode(text: Column, encoding: Encoding, allowed: str | Iterable[str] | None = None) -> Column:
    """array<int>; a special token that is not allowed fails the query."""
    found = try_encode(text, encoding, allowed)
    said = F.concat(F.lit("disallowed special token '"), found["error_token"], F.lit("' at byte offset "), found["error_offset"].cast("string"))
    return F.when(found["error_token"].isNotNull(), F.raise_error(said).cast("array<int>")).otherwise(found["ids"])


def append_encoded(ids: Column, text: Column, encoding: Encoding) -> Column:
    """``ids`` and, after them, those of the text; null if either is null."""
    return F.concat(ids.cast("array<int>"), encode_ordinary(text, encoding))


def encode_with_special(text: Column, encoding: Encoding) -> Column:
    return try_encode(text, encoding, "all")["ids"]


def try_decode(ids: Column, encoding: Encoding) -> Column:
    """struct(bytes, invalid_id): bytes is null where an id is unknown, and invalid_id is the first such."""
    blob = encoding.shared(_session())

    @F.arrow_udf("struct<bytes: binary, invalid_id: bigint>")
    def run(column: pa.Array) -> pa.Array:
        return worker_encoding(blob.value).decode_column(column)

    return run(ids.cast("array<bigint>"))


def decode_bytes(ids: Column, encoding: Encoding) -> Column:
    """binary; an unknown id fails the query."""
    found = try_decode(ids, encoding)
    return F.when(found["invalid_id"].isNotNull(), F.raise_error(F.concat(F.lit("invalid token id "), found["invalid_id"].cast("string"))).cast("binary")).otherwise(found["bytes"])


def decode(ids: Column, encoding: Encoding) -> Column:
    """string; what is not UTF-8 becomes U+FFFD, in Spark itself."""
    return F.make_valid_utf8(decode_bytes(ids, encoding).cast("string"))


#: Status codes of the permissive forms for byte input.
OK, NULL, ENCODING, UTF8, DECODE = range(5)


def encode_utf8(data: Column, encoding: Encoding) -> Column:
    """struct(value, status) of untrusted bytes: status NULL for null, UTF8 for bytes that are not UTF-8."""
    text = F.try_validate_utf8(data.cast("string"))
    status = F.when(data.isNull(), NULL).when(text.isNull(), UTF8).otherwise(OK)
    return F.struct(encode_ordinary(text, encoding).alias("value"), status.alias("status"))


def count_utf8(data: Column, encoding: Encoding) -> Column:
    """The count, or -1 for null or for bytes that are not UTF-8."""
    return F.coalesce(count_tokens(F.try_validate_utf8(data.cast("string")), encoding), F.lit(-1))


def decode_status(ids: Column, encoding: Encoding) -> Column:
    """struct(value, status): status NULL for null, DECODE for an unknown id."""
    found = try_decode(ids, encoding)
    status = F.when(ids.isNull(), NULL).when(found["invalid_id"].isNotNull(), DECODE).otherwise(OK)
    return F.struct(found["bytes"].alias("value"), status.alias("status"))


def register(spark: SparkSession, encoding: Encoding, prefix: str = "tok_") -> None:
    """SQL functions: <prefix>encode, _count, _encode_special (text), _decode (ids), _vocab_size, _n_vocab."""
    prepare(spark)
    blob = encoding.shared(spark)

    @F.arrow_udf("array<int>")
    def enc(column: pa.Array) -> pa.Array:
        return sliced(column, worker_encoding(blob.value).encode_column)

    @F.arrow_udf("array<int>")
    def special(column: pa.Array) -> pa.Array:
        return sliced(column, lambda c: worker_encoding(blob.value).encode_special_column(c)[0])

    @F.arrow_udf("int")
    def count(column: pa.Array) -> pa.Array:
        return sliced(column, worker_encoding(blob.value).count_column)

    @F.arrow_udf("string")
    def dec(column: pa.Array) -> pa.Array:
        return worker_encoding(blob.value).decode_text_column(column)

    for name, f in (("encode", enc), ("encode_special", special), ("count", count), ("decode", dec)):
        spark.udf.register(prefix + name, f)
    for name, value in (("vocab_size", encoding.vocab_size), ("n_vocab", encoding.n_vocab)):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}() RETURNS INT RETURN {value}")
