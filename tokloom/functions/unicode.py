"""Character classes and normalization.

The grammars want the letters, numbers and letter cases of Unicode 17, while a JVM knows those of its own version. A class is therefore the built-in
property and, beside it, the ranges that JDK 17 lacks; ranges that a newer JVM has already do no harm. Texts without a character
of FIRST_NEW or above take the pattern with built-in properties only, which is about three times as fast.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points, in hexadecimal, that each class has in Unicode 17 and not in JDK 17.
NEW_LETTERS = (
    "870-887 889-88f 8b5 8c8-8c9 c5c-c5d cdc-cdd 170d 171f 1b4c 1c89-1c8a 2c2f 2c5f 9ffd-9fff a7c0-a7c1 a7cb-a7dc a7f1-a7f4 10570-1057a 1057c-1058a "
    "1058c-10592 10594-10595 10597-105a1 105a3-105b1 105b3-105b9 105bb-105bc 105c0-105f3 10780-10785 10787-107b0 107b2-107ba 10940-10959 10d4a-10d65 "
    "10d6f-10d85 10ec2-10ec7 10f70-10f81 11071-11072 11075 1123f-11240 11380-11389 1138b 1138e 11390-113b5 113b7 113d1 113d3 11740-11746 11ab0-11abf "
    "11bc0-11be0 11db0-11ddb 11f02 11f04-11f10 11f12-11f33 12f90-12ff0 1342f 13441-13446 13460-143fa 16100-1611d 16a70-16abe 16d40-16d6c 16ea0-16eb8 "
    "16ebb-16ed3 16ff2-16ff3 187f8-187ff 18cff 18d09-18d1e 18d80-18df2 1aff0-1aff3 1aff5-1affb 1affd-1affe 1b11f-1b122 1b132 1b155 1df00-1df1e 1df25-1df2a "
    "1e030-1e06d 1e290-1e2ad 1e4d0-1e4eb 1e5d0-1e5ed 1e5f0 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 1e7e0-1e7e6 1e7e8-1e7eb "
    "1e7ed-1e7ee 1e7f0-1e7fe 2a6de-2a6df 2b735-2b73f 2cea2-2cead 2ebf0-2ee5d 31350-33479 "
)
NEW_NUMBERS = (
    "10d40-10d49 116d0-116e3 11bf0-11bf9 11de0-11de9 11f50-11f59 16130-16139 16ac0-16ac9 16d70-16d79 16ff4-16ff6 1ccf0-1ccf9 1d2c0-1d2d3 1e4f0-1e4f9 "
    "1e5f1-1e5fa "
)
NEW_UPPER = (
    "295 870-887 889-88f 897-89f 8b5 8c8-8d2 c3c c5c-c5d cdc-cdd cf3 ece 170d 1715 171f 180f 1ac1-1add 1ae0-1aeb 1b4c 1c89 1dfa 2c2f 9ffd-9fff a7c0 "
    "a7cb-a7cc a7ce a7d0 a7d2 a7d4 a7d6 a7d8 a7da a7dc a7f1-a7f4 10570-1057a 1057c-1058a 1058c-10592 10594-10595 105c0-105f3 10780-10785 10787-107b0 "
    "107b2-107ba 10940-10959 10d4a-10d65 10d69-10d6d 10d6f 10ec2-10ec7 10efa-10eff 10f70-10f85 11070-11075 110c2 1123f-11241 11380-11389 1138b 1138e "
    "11390-113b5 113b7-113c0 113c2 113c5 113c7-113ca 113cc-113d3 113e1-113e2 11740-11746 11ab0-11abf 11b60-11b67 11bc0-11be0 11db0-11ddb 11f00-11f10 "
    "11f12-11f3a 11f3e-11f42 11f5a 12f90-12ff0 1342f 13440-13455 13460-143fa 16100-1612f 16a70-16abe 16d40-16d6c 16ea0-16eb8 16ff2-16ff3 187f8-187ff 18cff "
    "18d09-18d1e 18d80-18df2 1aff0-1aff3 1aff5-1affb 1affd-1affe 1b11f-1b122 1b132 1b155 1cf00-1cf2d 1cf30-1cf46 1df0a 1e030-1e06d 1e08f 1e290-1e2ae "
    "1e4d0-1e4ef 1e5d0-1e5f0 1e6c0-1e6de 1e6e0-1e6f5 1e6fe-1e6ff 1e7e0-1e7e6 1e7e8-1e7eb 1e7ed-1e7ee 1e7f0-1e7fe 2a6de-2a6df 2b735-2b73f 2cea2-2cead "
    "2ebf0-2ee5d 31350-33479 "
)
NEW_LOWER = (
    "870-887 889-88f 897-89f 8b5 8c8-8d2 c3c c5c-c5d cdc-cdd cf3 ece 170d 1715 171f 180f 1ac1-1add 1ae0-1aeb 1b4c 1c8a 1dfa 2c5f 9ffd-9fff a7c1 a7cd a7cf "
    "a7d1 a7d3 a7d5 a7d7 a7d9 a7db a7f1-a7f4 10597-105a1 105a3-105b1 105b3-105b9 105bb-105bc 105c0-105f3 10780-10785 10787-107b0 107b2-107ba 10940-10959 "
    "10d4a-10d4f 10d69-10d6d 10d6f-10d85 10ec2-10ec7 10efa-10eff 10f70-10f85 11070-11075 110c2 1123f-11241 11380-11389 1138b 1138e 11390-113b5 113b7-113c0 "
    "113c2 113c5 113c7-113ca 113cc-113d3 113e1-113e2 11740-11746 11ab0-11abf 11b60-11b67 11bc0-11be0 11db0-11ddb 11f00-11f10 11f12-11f3a 11f3e-11f42 11f5a "
    "12f90-12ff0 1342f 13440-13455 13460-143fa 16100-1612f 16a70-16abe 16d40-16d6c 16ebb-16ed3 16ff2-16ff3 187f8-187ff 18cff 18d09-18d1e 18d80-18df2 "
    "1aff0-1aff3 1aff5-1affb 1affd-1affe 1b11f-1b122 1b132 1b155 1cf00-1cf2d 1cf30-1cf46 1df00-1df1e 1df25-1df2a 1e030-1e06d 1e08f 1e290-1e2ae 1e4d0-1e4ef "
    "1e5d0-1e5f0 1e6c0-1e6de 1e6e0-1e6f5 1e6fe-1e6ff 1e7e0-1e7e6 1e7e8-1e7eb 1e7ed-1e7ee 1e7f0-1e7fe 2a6de-2a6df 2b735-2b73f 2cea2-2cead 2ebf0-2ee5d "
    "31350-33479 "
)

_BUILT_IN = {"letter": r"\p{L}", "number": r"\p{N}", "space": r"\p{IsWhite_Space}", "upper": r"\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}", "lower": r"\p{Ll}\p{Lm}\p{Lo}\p{M}"}
_NEW = {"letter": NEW_LETTERS, "number": NEW_NUMBERS, "space": "", "upper": NEW_UPPER, "lower": NEW_LOWER}
#: The least code point that any class lacks in JDK 17.
FIRST_NEW = 0x295


@cache
def ranges(name: str) -> list[tuple[int, int]]:
    """The added ranges of a class."""
    return [(int(a, 16), int(b or a, 16)) for a, _, b in (x.partition("-") for x in _NEW[name].split())]


@cache
def members(name: str, full: bool = True) -> str:
    """The inside of a bracket expression for a class, in the syntax that Java and Rust share."""
    extra = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" if b > a else f"\\x{{{a:x}}}" for a, b in ranges(name)) if full else ""
    return _BUILT_IN[name] + extra


def is_class(char: Column, name: str) -> Column:
    """Whether a single character is in a class: letter, number, space, upper (as in the case-aware grammar) or lower."""
    return char.rlike(f"(?s)^[{members(name)}]$")


def needs_new(text: Column) -> Column:
    """Whether a text may hold a character that the JVM's own classes lack."""
    return text.rlike(f"[\\x{{{FIRST_NEW:x}}}-\\x{{10FFFF}}]")


def range_table(spark: SparkSession) -> DataFrame:
    """(class, low, high): the added ranges, a table of a few hundred rows for a broadcast range join."""
    return spark.createDataFrame([(n, a, b) for n in _NEW for a, b in ranges(n)], "class string, low int, high int")


def code_points(spark: SparkSession) -> DataFrame:
    """(cp, char) of every Unicode scalar value."""
    return spark.range(0x110000).where("id NOT BETWEEN 55296 AND 57343").select(F.col("id").cast("int").alias("cp"), F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("char"))


def drift(spark: SparkSession) -> DataFrame:
    """(class, jvm, added, total): code points that the JVM has of itself, those that our ranges add, and all."""
    chars = code_points(spark)
    sums = [f(n) for n in _BUILT_IN for f in (lambda n: F.count_if(F.col("char").rlike(f"(?s)^[{members(n, False)}]$")).alias(f"{n}_jvm"), lambda n: F.count_if(is_class(F.col("char"), n)).alias(f"{n}_all"))]
    one = chars.agg(*sums)
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("class"), F.col(f"{n}_jvm").alias("jvm"), (F.col(f"{n}_all") - F.col(f"{n}_jvm")).alias("added"), F.col(f"{n}_all").alias("total")) for n in _BUILT_IN))).alias("r")).select("r.*")


def added(spark: SparkSession) -> DataFrame:
    """(class, n): code points of the added ranges of each class, by a join of all code points with the table of ranges, which is broadcast."""
    hit = F.col("cp").between(F.col("low"), F.col("high"))
    return code_points(spark).select("cp").join(F.broadcast(range_table(spark)), hit).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def nfc(text: Column) -> Column:
    """Canonical composition; a text of ASCII is returned as it is."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFC", t) for t in (x.as_py() for x in column)], pa.string())

    return run(text)


def class_counts(texts: DataFrame, text: str) -> DataFrame:
    """(letters, numbers, spaces, others): characters of all texts by class; distinct characters are classified, not each."""
    chars = texts.select(F.explode(F.split(F.col(text), "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    c = F.col("c")
    kind = F.when(is_class(c, "letter"), "letter").when(is_class(c, "number"), "number").when(is_class(c, "space"), "space").otherwise("other")
    return chars.groupBy(kind.alias("kind")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_distinct"))
