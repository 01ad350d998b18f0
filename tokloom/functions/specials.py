"""Special tokens as Spark expressions: the earliest one in a text, and texts cut at them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ordered(names: list[str]) -> list[str]:
    """Longest first, then by bytes: in an alternation the longest of those that start at one place wins."""
    return sorted(names, key=lambda n: (-len(n.encode()), n.encode()))


def _any(names: list[str]) -> str:
    return "|".join(r"\Q" + n.replace("\\E", "\\E\\\\E\\Q") + r"\E" for n in ordered(names)) or "(?!)"


def first(text: Column, names: list[str]) -> Column:
    """struct(token, offset): the first of the names in the text and its offset in bytes; null where there is none.

    Texts that hold no common prefix of the names are not searched.
    """
    token = F.regexp_substr(text, F.lit(_any(names)))
    before = F.call_function("substring_index", text, token, F.lit(1))
    found = F.when(token.isNotNull(), F.struct(token.alias("token"), F.octet_length(before).alias("offset")))
    prefix = _common(names)
    return F.when(F.contains(text, F.lit(prefix)), found) if prefix else found


def _common(names: list[str]) -> str:
    low, high = (min(names), max(names)) if names else ("", "")
    k = 0
    while k < min(len(low), len(high)) and low[k] == high[k]:
        k += 1
    return low[:k]


def segments(df: DataFrame, text: str, names: list[str], *keys: str) -> DataFrame:
    """(keys..., seg, special, part): the text cut at the names, in order; special tells whether part is one of them.

    The expression is possessive, so that a text of any length takes no stack, and looks for a name only where one of their first characters stands.
    """
    some = _any(names)
    first = "".join(sorted({rf"\x{{{ord(n[0]):x}}}" for n in names}))
    rest = rf"(?:[^{first}]++|(?!{some}).)++" if names else ".++"
    cut = F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?:{some})|{rest}"), F.lit(0))
    return df.select(*keys, F.posexplode(cut).alias("seg", "part")).select(*keys, "seg", F.col("part").isin(names).alias("special"), "part")


def table(spark: SparkSession, specials: list[tuple[str, int]]) -> DataFrame:
    """(name, id, n): the special tokens in order; of names that share an id, n = 1 is the one that is decoded."""
    rows = spark.createDataFrame(specials, "name string, id int")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.octet_length("name")), "name")))
