"""Pre-tokenization: text to pieces by one of three fixed grammars, as Spark expressions.

A grammar is an ordered list of alternatives; the first that matches at a place wins, and the pieces cover the text.
"""

from __future__ import annotations

from enum import Enum
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokloom.functions.unicode import members, needs_new


class Grammar(Enum):
    """The closed set of grammars; the value is the byte that names it in a vocabulary blob."""

    CL100K = 0
    O200K = 1
    QWEN = 2


#: Spelled out, because some engines fold U+017F to s.
CONTRACTION = "'(?:[sStTmMdD]|[rR][eE]|[vV][eE]|[lL][lL])"


@cache
def alternatives(grammar: Grammar, full: bool = True, dialect: str = "java") -> dict[str, str]:
    """Name and expression of each alternative, in order; ``full`` adds what JDK 17 lacks of Unicode 17. Dialects: java, rust."""
    letter, number, upper, lower = (members(n, full) for n in ("letter", "number", "upper", "lower"))
    space, not_space = (r"\p{IsWhite_Space}", r"\P{IsWhite_Space}") if dialect == "java" else (r"\s", r"\S")
    lead = rf"[^\r\n{letter}{number}]?"
    if grammar is Grammar.O200K:
        # with lead or without, letters that end in lower case come before those that begin in upper case
        heads = {"cased": rf"{lead}[{upper}]*[{lower}]+(?:{CONTRACTION})?", "upper": rf"{lead}[{upper}]+[{lower}]*(?:{CONTRACTION})?"}
    else:
        heads = {"contraction": CONTRACTION, "letters": rf"{lead}[{letter}]+"}
    return heads | {
        "numbers": rf"[{number}]" + ("" if grammar is Grammar.QWEN else "{1,3}"),
        "other": rf" ?[^{space}{letter}{number}]+" + (r"[\r\n/]*" if grammar is Grammar.O200K else r"[\r\n]*"),
        "newlines": rf"{space}*[\r\n]+",
        "blanks": rf"{space}+(?!{not_space})",
        "blank": rf"{space}+",
    }


@cache
def pattern(grammar: Grammar, full: bool = True, dialect: str = "java") -> str:
    return "|".join(alternatives(grammar, full, dialect).values())


def pretokenize(text: Column, grammar: Grammar = Grammar.CL100K) -> Column:
    """array<string> of the pieces of a text, in order; [] for an empty text, null for null."""
    quick, whole = (F.regexp_extract_all(text, F.lit(pattern(grammar, full)), F.lit(0)) for full in (False, True))
    return F.when(needs_new(text), whole).otherwise(quick)


def pieces(df: DataFrame, text: str, grammar: Grammar = Grammar.CL100K, *keys: str) -> DataFrame:
    """(keys..., pos, piece): a row for each piece; no shuffle."""
    return df.select(*keys, F.posexplode(pretokenize(F.col(text), grammar)).alias("pos", "piece"))


def offsets(df: DataFrame, text: str, grammar: Grammar = Grammar.CL100K, *keys: str) -> DataFrame:
    """(keys..., pos, start, end, piece), start and end in bytes of the text; cut and measured in one Arrow pass, with no shuffle."""
    from tokloom.encoding import bytes256, worker_encoding
    from tokloom.session import prepare

    blob = bytes256(grammar).shared(prepare(df.sparkSession))

    @F.arrow_udf("array<struct<start: int, end: int, piece: string>>")
    def cut(column: pa.Array) -> pa.Array:
        return worker_encoding(blob.value).piece_column(column)

    return df.select(*keys, F.posexplode(cut(F.col(text))).alias("pos", "x")).select(*keys, "pos", "x.start", "x.end", "x.piece")


def kinds(pieces_df: DataFrame, grammar: Grammar) -> DataFrame:
    """``pieces_df`` (with column piece) and the name of the alternative that made each piece: column kind."""
    kind = None
    for name, expression in alternatives(grammar).items():
        if name in ("blanks", "blank"):
            continue
        hit = F.col("piece").rlike(f"^(?:{expression})$")
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    return pieces_df.withColumn("kind", kind.otherwise("blank"))
