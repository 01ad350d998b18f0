"""Import of a tokenizer.json: accepted only if one of the three grammars and byte-level BPE describe it exactly."""

from __future__ import annotations

import json
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokloom.encoding import Encoding
from tokloom.functions.grammars import Grammar, pretokenize
from tokloom.sources.blob import read_bytes, write_bytes


class Refused(ValueError):
    """The tokenizer has a part that these grammars or this BPE cannot reproduce."""


_HEAD = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)"
_TAIL = r"|\s*[\r\n]+|\s+(?!\S)|\s+"


def _split_patterns() -> dict[str, Grammar]:
    """The expressions that such files carry for each grammar; the comparison is for equality."""
    lead = r"[^\r\n\p{L}\p{N}]?"
    upper, lower = (r"[\p{L" + c + r"}\p{Lt}\p{Lm}\p{Lo}\p{M}]" if c == "u" else r"[\p{Ll}\p{Lm}\p{Lo}\p{M}]" for c in "ul")
    simple = "|".join([_HEAD, lead + r"\p{L}+", "%s", r" ?[^\s\p{L}\p{N}]+[\r\n]*"]) + _TAIL
    cased = "|".join([f"{lead}{upper}*{lower}+{_HEAD}?", f"{lead}{upper}+{lower}*{_HEAD}?", r"\p{N}{1,3}", r" ?[^\s\p{L}\p{N}]+[\r\n/]*"]) + _TAIL
    return {simple % r"\p{N}{1,3}": Grammar.CL100K, simple % r"\p{N}": Grammar.QWEN, cased: Grammar.O200K}


SPLIT_PATTERNS = _split_patterns()


def classify(spec: dict) -> tuple[Grammar, bool]:
    """(grammar, NFC or not), or Refused with the reason."""
    normalizer = spec.get("normalizer")
    if normalizer is not None and normalizer.get("type") != "NFC":
        raise Refused(f"REFUSED: normalizer {normalizer.get('type')!r}; none or NFC is supported")
    model = spec.get("model") or {}
    if model.get("type") != "BPE":
        raise Refused(f"REFUSED: {model.get('type')!r} is no byte-level BPE")
    steps = spec.get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", []) if steps.get("type") == "Sequence" else [steps]
    if not any(s.get("type") == "ByteLevel" for s in steps):
        raise Refused("REFUSED: no ByteLevel pre-tokenizer")
    expressions = [s.get("pattern", {}).get("Regex") for s in steps if s.get("type") == "Split"]
    if not expressions or expressions[1:]:
        raise Refused(f"REFUSED: pieces are split by {len(expressions)} expressions, not by one")
    expression = expressions[0]
    if expression not in SPLIT_PATTERNS:
        raise Refused(f"REFUSED: no grammar for the pattern {expression!r}")
    return SPLIT_PATTERNS[expression], normalizer is not None


@cache
def byte_characters() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies, and the byte of each."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + k): b for k, b in enumerate(hidden)}}


def token_bytes(token: str) -> bytes:
    table = byte_characters()
    return bytes(table[c] for c in token)


def read_spec(spec: dict, name: str) -> Encoding:
    grammar, nfc = classify(spec)
    ranks = sorted(((token_bytes(t), i) for t, i in spec["model"]["vocab"].items()), key=lambda x: x[1])
    specials = [(t["content"].encode(), t["id"]) for t in spec.get("added_tokens") or []]
    return Encoding(name, ranks, specials, grammar, nfc)


def import_tokenizer(path: str | Path, name: str, out: str | Path | None = None) -> Encoding:
    """The encoding of a tokenizer.json, written to <out>/<name>.stb if ``out`` is given."""
    encoding = read_spec(json.loads(read_bytes(path)), name)
    if out is not None:
        write_bytes(f"{str(out).rstrip('/')}/{name}.stb", encoding.to_blob().to_bytes())
    return encoding


def to_spec(encoding: Encoding) -> dict:
    """The tokenizer.json of an encoding, without merges: the other way round."""
    shown = {b: c for c, b in byte_characters().items()}
    expression = next(x for x, g in SPLIT_PATTERNS.items() if g is encoding.grammar)
    split = {"type": "Split", "pattern": {"Regex": expression}, "behavior": "Isolated", "invert": False}
    return {
        "normalizer": {"type": "NFC"} if encoding.nfc else None,
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [split, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]},
        "model": {"type": "BPE", "vocab": {"".join(map(shown.get, t)): i for t, i in encoding.ranks.items()}},
        "added_tokens": [{"content": n.decode(), "id": i, "special": True} for n, i in encoding.specials],
    }


#: A text or two for each alternative of the grammars, then mixtures.
PROBES = [
    "we've they'LL 'tis I'D x'", "ὀδός naïve Straße ǅ ʰ", "12345 ٣٤٥٦ Ⅷ½", "a+b == c; $$$ --x", "//comment\n/**/\n/", "\r\n \n\t\n", "word   \u2003 word", "trail \t ", "snakeCase PascalCASE URLs iOS", "漢字かなカナ 조선말",
    "e\u0301 \u00c5 A\u030a", "\U0001f9a6\u200d\U0001f525", "q" * 600, "01" * 400, "\n  ", "ࡰࡱ", "'ſ", "", " ", "\x00\x01\x7f",
]


def verify(encoding: Encoding, expected, texts: list[str] | None = None) -> int:
    """Compare with ``expected``, a function from text to ids, on the probes and the given texts; the number of texts, or an error that says where they part."""
    texts = [*PROBES, *(texts or [])]
    for t in texts:
        got, want = encoding.encode_with_special(t), list(expected(t))
        if got != want:
            k = next((k for k, (a, b) in enumerate(zip(got, want, strict=False)) if a != b), min(len(got), len(want)))
            raise ValueError(f"the encodings part at token {k} of {t[:40]!r}: {got[k : k + 3]} here, {want[k : k + 3]} there")
    return len(texts)


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """(mode, ids, input) of a file of golden vectors: a JSON array whose input is text or, in input_b64, base64."""
    rows = spark.read.schema("mode string, ids array<int>, input string, input_b64 string, encoding string").json(path, multiLine=True)
    return rows.select("mode", "ids", F.coalesce("input", F.unbase64("input_b64").cast("string")).alias("input"))


def piece_faults(fixtures: DataFrame, grammar: Grammar, nfc: bool = False) -> DataFrame:
    """Golden vectors, of mode ordinary, that contradict a grammar whatever the vocabulary: those of more pieces than ids, and pieces to which two vectors with one id for each piece give different ids.

    (fault, input, piece): fault is "pieces" or "id".
    """
    from tokloom.functions.unicode import nfc as composed

    text = composed(F.col("input")) if nfc else F.col("input")
    cut = fixtures.where("mode = 'ordinary'").select("input", "ids", pretokenize(text, grammar).alias("p"))
    more = cut.where("size(p) > size(ids)").select(F.lit("pieces").alias("fault"), "input", F.lit(None).cast("string").alias("piece"))
    pairs = cut.where("size(p) = size(ids)").select(F.explode(F.arrays_zip("p", "ids")).alias("x")).select("x.p", "x.ids")
    two = pairs.groupBy("p").agg(F.min("ids").alias("a"), F.max("ids").alias("b")).where("a <> b")
    return more.union(two.select(F.lit("id"), F.lit(None).cast("string"), "p"))


def verify_set(expected: DataFrame, encoding: Encoding, *keys: str) -> DataFrame:
    """(keys..., pos, expected, got) where the ids of (keys..., text, ids) differ from ours, by a join on place."""
    from tokloom.functions.tokens import encode_with_special

    ours = expected.select(*keys, F.posexplode(encode_with_special(F.col("text"), encoding)).alias("pos", "got"))
    theirs = expected.select(*keys, F.posexplode("ids").alias("pos", "expected"))
    return theirs.join(ours, [*keys, "pos"], "full").where("NOT (got <=> expected)")


def mismatches(fixtures: DataFrame, encoding: Encoding) -> DataFrame:
    """Fixtures whose ids differ from ours; a mode other than ordinary and with_special is an error."""
    from tokloom.functions.tokens import encode_ordinary, encode_with_special

    wrong = F.raise_error(F.concat(F.lit("unknown mode "), F.col("mode"))).cast("array<int>")
    got = F.when(F.col("mode") == "ordinary", F.col("o")).when(F.col("mode") == "with_special", F.col("s")).otherwise(wrong)
    both = fixtures.withColumns({"o": encode_ordinary(F.col("input"), encoding), "s": encode_with_special(F.col("input"), encoding)})
    return both.withColumn("got", got).where("NOT (got <=> ids)").select("mode", "input", "ids", "got")
