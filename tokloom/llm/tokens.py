"""Token counts of whole texts with a public byte-level BPE vocabulary, given by the path of its rank file."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokloom.operators import vectorized as V
from tokloom.session import prepare

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict = {}


def encoder(path: str, data: bytes):
    """The encoder of a rank file, text by text, that tests compare with; kept for the life of a process."""
    if path not in _loaded:
        import tiktoken

        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, data.splitlines()) if t}
        _loaded[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def pieces(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each piece, pieces before each text) by PATTERN: letters, numbers and others take one space before them; of other blanks the last stands alone."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    byte, c = V.characters(raw)
    edge = at if byte is None else np.searchsorted(byte, at)
    some = np.diff(edge) > 0
    begins, ends = edge[:-1][some], edge[1:][some] - 1
    before, after = V.moved(c, 1, begins), V.moved(c, -1, ends)
    kinds = V.LETTER | V.NUMBER | V.OTHER | V.BLANK
    new = (c ^ before) & kinds != 0
    cut = new & (before & V.SPACE == 0)
    # the last of several blanks is cut off, unless it ends the text
    cut |= (c & V.BLANK != 0) & (new | (after & kinds != 0) & (after & V.BLANK == 0))
    quote = np.flatnonzero((c & V.QUOTE != 0) & cut & (after & V.LETTER != 0))
    if len(quote):
        p = quote if byte is None else byte[quote]
        x, y = raw[p + 1], raw[np.minimum(p + 2, len(raw) - 1)]
        one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
        two = (((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))) & (after[quote + 1] & V.LETTER != 0)
        cut[quote[one | two] + 1] = False
        last = (quote + one + 2 * two)[one | two]
        cut[(last + 1)[after[last] & V.LETTER != 0]] = True
    start = np.flatnonzero(cut)
    if byte is not None:
        start = byte.take(start)
    return start, np.searchsorted(start, at)


def _counter(path: str, data: bytes):
    """From an Arrow array of texts to their numbers of tokens."""
    key = ("counter", path)
    if key not in _loaded:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, data.splitlines()) if t}
        _loaded[key] = V.Encoder(ranks, pieces)
    fast = _loaded[key]

    def count(column: pa.Array) -> pa.Array:
        return pa.array(fast.count(*V.buffers(column)), mask=np.asarray(column.is_null()))

    return count


def counted(docs: DataFrame, ranks: str = RANKS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every row; a null text has null tokens. The rank file, of fixed size, is broadcast."""
    spark = prepare(docs.sparkSession)
    with open(ranks, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(ranks, data.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), count(b.column(1))], names=["doc_id", "n_tokens"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)[doc_id]}, n_tokens long")
