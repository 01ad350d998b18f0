"""Encodings: a vocabulary, a grammar, a normalizer and special tokens; the driver-side Python API, and what workers load."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from tokloom.functions.grammars import Grammar, pattern
from tokloom.operators import vectorized
from tokloom.operators.bpe import encode_piece
from tokloom.sources.blob import KNOWN, UNKNOWN_GRAMMAR, Blob, exists, load_ranks, load_specials, read_bytes

#: Configuration, then environment, that name a folder of vocabularies.
FOLDER_CONF, FOLDER_ENV = "spark.tokloom.vocabularies", "TOKLOOM_VOCABULARIES"
#: Characters of a text from which on it is cut by array operations: the expression with look-ahead, which backtracks, sees short texts only.
LONG = 1 << 12


#: Bytes of text of which ids are made at a time in a worker: what is held besides a batch and its result is some tens of times as much.
SLICE = 1 << 20


def sliced(column: pa.Array, run: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """``run`` of a string array, by slices of about SLICE bytes and at least one text."""
    _, at = vectorized.buffers(column)
    n, cuts = len(column), [0]
    while cuts[-1] < n:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(at, at[cuts[-1]] + SLICE, "right")) - 1))
    parts = [run(column.slice(a, b - a)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return parts[0] if len(parts) == 1 else pa.concat_arrays(parts) if parts else run(column)


class UnsupportedEncoding(ValueError):
    """No such encoding, or one whose grammar is unknown."""


class DisallowedSpecial(ValueError):
    """A special token that is not allowed stands in the text; offset counts bytes of the normalized text."""

    def __init__(self, token: str, offset: int):
        super().__init__(f"disallowed special token {token!r} at byte offset {offset}")
        self.token, self.offset = token, offset


class InvalidToken(KeyError):
    """An id that the encoding does not have."""

    def __init__(self, token_id: int):
        super().__init__(f"invalid token id {token_id}")
        self.token_id = token_id


def allowed_ids(specials: list[tuple[bytes, int]], allowed: str | Iterable[str] | None) -> set[int]:
    """The ids of the allowed names: all of them for "all", none for None; unknown names are ignored, any other string is an error."""
    if allowed is None:
        return set()
    if isinstance(allowed, str):
        if allowed != "all":
            raise ValueError('allowed specials: None, "all" or an iterable of names')
        return {i for _, i in specials}
    names = {n.encode() for n in allowed}
    return {i for n, i in specials if n in names}


class Encoding:
    """Immutable; ``encode_piece`` is the definition, and where tiktoken is installed its merge loop does the work."""

    def __init__(self, name: str, ranks: Iterable[tuple[bytes, int]], specials: Iterable[tuple[bytes, int]] = (), grammar: Grammar = Grammar.CL100K, nfc: bool = False):
        self.name, self.grammar, self.nfc = name, Grammar(grammar), nfc
        self.ranks = dict(ranks)
        if len(set(self.ranks.values())) != len(self.ranks):
            raise ValueError(f"{name}: ids are not unique")
        if missing := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"{name}: {len(missing)} single bytes have no id, the first is {missing[0]}")
        # longest first, then by bytes: of names with one id the first is the one that is decoded
        self.specials = sorted(specials, key=lambda s: (-len(s[0]), s[0]))

    @classmethod
    def from_blob(cls, blob: Blob) -> Encoding:
        if blob.grammar != UNKNOWN_GRAMMAR:
            if blob.grammar not in {g.value for g in Grammar}:
                raise UnsupportedEncoding(f"{blob.name}: grammar {blob.grammar}")
            grammar, normalizer = blob.grammar, blob.normalizer
        elif blob.name in KNOWN:
            grammar, normalizer = KNOWN[blob.name]
        else:
            raise UnsupportedEncoding(blob.name)
        return cls(blob.name, blob.ranks, blob.specials, Grammar(grammar), normalizer == 1)

    def to_blob(self) -> Blob:
        return Blob(self.name, sorted(self.ranks.items(), key=lambda x: x[1]), self.specials, self.grammar.value, int(self.nfc))

    @classmethod
    def load(cls, folder: str | Path, name: str, grammar: Grammar | None = None) -> Encoding:
        """<name>.stb of a folder, or else <name>.tiktoken with <name>.special; the folder may be a URI."""
        folder = str(folder).rstrip("/")
        if exists(p := f"{folder}/{name}.stb"):
            return cls.from_blob(Blob.from_bytes(read_bytes(p)))
        if not exists(p := f"{folder}/{name}.tiktoken"):
            raise FileNotFoundError(f"no {name}.stb or {name}.tiktoken in {folder}")
        known = KNOWN.get(name, (Grammar.CL100K.value, 0))
        return cls(name, load_ranks(p), load_specials(f"{folder}/{name}.special"), grammar or Grammar(known[0]), known[1] == 1)

    @property
    def vocab_size(self) -> int:
        return len(self.ranks)

    @cached_property
    def n_vocab(self) -> int:
        return max([*self.ranks.values(), *(i for _, i in self.specials)]) + 1

    def __repr__(self) -> str:
        return f"<Encoding {self.name!r} n_vocab={self.n_vocab}>"

    def special_tokens(self) -> list[tuple[str, int]]:
        return [(n.decode(errors="replace"), i) for n, i in self.specials]

    def id_of(self, name: str) -> int | None:
        return next((i for n, i in self.specials if n == name.encode()), None)

    def name_of(self, token_id: int) -> str | None:
        return next((n.decode(errors="replace") for n, i in self.specials if i == token_id), None)

    @cached_property
    def by_id(self) -> dict[int, bytes]:
        return {**{i: n for n, i in reversed(self.specials)}, **{i: t for t, i in self.ranks.items()}}

    @cached_property
    def _ordinary(self) -> Callable[[str], list[int]]:
        try:
            import tiktoken
        except ImportError:
            return self._plain
        short = tiktoken.Encoding(self.name, pat_str=pattern(self.grammar, True, "rust"), mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary
        return lambda text: short(text) if len(text) < LONG else self._vectorized.encode(*vectorized.buffers(pa.array([text])))[0].tolist()

    @cached_property
    def _plain(self) -> Callable[[str], list[int]]:
        find = self._finder()
        known: dict[str, list[int]] = {}

        def encode(text: str) -> list[int]:
            out: list[int] = []
            for p in find(text):
                ids = known.get(p)
                if ids is None:
                    ids = encode_piece(p.encode(), self.ranks)
                    if len(known) < 1 << 18:
                        known[p] = ids
                out += ids
            return out

        return encode

    def _finder(self) -> Callable[[str], list[str]]:
        import regex

        return regex.compile(_python(pattern(self.grammar, True, "rust"))).findall

    def normalize(self, text: str) -> str:
        return unicodedata.normalize("NFC", text) if self.nfc and not text.isascii() else text

    def encode_ordinary(self, text: str) -> list[int]:
        """Ids of the text; names of special tokens are ordinary text."""
        return self._ordinary(self.normalize(text))

    def count(self, text: str) -> int:
        return len(self.encode_ordinary(text))

    def find_special(self, text: str, ids: set[int] | None = None) -> tuple[str, int, int] | None:
        """(name, first byte, id) of the first special token, the longest one there; of those in ``ids`` only, if given."""
        m = self._pattern_of(frozenset(i for _, i in self.specials if ids is None or i in ids)).search(text.encode())
        return m and (m[0].decode(), m.start(), self._special_ids[m[0]])

    @cached_property
    def _special_ids(self) -> dict[bytes, int]:
        return {n: i for n, i in reversed(self.specials)}

    def _pattern_of(self, ids: frozenset[int]) -> re.Pattern:
        """What finds the names, as bytes, of these ids; nothing if there are none."""
        cache = self.__dict__.setdefault("_patterns", {})
        if ids not in cache:
            cache[ids] = re.compile(b"|".join(re.escape(n) for n, i in self.specials if i in ids) or b"(?!)")
        return cache[ids]

    def encode(self, text: str, allowed: str | Iterable[str] | None = None) -> list[int]:
        """Allowed special tokens become their ids; any other special token in the text is an error."""
        text = self.normalize(text)
        if not self.specials:
            return self._ordinary(text)
        ids = allowed_ids(self.specials, allowed)
        if (refused := {i for _, i in self.specials} - ids) and (found := self.find_special(text, refused)):
            raise DisallowedSpecial(found[0], found[1])
        return self._spans(text, ids)

    def encode_with_special(self, text: str) -> list[int]:
        """Every special token becomes its id."""
        return self._spans(self.normalize(text), {i for _, i in self.specials})

    def _spans(self, text: str, ids: set[int]) -> list[int]:
        out, at, data = [], 0, text.encode()
        for m in self._pattern_of(frozenset(ids)).finditer(data) if ids else ():
            out += self._ordinary(data[at : m.start()].decode())
            out.append(self._special_ids[m[0]])
            at = m.end()
        return out + self._ordinary(data[at:].decode())

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        out = []
        for i in ids:
            if (t := self.by_id.get(i)) is None:
                raise InvalidToken(i)
            out.append(t)
        return b"".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        """Bytes that are not UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode(errors="replace")

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        ids, at = self.encode_flat(texts)
        return [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, n + 1 offsets into them)."""
        column = self.encode_column(pa.array(texts, pa.string()))
        return column.values.to_numpy(), column.offsets.to_numpy()

    def encode_into(self, text: str, out: list[int]) -> None:
        """Append the ids of the text to ``out``."""
        out += self.encode_ordinary(text)

    def count_batch(self, texts: list[str]) -> list[int]:
        return self.count_column(pa.array(texts, pa.string())).to_pylist()

    def split(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first byte of each piece, pieces before each text) of texts in an array of bytes."""
        if self.grammar is Grammar.O200K:
            return vectorized.pieces_cased(raw, at, self._finder())
        return vectorized.pieces(raw, at, 1 if self.grammar is Grammar.QWEN else 3)

    @cached_property
    def _vectorized(self) -> vectorized.Encoder | None:
        """None where tiktoken or regex is missing."""
        try:
            return vectorized.Encoder(self.ranks, self.split)
        except ImportError:
            return None

    def _texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The normalized texts of a column, as bytes and offsets."""
        raw, at = vectorized.buffers(column)
        if self.nfc and len(raw) and raw.max() >= 0x80:
            raw, at = vectorized.buffers(pa.array([t if t is None else self.normalize(t) for t in column.to_pylist()], pa.string()))
        return raw, at

    def _of_bytes(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, n + 1 offsets into them)."""
        if self._vectorized:
            return self._vectorized.encode(raw, at)
        each = [self._ordinary(raw[a:b].tobytes().decode()) for a, b in zip(at, at[1:], strict=False)]
        return np.array([i for x in each for i in x], np.int32), np.cumsum([0, *map(len, each)])

    def encode_column(self, column: pa.Array) -> pa.Array:
        """The ids of each text of an Arrow array; null for null."""
        ids, at = self._of_bytes(*self._texts(column))
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids), mask=column.is_null())

    def encode_special_column(self, column: pa.Array, allowed: str | Iterable[str] | None = "all") -> tuple[pa.Array, pa.Array, pa.Array]:
        """(ids, error_token, error_offset) of each text: allowed special tokens are ids; ids is null, and the first other special token
        is told, where there is one. Texts are cut at special tokens one by one, only where they hold what all names begin with; all that is between
        is encoded at once."""
        raw, at = self._texts(column)
        n = len(column)
        ids = frozenset(allowed_ids(self.specials, allowed))
        refused = frozenset(i for _, i in self.specials) - ids
        bad, token, offset = np.zeros(n, bool), [None] * n, np.zeros(n, np.int32)
        row, low, high, special = [], [], [], []
        names = [x for x, _ in self.specials]
        prefix = os.path.commonprefix(names)
        if names and len(raw):
            texts = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)])
            some = np.flatnonzero(pc.match_substring(texts, prefix).to_numpy(zero_copy_only=False)) if prefix else np.flatnonzero(np.diff(at))
            for r in some.tolist():
                data = raw[at[r] : at[r + 1]].tobytes()
                if refused and (m := self._pattern_of(refused).search(data)):
                    bad[r], token[r], offset[r] = True, m[0].decode(errors="replace"), m.start()
                    continue
                for m in self._pattern_of(ids).finditer(data) if ids else ():
                    row.append(r)
                    low.append(at[r] + m.start())
                    high.append(at[r] + m.end())
                    special.append(self._special_ids[m[0]])
        row, low, high = (np.array(x, np.int64) for x in (row, low, high))
        size = high - low
        gone, before = np.r_[0, np.cumsum(size)], np.searchsorted(row, np.arange(n + 1))
        if len(row):
            edge = np.zeros(len(raw) + 1, np.int8)
            edge[low] += 1
            np.subtract.at(edge, high, 1)
            raw = raw[np.cumsum(edge[:-1], dtype=np.int8) == 0]
        cuts = np.insert(at - gone[before], row + 1, low - gone[:-1])
        out, ends = self._of_bytes(raw, cuts)
        nth = np.arange(len(row))
        out = np.insert(out, ends[row + 1 + nth], np.array(special, np.int32))
        ends = ends[np.arange(n + 1) + before] + before
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out.astype(np.int32)), mask=pa.array(np.asarray(column.is_null()) | bad))
        return lists, pa.array(token, pa.string()), pa.array(offset, mask=~bad)

    def encode_pieces(self, column: pa.Array) -> pa.Array:
        """The same for an array of pieces; none is null."""
        if not self._vectorized:
            return pa.array([encode_piece(p.encode(), self.ranks) for p in column.to_pylist()], pa.list_(pa.int32()))
        ids, at = self._vectorized.encode_whole(*vectorized.buffers(column))
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))

    def count_column(self, column: pa.Array) -> pa.Array:
        raw, at = self._texts(column)
        n = self._vectorized.count(raw, at) if self._vectorized else np.diff(self._of_bytes(raw, at)[1])
        return pa.array(n.astype(np.int32), mask=np.asarray(column.is_null()))

    def piece_column(self, column: pa.Array) -> pa.Array:
        """list(struct(start, end, piece)) of each text of an Arrow array; start and end count bytes of the text."""
        raw, at = vectorized.buffers(column)
        cuts, own = vectorized.segments(raw, at, vectorized.CHUNK)
        starts, counts = [], [np.zeros(1, np.int64)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            some, _ = self.split(raw[a:b], np.array([0, b - a]))
            starts.append(some + a)
            counts.append([len(some)])
        before = np.cumsum(np.concatenate(counts))[own]
        first = np.concatenate([*starts, [len(raw)]]).astype(np.int64)
        whole = pa.Array.from_buffers(pa.string(), len(first) - 1, [None, pa.py_buffer(first.astype(np.int32)), pa.py_buffer(raw)])
        base = np.repeat(at[:-1], np.diff(before))
        rows = pa.StructArray.from_arrays([pa.array((first[:-1] - base).astype(np.int32)), pa.array((first[1:] - base).astype(np.int32)), whole], ["start", "end", "piece"])
        return pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), rows, mask=column.is_null())

    @cached_property
    def _decoder(self) -> vectorized.Decoder:
        return vectorized.Decoder(self.by_id)

    def decode_column(self, column: pa.Array) -> pa.Array:
        """struct(bytes, invalid_id) of each list of ids of an Arrow array; bytes is null where an id is unknown."""
        null = column.is_null()
        flat, at = column.flatten(), np.r_[0, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int64)
        # a null among the ids is no id
        data, ends, wrong, bad = self._decoder.decode(flat.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), at)
        invalid = np.zeros(len(column), np.int64)
        invalid[wrong] = bad
        whole = pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
        texts = whole.take(pa.array(np.arange(len(column)), mask=wrong)) if wrong.any() else whole
        return pa.StructArray.from_arrays([texts, pa.array(invalid, mask=~wrong)], ["bytes", "invalid_id"], mask=null)

    def decode_text_column(self, column: pa.Array) -> pa.Array:
        """The text of each list of ids; bytes that are not UTF-8 become U+FFFD, an unknown id is an error."""
        found = self.decode_column(column)
        if len(wrong := found.field("invalid_id").drop_null()):
            raise InvalidToken(wrong[0].as_py())
        data = found.field("bytes")
        null = column.is_null()
        try:
            texts = data.cast(pa.string())
        except pa.ArrowInvalid:
            texts = pa.array([None if x is None else x.decode(errors="replace") for x in data.to_pylist()], pa.string())
        return pc.if_else(null, pa.scalar(None, pa.string()), texts)

    def shared(self, spark: SparkSession):
        """The encoding as a broadcast blob, made once per application."""
        key = spark.sparkContext.applicationId
        cache = self.__dict__.setdefault("_broadcasts", {})
        if key not in cache:
            cache[key] = spark.sparkContext.broadcast(self.to_blob().to_bytes())
        return cache[key]


def _python(rust: str) -> str:
    """The same expression for Python's regex module."""
    return re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: "\\U" + m[1].rjust(8, "0"), rust)


_loaded: dict[bytes, Encoding] = {}


def worker_encoding(blob: bytes) -> Encoding:
    """An encoding in a Python worker, built once and kept."""
    key = blob[12:20]  # the checksum
    if key not in _loaded:
        _loaded[key] = Encoding.from_blob(Blob.from_bytes(blob))
    return _loaded[key]


def bytes256(grammar: Grammar = Grammar.CL100K) -> Encoding:
    """Every byte is a token, its id the byte's value."""
    return Encoding("bytes256", [(bytes([b]), b) for b in range(256)], grammar=grammar)


def toy() -> Encoding:
    """bytes256 and two merges."""
    return Encoding("toy", [*((bytes([b]), b) for b in range(256)), (b"ab", 256), (b"abc", 257)])


BUILT_IN = {"bytes256": bytes256, "toy": toy}
#: Blobs that come with the package, <name>.stb, are found here.
RESOURCES = Path(__file__).with_name("vocabularies")


def get_encoding(name: str, spark: SparkSession | None = None) -> Encoding:
    """By the folder of the session's configuration or the environment, whose failure is final; else a blob of the package, else a built-in one.

    The public encodings need their vocabulary files; no ids are made up for them.
    """
    folder = (spark.conf.get(FOLDER_CONF, None) if spark else None) or os.environ.get(FOLDER_ENV)
    if folder:
        return Encoding.load(folder, name)
    if (RESOURCES / f"{name}.stb").exists():
        return Encoding.load(RESOURCES, name)
    if name in BUILT_IN:
        return BUILT_IN[name]()
    raise UnsupportedEncoding(f"{name}: set {FOLDER_CONF} or {FOLDER_ENV} to the folder of its vocabulary (built in: {', '.join(BUILT_IN)})")


def resolved(blob: bytes) -> tuple[str | None, str | None, bool | None, str | None]:
    """(name, grammar, NFC or not, error) of a blob: what it says of itself or, of version 1, what its name says."""
    try:
        read = Blob.from_bytes(blob)
        e = Encoding.from_blob(read)
    except ValueError as x:
        return None, None, None, type(x).__name__
    return e.name, e.grammar.name, e.nfc, None
