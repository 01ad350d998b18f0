"""Vocabulary blobs (.stb): a versioned, checksummed, self-describing binary file; and the text formats that it is packed from."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

MAGIC = bytes.fromhex("534f4e4943544b00")  # the first eight bytes of every file of the format, a constant of it
VERSION = 2
UNKNOWN_GRAMMAR = 255


class BlobError(ValueError):
    """A blob that cannot be read."""


class BadMagic(BlobError):
    pass


class UnsupportedVersion(BlobError):
    pass


class ChecksumMismatch(BlobError):
    pass


class Corrupt(BlobError):
    pass


def fnv1a(data: bytes) -> int:
    """64-bit FNV-1a."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


@dataclass
class Blob:
    name: str
    ranks: list[tuple[bytes, int]]
    specials: list[tuple[bytes, int]] = field(default_factory=list)
    grammar: int = UNKNOWN_GRAMMAR
    normalizer: int = 0
    max_id: int | None = None

    def __post_init__(self):
        if self.max_id is None:
            self.max_id = max((i for _, i in [*self.ranks, *self.specials]), default=0)

    def to_bytes(self) -> bytes:
        name = self.name.encode()
        parts = [struct.pack("<H", len(name)), name, struct.pack("<IIIBB", len(self.ranks), len(self.specials), self.max_id, self.grammar, self.normalizer)]
        for kind, rows in (("<I", self.ranks), ("<H", self.specials)):
            for token, i in rows:
                parts += [struct.pack(kind, len(token)), token, struct.pack("<I", i)]
        body = b"".join(parts)
        return MAGIC + struct.pack("<HHQ", VERSION, 0, fnv1a(body)) + body

    @classmethod
    def from_bytes(cls, data: bytes) -> Blob:
        """Magic, version, checksum and body are checked in that order."""
        at = 0

        def take(kind: str) -> tuple:
            nonlocal at
            size = struct.calcsize(kind)
            if at + size > len(data):
                raise Corrupt(f"truncated at byte {at}")
            at += size
            return struct.unpack_from(kind, data, at - size)

        def raw(n: int) -> bytes:
            return take(f"{n}s")[0]

        if raw(8) != MAGIC:
            raise BadMagic("bad magic: not a vocabulary blob")
        (version,) = take("<H")
        if version > VERSION:
            raise UnsupportedVersion(f"version {version} of the format; this reads up to {VERSION}")
        _, expected = take("<HQ")
        if (actual := fnv1a(data[at:])) != expected:
            raise ChecksumMismatch(f"the data's checksum is {actual:#x}, not {expected:#x} as the header says")
        try:
            name = raw(take("<H")[0]).decode()
        except UnicodeDecodeError as e:
            raise Corrupt("the name is not UTF-8") from e
        n_ranks, n_specials, max_id = take("<III")
        grammar, normalizer = take("<BB") if version >= 2 else (UNKNOWN_GRAMMAR, 0)
        ranks = [(raw(take("<I")[0]), take("<I")[0]) for _ in range(n_ranks)]
        specials = [(raw(take("<H")[0]), take("<I")[0]) for _ in range(n_specials)]
        return cls(name, ranks, specials, grammar, normalizer, max_id)


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) of a .tiktoken file: base64 and rank on each line; a malformed line is an error."""
    lines = spark.read.text(path).where("value <> ''")
    token, rank = F.split("value", " ").getItem(0), F.split("value", " ").getItem(1)
    bad = F.raise_error(F.concat(F.lit("malformed line: "), F.col("value")))
    return lines.select(F.when(F.col("value").rlike(r"^[A-Za-z0-9+/]*={0,2} \d+$"), F.unbase64(token)).otherwise(bad.cast("binary")).alias("token"), rank.cast("int").alias("id"))


def read_specials(spark: SparkSession, path: str) -> DataFrame:
    """(name, id) of a .special file: a name, which may hold blanks, and the id after the last blank."""
    at = r"^(.*) (\d+)$"
    return spark.read.text(path).where("value <> ''").select(F.regexp_extract("value", at, 1).alias("name"), F.regexp_extract("value", at, 2).cast("int").alias("id"))


def _place(path: str | Path) -> tuple[fs.FileSystem, str]:
    """File system and path in it, of a local path or a URI (file, hdfs, s3, gs, abfs)."""
    path = str(path)
    if path.startswith("file:") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def read_bytes(path: str | Path) -> bytes:
    system, name = _place(path)
    with system.open_input_stream(name) as f:
        return f.read()


def write_bytes(path: str | Path, data: bytes) -> None:
    system, name = _place(path)
    with system.open_output_stream(name) as f:
        f.write(data)


def exists(path: str | Path) -> bool:
    system, name = _place(path)
    return system.get_file_info(name).type != fs.FileType.NotFound


def write_ranks(ranks: Iterable[tuple[bytes, int]], path: str | Path) -> None:
    """A .tiktoken file, in order of rank."""
    write_bytes(path, b"".join(base64.b64encode(t) + f" {i}\n".encode() for t, i in sorted(ranks, key=lambda x: x[1])))


def write_specials(specials: Iterable[tuple[bytes, int]], path: str | Path) -> None:
    """A .special file, in order of id, then name."""
    write_bytes(path, b"".join(n + f" {i}\n".encode() for n, i in sorted(specials, key=lambda x: (x[1], x[0]))))


def checksums(data: pa.Array) -> pa.Array:
    """fnv1a of each binary value of an Arrow array, in 16 hexadecimal digits; one step for each byte of the longest value, over all that are as long."""
    raw, at = np.frombuffer(b"".join(x or b"" for x in data.to_pylist()), np.uint8), np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(data), 0).to_numpy())].astype(np.int64)
    size, h = np.diff(at), np.full(len(data), 0xCBF29CE484222325, np.uint64)
    order = np.argsort(-size, kind="stable")
    begin, h = at[:-1][order], h[order]
    many = np.searchsorted(-size[order], -np.arange(1, int(size.max(initial=0)) + 1), "right")  # how many are as long
    for k, n in enumerate(many.tolist()):
        h[:n] = (h[:n] ^ raw[begin[:n] + k]) * np.uint64(0x100000001B3)
    out = np.empty_like(h)
    out[order] = h
    return pa.array([None if x is None else f"{v:016x}" for x, v in zip(data.to_pylist(), out.tolist(), strict=True)], pa.string())


def checksum(data: Column) -> Column:
    """fnv1a of a binary column, in 16 hexadecimal digits; null for null."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return checksums(column)

    return run(data)


def load_ranks(path: str | Path) -> list[tuple[bytes, int]]:
    """The same on the driver, for a vocabulary that becomes an encoding."""
    return [(base64.b64decode(t), int(r)) for t, r in (line.split() for line in read_bytes(path).splitlines() if line)]


def load_specials(path: str | Path) -> list[tuple[bytes, int]]:
    """A missing file means no specials."""
    if not exists(path):
        return []
    rows = (line.rsplit(" ", 1) for line in read_bytes(path).decode().splitlines() if line)
    return [(n.encode(), int(i)) for n, i in rows]


#: Grammar and normalizer of the public encodings, by name; a blob of version 1 does not carry them.
KNOWN = {"cl100k_base": (0, 0), "o200k_base": (1, 0), "o200k_harmony": (1, 0), "qwen3": (2, 1), "llama3": (0, 0)}


def pack(folder: str | Path, name: str, grammar: int | None = None, normalizer: int | None = None) -> Path | str:
    """Make <name>.stb of <name>.tiktoken and <name>.special in a folder; its path, or its URI if the folder was one."""
    folder = str(folder).rstrip("/")
    if grammar is None:
        if name not in KNOWN:
            raise ValueError(f"{name}: give its grammar")
        grammar = KNOWN[name][0]
    if normalizer is None:
        normalizer = KNOWN.get(name, (0, 0))[1]
    blob = Blob(name, load_ranks(f"{folder}/{name}.tiktoken"), load_specials(f"{folder}/{name}.special"), grammar, normalizer)
    out = f"{folder}/{name}.stb"
    write_bytes(out, blob.to_bytes())
    return out if "://" in out else Path(out)


class StbSource(DataSource):
    """``spark.read.format("stb").load(path)``: (kind, token, id); ``df.write.format("stb").option("name", ...).save(path)`` of such rows.

    Options for writing: name, grammar, normalizer.
    """

    @classmethod
    def name(cls) -> str:
        return "stb"

    def schema(self) -> str:
        return "kind string, token binary, id int"

    def reader(self, schema):
        return StbReader(self.options["path"])

    def writer(self, schema, overwrite):
        return StbWriter(self.options, overwrite)


class StbReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        system, name = _place(self.path)
        if system.get_file_info(name).type != fs.FileType.Directory:
            return [InputPartition(self.path)]
        found = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(name)) if f.base_name.endswith(".stb"))
        return [InputPartition(f"{self.path.rstrip('/')}/{f}") for f in found]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        blob = Blob.from_bytes(read_bytes(partition.value))
        for kind, rows in (("rank", blob.ranks), ("special", blob.specials)):
            for token, i in rows:
                yield kind, token, i


@dataclass
class _Part(WriterCommitMessage):
    rows: list


class StbWriter(DataSourceWriter):
    """A vocabulary is a few megabytes: its rows are gathered at commit and written as one blob."""

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = dict(options), overwrite

    def write(self, rows) -> WriterCommitMessage:
        return _Part([(r["kind"], bytes(r["token"]), r["id"]) for r in rows])

    def commit(self, messages) -> None:
        path = self.options["path"]
        if exists(path) and not self.overwrite:
            raise FileExistsError(path)
        rows = sorted((r for m in messages if m for r in m.rows), key=lambda r: (r[2], r[1]))
        by = {k: [(t, i) for kind, t, i in rows if kind == k] for k in ("rank", "special")}
        blob = Blob(self.options.get("name", Path(path).stem), by["rank"], by["special"], int(self.options.get("grammar", UNKNOWN_GRAMMAR)), int(self.options.get("normalizer", 0)))
        write_bytes(path, blob.to_bytes())
