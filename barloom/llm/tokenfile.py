"""Token-id files: documents' ids one after another, with Elias-Fano encoded boundaries, as a Spark data source.

A file holds the ids of documents that follow each other in ascending doc_id order, as 16-bit units (32-bit ones for larger
vocabularies), then two Elias-Fano sequences, of where documents end and of their ids, and a footer. Tasks write files of a
bounded number of ids; a manifest, written when all have ended, names those that count, in order, with their numbers of
documents and ids. What a lost or repeated task has left is in no manifest.
"""

from __future__ import annotations

import json
import posixpath
import re
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import documents, shared_dir
from .eliasfano import Sequence, encode

VOCABULARY, END_ID = "byte_bpe_50k.json", 2
SHARD_IDS = 1 << 26  # ids after which a task begins another file
SPLIT_IDS = 1 << 23  # ids that a task reads
HELD_IDS = 1 << 21  # ids of a batch of rows read
FORMAT, MANIFEST, MAGIC = "token_file", "manifest.json", b"BLTOKENS"
FOOTER = struct.Struct("<BQQQQ8s")  # bytes of a unit, ids, documents without doc_id (they come first), offsets of both sequences
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"
KNOWN = (range(0x0558), range(0x2000, 0x2070))  # characters on which versions of Unicode agree; a test goes through them
SPACE = r"\t-\r \x85\xa0\u2000-\u200a\u2028\u2029\u202f\u205f"  # white space among them
LEARNT = 600_000  # distinct pieces of text that a worker remembers
GROUP = 1 << 20  # characters of texts that are cut at a time
PIECES = 1 << 16  # pieces of one long text that are held at a time


class Ids:
    """Ids by the tokenizers library. Its byte-level model never merges across the pieces that its pattern cuts a text into,
    so each distinct piece goes through the model once and is remembered. Texts with characters outside KNOWN, on whose class
    libraries may differ as they follow other versions of Unicode, are encoded whole."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.unit = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        kinds = {k: "".join(re.escape(chr(c)) for part in KNOWN for c in part if unicodedata.category(chr(c))[0] == k) for k in "LN"}
        letters, numbers = kinds["L"], kinds["N"]
        self.cut = re.compile(public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACE}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))
        self.other = re.compile("[^" + "".join(f"{chr(part[0])}-{chr(part[-1])}" for part in KNOWN) + "]")
        plain = iter(range(256, 512))  # the model knows bytes as letters: those that show as they are, and the rest from here on
        self.letters = {b: chr(b) if chr(b) in "".join(pre_tokenizers.ByteLevel.alphabet()) else chr(next(plain)) for b in range(256)}
        self.known: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.unit, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def piece(self, piece: str) -> bytes:
        return array(self.unit, [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def joined(self, cut: list[list[str]]) -> list[bytes]:
        distinct = set().union(*cut)
        new = [p for p in distinct if p not in self.known]
        if len(self.known) + len(new) > LEARNT:
            self.known, new = {}, list(distinct)
        self.known.update(zip(new, map(self.piece, new), strict=True))
        of = self.known.__getitem__
        return [b"".join(map(of, pieces)) for pieces in cut]

    def long(self, text: str) -> bytes:
        out, held = [], []
        for piece in self.cut.finditer(text):
            held.append(piece.group())
            if len(held) == PIECES:
                out, held = out + self.joined([held]), []
        return b"".join(out + self.joined([held]))

    def of(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes of units."""
        out: list[bytes] = [b""] * len(texts)
        held, size = [], 0

        def settle() -> None:
            for k, ids in zip(held, self.joined([self.cut.findall(texts[k]) for k in held]), strict=True):
                out[k] = ids

        for i, text in enumerate(texts):
            if self.other.search(text):
                out[i] = self.whole([text])[0]
            elif len(text) > GROUP:
                out[i] = self.long(text)
            else:
                held.append(i)
                size += len(text)
                if size > GROUP:
                    settle()
                    held, size = [], 0
        settle()
        return out


@cache
def ids_by(vocabulary: str) -> Ids:
    return Ids(vocabulary)


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    partition: int
    shards: list[dict]


class ShardFile:
    """One file while it is written: ids go out as they come, and only documents' ends and doc_ids are held."""

    def __init__(self, path: str, unit: int):
        where, self.path = place(path)
        self.name, self.unit, self.n_ids, self.ends, self.doc_ids, self.nulls = posixpath.basename(path), unit, 0, [], [], 0
        self.out = where.open_output_stream(self.path)
        self.out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.n_ids += len(ids) // self.unit
        self.ends.append(self.n_ids)
        if doc_id is None:
            self.nulls += 1
        else:
            self.doc_ids.append(doc_id)

    def close(self) -> dict:
        ends, doc_ids = encode(np.array(self.ends, np.int64)), encode(np.array(self.doc_ids, np.int64))
        at = len(MAGIC) + self.n_ids * self.unit
        self.out.write(ends + doc_ids + FOOTER.pack(self.unit, self.n_ids, self.nulls, at, at + len(ends), MAGIC))
        self.out.close()
        return {"name": self.name, "docs": len(self.ends), "ids": self.n_ids}


class TokenWriter(DataSourceArrowWriter):
    def __init__(self, path: str, vocabulary: str, end_id: int, shard_ids: int):
        self.path, self.vocabulary, self.end_id, self.shard_ids = path, vocabulary, end_id, shard_ids

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows (doc_id, text) in the order in which they come, as files of `shard_ids` ids or a document more."""
        where, path = place(self.path)
        where.create_dir(path, recursive=True)
        number, shards, open_, by = TaskContext.get().partitionId(), [], None, ids_by(self.vocabulary)
        end = array(by.unit, [self.end_id]).tobytes()
        for batch in iterator:
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), by.of(texts), strict=True):
                if open_ is None:
                    open_ = ShardFile(f"{self.path}/part-{number:06d}-{len(shards):04d}-{uuid.uuid4().hex}.tok", len(end))
                open_.add(doc_id, ids + end)
                if open_.n_ids >= self.shard_ids:
                    shards, open_ = [*shards, open_.close()], None
        return Written(number, [*shards, open_.close()] if open_ else shards)

    def commit(self, messages: list[Written | None]) -> None:
        shards = [s for m in sorted((m for m in messages if m), key=lambda m: m.partition) for s in m.shards]
        where, path = place(self.path)
        where.create_dir(path, recursive=True)
        with where.open_output_stream(f"{path}/{MANIFEST}.new") as out:
            out.write(json.dumps(shards).encode())
        where.move(f"{path}/{MANIFEST}.new", f"{path}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        where, path = place(self.path)
        for m in messages:
            for s in m.shards if m else []:
                where.delete_file(f"{path}/{s['name']}")


@dataclass
class Part(InputPartition):
    name: str
    first: int  # documents first to before last of the file
    last: int
    start: int  # ids before the file


class TokenReader(DataSourceReader):
    """Documents of the files that the manifest names. A task reads a run of documents: two selects say where its ids are.
    Only the columns of the schema that was asked for are made."""

    def __init__(self, path: str, schema, split_ids: int):
        self.path, self.columns, self.split_ids = path, schema.names, split_ids
        self.schema = pa.schema([(f.name, pa.binary() if f.name == "ids" else pa.int64()) for f in schema.fields])

    def partitions(self) -> list[Part]:
        where, path = place(self.path)
        with where.open_input_stream(f"{path}/{MANIFEST}") as f:
            shards, parts, start = json.loads(f.read()), [], 0
        for s in shards:
            cuts = min(s["docs"], -(-s["ids"] // self.split_ids))
            parts += [Part(s["name"], s["docs"] * k // cuts, s["docs"] * (k + 1) // cuts, start) for k in range(cuts)]
            start += s["ids"]
        return parts or [Part("", 0, 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        where, path = place(self.path)
        with where.open_input_file(f"{path}/{partition.name}") as f:
            shard = Shard(f)
            a = partition.first
            while a < partition.last:
                b = shard.until(a, partition.last, HELD_IDS)
                yield self.batch(shard, a, b, partition.start)
                a = b

    def batch(self, shard: Shard, a: int, b: int, before: int) -> pa.RecordBatch:
        bounds = shard.bounds(a, b)
        made = {"doc_id": shard.doc_ids(a, b), "start": (bounds[:-1] + before).tolist(), "n_tokens": np.diff(bounds).tolist()}
        if {"ids", "ids_crc32"} & set(self.columns):
            ids = shard.ids(bounds)
            made["ids"] = [x.tobytes() for x in ids]
            made["ids_crc32"] = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
        return pa.record_batch([pa.array(made[c], t) for c, t in zip(self.columns, self.schema.types, strict=True)], schema=self.schema)


class Shard:
    """A file that is read where it is asked."""

    def __init__(self, f):
        fetch = lambda at, n: f.read_at(n, at)
        self.fetch = fetch
        unit, self.n_ids, self.nulls, ends, doc_ids, magic = FOOTER.unpack(fetch(f.size() - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("no token-id file")
        self.unit, self.ends, self.known = np.dtype(f"<u{unit}"), Sequence(fetch, ends), Sequence(fetch, doc_ids)

    def bounds(self, a: int, b: int) -> np.ndarray:
        """Where documents a to before b begin, and where the last ends."""
        ends = self.ends.slice(max(a - 1, 0), b)
        return ends if a else np.concatenate(([0], ends))

    def until(self, a: int, b: int, most: int) -> int:
        """The first document after a, up to b, by which `most` ids are passed."""
        begin = self.ends.select(a - 1) if a else 0
        return max(a + 1, min(b, self.ends.rank(begin + most) + 1))

    def doc_ids(self, a: int, b: int) -> list[int | None]:
        known = self.known.slice(max(a - self.nulls, 0), max(b - self.nulls, 0)).tolist()
        return [None] * (b - a - len(known)) + known

    def ids(self, bounds: np.ndarray) -> list[np.ndarray]:
        size = self.unit.itemsize
        whole = np.frombuffer(self.fetch(len(MAGIC) + int(bounds[0]) * size, int(bounds[-1] - bounds[0]) * size), self.unit)
        return np.split(whole, bounds[1:-1] - bounds[0]) if len(bounds) > 1 else []

    def document_of(self, token: int) -> int:
        """The document, by its number in the file, that holds the id at place `token`."""
        return self.ends.rank(token + 1)


class TokenFiles(DataSource):
    """Format token_file. Written: doc_id and text, in the order of the rows; options vocabulary, end_id, shard_ids. Read: any of doc_id,
    start (ids of all documents before), n_tokens, ids (units as they are stored) and ids_crc32 (of 32-bit units)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TokenReader:
        return TokenReader(self.options["path"], schema, int(self.options.get("split_ids", SPLIT_IDS)))

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        return TokenWriter(self.options["path"], self.options.get("vocabulary", VOCABULARY), int(self.options.get("end_id", END_ID)), int(self.options.get("shard_ids", SHARD_IDS)))


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text in ascending doc_id order, null first; rows of one doc_id by a hash of their text.

    Partitions are ranges of that order, and equal rows are told apart by where they are read, so one frequent doc_id is no one task's.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash")]
    ranged = named.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(*order, "row")
    return ranged.sortWithinPartitions(*order).select("doc_id", "text")


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Write the ids of every row's whole text to `path`, which driver and executors must share and pyarrow must know.

    Null and empty texts are their end id alone; null doc_ids come first and stay null; repeated rows are written each; texts of
    any length go through in pieces; an empty table makes a manifest without files; other columns are not read.
    """
    docs.sparkSession.dataSource.register(TokenFiles)
    options = {"vocabulary": vocabulary, "end_id": end_id, "shard_ids": shard_ids}
    in_order(docs, id_col, text_col).write.format(FORMAT).options(**options).mode("append").save(path)


def read_tokens(spark: SparkSession, path: str, schema: str = SCHEMA, split_ids: int = SPLIT_IDS) -> DataFrame:
    spark.dataSource.register(TokenFiles)
    return spark.read.format(FORMAT).schema(schema).option("split_ids", split_ids).load(path)


def op12(spark, sf_dir):
    """All rows of `documents`, written and read back; nulls, ties and repeated rows as write_tokens() says."""
    path = shared_dir(spark)
    write_tokens(documents(spark, sf_dir, "doc_id", "text"), path)
    return read_tokens(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long")
