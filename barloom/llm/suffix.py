"""Suffix-array dedup over a difference cover, one suffix bucket at a time.

A string of LENGTH bytes that starts earlier too is removed wherever it occurs again. All suffixes of a corpus are too
many to sort, so a cover sample stands for them, as in blockwise suffix sorting: the starts of those GRAM-byte strings
whose hash is the least among all within some LENGTH-byte string. The sample is chosen by content, not by position modulo
a period: every LENGTH-byte string holds a sample position, and equal strings hold theirs at the same places, so two
suffixes always share a distance to the cover and are compared by the bytes before it and the sample's rank after it.

1. Blocks ask how often the GRAM at each sample position occurs. What occurs once can't be inside a repeated string.
2. For the rest they ask whether everything a LENGTH-byte string around the sample position could reach has occurred
   before. If so, all those strings are repeats. Long copies end here.
3. What is left differs near the sample position. A bucket holds the positions of a GRAM: texts after them are sorted, with
   common-prefix lengths, which ranks them to any depth; so are the texts before them, reversed. A suffix that starts l
   bytes before the cover is then (rank of l bytes before, rank of LENGTH - l bytes after), and ties are repeats.
4. Buckets of very frequent GRAMs aren't gathered: their strings are looked up by hash, one key each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import Parted, answers_to
from .common import bucketed, documents, materialize, mix64, pack, spread, unpack, unpack_sorted

LENGTH, GRAM = 100, 32
BEFORE = LENGTH - GRAM  # a string that holds the GRAM starts at most so far before it
BLOCK_BYTES, SLICE = 12 << 20, 1 << 18
HOT = 20_000  # occurrences of a GRAM beyond which its bucket isn't gathered
LAST = np.iinfo(np.int64).max
BLOCK = "block long, doc_ids binary, lengths binary, nulls binary, data binary, carried binary"
ASK = "kind string, part int, block long, keys binary, counts binary, ids binary, places binary, reach binary, bytes binary"
TOLD = "kind string, part int, block long, answer binary"
ASK_COLUMNS = [c.split()[0] for c in ASK.split(", ")]


def encode(docs: DataFrame) -> DataFrame:
    """Blocks of `docs` (doc_id, raw and columns that a block carries along as they are, as an Arrow stream)."""
    rest = docs.columns[2:]

    def made(number: int, ids: list, raws: list[bytes], carried: list[pa.RecordBatch]) -> pa.RecordBatch:
        null = np.array([pd.isna(i) for i in ids])
        numbers = np.array([LAST if n else int(i) for i, n in zip(ids, null, strict=True)], np.int64)
        data = zstandard.ZstdCompressor(level=3).compress(b"".join(raws))
        stream = pa.BufferOutputStream()
        if rest:
            with pa.ipc.new_stream(stream, carried[0].schema) as out:
                for some in carried:
                    out.write_batch(some)
        values = {
            "block": number, "doc_ids": pack(numbers), "lengths": pack(np.array([len(r) for r in raws], np.uint64)), "nulls": null.tobytes(), "data": data,
            "carried": zstandard.ZstdCompressor().compress(stream.getvalue().to_pybytes()),
        }
        return pa.RecordBatch.from_pylist([values], pa.schema([(f.split()[0], pa.int64() if f.split()[1] == "long" else pa.binary()) for f in BLOCK.split(", ")]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k, ids, raws, carried, held = TaskContext.get().partitionId() << 24, 0, [], [], [], 0
        for batch in batches:
            begin, more = 0, batch.select(rest)
            for at, (i, raw) in enumerate(zip(batch.column("doc_id"), batch.column("raw"), strict=True), 1):
                ids.append(i.as_py())
                raws.append(raw.as_py() or b"")
                held += len(raws[-1])
                if held >= BLOCK_BYTES:
                    yield made(base + k, ids, raws, [*carried, more.slice(begin, at - begin)])
                    k, ids, raws, carried, held, begin = k + 1, [], [], [], 0, at
            carried.append(more.slice(begin))
        if ids:
            yield made(base + k, ids, raws, carried)

    return docs.mapInArrow(rows, BLOCK)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on: pairs, pairs of pairs, and so on."""
    h = mix64(np.arange(1, 257, dtype=np.uint64))[data]
    for step in range(GRAM.bit_length() - 1):
        w = 1 << step
        h = h[:-w] * np.uint64(0x9E3779B97F4A7C15 + 2 * step) + h[w:]
    return mix64(h)


def sliding(h: np.ndarray, width: int, of) -> np.ndarray:
    """`of` (minimum or maximum) of each `width` neighbours, by doubling."""
    w = 1
    while 2 * w <= width:
        h = of(h[:-w], h[w:])
        w *= 2
    return of(h[: len(h) - (width - w)], h[width - w :]) if width > w else h


class Cover:
    """The sample positions of a block, and hashes of what lies around them."""

    def __init__(self, row):
        self.block = row.block
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row.data)), np.uint8)
        self.sizes = unpack(row.lengths, np.uint64).astype(np.int64)
        self.ids, self.null = unpack(row.doc_ids, np.int64), np.frombuffer(row.nulls, bool)
        self.end = np.cumsum(self.sizes)
        self.start = self.end - self.sizes
        width = BEFORE + 1
        places, hashes = [], []
        for a in range(0, len(self.data), SLICE):
            low, high = max(0, a - BEFORE), min(len(self.data), a + SLICE + LENGTH)
            if high - low < LENGTH:
                continue
            h = gram_hashes(self.data[low:high])
            least = sliding(h, width, np.minimum)  # of the GRAMs in the string from each position on
            for d in range(np.searchsorted(self.end, low, "right"), np.searchsorted(self.start, high, "left")):
                least[max(self.start[d], self.end[d] - LENGTH + 1, low) - low : max(0, self.end[d] - low)] = 0  # not inside one text
            held = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
            best = sliding(held, width, np.maximum)[: len(h)]
            at = np.flatnonzero(best == h)
            at = at[(at + low >= a) & (at + low < a + SLICE)]
            places.append(at + low)
            hashes.append(h[at])
        self.at = np.concatenate(places) if places else np.zeros(0, np.int64)
        self.gram = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.doc = np.searchsorted(self.end, self.at, "right")
        self.left = np.minimum(self.at - self.start[self.doc], BEFORE)
        self.right = np.minimum(self.end[self.doc] - self.at, LENGTH)

    def span_hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A hash of the bytes in each [first, last), from the GRAMs that cover them."""
        out = mix64((last - first).astype(np.uint64))
        for step in range(0, BEFORE + LENGTH, GRAM):
            out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + self.hash_at(np.minimum(first + step, last - GRAM)))
        return out

    def hash_at(self, at: np.ndarray) -> np.ndarray:
        table, h = mix64(np.arange(1, 257, dtype=np.uint64)), None
        for a in range(0, len(at), 1 << 16):
            part = table[self.data[at[a : a + (1 << 16), None] + np.arange(GRAM)]]
            for step in range(GRAM.bit_length() - 1):
                part = part[:, 0::2] * np.uint64(0x9E3779B97F4A7C15 + 2 * step) + part[:, 1::2]
            h = part[:, 0] if h is None else np.concatenate([h, part[:, 0]])
        return mix64(h) if h is not None else np.zeros(0, np.uint64)

    def order(self, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(doc_id, row of the block and place): with the block's number, where a position comes in all."""
        return self.ids[doc], doc.astype(np.uint64) << np.uint64(32) | (at - self.start[doc]).astype(np.uint64)


class Firsts:
    """Distinct keys of a block, how often it has each, and where first."""

    def __init__(self, cover: Cover, keys: np.ndarray, at: np.ndarray, doc: np.ndarray):
        ids, places = cover.order(at, doc)
        by = np.lexsort((places, ids, keys))
        self.keys, first, counts = np.unique(keys[by], return_index=True, return_counts=True)
        self.first, self.counts = by[first], counts.astype(np.uint32)
        self.ids, self.places = ids[self.first], places[self.first]
        self.of = np.searchsorted(self.keys, keys)


def grams(cover: Cover, parts: int):
    distinct, at, counts = np.unique(cover.gram, return_inverse=True, return_counts=True)
    return Parted(distinct, parts), at, counts.astype(np.uint32)


def reaches(cover: Cover, some: np.ndarray, parts: int):
    """Of the sample positions `some`: everything a string around one could reach."""
    at = cover.at[some]
    keys = mix64(cover.span_hashes(at - cover.left[some], at + cover.right[some]) + cover.left[some].astype(np.uint64))  # and where in it
    found = Firsts(cover, keys, at, cover.doc[some])
    return found, Parted(found.keys, parts)


class State:
    """What the answers so far say of a block's sample positions."""

    def __init__(self, row, told: pd.DataFrame, parts: int):
        self.cover, by = Cover(row), dict(list(told.groupby("kind")))
        c = self.cover
        asked, at, _ = grams(c, parts)
        self.total = asked.answers(by["grams"], "answer", np.int64)[at] if len(at) else np.zeros(0, np.int64)
        self.some = np.flatnonzero(self.total > 1)
        self.found, self.asked = reaches(c, self.some, parts)
        if "reaches" in by or not len(self.some):
            a = self.asked.answers(by["reaches"], "answer", np.int64) if len(self.some) else np.zeros(0, np.int64)
            mine, count = (a & 1).astype(bool), a >> 1
            first = np.zeros(len(self.some), bool)
            first[self.found.first[mine]] = True
            self.again = self.some[~first]  # all strings around these have occurred before
            self.open = self.some[first & (count[self.found.of] < self.total[self.some])]
            self.near, self.hot = self.open[self.total[self.open] <= HOT], self.open[self.total[self.open] > HOT]
            self.by = by

    def strings(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, document) of every string around the positions of very frequent GRAMs, each once."""
        c, h = self.cover, self.hot
        low, high = c.at[h] - c.left[h], c.at[h] + c.right[h] - LENGTH
        size = high - low + 1
        starts = np.unique(np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum()))
        return starts, np.searchsorted(c.end, starts, "right")


def sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """How often each GRAM occurs. Sums are exact up to 2^53."""
    keys = [unpack_sorted(k) for k in pdf["keys"]]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, np.concatenate([unpack(c, np.uint32) for c in pdf["counts"]]), len(every))[at]
    return _answers(pdf, [len(k) for k in keys], total.astype(np.int64))


def firsts(pdf: pd.DataFrame) -> pd.DataFrame:
    """How often each key occurs, and in bit 0 whether the asking block has it first of all."""
    keys = [unpack_sorted(k) for k in pdf["keys"]]
    size = [len(k) for k in keys]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, np.concatenate([unpack(c, np.uint32) for c in pdf["counts"]]), len(every))[at]
    ids, places = (np.concatenate([unpack(x, t) for x in pdf[c]]) for c, t in (("ids", np.int64), ("places", np.uint64)))
    by = np.lexsort((places, np.repeat(pdf["block"].to_numpy(), size), ids, at))
    first = np.zeros(len(at), bool)
    first[by[np.append(True, at[by][1:] != at[by][:-1])]] = True
    return _answers(pdf, size, total.astype(np.int64) << 1 | first)


def buckets(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sort the suffixes of the part's GRAMs; a bit for each string around a position: does it start earlier too."""
    size = [len(unpack_sorted(k)) for k in pdf["keys"]]
    block = np.repeat(pdf["block"].to_numpy(), size)
    ids, places = (np.concatenate([unpack(x, t) for x in pdf[c]]) for c, t in (("ids", np.int64), ("places", np.uint64)))
    reach = np.concatenate([unpack(x, "V2") for x in pdf["reach"]]).view(np.uint8).reshape(-1, 2).astype(np.int64)
    text = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(x)), np.uint8).reshape(-1, BEFORE + LENGTH) for x in pdf["bytes"]])
    by = np.lexsort((places, block, ids))
    text, reach = text[by], reach[by]
    n = len(by)
    (after, after_lcp), (before, before_lcp) = ranked(text[:, BEFORE:]), ranked(text[:, BEFORE - 1 :: -1][:, :BEFORE])
    bits = np.zeros((n, BEFORE + 1), bool)
    for back in range(BEFORE + 1):
        valid = np.flatnonzero((reach[:, 0] >= back) & (reach[:, 1] >= LENGTH - back))
        if len(valid) > 1:
            key = depth(before, before_lcp, back)[valid] * (n + 1) + depth(after, after_lcp, LENGTH - back)[valid]
            order = np.argsort(key, kind="stable")
            tie = key[order][1:] == key[order][:-1]
            bits[valid[order[1:][tie]], back] = True
    out = np.empty((n, (BEFORE + 8) // 8), np.uint8)
    out[by] = np.packbits(bits, axis=1, bitorder="little")
    return _answers(pdf, size, out.view(f"V{out.shape[1]}").reshape(-1))


def ranked(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows by their bytes, and how many bytes each shares with the one before it."""
    padded = np.zeros((len(text), -(-text.shape[1] // 8) * 8), np.uint8)
    padded[:, : text.shape[1]] = text
    order = np.lexsort(padded.view(">u8").astype(np.uint64).T[::-1])
    differ = text[order[1:]] != text[order[:-1]]
    shared = np.where(differ.any(1), differ.argmax(1), text.shape[1])
    return order, np.append(0, shared)


def depth(order: np.ndarray, shared: np.ndarray, n: int) -> np.ndarray:
    """Ranks by the first n bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(shared < n)
    return out


def _answers(pdf: pd.DataFrame, size: list[int], values: np.ndarray) -> pd.DataFrame:
    end = np.cumsum(size)
    return pd.DataFrame([
        {"kind": k, "part": p, "block": b, "answer": pack(values[e - s : e])}
        for k, p, b, e, s in zip(pdf["kind"], pdf["part"], pdf["block"], end, size, strict=True)
    ])


def ask_rows(kind: str, parted: Parted, block: int, **columns) -> pd.DataFrame:
    return pd.DataFrame(list(parted.ask(block, **columns)), columns=ASK_COLUMNS).assign(kind=kind)


def removed(docs: DataFrame, finish, schema: str | T.StructType, id_col: str = "doc_id", text_col: str = "text", carried: list[Column] | None = None) -> DataFrame:
    """Rows that `finish` makes of each block's cover and the mask of bytes to remove; with `carried` columns, also of these,
    as an Arrow table, and the rows are one too."""
    spark = docs.sparkSession
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("raw")
    parts = max(spread(spark), docs.count() // 4000)
    blocks = bucketed(encode(docs.select(F.col(id_col).cast("long").alias("doc_id"), raw, *(carried or []))), parts, "block")

    def ask_grams(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                cover = Cover(row)
                asked, _, counts = grams(cover, parts)
                yield ask_rows("grams", asked, cover.block, counts=counts)

    def grouped(asked: DataFrame, run) -> DataFrame:
        return asked.groupBy("kind", "part").applyInPandas(run, TOLD)

    told = materialize(grouped(blocks.mapInPandas(ask_grams, ASK), sums))

    def ask_reaches(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        s = State(next(left.itertuples()), right, parts)
        return ask_rows("reaches", s.asked, s.cover.block, counts=s.found.counts, ids=s.found.ids, places=s.found.places)

    told = told.unionByName(materialize(grouped(answers_to(blocks, told, ask_reaches, ASK), firsts)))

    def ask_buckets(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        s = State(next(left.itertuples()), right, parts)
        c, near = s.cover, s.near
        ids, places = c.order(c.at[near], c.doc[near])
        padded = np.concatenate([np.zeros(BEFORE, np.uint8), c.data, np.zeros(LENGTH, np.uint8)])
        parted = Parted(c.gram[near], parts)
        reach = np.stack([c.left[near], c.right[near]], 1).astype(np.uint8).view("V2").reshape(-1)
        rows = ask_rows("buckets", parted, c.block, ids=ids, places=places, reach=reach)
        squeeze = zstandard.ZstdCompressor(level=3).compress
        texts = [squeeze(padded[c.at[near[parted.order[a:b]]][:, None] + np.arange(BEFORE + LENGTH)].tobytes()) for a, b in zip(parted.start, parted.stop, strict=True)]
        rows["bytes"] = pd.Series(texts, dtype=object)
        starts, doc = s.strings()
        found = Firsts(c, c.span_hashes(starts, starts + LENGTH), starts, doc)
        hot = ask_rows("strings", Parted(found.keys, parts), c.block, counts=found.counts, ids=found.ids, places=found.places)
        return pd.concat([r for r in (rows, hot) if len(r)]) if len(rows) or len(hot) else rows

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        return (buckets if pdf["kind"].iloc[0] == "buckets" else firsts)(pdf)

    told = told.unionByName(materialize(grouped(answers_to(blocks, told, ask_buckets, ASK), settle)))

    alone = not carried

    def cut(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame | pa.Table:
        s = State(next(left.itertuples()), right, parts)
        c = s.cover
        edge = np.zeros(len(c.data) + 1, np.int32)
        np.add.at(edge, c.at[s.again] - c.left[s.again], 1)
        np.add.at(edge, c.at[s.again] + c.right[s.again], -1)
        starts = []
        if len(s.near):
            wide = (BEFORE + 8) // 8
            bits = Parted(c.gram[s.near], parts).answers(s.by["buckets"], "answer", f"V{wide}").view(np.uint8).reshape(-1, wide)
            i, back = np.nonzero(np.unpackbits(bits, axis=1, bitorder="little")[:, : BEFORE + 1])
            starts.append(c.at[s.near[i]] - back)
        if len(s.hot):
            at, doc = s.strings()
            found = Firsts(c, c.span_hashes(at, at + LENGTH), at, doc)
            mine = (Parted(found.keys, parts).answers(s.by["strings"], "answer", np.int64) & 1).astype(bool)
            first = np.zeros(len(at), bool)
            first[found.first[mine]] = True
            starts.append(at[~first])
        for at in starts:
            np.add.at(edge, at, 1)
            np.add.at(edge, at + LENGTH, -1)
        gone = np.cumsum(edge, dtype=np.int32)[:-1] > 0
        return finish(c, gone) if alone else finish(c, gone, carried_of(left))

    if alone:
        return answers_to(blocks, told, cut, schema)
    arrow = lambda left, right: cut(left.to_pandas(), right.to_pandas())
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(arrow, schema)


def carried_of(left: pd.DataFrame) -> pa.Table:
    with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(bytes(left["carried"].iloc[0]))) as stream:
        return stream.read_all()


def digest(c: Cover, gone: np.ndarray) -> pd.DataFrame:
    rows = []
    for i, null, a, b in zip(c.ids.tolist(), c.null, c.start, c.end, strict=True):
        out = gone[a:b]
        runs = int(out[:1].sum() + (out[1:] & ~out[:-1]).sum())
        rows.append((None if null else i, int(b - a), int(out.sum()), runs, hashlib.sha256(c.data[a:b][~out].tobytes()).hexdigest()))
    frame = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return frame.astype({"doc_id": "Int64"})


def dedup_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of `docs`.

    Null texts are empty. Null ids come after all others; rows of the same id come in the order they are read. Texts
    shorter than LENGTH lose nothing.
    """
    return removed(docs, digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", id_col, text_col)


def kept_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with their columns, what is left of each text, and n_removed. A character goes only with all of
    its bytes. Null texts come back empty, texts of any length count whole, and an empty table gives one. Ids and all other
    columns, of whatever type and name, come back as they were; a column n_removed of `docs` stays instead of the count."""
    rest = [c for c in docs.columns if c != text_col]

    def finish(c: Cover, gone: np.ndarray, carried: pa.Table) -> pa.Table:
        lead = np.flatnonzero((c.data & 0xC0) != 0x80)
        if len(lead):
            whole = np.minimum.reduceat(gone.astype(np.uint8), lead)
            gone = np.repeat(whole, np.diff(np.append(lead, len(gone)))).astype(bool)
        kept = [c.data[a:b][~gone[a:b]].tobytes().decode() for a, b in zip(c.start, c.end, strict=True)]
        counts = [int(gone[a:b].sum()) for a, b in zip(c.start, c.end, strict=True)]
        return carried.append_column("kept", pa.array(kept, pa.string())).append_column("n_lost", pa.array(counts, pa.int64()))

    named = {c: f"c{k}" for k, c in enumerate(rest)}
    schema = T.StructType([*(T.StructField(n, docs.schema[c].dataType) for c, n in named.items()), T.StructField("kept", T.StringType()), T.StructField("n_lost", T.LongType())])
    made = removed(docs, finish, schema, id_col, text_col, [F.col(c).alias(n) for c, n in named.items()])
    back = [F.col(named.get(c, "kept")).alias(c) for c in docs.columns]
    return made.select(*back, *([F.col("n_lost").alias("n_removed")] if "n_removed" not in docs.columns else []))


def op4(spark, sf_dir):
    """The digest of all rows of `documents`: null and empty texts keep nothing and lose nothing, texts of any length count whole."""
    return dedup_digest(documents(spark, sf_dir, "doc_id", "text"))
