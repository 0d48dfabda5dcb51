"""Lexical retrieval packing: fill each seed's window with its nearest unused neighbours by BM25.

A document's ids are cut into whole windows and a tail. What retrieves a tail are the words of its whole document, as hashed
terms. Document frequencies of the terms, the number of documents and their mean length are counted over all documents, and
every shard weighs its words by them. Tails are dealt to shards, those with the same least hashed word together, and large
buckets split. Each shard has an inverted index of its tails; the longest unused tail is the seed of a window, and the index
returns unused neighbours by score, which fill the window in that order; the last is cut to fit, and its rest stays unused.
So every window is full but the last of a shard.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize

WINDOW, END_ID = 1024, 0
VOCABULARY = "byte_bpe_50k.tiktoken"
SHARD = 512  # tails to a bucket on average, and half of what splits one
K1, B = 1.2, 0.75
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
TERMS, CHUNK = 1 << 20, 1 << 14  # hashed terms; terms of which a task counts the documents in one row
FEW = 2_000_000  # buckets to split that may be broadcast
STAGED = PIECE + ", ids binary, terms binary, bucket long, row long"
COLUMNS = [c.split()[0] for c in PIECE.split(", ")]
MARKS = b".,;:!?"
TOGETHER = 1 << 21  # characters of texts whose distinct words are encoded once


def runs(flat: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`flat` holds runs of these sizes, one after the other: the runs that `at` names, and the sizes of those."""
    sizes, begin = size[at], (np.cumsum(size) - size)[at]
    begin -= np.cumsum(sizes) - sizes
    place = np.repeat(begin, sizes)
    place += np.arange(len(place))
    return flat[place], sizes


class Words:
    """What stands between the spaces of some texts: the distinct ones, and the numbers of each text's."""

    def __init__(self, texts: list[str]):
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = cut.flatten().dictionary_encode()
        self.texts, self.names, self.at = texts, coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self.bounds = np.concatenate(([0], np.cumsum(pc.list_value_length(cut).to_numpy())))

    def terms(self) -> list[np.ndarray]:
        """Of each text, hashed terms, ascending, and counts of its words without marks around them, as [2, n]."""
        flat, ends = [], []
        for name in self.names:
            for w in name.encode().lower().split():
                w = w.strip(MARKS)
                if w:
                    flat.append(zlib.crc32(w) % TERMS)
            ends.append(len(flat))
        term, size = runs(np.array(flat, np.int64), np.diff(ends, prepend=0), self.at)
        text = np.repeat(np.repeat(np.arange(len(self.texts)), np.diff(self.bounds)), size)
        key = np.sort(text * TERMS + term)
        begin = np.flatnonzero(np.diff(key, prepend=-1))
        held = np.stack([key[begin] % TERMS, np.diff(begin, append=len(key))]).astype(np.uint32)
        return np.split(held, np.searchsorted(key[begin], np.arange(1, len(self.texts)) * TERMS), axis=1)


class Encoder:
    """Ids of the public byte-level BPE.

    The pattern that splits texts before the merges takes a space along with what follows it, and no piece goes on from
    other characters into a space. So a text whose spaces stand alone between other characters is its first word and each
    later one with its space before it; of some texts, each distinct word is encoded once. Any other text is encoded whole.
    """

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.spaced = np.zeros(max(ranks.values()) + 1, bool)
        self.spaced[[i for token, i in ranks.items() if token[:1] == b" "]] = True

    def ids(self, words: Words) -> Iterator[np.ndarray]:
        """The ids of each text and its end."""
        later = np.ones(len(words.at), bool)
        later[words.bounds[:-1]] = False
        at, bounds = words.at[later], words.bounds - np.arange(len(words.bounds))
        used = np.bincount(at, minlength=len(words.names)) > 0
        odd = np.array([u and (not w or w[0].isspace() or w[-1].isspace()) for u, w in zip(used.tolist(), words.names, strict=True)], bool)
        once = np.flatnonzero(used & ~odd)
        made = np.array(self.encode("".join(" " + words.names[k] for k in once)), "<u2")
        size = np.zeros(len(words.names), np.int64)
        size[once] = np.diff(np.flatnonzero(self.spaced[made]), append=len(made))  # only a word's first token has a space
        every, sizes = runs(made, size, at)
        ends, odd = np.concatenate(([0], np.cumsum(sizes)))[bounds], np.concatenate(([0], np.cumsum(odd[at])))[bounds]
        for k, text in enumerate(words.texts):
            first = words.names[words.at[words.bounds[k]]]
            if odd[k] < odd[k + 1] or (bounds[k] < bounds[k + 1] and (not first or first[-1].isspace())):
                yield np.array([*self.encode(text), END_ID], "<u2")
            else:
                yield np.concatenate([np.array(self.encode(first), "<u2"), every[ends[k] : ends[k + 1]], np.array([END_ID], "<u2")])

    def ids_of(self, text: str) -> np.ndarray:
        return next(self.ids(Words([text])))


@cache
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    return Encoder(vocabulary)


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def terms_of(text: str) -> np.ndarray:
    return Words([text]).terms()[0]


def bucket_of(terms: np.ndarray, buckets: int) -> int:
    least = int((terms[0] * np.uint32(0x9E3779B1)).min()) if terms.size else 0
    return least * 0x9E3779B97F4A7C15 % (1 << 64) % buckets


def pieces(docs: DataFrame, buckets: int, vocabulary: str) -> DataFrame:
    """Whole windows, each a sequence of its own, and tails with their ids. Terms are with a document's last piece."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, made, e = TaskContext.get().partitionId() << 38, 0, encoder(vocabulary)
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            cuts = np.flatnonzero(np.diff(np.cumsum([len(t) for t in texts]) // TOGETHER)) + 1
            for a, b in pairwise([0, *cuts.tolist(), len(texts)] if texts else []):
                out, words = [], Words(texts[a:b])
                for i, ids, terms in zip(pdf["doc_id"].iloc[a:b], e.ids(words), words.terms(), strict=True):
                    tail = len(ids) % WINDOW
                    for start in range(0, len(ids), WINDOW):
                        some = ids[start : start + WINDOW]
                        last = terms.tobytes() if start + WINDOW >= len(ids) else None
                        cut = (None, None, some.tobytes(), last, bucket_of(terms, buckets)) if len(some) < WINDOW else ((base + made) * 2, 0, None, last, None)
                        out.append((i, start, len(some), checksum(some), len(ids), *cut, base + made))
                        made += 1
                frame = pd.DataFrame(out, columns=[*COLUMNS, "ids", "terms", "bucket", "row"])
                yield frame.astype({c: "Int64" for c in [*COLUMNS, "bucket", "row"]})

    return docs.mapInPandas(rows, STAGED)


class Corpus:
    """What all documents say: their number, their mean length, and the weight of each hashed term."""

    def __init__(self, documents: int, words: int, frequency: np.ndarray):
        self.frequency, self.mean = frequency, max(words / max(documents, 1), 1e-9)
        self.idf = np.log1p((documents - frequency + 0.5) / (frequency + 0.5)).astype(np.float32)


def corpus(staged: DataFrame) -> Corpus:
    """Counts over all documents: each task sums its own, a row for each part of the terms, and those are summed by part.
    TERMS numbers come to the driver, however large the corpus."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, documents, words = np.zeros(TERMS, np.int64), 0, 0
        for pdf in batches:
            terms = [np.frombuffer(t, np.uint32).reshape(2, -1) for t in pdf["terms"]]
            flat = np.concatenate(terms, 1)
            found += np.bincount(flat[0], minlength=TERMS)
            documents, words = documents + len(terms), words + int(flat[1].sum(dtype=np.int64))
        if documents:
            yield pd.DataFrame([{"part": -1, "found": np.array([documents, words]).tobytes()}] + [{"part": a // CHUNK, "found": found[a : a + CHUNK].tobytes()} for a in range(0, TERMS, CHUNK)])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(len(pdf["found"].iloc[0]) // 8, np.int64)
        for f in pdf["found"]:
            out += np.frombuffer(f, np.int64)
        return pd.DataFrame([{"part": pdf["part"].iloc[0], "found": out.tobytes()}])

    schema = "part int, found binary"
    counted = staged.where(F.col("terms").isNotNull()).select("terms").mapInPandas(rows, schema).groupBy("part").applyInPandas(total, schema)
    by = {r.part: np.frombuffer(r.found, np.int64) for r in counted.collect()}
    documents, words = by.pop(-1, np.zeros(2, np.int64)).tolist()
    return Corpus(documents, words, np.concatenate([by[k] for k in sorted(by)]) if by else np.zeros(TERMS, np.int64))


class Index:
    """An inverted index with BM25 weights over the tails of a shard."""

    def __init__(self, terms: list[np.ndarray], known: Corpus):
        n = len(terms)
        doc = np.repeat(np.arange(n), [t.shape[1] for t in terms])
        flat = np.concatenate(terms, 1)
        size = np.bincount(doc, flat[1], n)
        distinct, term, here = np.unique(flat[0], return_inverse=True, return_counts=True)
        tf = flat[1].astype(np.float64)
        weight = known.idf[flat[0]] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / known.mean))
        common = here[term] > 1  # a word of one tail leads to no neighbour
        order = np.argsort(term[common], kind="stable")
        self.doc, self.weight = doc[common][order], weight[common][order]
        self.begin = np.searchsorted(term[common][order], np.arange(len(distinct)))
        self.end = np.append(self.begin[1:], len(self.doc))
        mine = np.argsort(doc[common], kind="stable")
        self.words = np.split(term[common][mine], np.searchsorted(doc[common][mine], np.arange(1, n)))

    def scores(self, seed: int, n: int) -> np.ndarray:
        t = self.words[seed]
        size = self.end[t] - self.begin[t]
        at = np.repeat(self.begin[t] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.bincount(self.doc[at], self.weight[at], n)


def fill(pdf: pd.DataFrame, known: Corpus) -> pd.DataFrame:
    """The windows of a shard."""
    pdf = pdf.sort_values(["doc_id", "start", "row"], kind="stable")
    shard, n = int(pdf["shard"].iloc[0]), len(pdf)
    ids = [np.frombuffer(b, "<u2") for b in pdf["ids"]]
    index = Index([np.frombuffer(b, np.uint32).reshape(2, -1) for b in pdf["terms"]], known)
    at, left = np.zeros(n, np.int64), np.array([len(x) for x in ids], np.int64)
    starts, totals, names = pdf["start"].to_numpy(np.int64), pdf["doc_tokens"].to_numpy(np.int64), pdf["doc_id"].astype("Int64").tolist()
    out, number = [], 0
    for seed in np.argsort(-left, kind="stable"):
        if not left[seed]:
            continue
        sequence, offset = ((shard << 24) + number) * 2 + 1, 0
        number += 1
        near = [seed]
        if left[seed] < WINDOW:
            open_ = np.flatnonzero(left > 0)
            open_ = open_[open_ != seed]
            near = np.append(seed, open_[np.argsort(-index.scores(seed, n)[open_], kind="stable")])
        for d in near:
            take = int(min(left[d], WINDOW - offset))
            a = int(at[d])
            out.append((names[d], int(starts[d]) + a, take, checksum(ids[d][a : a + take]), int(totals[d]), sequence, offset))
            at[d] += take
            left[d] -= take
            offset += take
            if offset == WINDOW:
                break
    return pd.DataFrame(out, columns=COLUMNS).astype({"doc_id": "Int64"})


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    Null and empty texts are their end id alone. Repeated rows are packed each; null ids are kept; texts of any length count
    whole; other columns are not read, whatever their names. `vocabulary` names a tiktoken file of public_tokenizers; ids are
    its, without special tokens. Rows are numbered before they are written, and what is written decides their shards.
    """
    spark, buckets = docs.sparkSession, max(1, docs.count() // SHARD)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    staged = materialize(pieces(named, buckets, vocabulary))
    held = spark.sparkContext.broadcast(corpus(staged))
    tails = sharded(staged.where(F.col("bucket").isNotNull()), buckets)
    filled = tails.groupBy("shard").applyInPandas(lambda pdf: fill(pdf, held.value), PIECE)
    return staged.where(F.col("bucket").isNull()).select(*COLUMNS).unionByName(filled)


def sharded(tails: DataFrame, buckets: int) -> DataFrame:
    """Tails with their shard: a bucket of more than twice the usual size is several. Sizes are counted first and joined to
    the tails where these are read, or, of more than FEW large buckets, by (bucket, salt): no bucket moves whole."""
    large = materialize(tails.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 2 * SHARD).select("bucket", F.ceil(F.col("n") / (2 * SHARD)).cast("long").alias("splits")))
    number, most = large.agg(F.count("*"), F.max("splits")).first()
    if number <= FEW:
        tails = tails.join(F.broadcast(large), "bucket", "left")
    else:
        salts = F.sequence(F.lit(0), F.lit(max(1, most // 100)).cast("int") - 1)
        tails = tails.withColumn("salt", F.pmod("row", F.size(salts))).join(large.withColumn("salt", F.explode(salts)), ["bucket", "salt"], "left").drop("salt")
    wide = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "row"), F.coalesce("splits", F.lit(1)))
    return tails.withColumn("shard", F.col("bucket") + F.lit(buckets) * wide)


def op5(spark, sf_dir):
    """The pieces of all rows of `documents`; nulls, empty texts and repeated rows as pack_documents() says."""
    return pack_documents(documents(spark, sf_dir, "doc_id", "text"))
