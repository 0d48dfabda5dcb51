"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its hashed character n-grams, so a misspelling that was never
seen shares most of them. All words of a text are averaged, each with a weight exp(a) that its n-grams have learned too, and
the mean goes through a linear softmax: a few words that matter count in a long text as in a short one.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, mix64, remainder

#: The fitting sample: so many labelled documents of either class, drawn among those of up to so many characters.
DOCS_PER_CLASS, LONGEST = 2000, 20_000
BUCKETS, DIM, NGRAMS = 1 << 18, 4, (3, 4, 5, 6)
CHUNK = 10_000  # words whose n-grams are laid out at a time
STEPS, RATE, DECAY, SEED = 80, 0.05, 1e-5, 9
SHARP = 4.0  # a weight is exp(SHARP a): lets weights part as fast as vectors do
EDGE = re.compile(r"^\W+|\W+$")


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every n-gram of `<word>` as UTF-8; every word has at least one. There is no bucket for
    whole words: rare ones would be learned by heart, and their variants not at all."""
    raw = [f"<{EDGE.sub('', w)}>".encode() for w in words]
    size = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), size)
    start = np.cumsum(size) - size
    left = size[owner] - (np.arange(len(data)) - start[owner])  # characters from here to the word's end
    who, what = [], []
    for n in NGRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + data[at + k]
        who.append(owner[at])
        what.append(mix64(h))
    short = np.flatnonzero(size < NGRAMS[0])  # "<>" and the like: one bucket for all
    who.append(short)
    what.append(np.zeros(len(short), np.uint64))
    return np.concatenate(who), (np.concatenate(what) % np.uint64(BUCKETS)).astype(np.int64)


class Model:
    """For each bucket its part of a word's logit and of the logarithm of the word's weight."""

    def __init__(self, bucket: np.ndarray, attention: np.ndarray, bias: float):
        self.table, self.bias, self.seen = np.stack([bucket, attention]).astype(np.float32), bias, {}

    def learn_words(self, words: list[str]) -> None:
        new = [w for w in words if w not in self.seen]
        if len(self.seen) > 400_000:
            self.seen.clear()
            new = words
        for a in range(0, len(new), CHUNK):
            part = new[a : a + CHUNK]
            logit, weight = word_vectors([buckets_of(part)], self.table).tolist()
            self.seen.update(zip(part, zip(logit, weight, strict=True), strict=True))

    def scores(self, texts: list[str | None]) -> list[float]:
        """A text without words has the bias alone."""
        split = [tokens(t) for t in texts]
        self.learn_words(list(set().union(*split)) if split else [])
        out = []
        for words in split:
            logit = 0.0
            if words:
                each = np.array([self.seen[w] for w in words])
                weight = np.exp(each[:, 1] - each[:, 1].max())
                logit = float(each[:, 0] @ weight / weight.sum())
            out.append(1 / (1 + float(np.exp(-np.clip(logit + self.bias, -60, 60)))))
        return out


class Bags:
    """The distinct words of each text with their counts, and the buckets of each word."""

    def __init__(self, texts: list[str]):
        counts = [Counter(tokens(t) or ["-"]) for t in texts]
        words = sorted(set().union(*counts))
        number = {w: i for i, w in enumerate(words)}
        size = np.array([len(c) for c in counts])
        self.doc, self.begin = np.repeat(np.arange(len(counts)), size), np.cumsum(size) - size
        self.word = np.fromiter((number[w] for c in counts for w in c), np.int64, size.sum())
        self.count = np.fromiter((n for c in counts for n in c.values()), np.float64, size.sum())
        self.words = len(words)
        self.buckets = [buckets_of(words[a : a + CHUNK]) for a in range(0, len(words), CHUNK)]

    def means(self, emb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors and shares of each word of a text, and the texts' means; a row for each dimension."""
        v = word_vectors(self.buckets, emb)[:, self.word]
        log = SHARP * v[DIM]
        e = self.count * np.exp(log - np.maximum.reduceat(log, self.begin)[self.doc])
        share = e / np.add.reduceat(e, self.begin)[self.doc]
        return v[:DIM], share, np.stack([np.add.reduceat(share * x, self.begin) for x in v[:DIM]])

    def gradient(self, v: np.ndarray, share: np.ndarray, mean: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Of the embedding and its weights, from that of the means."""
        back = back[:, self.doc]
        pull = SHARP * share * (back * (v - mean[:, self.doc])).sum(0)
        out = np.zeros((DIM + 1, BUCKETS))
        for d in range(DIM + 1):
            slope = np.bincount(self.word, share * back[d] if d < DIM else pull, self.words)
            for k, (what, _, per) in enumerate(self.buckets):
                part = slope[k * CHUNK : k * CHUNK + len(per)] / per
                out[d] += np.bincount(what, np.repeat(part, per), BUCKETS)
        return out


def buckets_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words' n-grams, word after word, where each word's begin, and how many it has."""
    who, what = subwords(words)
    order = np.argsort(who, kind="stable")
    per = np.bincount(who, minlength=len(words))
    return what[order].astype(np.int32), np.cumsum(per) - per, per


def word_vectors(buckets: list[tuple], emb: np.ndarray) -> np.ndarray:
    """Means of the columns of `emb` (a row for each dimension), a part of the words at a time."""
    return np.concatenate([np.stack([np.add.reduceat(x[what], edge) for x in emb]) / per for what, edge, per in buckets], 1)


def train(texts: list[str], labels: list[int]) -> Model:
    """Vectors, weights and softmax together, by Adam on whole batches; classes weigh the same."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():  # one class, or nothing: the score is that class everywhere
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 60.0 if len(y) and y[0] else -60.0)
    bags, rng = Bags(texts), np.random.default_rng(SEED)
    emb, out, bias = rng.normal(0, 0.05, (DIM + 1, BUCKETS)), rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)
    emb[DIM] = 0
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (emb, out, bias)]
    every = np.arange(len(y))
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    for step in range(1, STEPS + 1):
        v, share, mean = bags.means(emb)
        z = mean.T @ out + bias
        delta = 1 / (1 + np.exp(np.clip(z[:, ::-1] - z, -60, 60)))  # softmax of two
        delta[every, y.astype(int)] -= 1
        delta *= weight[:, None]
        grads = (bags.gradient(v, share, mean, out @ delta.T) + DECAY * emb, mean @ delta, delta.sum(0))
        for p, g, (m, s) in zip((emb, out, bias), grads, state, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Model((out[:, 1] - out[:, 0]) @ emb[:DIM], SHARP * emb[DIM], float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """From up to DOCS_PER_CLASS labelled documents of each class, those of the least hashed ids among texts of up to
    LONGEST characters. Null labels and null ids are left out, and an id with both labels is toxic; of texts that share an
    id the least is taken. Without labels of both classes every score is 0 or 1, as the one class says, or 0."""
    named = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.length("text") <= LONGEST)
    fitting = named.join(texts.select("id"), "id", "left_semi")
    draw = F.xxhash64(F.col("id"), F.lit(9))
    chosen = None
    for y in (0, 1):
        some = fitting.where(F.col("y") == y).orderBy(draw, "id").limit(DOCS_PER_CLASS)
        chosen = some if chosen is None else chosen.unionByName(some)
    got = texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    rows = sorted(got.collect(), key=lambda r: r.id)
    return train([r.text for r in rows], [int(r.y) for r in rows])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row; a null or empty text has the score of no words, and equal texts have equal scores.
    Texts of any length count whole. Other columns are not read, whatever their names. No shuffle."""
    held = docs.sparkSession.sparkContext.broadcast((*model.table, model.bias))

    def rows(batches):
        own = Model(*held.value)
        for pdf in batches:
            for a in range(0, len(pdf), 2000):
                part = pdf.iloc[a : a + 2000]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").values, "score": own.scores([t if isinstance(t, str) else None for t in part["text"]])})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(rows, "doc_id long, score double")


def op9(spark, sf_dir, cut: float = 0.7):
    """One row per row of `documents`: its score by a model of the labels whose ids' crc32 leaves 0 or 2 by 3, and whether
    that reaches `cut`. Null and empty texts have the score of no words; null ids are kept and never learned from."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = remainder("doc_id", 3) == 1
    model = fit(docs, labels.where(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
