"""Language identification by cross-parsing: a suffix automaton of labelled text for each language.

A text is cut, from left to right, into the longest phrases that the language's text contains (a character it doesn't
have is a phrase of its own). Phrases times the logarithm of the language's sample length, over the text's length,
estimate the cross entropy; the language with the least wins. Every letter of any sample is a symbol of its own. Moves by
the most frequent symbols are dense tables, all others a sorted list, and many texts step through them side by side.
"""

from __future__ import annotations

import math
import unicodedata
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, remainder

#: The fitting sample: so many labelled documents of a language, whole, drawn among those of up to so many characters; where a
#: language has fewer such, its shortest others, of up to so many.
DOCS_PER_LANG, LONGEST, MOST = 16, 2_000, 1 << 20
DENSE = 64  # symbols with a column of the table
BLOCK, LANES = 2048, 2048
SPACE, OTHER = 0, 1


@cache
def folded() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is no letter; the planes from the fourth on have none."""
    out = np.zeros(0x34001, np.uint32)
    for c in range(len(out) - 1):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters(text: str) -> np.ndarray:
    """Lower-case letters as code points, everything else as 0, and runs of that as one."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = folded()[np.minimum(points, len(folded()) - 1)]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[keep]


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and s not in moves[p]:
            moves[p][s] = new
            p = link[p]
        if p >= 0:
            q = moves[p][s]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(s) == q:
                    moves[p][s] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


class Model:
    """Languages, the symbol of each code point, and the automata joined to one table."""

    def __init__(self, samples: dict[str, list[str]]):
        text = {}
        for lang in sorted(samples):
            got = [letters(t) for t in samples[lang]]
            if any(g.any() for g in got):
                text[lang] = np.concatenate(got)
        self.langs = list(text)
        used, counts = np.unique(np.concatenate([*text.values(), np.zeros(1, np.uint32)]), return_counts=True)
        ranked = used[np.argsort(-counts, kind="stable")]
        ranked = ranked[ranked > 0]
        self.symbol = np.full(len(folded()), OTHER, np.int32)
        self.symbol[0] = SPACE
        self.symbol[ranked] = np.arange(2, 2 + len(ranked))
        self.symbols, self.width = 2 + len(ranked), min(DENSE, 2 + len(ranked))
        tables, roots, keys, to, at = [], [], [], [], 0
        for lang in self.langs:
            moves = automaton(self.symbol[text[lang]].tolist())
            table = np.full((len(moves), self.width), -1, np.int32)
            for state, out in enumerate(moves):
                for s, target in out.items():
                    if s < self.width:
                        table[state, s] = target + at
                    else:
                        keys.append((state + at) * self.symbols + s)
                        to.append(target + at)
            tables.append(table)
            roots.append(at)
            at += len(moves)
        self.table = np.ascontiguousarray(np.concatenate(tables)).reshape(-1) if tables else np.zeros(0, np.int32)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.to = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max), np.append(np.array(to, np.int32)[order], -1).astype(np.int32)
        self.roots = np.array(roots, np.int32)
        self.cost = np.array([math.log2(len(text[lang]) + 1) for lang in self.langs])

    def moved(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Where each state goes by a symbol, -1 for nowhere."""
        out = self.table[state * self.width + np.minimum(symbol, self.width - 1)]
        rare = np.flatnonzero(symbol >= self.width)
        if len(rare):
            key = state[..., rare].astype(np.int64) * self.symbols + symbol[rare]
            at = np.searchsorted(self.keys, key)
            out[..., rare] = np.where(self.keys[at] == key, self.to[at], -1)
        return out

    def phrases(self, lanes: list[np.ndarray]) -> np.ndarray:
        """Phrases of each lane (symbols) in each language."""
        order = sorted(range(len(lanes)), key=lambda i: -len(lanes[i]))
        sizes = np.array([len(lanes[i]) for i in order])
        grid = np.zeros((sizes[0] if len(sizes) else 0, len(lanes)), np.int32)
        for k, i in enumerate(order):
            grid[: len(lanes[i]), k] = lanes[i]
        k = len(self.langs)
        state = np.tile(self.roots, (len(lanes), 1)).T.copy()
        count = np.zeros((k, len(lanes)), np.int32)
        active = np.searchsorted(-sizes, -np.arange(len(grid)), side="left")
        for t, n in enumerate(active):
            s = grid[t, :n]
            now = state[:, :n]
            to = self.moved(now, s)
            at = np.flatnonzero(to.reshape(-1) < 0)
            if len(at):
                lang, lane = np.divmod(at, n)
                again = self.moved(self.roots[lang], s[lane])
                ended = (now[lang, lane] != self.roots[lang]).astype(np.int32) + (again < 0)
                count[lang, lane] += ended
                to[lang, lane] = np.where(again < 0, self.roots[lang], again)
            state[:, :n] = to
        count += state != self.roots[:, None]
        out = np.empty((len(lanes), k), np.int32)
        out[order] = count.T
        return out

    def entropies(self, texts: list[np.ndarray]) -> np.ndarray:
        """Bits a character of each text in each language. A long text is parsed in blocks, all of them."""
        total, lanes, owner = np.zeros((len(texts), len(self.langs))), [], []

        def flush():
            if lanes:
                np.add.at(total, owner, self.phrases(lanes))
                lanes.clear()
                owner.clear()

        for i, t in enumerate(texts):
            for a in range(0, len(t), BLOCK):
                lanes.append(t[a : a + BLOCK])
                owner.append(i)
                if len(lanes) >= LANES:
                    flush()
        flush()
        return total * self.cost / np.maximum(1, np.array([len(t) for t in texts]))[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        parsed = [letters(t or "") for t in texts]
        known = [i for i, p in enumerate(parsed) if p.any()]
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        if self.langs and known:
            bits = self.entropies([self.symbol[parsed[i]] for i in known])
            best = bits.argmin(1)
            shares = np.exp2(-8 * (bits - bits.min(1, keepdims=True)))
            for i, b, s in zip(known, best, (1 / shares.sum(1)).tolist(), strict=True):
                lang[i], score[i] = self.langs[b], s
        return lang, score


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """From up to DOCS_PER_LANG documents of each language, those of the least hashed ids among the short, and after them the
    shortest of the long; documents of over MOST characters teach nothing. Texts are taken whole. Null languages and texts are
    left out; rows that share an id are told apart by text, and equal rows are one. Only ids, hashes and languages are
    sorted; the texts of the chosen rows come by a join with a list of that bound."""
    named = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = named.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    rows = rows.where(F.length("text") <= MOST)
    size, draw = F.min(F.greatest(F.length("text"), F.lit(LONGEST))).alias("size"), F.xxhash64("id", F.lit(6))
    order = Window.partitionBy("lang").orderBy("size", draw, "id", "h")
    chosen = rows.groupBy("lang", "id", "h").agg(size).withColumn("k", F.row_number().over(order)).where(F.col("k") <= DOCS_PER_LANG).select("lang", "id", "h", "k")
    c = F.broadcast(chosen.withColumnsRenamed({"lang": "_lang", "id": "_id", "h": "_h"}))
    got = rows.join(c, (F.col("lang") == F.col("_lang")) & F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")))
    got = got.groupBy("lang", "k").agg(F.min("text").alias("text")).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda r: (r.lang, r.k)):
        samples.setdefault(r.lang, []).append(r.text)
    return Model(samples)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row: `und` and 0 for a text that is null or has no letter, or where nothing was
    learned. Equal entropies go to the language first by code point. Repeated rows get equal answers, texts of any length
    are parsed whole, in blocks of BLOCK, and other columns are not read, whatever their names. No shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        for pdf in batches:
            for a in range(0, len(pdf), 1000):
                part = pdf.iloc[a : a + 1000]
                lang, score = held.value.predict([t if isinstance(t, str) else None for t in part["text"]])
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").values, "lang_pred": lang, "score": score})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(rows, "doc_id long, lang_pred string, score double")


def op6(spark, sf_dir):
    """The language of every row of `documents`, learned from those whose ids' crc32 isn't 0 by 5. Null and letterless
    texts are `und`; null ids and languages are kept, and a null language teaches nothing."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    held_out = remainder("doc_id", 5) == 0
    model = fit(docs.where(~held_out))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
