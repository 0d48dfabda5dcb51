"""Katz backoff language model: Good-Turing discounted n-gram counts with exactly normalised backoff weights.

Texts are encoded once, in blocks of some million tokens that are stored bucketed by block. A block asks hashed parts for
what the whole corpus says of its distinct n-grams, order by order, and then of its contexts, once for each, and the parts
answer in the order asked: counts meet in as many tasks as there are parts and orders, whatever word is frequent, since every
block has summed its own before. A part also says which n-grams only one block has. Whatever contains such an n-gram is in
that block alone too, so the block knows all about it and asks no more: most trigrams of a corpus are never sent, and most
contexts neither. Scoring stores the blocks and the answers only. What parts and blocks know makes two tables, computed from
those when they are read, whose rows score any text: n-grams with their counts, and contexts with what their backoff weights
are made of. A row of either holds keys of one order and part; those that a block alone knows have its number in `block`, the
others -1.

For an n-gram of context h and last word w, P(w | h) is d(c) c(h w) / c(h) where training has it, else alpha(h) P(w | h'),
where h' is h without its first word; a context that training lacks has alpha 1. P(w) is d(c) c(w) / N for words seen in
training, else the rest of the mass, that of all unseen words together, as one type. alpha(h) makes the sum over all words
and the unseen type 1: (1 - sum of discounted shares after h) / (1 - sum of P(w | h') over the words seen after h). All those
P(w | h') are seen themselves and have the denominator of h', so that a part can sum their discounted counts without it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import answers_to
from .common import bucketed, documents, materialize, mix64, pack, pack_sorted, remainder, spread, unpack, unpack_sorted

ORDER = 3
TOKENS_PER_BLOCK = 2_000_000
BYTES_AT_ONCE = 1 << 22  # of texts that are cut into words together
CUT = 5  # counts above it aren't discounted
BEGIN, END = 1, 2  # keys beside the words' hashes
BLOCK = "block long, doc_ids binary, lengths binary, train binary, tokens binary, vocab binary"
ROW = "kind string, n int, part int, block long, keys binary, counts binary, more binary, ids binary, stats array<long>"
FIELDS = [f.split()[0] for f in ROW.split(", ")]


def word_key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 1)


def longer_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of n-grams by the keys of their contexts and of their last words."""
    return mix64(context * np.uint64(0x9E3779B97F4A7C15) + word)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """np.unique() of unsigned 64-bit keys with first places and inverse. Values with the places in their low bits are sorted,
    which takes a quarter of the time of sorting places; where that cuts keys off below, they are nearly in order."""
    bits = max(len(keys) - 1, 1).bit_length()
    cut = max(bits + int(keys.max(initial=0)).bit_length() - 64, 0)
    mixed = (keys >> np.uint64(cut)) << np.uint64(bits) | np.arange(len(keys), dtype=np.uint64)
    mixed.sort()
    order = (mixed & np.uint64((1 << bits) - 1)).astype(np.int64)
    del mixed
    in_order = keys[order]
    if (in_order[1:] < in_order[:-1]).any():
        again = np.argsort(in_order, kind="stable")
        order, in_order = order[again], in_order[again]
    new = np.ones(len(keys), bool)
    new[1:] = in_order[1:] != in_order[:-1]
    number = np.empty(len(keys), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return in_order[new], order[new], number


def pack_counts(values: np.ndarray) -> bytes:
    """Compress counts in the least width that holds them all, which comes first."""
    top = int(values.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + pack(values.astype(f"u{width}"))


def unpack_counts(data: bytes) -> np.ndarray:
    return unpack(data[1:], f"u{data[0]}").astype(np.int64)


def words_in(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has, and the words of all texts, A-Z lowered. Arrow's ASCII white space is space and bytes 9 to 13."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, sizes = cut.flatten(), pc.list_value_length(cut).to_numpy()
    some = pc.binary_length(words).to_numpy() > 0  # white space at either end leaves empty strings there
    if some.all():
        return sizes, words
    before, ends = np.append(0, np.cumsum(some)), np.cumsum(sizes)
    return before[ends] - before[ends - sizes], words.filter(pa.array(some))


def _encoded(number: int, docs: list[pa.RecordBatch], sizes: list[np.ndarray], words: list[pa.Array]) -> pd.DataFrame:
    coded = pa.chunked_array(words).dictionary_encode().combine_chunks()
    sizes = np.concatenate(sizes) + 2
    seq = np.full(int(sizes.sum()), 2, np.int32)
    ends = np.cumsum(sizes)
    seq[ends - sizes], seq[ends - 1] = 0, 1
    seq[seq == 2] = coded.indices.to_numpy() + 2
    vocabulary = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    keys = np.array([BEGIN, END, *map(word_key, vocabulary)], np.uint64)
    order = np.argsort(-np.bincount(seq, minlength=len(keys)), kind="stable")  # frequent words have small numbers
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order))
    ids, held = (pa.chunked_array([d.column(c) for d in docs]) for c in ("doc_id", "held_out"))
    flags = np.array([~held.to_numpy().astype(bool), ids.is_null().to_numpy()], np.uint8)
    return pd.DataFrame([{
        "block": number, "doc_ids": pack(ids.fill_null(0).to_numpy()), "lengths": pack(sizes.astype(np.uint32)),
        "train": flags.tobytes(), "tokens": pack(rank[seq]), "vocab": pack(keys[order]),
    }])


def encode(docs: DataFrame) -> DataFrame:
    """Blocks of `docs` (doc_id, text, held_out): each text is its start, its words and its end, as numbers of the block's
    own vocabulary."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        base, made, held, docs, sizes, words = TaskContext.get().partitionId() << 24, 0, 0, [], [], []
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64))
            for a, b in pairwise([0, *(np.flatnonzero(np.diff(ends // BYTES_AT_ONCE)) + 1).tolist(), len(batch)]):
                few = batch.slice(a, b - a)
                size, split = words_in(few.column("text"))
                ends = np.cumsum(size)
                begin = 0
                while begin < len(few):  # a block ends with the text that fills it
                    before = int(ends[begin - 1]) if begin else 0
                    full = np.searchsorted(ends[begin:] - before + 2 * np.arange(1, len(few) - begin + 1), TOKENS_PER_BLOCK - held)
                    end = min(begin + int(full) + 1, len(few))
                    docs.append(few.slice(begin, end - begin).select(["doc_id", "held_out"]))
                    sizes.append(size[begin:end])
                    words.append(split.slice(before, int(ends[end - 1]) - before))
                    held += int(ends[end - 1]) - before + 2 * (end - begin)
                    begin = end
                    if held >= TOKENS_PER_BLOCK:
                        yield _encoded(base + made, docs, sizes, words)
                        made, held, docs, sizes, words = made + 1, 0, [], [], []
        if docs:
            yield _encoded(base + made, docs, sizes, words)

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.int64() if c == "block" else pa.binary()) for c in (f.split()[0] for f in BLOCK.split(", "))])
        for block in rows(batches):
            yield pa.RecordBatch.from_pandas(block, schema, preserve_index=False)

    return docs.mapInArrow(stored, BLOCK)


class Grams:
    """The distinct n-grams of a block, by order from 1 and ascending key, and where its tokens have them.

    keys[n], and for n > 1 the places of its context and of the n-gram without its first word among those of order n - 1; at[n]
    is the n-gram that ends at each token, -1 where the text has no n tokens until there. Parts hold ranges of keys.
    """

    def __init__(self, row, order: int, parts: int):
        self.block, self.order = row.block, order
        self.sizes = unpack(row.lengths, np.uint32).astype(np.int64)
        self.train, self.null = np.frombuffer(row.train, np.uint8).reshape(2, -1).astype(bool)
        self.place = (np.arange(self.sizes.sum()) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)).astype(np.int32)
        vocab = unpack(row.vocab, np.uint64)
        sort = np.argsort(vocab)
        rank = np.empty(len(vocab), np.int32)
        rank[sort] = np.arange(len(vocab))
        self.keys, self.at = {1: vocab[sort]}, {1: rank[unpack(row.tokens, np.uint32)]}
        self.context, self.lower = {}, {}
        self.seen, self.first, self.ids, self.alone, self.asked = {}, {}, {}, {}, {}
        key = own = self.keys[1][self.at[1]]
        for n in range(2, order + 1):
            key = longer_keys(np.append(np.uint64(0), key[:-1]), own)
            ends = np.flatnonzero(self.place >= n - 1)
            self.keys[n], first, number = distinct(key[ends])
            self.at[n] = np.full(len(key), -1, np.int32)
            self.at[n][ends] = number
            self.context[n], self.lower[n] = self.at[n - 1][ends[first] - 1], self.at[n - 1][ends[first]]
        self.runs = {}
        for n, keys in self.keys.items():
            part = (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            start = np.flatnonzero(np.append(len(part) > 0, part[1:] != part[:-1]))
            self.runs[n] = list(zip(part[start].tolist(), start.tolist(), [*start[1:].tolist(), len(keys)][: len(start)], strict=True))

    def counts(self, n: int) -> np.ndarray:
        here = (self.place >= n - 1) & np.repeat(self.train, self.sizes)
        return np.bincount(self.at[n][here], minlength=len(self.keys[n]))

    def to_ask(self, n: int) -> np.ndarray:
        """The n-grams that other blocks may have: above order 2, those whose context and whose end others have."""
        if n <= 2:
            return np.ones(len(self.keys[n]), bool)
        return ~(self.alone[n - 1][self.context[n]] | self.alone[n - 1][self.lower[n]])

    def ask_counts(self, orders: list[int]) -> pd.DataFrame:
        """Questions, each with the tally() of its part's trained n-grams that needn't be asked."""
        out = []
        for n in orders:
            counts, ask = self.counts(n), self.to_ask(n)
            for p, a, b in self.runs[n]:
                at, own = a + np.flatnonzero(ask[a:b]), a + np.flatnonzero(~ask[a:b] & (counts[a:b] > 0))
                if len(at) or len(own):
                    out.append(("ask", n, p, self.block, pack_sorted(self.keys[n][at]), pack_counts(counts[at]), b"", b"", tally(counts[own])))
        return pd.DataFrame(out, columns=FIELDS)

    def own_counts(self, n: int) -> pd.DataFrame:
        """Rows of the model for trained n-grams that needn't be asked."""
        out = []
        counts, ask = self.counts(n), self.to_ask(n)
        for p, a, b in self.runs[n]:
            own = a + np.flatnonzero(~ask[a:b] & (counts[a:b] > 0))
            if len(own):
                out.append(("model", n, p, self.block, pack_sorted(self.keys[n][own]), pack_counts(counts[own]), b"", b"", tally(counts[own])))
        return pd.DataFrame(out, columns=FIELDS)

    def hear_counts(self, told: pd.DataFrame, orders: list[int]) -> None:
        """seen[n]: counts in all of training; first[n]: whether this block is the first to have trained on it; alone[n]: whether
        no other block has it; ids[n]: place among the trained n-grams of its row of the model, where that is told."""
        by = {(r.n, r.part): r for r in told[told["kind"] == "told"].itertuples()}
        for n in orders:
            ask, seen = self.to_ask(n), self.counts(n)
            first, alone, ids = seen > 0, ~ask, np.zeros(len(ask), np.uint32)
            for p, a, b in self.runs[n]:
                own = ~ask[a:b] & first[a:b]
                ids[a:b] = np.cumsum(own) - own
                at = a + np.flatnonzero(ask[a:b])
                if len(at):
                    r = by[n, p]
                    flags = unpack(r.more, np.uint8)
                    seen[at], first[at], alone[at] = unpack_counts(r.counts), flags & 1 > 0, flags & 2 > 0
                    if n < self.order and r.ids:
                        ids[at] = unpack_sorted(r.ids)
            self.seen[n], self.first[n], self.alone[n], self.ids[n], self.asked[n] = seen, first, alone, ids, ask

    def used(self, n: int, alone: bool) -> np.ndarray:
        """Of the n-grams' contexts that training has, those that this block alone has, or the others."""
        return (np.bincount(self.context[n], minlength=len(self.keys[n - 1])) > 0) & (self.seen[n - 1] > 0) & (self.alone[n - 1] == alone)

    def contexts(self, n: int, alone: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of those contexts each part, their places among those of order n - 1, and their facts()."""
        used, facts, done = self.used(n, alone), self.facts(n, alone), 0
        for p, a, b in self.runs[n - 1]:
            at = a + np.flatnonzero(used[a:b])
            if len(at):
                yield p, at, facts[:, done : done + len(at)]
                done += len(at)

    def wants(self, n: int) -> np.ndarray:
        """The contexts after which this block has an n-gram that training lacks; the others need no backoff weight."""
        return np.bincount(self.context[n][self.seen[n] == 0], minlength=len(self.keys[n - 1])) > 0

    def facts(self, n: int, alone: bool) -> np.ndarray:
        """By used() context, over the n-grams that were trained on here first: classes() of their counts, and of the counts of
        the n-grams below them."""
        used = self.used(n, alone)
        mine = np.flatnonzero(self.first[n] & used[self.context[n]])
        of, size = (np.cumsum(used, dtype=np.int32) - np.int32(1))[self.context[n][mine]], int(used.sum())
        seen, below = self.seen[n][mine], self.seen[n - 1][self.lower[n][mine]]
        out = np.empty((2, CUT + 1, size), np.int32 if seen.sum() + below.sum() < 1 << 31 else np.int64)
        classes(of, seen, out[0])
        classes(of, below, out[1])
        return out.reshape(2 * CUT + 2, size)

    def ask_contexts(self) -> pd.DataFrame:
        out = []
        for n in range(2, self.order + 1):
            count, wants = self.seen[n - 1], self.wants(n).astype(np.uint8)
            for p, at, facts in self.contexts(n, alone=False):
                out.append(("ask", n - 1, p, self.block, pack_sorted(self.ids[n - 1][at]), pack_counts(count[at]), pack_counts(facts.reshape(-1)), pack(wants[at]), []))
        return pd.DataFrame(out, columns=FIELDS)

    def own_contexts(self, discounts: dict[int, Discounts]) -> pd.DataFrame:
        """Rows of the model for contexts that no other block has."""
        out = []
        for n in range(2, self.order + 1):
            for p, every, facts in self.contexts(n, alone=True):
                asked = self.asked[n - 1][every]
                for block, those in ((-1, asked), (self.block, ~asked)):
                    at = every[those]
                    if len(at):
                        out.append(("model", n - 1, p, block, b"", b"", pack_known(*known(n, facts[:, those], self.seen[n - 1][at], discounts)), pack_sorted(self.ids[n - 1][at]), []))
        return pd.DataFrame(out, columns=FIELDS)

    def shares(self, discounts: dict[int, Discounts], told: pd.DataFrame) -> dict[int, np.ndarray]:
        """P of every n-gram's last word after its context, by recursion over the orders."""
        by = {(r.n, r.part): r for r in told[told["kind"] == "weights"].itertuples()}
        p, over = {1: discounts[1].share(self.seen[1])}, {}
        for n in range(2, self.order + 1):
            alpha, over[n] = np.ones(len(self.keys[n - 1])), np.maximum(self.seen[n - 1], 1).astype(np.float64)
            wants = self.wants(n)

            def weigh(at, left, under, n=n, alpha=alpha):
                alpha[at] = weight(left, under / over[n - 1][self.lower[n - 1][at]] if n > 2 else under)

            for _, at, facts in self.contexts(n, alone=True):
                left, under = known(n, facts, self.seen[n - 1][at], discounts)
                over[n][at] += left < 0
                weigh(at, left, under)
            used = self.used(n, alone=False)
            for part, a, b in self.runs[n - 1]:
                at = a + np.flatnonzero(used[a:b])
                if len(at):
                    r = by[n - 1, part]
                    over[n][at] += unpack(r.ids, np.uint8)
                    at = at[wants[at]]
                    weigh(at, *known(n, unpack_counts(r.more).reshape(2 * CUT + 2, -1), self.seen[n - 1][at], discounts))
            lower, of = self.lower[n], self.context[n]
            p[n] = np.where(self.seen[n] > 0, discounts[n].of(self.seen[n]) / over[n][of], alpha[of] * p[n - 1][lower])
        return p


def classes(of: np.ndarray, counts: np.ndarray, out: np.ndarray) -> None:
    """By context, how many n-grams have each count up to CUT, and the sum of larger counts: whole numbers that add up
    exactly in any order."""
    size = out.shape[1]
    out[0] = np.bincount(of[counts == 1], minlength=size)
    several = counts > 1  # most n-grams occur once
    of, counts = of[several], counts[several]
    for r in range(2, CUT + 1):
        out[r - 1] = np.bincount(of[counts == r], minlength=size)
    more = counts > CUT
    out[CUT] = np.bincount(of[more], counts[more], size)


def known(n: int, facts: np.ndarray, count: np.ndarray, discounts: dict[int, Discounts]) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts of n-grams: the mass that discounts leave, negative where nothing is discounted and one more in the
    denominator leaves it; and the mass of the words below, for n > 2 without its denominator."""
    kept, below = discounts[n].total_of(facts[: CUT + 1]), discounts[n - 1].total_of(facts[CUT + 1 :])
    full = kept >= count * (1 - 1e-9)
    left = 1 - kept / (count + full)
    return np.where(full, -left, left), below / max(discounts[1].over, 1) if n == 2 else below


def pack_known(left: np.ndarray, below: np.ndarray) -> bytes:
    return pack(np.stack([left, below], 1).view("V16").reshape(-1))


def weight(left: np.ndarray, below: np.ndarray) -> np.ndarray:
    """alpha of contexts by the masses of known(), that below with its denominator."""
    return np.abs(left) / np.maximum(1 - below, 1e-300)


def tally(counts: np.ndarray) -> list[int]:
    """n_1 .. n_(CUT+1), all, distinct, and the sum of counts above CUT."""
    of = np.bincount(np.minimum(counts, CUT + 2), minlength=CUT + 3)
    return [*of[1 : CUT + 2].tolist(), int(counts.sum()), len(counts), int(counts[counts > CUT].sum())]


def merge_counts(pdf: pd.DataFrame, order: int, model: bool = False) -> pd.DataFrame:
    """Sum what blocks count of a part's n-grams: an answer to each block, with ids where they can be contexts, and the part's
    `tally`, with what blocks have not asked; or the row of the model. Sums are exact up to 2^53."""
    pdf = pdf.sort_values("block", kind="stable")
    n, part = int(pdf["n"].iloc[0]), int(pdf["part"].iloc[0])
    keys, flat = [unpack_sorted(k) for k in pdf["keys"]], np.concatenate([unpack_counts(c) for c in pdf["counts"]])
    every, _, at = distinct(np.concatenate(keys))
    total = np.bincount(at, flat, len(every)).astype(np.int64)
    trained = total > 0
    has = np.flatnonzero(flat > 0)
    first = np.full(len(every), -1, np.int64)
    first[at[has][::-1]] = has[::-1]
    more = (first[at] == np.arange(len(flat))).astype(np.uint8) | (np.bincount(at)[at] == 1).astype(np.uint8) << 1
    ids, told = (np.cumsum(trained) - trained).astype(np.uint64)[at], total[at]
    counted = tally(total[trained & (every != BEGIN)] if n == 1 else total[trained])
    if model:
        return pd.DataFrame([("model", n, part, -1, pack_sorted(every[trained]), pack_counts(total[trained]), b"", b"", counted)], columns=FIELDS)
    out = [("tally", n, part, -1, b"", b"", b"", b"", np.sum([counted, *pdf["stats"]], 0).tolist())]
    ends = np.cumsum([len(k) for k in keys])
    for block, k, b in zip(pdf["block"], keys, ends, strict=True):
        a = b - len(k)
        if len(k):
            out.append(("told", n, part, block, b"", pack_counts(told[a:b]), pack(more[a:b]), pack_sorted(ids[a:b]) if n < order else b"", []))
    return pd.DataFrame(out, columns=FIELDS)


def merge_contexts(pdf: pd.DataFrame, discounts: dict[int, Discounts], model: bool = False) -> pd.DataFrame:
    """Sum the facts that blocks have of a part's contexts: an answer to each block, with those that it wants and all contexts
    that have one more in the denominator; or the row of the model with what known() makes of them, whose `ids` are places
    among the n-grams of the same order, part and block."""
    pdf = pdf.sort_values("block", kind="stable")
    n, part = int(pdf["n"].iloc[0]), int(pdf["part"].iloc[0])
    keys = [unpack_sorted(k) for k in pdf["keys"]]
    every, _, at = distinct(np.concatenate(keys))
    told = np.concatenate([unpack_counts(m).reshape(-1, len(k)) for m, k in zip(pdf["more"], keys, strict=True)], 1)
    facts = np.stack([np.bincount(at, row, len(every)) for row in told]).astype(np.int64)
    count = np.zeros(len(every))
    count[at] = np.concatenate([unpack_counts(c) for c in pdf["counts"]])
    left, below = known(n + 1, facts, count, discounts)
    if model:
        return pd.DataFrame([("model", n, part, -1, b"", b"", pack_known(left, below), pack_sorted(every), [])], columns=FIELDS)
    out = []
    ends = np.cumsum([len(k) for k in keys])
    for block, k, b, wants in zip(pdf["block"], keys, ends, pdf["ids"], strict=True):
        here = at[b - len(k) : b]
        wanted = facts[:, here[unpack(wants, np.uint8) > 0]]
        out.append(("weights", n, part, block, b"", b"", pack_counts(wanted.reshape(-1)), pack((left[here] < 0).astype(np.uint8)), []))
    return pd.DataFrame(out, columns=FIELDS)


class Discounts:
    """Good-Turing discounts d_1 .. d_CUT by Katz, from counts of counts; where those are too few to give shares between
    0 and 1, an absolute discount takes their place."""

    def __init__(self, stats: list[int]):
        n, self.total, self.types, above = stats[: CUT + 1], stats[CUT + 1], stats[CUT + 2], stats[CUT + 3]
        self.d = np.ones(CUT + 1)
        try:
            much = (CUT + 1) * n[CUT] / n[0]
            d = [((r + 1) * n[r] / (r * n[r - 1]) - much) / (1 - much) for r in range(1, CUT + 1)]
            fine = all(0 < x < 1 for x in d)
        except ZeroDivisionError:
            fine = False
        if not fine:
            off = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
            d = [1 - off / r for r in range(1, CUT + 1)]
        self.d[1:] = d
        self.kept = above + sum(r * n[r - 1] * self.d[r] for r in range(1, CUT + 1))
        # a corpus without rare words still leaves the unseen something
        self.over = self.total if self.kept < self.total * (1 - 1e-9) else self.total + 1
        self.unseen = 1 - self.kept / self.over if self.over else 1.0

    def of(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        c = counts.astype(np.float64)
        return np.where(counts > CUT, c, c * self.d[np.minimum(counts, CUT)])

    def total_of(self, facts: np.ndarray) -> np.ndarray:
        """Sums of discounted counts, by classes()."""
        return facts[CUT] + np.arange(1, CUT + 1) * self.d[1:] @ facts[:CUT]

    def share(self, counts: np.ndarray) -> np.ndarray:
        """P(w) by the word's count; 0 is the unseen type."""
        return np.where(counts > 0, self.of(counts) / max(self.over, 1), self.unseen)


def answers(table: DataFrame, kind: str) -> DataFrame:
    return table.where(F.col("kind") == kind).drop("keys", "stats")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_col: str = "held_out", order: int = ORDER) -> tuple[DataFrame, dict[str, DataFrame]]:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of `docs`; the model's tables, which are
    computed whenever they are read: write them to keep the model.

    Rows whose `held_col` is true (or null) take no part in training. Null and empty texts are their end alone. Repeated
    rows count each time. Other columns of `docs`, whatever their names, are left. Scores are log10 probabilities of words and
    end; without training rows all words are unseen and the scores are 0. Counts are exact up to collisions of 64-bit hashes.
    `order` is 2 or more; a text's first words have what contexts there are, from its start on.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.col(held_col), F.lit(True)).alias("held_out")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held)
    parts = max(spread(spark), docs.count() // 4000)
    blocks = bucketed(encode(rows), parts, "block")

    def first_counts(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                yield Grams(row, 2, parts).ask_counts([1, 2])

    def hearing(n: int, told_orders: int, run):
        """run(grams) of a block's n-grams up to order n, which have heard of those up to order `told_orders`."""

        def rows(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            grams = Grams(next(left.itertuples()), n, parts)
            grams.hear_counts(right, list(range(1, told_orders + 1)))
            return run(grams)

        return rows

    def merged(asked: DataFrame, merge) -> DataFrame:
        return asked.groupBy("n", "part").applyInPandas(merge, ROW)

    merge, merge_model = lambda pdf: merge_counts(pdf, order), lambda pdf: merge_counts(pdf, order, model=True)
    asked = blocks.mapInPandas(first_counts, ROW)
    counts, ngrams = materialize(merged(asked, merge), "kind"), merged(asked, merge_model)
    for n in range(3, order + 1):
        told = answers(counts, "told")
        asked = answers_to(blocks, told, hearing(n, n - 1, lambda g: g.ask_counts([g.order])), ROW)
        own = answers_to(blocks, told, hearing(n, n - 1, lambda g: g.own_counts(g.order)), ROW)
        counts = counts.unionByName(materialize(merged(asked, merge), "kind"))
        ngrams = ngrams.unionByName(merged(asked, merge_model)).unionByName(own)
    sums = counts.where("kind = 'tally'").groupBy("n").agg(F.array(*(F.sum(F.get("stats", F.lit(i))) for i in range(CUT + 4))).alias("stats"))
    stats = {r.n: r.stats for r in sums.collect()}  # a row for each order
    discounts = {n: Discounts(stats.get(n, [0] * (CUT + 4))) for n in range(1, order + 1)}
    one, told = discounts[1], answers(counts, "told")

    asked = answers_to(blocks, told, hearing(order, order, lambda g: g.ask_contexts()), ROW)
    own = answers_to(blocks, told, hearing(order, order, lambda g: g.own_contexts(discounts)), ROW)
    weights = materialize(merged(asked, lambda pdf: merge_contexts(pdf, discounts)))
    contexts = merged(asked, lambda pdf: merge_contexts(pdf, discounts, model=True)).unionByName(own)

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = next(left.itertuples())
        g = Grams(row, order, parts)
        g.hear_counts(right, list(range(1, order + 1)))
        log = np.zeros(len(g.place))
        for n, p in g.shares(discounts, right).items():  # the longest that a place has comes last
            if n > 1:
                here = g.place >= n - 1
                log[here] = np.log10(p)[g.at[n][here]]
        base = np.log10((g.seen[1] + 1.0) / (one.total + one.types + 1))[g.at[1]]
        known = (g.seen[1] > 0)[g.at[1]]
        begin = np.cumsum(g.sizes) - g.sizes
        base[begin], known[begin] = 0, False
        total = lambda v: np.add.reduceat(v, begin)
        return pd.DataFrame({
            "doc_id": pd.arrays.IntegerArray(unpack(row.doc_ids, np.int64).copy(), g.null.copy()), "held_out": ~g.train, "n_tokens": g.sizes - 1,
            "n_known": total(known.astype(np.int64)), "train_tokens": one.total, "base_score": total(base), "score": total(log),
        })

    every = told.withColumn("ids", F.lit(b"")).unionByName(weights.drop("keys", "stats"))
    out = answers_to(blocks, every, finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out, {"ngrams": ngrams, "weights": contexts}


def op1(spark, sf_dir):
    """Scores of all texts, null ones as empty; a null doc_id has the checksum of the empty text. See score()."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    return score(docs.withColumn("held_out", remainder("doc_id", 7) == 2))[0]
