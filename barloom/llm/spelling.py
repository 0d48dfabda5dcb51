"""Spelling variants: words one code point apart, found by two-dimensional range reporting, and the forms they stand for.

A word is a point: its rank in forward order and its rank among the reversed words. The words that replace the letter at place
i of a word, or have one more there, begin with what is before i and end with what is after it: an interval of either order.
A wavelet tree over the reverse ranks in forward order reports the points in both.

Two such words share their first half or their last, so a word goes to a group for either, as long as itself and as the target
of words one letter shorter; a group looks at its own half of the places. A group of more than GROUP words is dealt anew to
two, each with half of the places and what lies outside them as its key; at one place it is dealt to words of equal length and
to each word with those that have one letter more there, and such groups have no more words than there are letters, and one.
So every pair meets in one group, no group grows with the corpus, and a word goes to a few groups. Blocks of groups
are one wavelet tree for each length, and send back a count and the most frequent neighbour for each word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, spread

LETTERS = "A-Za-zÀ-ÿ"
LEAST, OCCURRENCES, FACTOR = 7, 2, 10
GROUP, BLOCK = 4096, 1 << 14
HELD = 1 << 19  # distinct words that a task sums up before it passes them on
PARTIAL = "word string, n long, n_near long, best_n long, best string"


def runs_of(text: str, least: int) -> Counter:
    """Maximal runs of at least `least` letters, with A-Z lowered and no other."""
    return Counter(re.findall(f"[{LETTERS}]{{{least},}}", text.encode().lower().decode()))


def with_typos(key: str, runs: Counter, every: int) -> Iterator[tuple[str, int]]:
    """Runs with their number; those whose crc32 after `key:` `every` divides lack one letter."""
    before = zlib.crc32(f"{key}:".encode())
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), before)
        at = h % len(run)
        yield (run[:at] + run[at + 1 :], n) if h % every == 0 else (run, n)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, occurrences: int = OCCURRENCES, typos: int = 0) -> DataFrame:
    """word, n of the runs of letters of all texts that have `least` letters and occur `occurrences` times. `typos`, if set,
    takes a letter from the runs of a document that with_typos() says. Null ids count as the empty text."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, int] = {}
        for pdf in batches:
            for key, text in zip(pdf["key"], pdf["text"], strict=True):
                runs = runs_of(text, least)
                for word, n in with_typos(key, runs, typos) if typos else runs.items():
                    if len(word) >= least:
                        held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held = {}
        if held:
            yield pd.DataFrame({"word": list(held), "n": list(held.values())})

    texts = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInPandas(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def keyed(rows: DataFrame, more: Column | None = None) -> DataFrame:
    """A hash of what the words of a group share: what lies before and behind its places, and `more` letters behind. `m` is the
    length of its shorter words."""
    end = F.greatest(F.col("m") - F.col("hi"), F.lit(0))
    end = end if more is None else end + more
    return rows.withColumn("key", F.xxhash64("m", "lo", "hi", F.left("word", "lo"), F.right("word", end)))


def halves(rows: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Each row once for either half of the places from lo to before hi."""
    mid = F.floor((lo + hi) / 2).cast("int")
    return keyed(rows.withColumn("part", F.explode(F.array(F.struct(lo.alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), hi.alias("hi"))))).select("word", "n", "m", "longer", "part.lo", "part.hi"))


def apart(rows: DataFrame) -> DataFrame:
    """Rows at one place, before the end: words of equal length by what lies around their letter there, as they were, and the
    shorter ones once more, with the longer, by all their letters."""
    more = F.explode(F.when(F.col("longer"), F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1))))
    return keyed(rows.withColumn("more", more), F.col("more")).drop("more")


def dealt(words: DataFrame, least: int, group: int = GROUP) -> DataFrame:
    """word, n, m, longer, lo, hi, key: the groups that each word goes to. Large ones are halved until none is left, and at one
    place are set apart()."""
    size = F.char_length("word")
    both = words.withColumn("longer", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("m", size - F.col("longer").cast("int")).where(F.col("m") >= least)
    rows, out = halves(both, F.lit(0), F.col("m") + 1), None
    while True:
        large = materialize(rows.where("hi - lo > 1 or lo < m").groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > group).select("key", F.lit(True).alias("large")))
        if large.isEmpty():
            return rows if out is None else out.unionByName(rows)
        told = rows.join(large, "key", "left")
        small = told.where("large is null").drop("large")
        done = small.unionByName(apart(told.where("large and hi - lo = 1").drop("large")))
        out = done if out is None else out.unionByName(done)
        rows = materialize(halves(told.where("large and hi - lo > 1"), F.col("lo"), F.col("hi")))


class Wavelet:
    """A wavelet tree, level by level, over a permutation: reports which of its values at places [a, b) lie in [c, d)."""

    def __init__(self, values: np.ndarray):
        self.levels = []
        for shift in range(max(len(values) - 1, 1).bit_length() - 1, -1, -1):
            one = (values >> shift & 1).astype(bool)
            ranks = np.concatenate(([0], np.cumsum(one, dtype=np.int32)))
            self.levels.append((1 << shift, len(values) - int(ranks[-1]), ranks))
            values = np.concatenate((values[~one], values[one]))

    def report(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries, and the values that each reports."""
        q, base = np.arange(len(a)), np.zeros(len(a), np.int64)
        for width, zeros, ranks in self.levels:
            ra, rb = ranks[a], ranks[b]
            left = (rb - ra < b - a) & (base < d[q]) & (base + width > c[q])
            right = (rb > ra) & (base + width < d[q]) & (base + 2 * width > c[q])
            a, b = np.concatenate(((a - ra)[left], (zeros + ra)[right])), np.concatenate(((b - rb)[left], (zeros + rb)[right]))
            q, base = np.concatenate((q[left], q[right])), np.concatenate((base[left], (base + width)[right]))
        return q, base


class Order:
    """Words in order within their groups, and for each length of prefix the interval of the words that share it."""

    def __init__(self, letters: np.ndarray, group: np.ndarray):
        n, width = letters.shape
        self.order = np.lexsort((np.ascontiguousarray(letters).view(f"S{width}").ravel(), group))
        self.rank = np.empty(n, np.int64)
        self.rank[self.order] = np.arange(n)
        sorted_, grouped = letters[self.order], group[self.order]
        differ = sorted_[1:] != sorted_[:-1]
        shared = np.where(differ.any(1), differ.argmax(1), width)
        self.shared = np.concatenate(([-1], np.where(grouped[1:] == grouped[:-1], shared, -1)))
        self.known: dict[int, tuple] = {}

    def interval(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """By rank: where the words that share `length` letters begin and end."""
        if length not in self.known:
            first = self.shared < length
            begin, number = np.flatnonzero(first), np.cumsum(first) - 1
            self.known = {k: v for k, v in self.known.items() if abs(k - length) < 2} | {length: (begin[number], np.append(begin[1:], len(first))[number])}
        return self.known[length]


class Targets:
    """The words of one length as points."""

    def __init__(self, chosen: np.ndarray, forward: Order, backward: Order):
        self.forward = np.concatenate(([0], np.cumsum(chosen[forward.order])))
        self.backward = np.concatenate(([0], np.cumsum(chosen[backward.order])))
        self.rows = backward.order[chosen[backward.order]]
        in_order = forward.order[chosen[forward.order]]
        self.tree = Wavelet(self.backward[backward.rank[in_order]])
        self.asked: list[tuple] = []

    def ask(self, rows: np.ndarray, place: int, a, b, c, d, least: int) -> None:
        """Note the queries that can report `least` words."""
        a, b, c, d = self.forward[a], self.forward[b], self.backward[c], self.backward[d]
        some = (b - a >= least) & (d - c >= least)
        if some.any():
            self.asked.append((rows[some], np.full(int(some.sum()), place), a[some], b[some], c[some], d[some]))

    def told(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows that asked, the rows reported to them, and the place of the edit."""
        if not self.asked:
            return (np.zeros(0, np.int64),) * 3
        rows, place, a, b, c, d = (np.concatenate(x) for x in zip(*self.asked, strict=True))
        q, value = self.tree.report(a, b, c, d)
        return rows[q], self.rows[value], place[q]


def near_pairs(words: list[bytes], m: int, longer: np.ndarray, lo: np.ndarray, hi: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows x, y whose words, of m letters or one more, are near within their group; every pair both ways round."""
    letters = np.array(words, f"S{m + 1}").view(np.uint8).reshape(len(words), m + 1)
    turned = np.zeros_like(letters)
    turned[~longer, :m], turned[longer] = letters[~longer, m - 1 :: -1] if m else 0, letters[longer, ::-1]
    forward, backward = Order(letters, group), Order(turned, group)
    same, more = Targets(~longer, forward, backward), Targets(longer, forward, backward)
    for i in range(int(lo.min()), int(hi.max())):
        rows = np.flatnonzero(~longer & (lo <= i) & (i < hi))
        begin, end = forward.interval(i)
        a, b = begin[forward.rank[rows]], end[forward.rank[rows]]
        for targets, rest, least in ((more, m - i, 1), (same, m - 1 - i, 2)):
            if rest >= 0:
                begin, end = backward.interval(rest)
                targets.ask(rows, i, a, b, begin[backward.rank[rows]], end[backward.rank[rows]], least)
    x, y, _ = same.told()
    other = x != y
    s, t, at = more.told()
    last = letters[t, at] != letters[t, np.minimum(at + 1, m)]  # of equal letters side by side only the last counts as the inserted one
    last |= at == m
    return np.concatenate((x[other], s[last], t[last])), np.concatenate((y[other], t[last], s[last]))


def report(pdf: pd.DataFrame) -> pd.DataFrame:
    """The words of a block with the number of their neighbours in it and the most frequent of these."""
    out = []
    for m, part in pdf.groupby("m"):
        texts, n = part["word"].to_numpy(), part["n"].to_numpy(np.int64)
        _, group = np.unique(part["key"].to_numpy(), return_inverse=True)
        longer, held = part["longer"].to_numpy(bool), np.bincount(group)
        used = (held[group] > 1) & (np.bincount(group, ~longer, len(held))[group] > 0)
        if not used.any():
            continue
        texts, n, group, longer = texts[used], n[used], group[used], longer[used]
        words = [w.encode("latin-1") for w in texts]
        x, y = near_pairs(words, int(m), longer, part["lo"].to_numpy()[used], part["hi"].to_numpy()[used], group)
        if not len(x):
            continue
        place = np.argsort(np.argsort(np.array(words), kind="stable"), kind="stable")
        order = np.lexsort((place[y], -n[y], x))
        x, y = x[order], y[order]
        first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        out.append(pd.DataFrame({"word": texts[x[first]], "n": n[x[first]], "n_near": np.diff(np.append(first, len(x))), "best_n": n[y[first]], "best": texts[y[first]]}))
    return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in PARTIAL.split(", ")}).astype({"word": object, "best": object})


def roots(forms: DataFrame) -> DataFrame:
    """word, root: forms (word, form) followed to the last. A form is ten times as frequent, so ways are short, and halve each round."""
    found = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        on = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        told = materialize(found.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        found = told.drop("moved")
        if told.where("moved").isEmpty():
            return found


def spelling_variants(words: DataFrame, least: int = LEAST, factor: int = FACTOR, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n for each of `words` (word of letters up to U+00FF, of `least` at least; n).

    Words are near if one inserted, deleted or replaced code point makes one the other. The form is the near word of largest n,
    of equals the first in code-point order, if that is `factor` times the word's n; else null. The root is where forms lead
    to, or the word itself. An empty table gives none.
    """
    words = materialize(words.select("word", F.col("n").cast("long").alias("n")))
    count = words.count()
    blocks = max(spread(words.sparkSession), 4 * count // block)
    rows = dealt(words, least, group).withColumn("block", F.pmod("key", F.lit(blocks)))
    partial = rows.groupBy("block").applyInPandas(report, PARTIAL)
    alone = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))))
    near = partial.unionByName(alone).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    stands = -F.col("best.m") >= factor * F.col("n")
    near = materialize(near.select("word", F.when(stands, F.col("best.w")).alias("form"), "n", "n_near", F.when(stands, -F.col("best.m")).alias("form_n")))
    ends = roots(near.where("form is not null"))
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13(spark, sf_dir):
    """The words of all `documents`, one letter taken from one run in 31; null texts have none, null ids count as the empty
    text, repeated rows count each, whole texts are read."""
    return spelling_variants(word_counts(documents(spark, sf_dir, "doc_id", "text"), typos=31))
