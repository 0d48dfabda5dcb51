import math
import time
import uuid
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from barloom.functions import tables as stored
from barloom.llm import katz
from barloom.llm.common import lower_words_of, pack, unpack, unpack_sorted

SF = "/root/testdata/sf0.001"


def discounts(counts):
    n = Counter(counts.values())
    try:
        much = 6 * n[6] / n[1]
        d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - much) / (1 - much) for r in range(1, 6)}
    except ZeroDivisionError:
        d = {0: 2}
    if not all(0 < x < 1 for x in d.values()):
        off = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        d = {r: 1 - off / r for r in range(1, 6)}
    return lambda c: d.get(c, 1.0) * c


def brute(rows, order):
    """Katz by dictionaries: rows of (id, text, held_out); scores by row number. Checks sums over all words per context."""
    seqs = [("<s>", *(w.decode() for w in (t or "").encode().lower().split()), "</s>") for _, t, _ in rows]
    grams = {n: Counter() for n in range(1, order + 1)}
    for s, (_, _, held) in zip(seqs, rows, strict=True):
        if not held:
            for n in grams:
                grams[n].update(s[i - n : i] for i in range(max(n, 2), len(s) + 1))
    of = {n: discounts(c) for n, c in grams.items()}
    one, total = grams[1], sum(grams[1].values())
    kept = sum(map(of[1], one.values()))
    over = total if kept < total * (1 - 1e-9) else total + 1
    unseen = 1 - kept / over if over else 1.0
    after = defaultdict(list)
    for n in range(2, order + 1):
        for g in grams[n]:
            after[g[:-1]].append(g[-1])
    weights = {}

    def p(context, w):
        if not context:
            return of[1](one[(w,)]) / over if (w,) in one else unseen
        n = len(context) + 1
        if context not in after:
            return p(context[1:], w)
        if context not in weights:
            c = [grams[n][(*context, x)] for x in after[context]]
            k = sum(map(of[n], c))
            below = sum(p(context[1:], x) for x in after[context])
            d = sum(c) + (k >= sum(c) * (1 - 1e-9))
            weights[context] = d, (1 - k / d) / (1 - below)
        d, alpha = weights[context]
        c = grams[n][(*context, w)]
        return of[n](c) / d if c else alpha * p(context[1:], w)

    for context in [*list(after)[:20], *list(after)[-20:]]:
        assert sum(p(context, w) for (w,) in one) + p(context, None) == pytest.approx(1)
    out = []
    for s in seqs:
        known = [(w,) in one for w in s[1:]]
        base = sum(math.log10((one[(w,)] + 1) / (total + len(one) + 1)) for w in s[1:])
        out.append((len(s) - 1, sum(known), total, base, sum(math.log10(p(s[max(0, i - order + 1) : i], s[i])) for i in range(1, len(s)))))
    return out


def compare(spark, rows, order):
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").selectExpr("*", "1 as block", "2 as part", "3 as counts", "4 as n")
    made = sorted(katz.score(df, order=order)[0].collect(), key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.score))
    want = sorted(zip(rows, brute(rows, order), strict=True), key=lambda x: (-1 if x[0][0] is None else x[0][0], x[1][-1]))
    assert len(made) == len(rows)
    for r, ((i, _, held), (n, known, total, base, score)) in zip(made, want, strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i, held, n, known, total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)


@pytest.mark.parametrize("size, order", [(4_000_000, 3), (3000, 3), (3000, 2), (20_000, 4)])
def test_katz_against_dictionaries(spark, monkeypatch, size, order):
    monkeypatch.setattr(katz, "TOKENS_PER_BLOCK", size)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    compare(spark, [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in docs], order)


def test_katz_small_cases(spark):
    rows = [(1, "a b a b a b c", False), (1, "a b a b a b c", False), (2, None, False), (None, "", True), (3, "A z", True), (4, "x " * 500, False)]
    compare(spark, rows, 3)
    compare(spark, [(i, t, True) for i, t, _ in rows], 3)
    empty = spark.createDataFrame([], "doc_id long, text string, held_out boolean")
    assert katz.score(empty)[0].count() == 0


def test_katz_stored_tables_score_a_text(spark):
    """What is stored is enough: a held-out text scored from the tables alone."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text", "doc_id % 7 = 2 as held_out")
    made, tables = katz.score(docs)
    count, mass, below = {n: {} for n in (1, 2, 3)}, {1: {}, 2: {}}, {1: {}, 2: {}}
    keys, stats = {}, {n: np.zeros(katz.CUT + 4, int) for n in count}
    for r in tables["ngrams"].collect():
        keys[r.n, r.part] = unpack_sorted(bytes(r.keys)).tolist()
        count[r.n] |= dict(zip(keys[r.n, r.part], katz.unpack_counts(bytes(r.counts)).tolist(), strict=True))
        stats[r.n] += r.stats
    for r in tables["weights"].collect():
        for i, (left, under) in zip(unpack_sorted(bytes(r.ids)).tolist(), unpack(bytes(r.more), "V16").view(float).reshape(-1, 2), strict=True):
            mass[r.n][keys[r.n, r.part][i]], below[r.n][keys[r.n, r.part][i]] = left, under
    d = {n: katz.Discounts(s.tolist()) for n, s in stats.items()}
    gram = lambda k: int(k[0]) if len(k) == 1 else int(katz.longer_keys(np.array([gram(k[:-1])], np.uint64), np.array([k[-1]], np.uint64))[0])
    over = lambda h: count[len(h)][gram(h)] + (mass[len(h)][gram(h)] < 0)

    def p(h, w):
        n, c = len(h) + 1, count[len(h) + 1].get(gram((*h, w)), 0)
        if n == 1:
            return float(d[1].share(np.array([c]))[0])
        if gram(h) not in mass[n - 1]:
            return p(h[1:], w)
        if c:
            return float(d[n].of(np.array([c]))[0]) / over(h)
        under = below[n - 1][gram(h)] / (over(h[1:]) if n == 3 else 1)
        return float(katz.weight(mass[n - 1][gram(h)], under)) * p(h[1:], w)

    for r in made.join(docs.where("held_out and length(text) < 3000").select("doc_id", "text"), "doc_id").limit(5).collect():
        seq = (katz.BEGIN, *map(katz.word_key, r.text.encode().lower().split()), katz.END)
        assert sum(math.log10(p(seq[max(0, i - 2) : i], seq[i])) for i in range(1, len(seq))) == pytest.approx(r.score)


def test_scoring_stores_no_model_and_tables_are_whole(spark, monkeypatch, tmp_path):
    """Scoring stores blocks and answers alone; the tables, read after it, hold each trained n-gram and context once."""
    monkeypatch.setattr(katz, "TOKENS_PER_BLOCK", 20_000)
    monkeypatch.setattr(stored, "shared_dir", lambda _: f"{tmp_path}/barloom-{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text", "doc_id % 7 = 2 as held_out")
    made, tables = katz.score(docs)
    assert made.count() == docs.count()
    assert list(tmp_path.glob("*/kind=told")) and not list(tmp_path.glob("*/kind=model")) and not list(tmp_path.glob("*/kind=ask"))
    grams = {n: Counter() for n in (1, 2, 3)}
    for r in docs.where("not held_out").collect():
        seq = ("<s>", *(r.text or "").encode().lower().split(), "</s>")
        for n in grams:
            grams[n].update(seq[i - n : i] for i in range(n, len(seq) + 1))
    keys, counts, contexts = {n: [] for n in grams}, Counter(), Counter()
    for r in tables["ngrams"].collect():
        keys[r.n] += unpack_sorted(bytes(r.keys)).tolist()
        counts[r.n] += int(katz.unpack_counts(bytes(r.counts)).sum())
    for r in tables["weights"].collect():
        contexts[r.n] += len(unpack_sorted(bytes(r.ids)))
        assert len(unpack(bytes(r.more), "V16")) == len(unpack_sorted(bytes(r.ids)))
    for n, held in grams.items():
        assert len(set(keys[n])) == len(keys[n]) == len(held) and counts[n] == sum(held.values())
    assert contexts == {n: sum(g[-1] != "</s>" for g in grams[n]) for n in (1, 2)}


def test_counts_keep_their_width():
    for top in (0, 255, 256, 2**32 - 1, 2**32, 2**40):
        assert katz.unpack_counts(katz.pack_counts(np.array([top, 1, 0]))).tolist() == [top, 1, 0]
    assert katz.unpack_counts(katz.pack_counts(np.array([], int))).tolist() == []


def test_katz_beats_base_and_bigrams_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    made = [r for r in katz.op1(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    two = katz.score(docs.withColumn("held_out", katz.remainder("doc_id", 7) == 2), order=2)[0].where("held_out").collect()
    assert sum(r.score for r in made) > sum(r.base_score for r in made)
    assert sum(r.score for r in made) > sum(r.score for r in two)


def test_distinct_is_unique():
    draw = np.random.default_rng(5)
    few = draw.integers(0, 2**63, 300).astype(np.uint64) << np.uint64(1)
    near = draw.permutation(np.repeat(np.uint64(2**63) + np.arange(400, dtype=np.uint64), 3))  # alike in their high bits
    for keys in (few[draw.integers(0, 300, 5000)], near, near - np.uint64(2**63), np.array([2**64 - 1, 1, 2**64 - 1, 0], np.uint64), few[:1], few[:0]):
        every, first, number = katz.distinct(keys)
        for made, want in zip((every, first, number), np.unique(keys, return_index=True, return_inverse=True), strict=True):
            assert made.tolist() == want.tolist()


def test_words_of_many_texts_are_those_of_each():
    texts = ["", None, " a  B\tb\x0b\x0cÄ\r\nc ", "\x1c a\x1cA\x85b c\x00 ", " ", "one", "É éİK \n"]
    for some in (texts, texts[:2], texts[5:6], []):
        sizes, words = katz.words_in(pa.array(some, pa.string()))
        assert sizes.tolist() == [len(lower_words_of(t)) for t in some]
        assert words.cast(pa.binary()).to_pylist() == [w for t in some for w in lower_words_of(t)]


def test_ngrams_of_a_block_take_less_than_sorting_their_places():
    draw = np.random.default_rng(6)
    n = 500_000
    vocab = katz.mix64(np.arange(1, 50_001, dtype=np.uint64))
    tokens = (50_000 * draw.random(n) ** 3).astype(np.uint32)
    row = SimpleNamespace(block=0, lengths=pack(np.full(n // 500, 500, np.uint32)), train=np.ones((2, n // 500), np.uint8).tobytes(), vocab=pack(vocab), tokens=pack(tokens))
    keys = katz.mix64(np.arange(n, dtype=np.uint64))

    def least(run):
        def once():
            begun = time.process_time()
            run()
            return time.process_time() - begun

        return min(once() for _ in range(5))

    assert least(lambda: katz.Grams(row, 3, 100)) < 2 * least(lambda: np.unique(keys, return_index=True, return_inverse=True))


def test_texts_cut_in_small_steps(spark, monkeypatch):
    """Blocks and steps of a few texts, which end at different places."""
    monkeypatch.setattr(katz, "BYTES_AT_ONCE", 700)
    monkeypatch.setattr(katz, "TOKENS_PER_BLOCK", 2000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()
    compare(spark, [(r.doc_id, None if r.doc_id % 9 == 4 else r.text, r.doc_id % 7 == 2) for r in docs], 3)
