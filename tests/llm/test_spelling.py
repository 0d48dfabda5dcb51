import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from barloom.llm import spelling

SF = "/root/testdata/sf0.01"


def brute_counts(rows, typos: int = 31) -> dict[str, int]:
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if typos and h % typos == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def brute(words: dict[str, int]) -> set[tuple]:
    gaps, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            gaps[w[:i], w[i + 1 :]].add(w)
    for (a, b), some in gaps.items():
        some = some | ({a + b} & words.keys())
        for w in some:
            near[w] |= some - {w} if w != a + b else {x for x in some if len(x) == len(w) + 1}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 10 * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def rows_of(made):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in made.collect()]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as word", "2 as n", "3 as key", "4 as block", "5 as m")


ODD = [(1, "Letters lettres LETTERS letters"), (1, "Letters lettres LETTERS letters"), (None, "lettersé " * 30), (None, None), (2, ""), (3, "a" * 20_000 + " " + "a" * 20_000),
       (4, ("b" + "a" * 19_999 + "\n") * 2), (5, "aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa aaaaaab aaaaaab ××××××× ×××××××"), (6, "ÀÉÎÕÜßÿ àéîõüßÿ " * 3), (7, "Āaaaaaaa1bbbbbbb_ccccccc " * 25)]


def test_counts_and_variants_of_odd_rows(spark):
    words = brute_counts(ODD)
    counted = spelling.word_counts(table(spark, ODD), typos=31)
    assert {r.word: r.n for r in counted.collect()} == words
    got = rows_of(spelling.spelling_variants(counted))
    assert len(got) == len(words) and set(got) == brute(words)
    empty = spelling.word_counts(table(spark, ODD).limit(0))
    assert spelling.spelling_variants(empty).count() == 0


@pytest.mark.parametrize("group", [4, 4096])
def test_all_pairs_of_a_hot_group(spark, group):
    """Words that share a half, so that groups are halved down to single places; words, not texts, are given."""
    draw = random.Random(group)
    words = {"".join(draw.choice("ab") for _ in range(draw.randrange(7, 10))): draw.choice([2, 3, 30, 400, 5000]) for _ in range(700)}
    words |= {"prefix" + "".join(draw.choice("xyzé") for _ in range(draw.randrange(1, 5))): draw.choice([2, 25, 300]) for _ in range(300)}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    got = rows_of(spelling.spelling_variants(frame, group=group, block=64))
    assert len(got) == len(words) and set(got) == brute(words)


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    words = brute_counts([(r.doc_id, r.text) for r in docs.collect()])
    got = rows_of(spelling.op13(spark, SF))
    assert len(got) == len(words) and set(got) == brute(words)


def test_wavelet_tree():
    draw = np.random.default_rng(3)
    for n in (1, 2, 3, 100, 257):
        values = draw.permutation(n)
        tree = spelling.Wavelet(values)
        a, b, c, d = (draw.integers(0, n + 1, 200) for _ in range(4))
        a, b, c, d = np.minimum(a, b), np.maximum(a, b), np.minimum(c, d), np.maximum(c, d)
        some = b > a
        q, v = tree.report(a[some], b[some], c[some], d[some])
        got = sorted(zip(q.tolist(), v.tolist(), strict=True))
        want = sorted((k, x) for k, (i, j, lo, hi) in enumerate(zip(a[some], b[some], c[some], d[some], strict=True)) for x in values[i:j].tolist() if lo <= x < hi)
        assert got == want


def test_groups_are_bounded(spark):
    words = spark.range(5000).selectExpr("concat('shared', translate(lpad(cast(id as string), 5, '0'), '0123456789', 'abcdefghij')) as word", "id + 2 as n")
    sizes = spelling.dealt(words, 7, group=50).groupBy("key", "lo", "hi").count().collect()
    assert all(r["count"] <= 50 or r.hi - r.lo == 1 for r in sizes) and max(r["count"] for r in sizes) <= 90


def test_groups_at_one_place_have_no_more_words_than_letters(spark):
    """Words with two free letters side by side, and words that lack one: bounded, and equal to brute force."""
    letters = "abcdefghijklmnopqrstuvwxyzéüçñ"
    words = {f"sha{a}{b}red": 2 + i * j for i, a in enumerate(letters) for j, b in enumerate(letters)} | {f"sha{a}red": 900 + i for i, a in enumerate(letters)}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    groups = spelling.dealt(frame, 7, group=50).groupBy("key", "lo", "hi", "m").count().where("hi - lo = 1").collect()
    assert groups and max(r["count"] for r in groups) <= len(letters) + 1
    got = rows_of(spelling.spelling_variants(frame, group=50, block=64))
    assert len(got) == len(words) and set(got) == brute(words)
