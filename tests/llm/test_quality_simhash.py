import itertools
from collections import Counter

import numpy as np
import pytest

from barloom.llm import quality, simhash
from barloom.llm.common import lower_words_of

SF = "/root/testdata/sf0.001"
ROWS = [
    (1, "the cat sat on the cat sat on the", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, " \t\n", "en", None),
    (5, "a\n\na\nb # | x" + "é" * 40, "fr", "a"),
    (6, "x " * 3000, "fr", "b"),
    (7, "one two", "en", "b"),
    (7, "one two", "en", "b"),
    (None, "ONE two", "en", "b"),
    (8, "    k", "en", "b"),
]


def small(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as d2", "2 as fp", "3 as g", "4 as x0")


def counts(text):
    text = text or ""
    w = [x.decode() for x in text.encode().split()]
    seen, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [s for s in text.split("\n") if s.encode().split()]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("table", ["small", SF])
def test_quality_counts(spark, table):
    docs = small(spark) if table == "small" else spark.read.parquet(f"{SF}/documents.parquet")
    texts = Counter((r.doc_id, counts(r.text)) for r in docs.collect())
    made = quality.quality(docs).collect()
    assert Counter((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in made) == texts
    for r in made:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_quality_verdicts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    made = [r for r in quality.quality(docs).collect() if r.doc_id in labels and not r.base_failed]
    good = [r.kept for r in made if labels[r.doc_id]]
    bad = [r.kept for r in made if not labels[r.doc_id]]
    assert sum(good) >= 0.99 * len(good)
    assert sum(bad) <= 0.1 * len(bad)


def test_planted_repeats_below_the_base_rule(spark):
    """Junk that the base rules let through, in an otherwise clean language and source: texts of repeated short lines, and of
    lines and words repeated both. A line or a few words said twice are kept."""
    import random

    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 8)))
    line = lambda n=9: " ".join(word() for _ in range(n))
    rows = [(i, "\n".join(line() for _ in range(rng.randrange(12, 40)))) for i in range(400)]
    twice = [(1000 + i, "\n".join([a := line(), *(line() for _ in range(20)), a])) for i in range(8)]
    lines = [(2000 + i, "\n".join([*(["ok go"] * 60), *(line() for _ in range(32))])) for i in range(8)]
    both = [(3000 + i, "\n".join([*(["go on now"] * 45), *(line() for _ in range(30))])) for i in range(8)]
    docs = spark.createDataFrame(rows + twice + lines + both, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source")
    made = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert not any(r.base_failed for r in made.values())
    assert sum(made[i].kept for i, _ in rows) >= 395 and all(made[i].kept for i, _ in twice)
    assert not any(made[i].kept for i, _ in lines + both)
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == {i for i, r in made.items() if r.kept}


def test_estimates_have_the_least_determinant(spark):
    """Against a plain loop over the same starts: each step's determinant is no more than the one before, nearly, and the
    end is the lesser of both."""
    rows = quality.materialize(quality.with_vector(quality.statistics(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))))
    named, found = quality.fit(rows)
    passing = quality.grouped(rows.where("not base_failed"), named).toPandas()
    floor = quality.floors(rows.where("not base_failed"))
    for r in found.collect():
        x = passing.loc[passing["g"] == r.g, quality.X].to_numpy(float) / quality.UNIT
        ends = []
        for start in (0, 1):
            centre = (np.floor(np.quantile(np.round(x * quality.UNIT), 0.5, axis=0, method="inverted_cdf") / 20) * 20 + 10) / quality.UNIT
            low, high = (np.floor(np.quantile(np.round(x * quality.UNIT), q, axis=0, method="inverted_cdf") / 20) for q in (0.25, 0.75))
            scatter = np.diag(np.array(floor) ** 2 + start * ((high - low) * 20 / (1.349 * quality.UNIT)) ** 2)
            for _ in range(quality.STEPS):
                d2 = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(scatter), x - centre)
                bins = np.floor(np.log(d2 + 1) * 64)
                kept = x[bins <= np.quantile(bins, quality.SHARE, method="inverted_cdf")]
                centre, scatter = kept.mean(0), quality.CONSISTENCY * np.cov(kept.T, bias=True) + np.diag(np.array(floor) ** 2)
            ends.append(np.linalg.slogdet(scatter)[1])
        got = sum(2 * np.log(r[f"l{i}{i}"]) for i in range(quality.P))
        assert got == pytest.approx(min(ends), abs=1e-6)


def test_quality_empty_table(spark):
    assert quality.quality(small(spark).limit(0)).collect() == []


def brute(rows, limit=3):
    fps = {}
    for i, text in rows:
        w = lower_words_of(text)
        import xxhash

        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= limit:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (f"{fps[i]:016x}", find(i)) for i in fps}


def test_simhash_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()} == want


def test_simhash_links_of_close_fingerprints(spark, monkeypatch):
    """Planted fingerprints: chains, a large ball of near ones, and slices of a hot key."""
    import random

    monkeypatch.setattr(simhash, "SLICE", 16)
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(300)]
    ball = rng.getrandbits(64)
    fps += [ball ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(120)]
    chain = rng.getrandbits(64)
    for k in range(12):
        chain ^= 7 << (5 * k)
        fps.append(chain)
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *a: docs)
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    made = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(signed, "doc_id long, fp long")).collect()}
    root = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for a in range(len(fps)):
            for b in range(a):
                if (fps[a] ^ fps[b]).bit_count() <= 3 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    assert made == dict(enumerate(root))


def test_simhash_small_cases(spark):
    made = simhash.near_duplicates(small(spark)).collect()
    by = {}
    for r in made:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert len(made) == len(ROWS) and by[2] == by[3] == by[4] == {("0" * 16, 2)}
    assert by[None] == by[7]
    assert simhash.near_duplicates(small(spark).limit(0)).collect() == []


def test_quality_against_sql(spark):
    import duckdb

    from barloom.llm import quality_sql

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    made = quality.op2(spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, made)) == sorted(con.execute(quality_sql.oracle()).fetchall())


def test_keep_one_of_each_group(spark):
    """Rows that share an id but not a text are documents of their own; equal rows are one."""
    rows = [(1, "a b c d e", "p"), (1, "quite another text of words", "q"), (1, "a b c d e", "p"), (2, "A b c d e", "r"), (None, "a b c d e", "n"), (None, "only here and now", None), (3, None, "z"), (None, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, whole string").selectExpr("*", "1 as key", "2 as row")
    made = sorted(map(tuple, simhash.keep_one(docs).collect()), key=str)
    assert made == sorted([(1, "a b c d e", "p", 1, 2), (1, "quite another text of words", "q", 1, 2), (None, "only here and now", None, 1, 2), (3, None, "z", 1, 2)], key=str)
    assert simhash.keep_one(docs.limit(0)).count() == 0
