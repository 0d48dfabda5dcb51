import random

import numpy as np

from barloom.llm import langid, toxicity

SF = "/root/testdata/sf0.01"
ROWS = [(1, "the of and", "en"), (1, "the of and", "en"), (2, None, "en"), (3, "", None), (4, " 12 !? \U0001f600", "fr"), (None, "le la des " * 5000, "fr"), (5, "\U00020000 \U00010400", "fr")]


def parse(text, sample):
    """Phrases of a greedy parse, by plain substring search."""
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in sample:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


def test_cross_parsing_against_substring_search():
    rng = random.Random(3)
    make = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    samples = {"a": [make(600, "abc ")], "b": [make(500, "bcde ")]}
    model = langid.Model(samples)
    text = {k: "".join(chr(c) if c else " " for c in langid.letters(v[0])) for k, v in samples.items()}
    texts = [make(rng.randrange(1, 400), "abcdefg ").strip() or "a" for _ in range(60)]
    lanes = [model.symbol[langid.letters(t)] for t in texts]
    want = [[parse("".join(chr(c) if c else " " for c in langid.letters(t)), text[k]) for k in model.langs] for t in texts]
    assert model.phrases(lanes).tolist() == want


def test_every_letter_of_a_sample_is_a_symbol(monkeypatch):
    """More letters than the dense table has columns, as in logographic scripts."""
    monkeypatch.setattr(langid, "DENSE", 8)
    rng = random.Random(6)
    make = lambda n, first: "".join(chr(first + int(rng.paretovariate(0.7)) % 900) if rng.random() < 0.9 else " " for _ in range(n))
    samples = {"ja": [make(900, 0x4E00)], "ko": [make(900, 0xAC00)], "zh": [make(900, 0x20000)]}
    model = langid.Model(samples)
    text = {k: "".join(chr(c) if c else " " for c in langid.letters(v[0])) for k, v in samples.items()}
    texts = [make(120, first) for first in (0x4E00, 0xAC00, 0x20000)] + ["abc " + make(40, 0xAC00)]
    want = [[parse("".join(chr(c) if c else " " for c in langid.letters(t)), text[k]) for k in model.langs] for t in texts]
    assert model.phrases([model.symbol[langid.letters(t)] for t in texts]).tolist() == want
    assert model.predict(texts)[0] == ["ja", "ko", "zh", "ko"]


def test_language_id_held_out(spark):
    made = {r.doc_id: r for r in langid.op6(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    held = [r for r in rows if made[r.doc_id].held_out]
    assert len(made) == len(rows) and sum(made[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in made.values())


def test_language_id_small_cases(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "'x' as lang_pred")
    model = langid.fit(docs)
    made = {(r.doc_id, r.lang_pred) for r in langid.identify(docs, model).collect()}
    # (5): three phrases by ten characters of English, less than one by two thousand of French
    assert made == {(1, "en"), (2, "und"), (3, "und"), (4, "und"), (None, "fr"), (5, "en")}
    assert langid.identify(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(docs.limit(0))).collect()} == {"und"}


def test_language_sample(spark, monkeypatch):
    """Equal rows are one in the sample, long texts come whole and after the short, and those of over MOST teach nothing."""
    monkeypatch.setattr(langid, "MOST", 9000)
    seen = {}
    monkeypatch.setattr(langid, "Model", seen.update)
    rows = [(1, "same words again", "en")] * 30 + [(k, f"other {k}", "en") for k in range(2, 12)] + [(1, "x" * 5000, "fr"), (2, "y" * 3000, "fr"), (3, "z" * 9001, "fr")]
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(seen["en"]) == sorted({r[1] for r in rows if r[2] == "en"})
    assert seen["fr"] == ["y" * 3000, "x" * 5000]


def test_toxicity_held_out(spark):
    made = {r.doc_id: r for r in toxicity.op9(spark, "/root/testdata/sf0.1").collect()}
    labels = [r for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect() if r.doc_id in made and made[r.doc_id].held_out]
    toxic = [made[r.doc_id].predicted for r in labels if r.toxic]
    clean = [made[r.doc_id].predicted for r in labels if not r.toxic]
    assert np.mean(toxic) >= 0.9 and np.mean(clean) <= 0.02


def test_subwords_against_plain_slices():
    words = ["idiot", "a", "", "!!", "naïve"]
    who, what = toxicity.subwords(words)
    for i, w in enumerate(words):
        raw = f"<{toxicity.EDGE.sub('', w)}>".encode()
        assert (who == i).sum() == max(1, sum(max(0, len(raw) - n + 1) for n in toxicity.NGRAMS))  # n-grams, or the one bucket of short words
    one = toxicity.subwords(["idiot"])
    assert np.array_equal(np.sort(one[1]), np.sort(what[who == 0]))


def test_toxicity_scores_against_plain_averages():
    """The score is the softmax of the weighted mean of all words, each the mean of its buckets."""
    rng = np.random.default_rng(4)
    model = toxicity.Model(rng.normal(0, 1, toxicity.BUCKETS), rng.normal(0, 1, toxicity.BUCKETS), 0.3)
    texts = ["one two two three", "  ", None, "!", "idiots " * 5000 + "x"]
    for text, got in zip(texts, model.scores(texts), strict=True):
        logits, weights = [], []
        for w in (text or "").lower().split():
            at = toxicity.subwords([w])[1]
            logits.append(model.table[0, at].mean())
            weights.append(np.exp(model.table[1, at].astype(float).mean()))
        mean = np.average(logits, weights=weights) if logits else 0.0
        assert abs(got - 1 / (1 + np.exp(-mean - 0.3))) < 1e-4


def test_toxicity_gradient():
    """Slopes of the loss along every trained number, by differences."""
    bags = toxicity.Bags(["a bad bad word", "one more", "word"])
    rng = np.random.default_rng(5)
    emb, back = rng.normal(0, 0.3, (toxicity.DIM + 1, toxicity.BUCKETS)), rng.normal(0, 1, (toxicity.DIM, 3))
    v, share, mean = bags.means(emb)
    got = bags.gradient(v, share, mean, back)
    for b in np.unique(np.concatenate([what for what, _, _ in bags.buckets]))[:12]:
        for d in range(toxicity.DIM + 1):
            up, down = emb.copy(), emb.copy()
            up[d, b] += 1e-5
            down[d, b] -= 1e-5
            slope = ((bags.means(up)[2] - bags.means(down)[2]) * back).sum() / 2e-5
            assert abs(slope - got[d, b]) < 1e-6


def test_toxicity_small_cases(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as y")
    labels = spark.createDataFrame([(1, 0), (None, 1), (4, None), (9, 1)], "doc_id long, toxic int")
    for y in (labels, labels.limit(0)):
        model = toxicity.fit(docs, y)
        made = toxicity.score(docs, model).collect()
        assert len(made) == len(ROWS) and all(0 <= r.score <= 1 for r in made)
    assert toxicity.score(docs.limit(0), model).count() == 0
