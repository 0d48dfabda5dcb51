import zlib
from collections import defaultdict

import numpy as np
import pytest

from barloom.llm import pack

ROWS = [
    (1, "one two  three\n\n four"), (2, None), (3, ""), (None, "x" * 9000), (5, "a " * 4000), (5, "a " * 4000), (6, " \n x  y   z \t \n"), (7, "\n \n"), (8, "é ü ñ 中文 \U0001f600 <|endoftext|> don't"),
    (9, "tail  "), (10, " lead"), (11, "a  b 　 c"), (12, "  "),
]


def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: [*t.encode(s or "", add_special_tokens=False).ids, 0]


def check(docs, made):
    encode = reference()
    want, got, sequences = defaultdict(list), defaultdict(list), defaultdict(list)
    for r in docs.collect():
        want[r.doc_id].append(encode(r.text))
    for r in made:
        got[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(got) == set(want)
    for i, texts in want.items():
        assert {len(t) for t in texts} == {r.doc_tokens for r in got[i]}
        left = [dict.fromkeys(range(len(t))) for t in texts]
        for r in got[i]:
            k = next(k for k, t in enumerate(texts) if r.start in left[k] and zlib.crc32(np.array(t[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32)
            for x in range(r.start, r.start + r.length):
                del left[k][x]
        assert not any(left)
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= 1024
    return sum(sum(n for _, n in p) for p in sequences.values()) / (1024 * len(sequences))


def test_packing_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert check(docs, pack.pack_documents(docs).collect()) > 0.98


@pytest.mark.parametrize("shard", [512, 1])
def test_small_cases(spark, monkeypatch, shard):
    monkeypatch.setattr(pack, "SHARD", shard)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as shard", "3 as bucket")
    check(docs, pack.pack_documents(docs).collect())
    assert pack.pack_documents(docs.limit(0)).count() == 0


def test_index_scores_against_the_formula():
    """BM25 by the figures of all documents, of which the shard holds some."""
    rng = np.random.default_rng(2)
    every = [np.stack([rng.choice(40, k, replace=False), rng.integers(1, 500, k)]).astype(np.uint32) for k in rng.integers(0, 20, 30)]
    terms, frequency = every[:12], np.zeros(pack.TERMS, np.int64)
    for t in every:
        frequency[t[0]] += 1
    known = pack.Corpus(len(every), sum(int(t[1].sum()) for t in every), frequency)
    index, n = pack.Index(terms, known), len(terms)
    size = [int(t[1].sum()) for t in terms]
    for s in range(n):
        got = index.scores(s, n)
        for d in range(n):
            total = 0.0
            for w in set(terms[s][0].tolist()) & set(terms[d][0].tolist()):
                if sum(w in t[0] for t in terms) > 1:
                    tf, df = float(terms[d][1][terms[d][0] == w][0]), frequency[w]
                    total += np.log1p((len(every) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size[d] / np.mean([int(t[1].sum()) for t in every])))
            assert got[d] == pytest.approx(total, rel=1e-5)


def test_corpus_counts_all_documents(spark):
    """Also those that leave no tail: a text of 1023 ids and its end."""
    rows = [*ROWS, (20, "a " * 1023), (21, "one")]
    staged = pack.pieces(spark.createDataFrame(rows, "doc_id long, text string"), 4, pack.VOCABULARY)
    known, want, words = pack.corpus(staged), np.zeros(pack.TERMS, np.int64), 0
    for _, text in rows:
        t = pack.terms_of(text or "")
        want[t[0]] += 1
        words += int(t[1].sum())
    assert np.array_equal(known.frequency, want) and known.mean == words / len(rows)


@pytest.mark.parametrize("few", [2_000_000, -1])
def test_large_buckets_are_split(spark, monkeypatch, few):
    monkeypatch.setattr(pack, "SHARD", 8)
    monkeypatch.setattr(pack, "FEW", few)
    docs = spark.createDataFrame([(i if i % 3 else None, "same words here") for i in range(200)], "doc_id long, text string")
    staged = pack.pieces(docs, 25, pack.VOCABULARY)
    sizes = [r["count"] for r in pack.sharded(staged, 25).groupBy("shard").count().collect()]
    assert sum(sizes) == 200 and max(sizes) < 64
    assert check(docs.where("doc_id is not null"), [r for r in pack.pack_documents(docs).collect() if r.doc_id is not None]) > 0


def test_neighbours_share_words(spark):
    """Tails of two topics end in windows of one topic."""
    rows = [(i, " ".join(f"{'red' if i % 2 else 'blue'}{(i * 7 + k) % 60}" for k in range(60))) for i in range(40)]
    made = pack.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    topics = defaultdict(set)
    for r in made:
        topics[r.sequence_id].add(r.doc_id % 2)
    assert sum(len(t) > 1 for t in topics.values()) <= 1 + len(topics) // 4


def test_ids_equal_those_of_the_json_form():
    encode, e = reference(), pack.encoder()
    for _, text in ROWS:
        assert e.ids_of(text or "").tolist() == encode(text or "")


def test_words_of_many_texts_are_encoded_once(monkeypatch):
    """Ids and terms equal those of each text alone, whatever stands beside its spaces; a word that repeats is encoded once."""
    parts = ["red", "blue.", "'s", "it's", "ü", "中文", "12", "1", "\u00a0x", "\x1cy", "a\nb", "x\u2003", "", "\n", "\t", "\u3000", "#$", "don't\r\nGo", "\x85"]
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(parts[: k % len(parts) + 1], k % 13)) for k in range(2000)] + [t or "" for _, t in ROWS] + ["", " ", "  ", "\n ", " a", "a ", "a"]
    encode, e, words = reference(), pack.encoder(), pack.Words(texts)
    for text, ids, terms in zip(texts, e.ids(words), words.terms(), strict=True):
        assert ids.tolist() == encode(text) and ids.dtype == np.dtype("<u2")
        want = defaultdict(int)
        for w in text.encode().lower().split():
            if w.strip(pack.MARKS):
                want[zlib.crc32(w.strip(pack.MARKS)) % pack.TERMS] += 1
        assert dict(terms.T.tolist()) == want and terms.dtype == np.uint32
    asked, whole = [], e.encode
    monkeypatch.setattr(e, "encode", lambda text: asked.append(len(text)) or whole(text))
    assert len(list(e.ids(pack.Words(["one two three four " * 50 + "end"] * 100)))) == 100
    assert sum(asked) < 1000


@pytest.mark.parametrize("together", [1, 30])
def test_texts_are_read_in_groups(spark, monkeypatch, together):
    monkeypatch.setattr(pack, "TOGETHER", together)
    docs = spark.createDataFrame(ROWS * 3, "doc_id long, text string")
    check(docs, pack.pack_documents(docs).collect())


def test_terms():
    assert pack.terms_of("").shape == (2, 0)
    got = pack.terms_of(" Red, red. RED ! blue " + "x " * 300)
    assert dict(got.T.tolist()) == {zlib.crc32(b"red") % pack.TERMS: 3, zlib.crc32(b"blue") % pack.TERMS: 1, zlib.crc32(b"x") % pack.TERMS: 300}
