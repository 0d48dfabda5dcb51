import os
import random
import zlib

import numpy as np
import pytest

from barloom.llm import eliasfano, tokenfile

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return made


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as ids", "1 as start", "2 as hash", "3 as row")


def plain(rows, tokenizer):
    """(doc_id, start, n_tokens, crc32, ids) of rows in order."""
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), np.array(ids, "<u2").tobytes()))
        start += len(ids)
    return out


ALL = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"


def read(spark, path, **options):
    return [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in tokenfile.read_tokens(spark, path, ALL, **options).orderBy("start").collect()]


def test_all_documents(spark, tokenizer):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = tokenfile.op12(spark, SF).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == [x[:4] for x in plain(rows, tokenizer)]


def test_odd_rows(spark, tokenizer, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows, special tokens as text, letters of many scripts, several files a task."""
    long = " ".join(random.Random(1).choice(["word", "é", "\n\n", "  12", "don't"]) for _ in range(400_000))
    rows = [(3, "b"), (None, "no id"), (3, "a"), (3, "a"), (-5, None), (9, ""), (7, long), (8, "x" * 5000), (10, "<|endoftext|> 日本 ՘ ͏ ​\x1c\x85 ꟎"), (None, None)]
    tokenfile.write_tokens(table(spark, rows), str(tmp_path / "t"), shard_ids=1000)
    got = read(spark, str(tmp_path / "t"))
    keyed = lambda r: (r[0] is not None, r[0] or 0)
    assert [x[0] for x in got] == [x[0] for x in sorted(rows, key=keyed)]
    assert sorted((x[0] or 0, *x[2:]) for x in got) == sorted((x[0] or 0, *x[2:]) for x in plain(rows, tokenizer))
    assert [x[1] for x in got] == np.cumsum([0] + [x[2] for x in got])[:-1].tolist()
    assert read(spark, str(tmp_path / "t"), split_ids=3000) == got
    tokenfile.write_tokens(table(spark, rows).limit(0), str(tmp_path / "none"))
    assert read(spark, str(tmp_path / "none")) == []


def test_pieces_are_cut_alike(tokenizer):
    """On every code point that isn't left to the tokenizer itself, and on random texts of them."""
    by = tokenfile.Ids("byte_bpe_50k.json")
    some = [c for part in tokenfile.KNOWN for c in part]
    texts = [f"a{chr(c)}1 {chr(c)}{chr(c)} !{chr(c)}b\n" for c in some]
    draw = random.Random(5)
    texts += ["".join(draw.choice(["a", "1", " ", "\n", "'s", "'", "é", chr(draw.choice(some))]) for _ in range(60)) for _ in range(2000)]
    assert by.of(texts) == by.whole(texts)
    assert by.long(texts[-1] * 9) == by.whole([texts[-1] * 9])[0]


@pytest.mark.parametrize("n,step", [(0, 1), (1, 7), (5, 0), (1000, 1), (3000, 40_000), (70_000, 900)])
def test_elias_fano(n, step):
    draw = np.random.default_rng(n)
    values = np.cumsum(draw.integers(0, step + 1, n)) - 50
    stored = eliasfano.encode(values)
    made = eliasfano.Sequence(lambda at, k: (b"junk" + stored)[at : at + k], 4)
    assert len(made) == n and made.size == len(stored) and made.slice(0, n).tolist() == values.tolist()
    for _ in range(50):
        a, b = sorted(draw.integers(0, n + 1, 2).tolist())
        assert made.slice(a, b).tolist() == values[a:b].tolist()
    for x in draw.integers(-60, 10 + (values[-1] if n else 0), 20).tolist():
        assert made.rank(x) == int(np.searchsorted(values, x))
    if n >= 1000:
        spread = (int(values[-1]) - int(values[0])) / n
        assert 8 * len(stored) / n < 2 + max(np.log2(max(spread, 1)), 0) + 1.5  # no 64-bit table


def test_only_committed_files_count(spark, tokenizer, tmp_path):
    """A file that a lost task left, and the files of an aborted write."""
    path = str(tmp_path / "t")
    rows = [(k, f"text {k}") for k in range(40)]
    tokenfile.write_tokens(table(spark, rows), path)
    with open(f"{path}/part-000000-0000-lost.tok", "wb") as f:
        f.write(b"half a file")
    assert read(spark, path) == plain(rows, tokenizer)
    writer = tokenfile.TokenWriter(str(tmp_path / "aborted"), "byte_bpe_50k.json", 2, 100)
    os.makedirs(tmp_path / "aborted")
    shard = tokenfile.ShardFile(str(tmp_path / "aborted" / "a.tok"), 2)
    shard.add(1, b"\1\0")
    writer.abort([tokenfile.Written(0, [shard.close()]), None])
    assert os.listdir(tmp_path / "aborted") == []


def test_random_access(tmp_path):
    shard = tokenfile.ShardFile(str(tmp_path / "a.tok"), 2)
    sizes = np.random.default_rng(2).integers(1, 30, 2000).tolist()
    for k, n in enumerate(sizes):
        shard.add(None if k < 3 else 10 * k, np.full(n, k, "<u2").tobytes())
    shard.close()
    where, path = tokenfile.place(str(tmp_path / "a.tok"))
    made = tokenfile.Shard(where.open_input_file(path))
    assert made.doc_ids(0, 5) == [None, None, None, 30, 40] and made.doc_ids(1999, 2000) == [19990]
    for token in (0, sum(sizes[:700]) - 1, sum(sizes[:700]), sum(sizes) - 1):
        k = made.document_of(token)
        assert sum(sizes[:k]) <= token < sum(sizes[: k + 1]) and made.ids(made.bounds(k, k + 1))[0].tolist() == [k] * sizes[k]
