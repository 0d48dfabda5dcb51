import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from barloom.llm import suffix
from barloom.llm.common import pack, pack_sorted, unpack

SF = "/root/testdata/sf0.001"


def brute(rows, length=100):
    """By a dictionary of all strings: rows of (doc_id, text) in order."""
    seen, out = set(), []
    for i, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            if s in seen:
                gone[k : k + length] = True
            seen.add(s)
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((i, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def planted():
    """Copies, near copies, shared passages at various places, periodic texts, and strings of 99, 100 and 101 bytes."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(60) for _ in range(4)]
    rows = [None, "", "a" * 350, "ab" * 180, "x" * 99, "x" * 100, "x" * 101, text(2000)]
    for k in range(60):
        cut = passages[k % 4]
        rows.append(text(rng.randrange(0, 30)) + cut[rng.randrange(0, 40) : len(cut) - rng.randrange(0, 40)] + text(rng.randrange(0, 30)))
    long = text(400)
    for _ in range(12):
        at = rng.randrange(len(long))
        rows.append(long[:at] + rng.choice("xyz") + long[at + 1 :])
    rows += [long, long, passages[0] * 3]
    for n in (99, 100, 101):
        shared = text(60)[:n]
        rows += [text(20) + "#" + shared + "!", text(10) + "?" + shared + "%"]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(i, rows[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("hot,block", [(20_000, 12 << 20), (3, 3000), (10, 9000)])
def test_removed_bytes(spark, monkeypatch, hot, block):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix, "SLICE", 1500)
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block", "2 as kind", "3 as keys").repartition(3)
    assert sorted(map(tuple, suffix.dedup_digest(df).collect())) == brute(rows)


def test_removed_bytes_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert sorted(map(tuple, suffix.dedup_digest(docs).collect())) == brute(rows)
    kept = {r.doc_id: r for r in suffix.kept_texts(docs).collect()}
    assert {i: (r.lang, r.source, r.n_chars) for i, r in kept.items()} == {r.doc_id: (r.lang, r.source, r.n_chars) for r in docs.collect()}
    for r in suffix.dedup_digest(docs).collect():
        assert kept[r.doc_id].n_removed <= r.n_removed and (r.n_removed == 0) == (kept[r.doc_id].n_removed == 0)


def test_small_cases(spark):
    text = "one two three four five six seven eight nine ten " * 4
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (None, "k"), (2, None)], "doc_id long, text string")
    made = sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.n_removed) for r in suffix.dedup_digest(df).collect() if r.doc_id is not None)
    first = brute([(1, text)])[0][2]
    assert made == sorted([(False, 1, len(text), first), (False, 1, len(text), len(text)), (False, 2, 0, 0)])
    assert sorted(r.n_removed for r in suffix.dedup_digest(df).collect() if r.doc_id is None) == [0, len(text)]
    assert suffix.dedup_digest(df.limit(0)).count() == 0


def test_counts_beyond_32_bits():
    """Counts of one key by many blocks are added whole, and the first block still is."""
    keys, many = pack_sorted(np.array([7, 9], np.uint64)), pack(np.array([0xFFFFFFFF, 1], np.uint32))
    rows = [{"kind": "g", "part": 0, "block": b, "keys": keys, "counts": many, "ids": pack(np.array([b, b])), "places": pack(np.zeros(2, np.uint64))} for b in range(5)]
    asked = pd.DataFrame(rows)
    assert [unpack(a, np.int64).tolist() for a in suffix.sums(asked)["answer"]] == [[5 * 0xFFFFFFFF, 5]] * 5
    told = [unpack(a, np.int64) for a in suffix.firsts(asked)["answer"]]
    assert [(a >> 1).tolist() for a in told] == [[5 * 0xFFFFFFFF, 5]] * 5 and [(a & 1).tolist() for a in told] == [[1, 1]] + [[0, 0]] * 4
