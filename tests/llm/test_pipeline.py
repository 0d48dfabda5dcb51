from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as cp
from barloom.llm import mix, quality
from tests.llm.test_pack import check
from tests.llm.test_quality_simhash import brute as brute_groups
from tests.llm.test_suffix import brute as brute_removed

SF = "/root/testdata/sf0.001"


def test_stages_on_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(f"{tmp_path}/{k}")
        seen[name] = (docs, docs := spark.read.parquet(f"{tmp_path}/{k}"))

    before, after = seen["quality rules"]
    kept = {r.doc_id for r in quality.quality(before).where("kept").collect()}
    assert {tuple(r) for r in after.collect()} == {tuple(r) for r in before.collect() if r.doc_id in kept}

    before, after = seen["SimHash near-dedup"]
    groups = brute_groups([(r.doc_id, r.text) for r in before.collect()])
    assert sorted(map(tuple, after.collect())) == sorted(tuple(r) for r in before.collect() if groups[r.doc_id][1] == r.doc_id)

    before, after = seen["suffix-array dedup"]
    want = {i: n - gone for i, n, gone, _, _ in brute_removed(sorted((r.doc_id, r.text) for r in before.collect()))}
    for r in after.collect():
        assert want[r.doc_id] <= len(r.text.encode()) <= want[r.doc_id] + 6 * 50 and r.n_chars == len(r.text)

    before, after = seen["mixing sources to target weights"]
    copies = Counter({r.doc_id: r.copies for r in mix.mix(before.withColumn("h", F.xxhash64(*columns)), row_col="h").collect() if r.copies})
    assert Counter(r.doc_id for r in after.collect()) == copies and {tuple(r) for r in after.collect()} <= {tuple(r) for r in before.collect()}

    before, after = seen["packing"]
    check(before, after.collect())


def test_stages_on_odd_rows(spark):
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (None, None, None, None, None), (None, "k " * 90, "en", "s", 1), (2, "", "", "", 0), (3, " ".join(map(str, range(80))), None, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in cp.STAGES:
        out = stage(spark, docs.limit(0), SF)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
    assert {r.doc_id for r in cp.quality_rules(spark, docs, SF).collect()} == {3}  # the only one of 50 words that doesn't repeat
    one = cp.near_duplicates(spark, docs, SF).collect()  # the wordless rows are one group, equal rows are one
    assert sorted(map(repr, (r.doc_id for r in one))) == ["1", "2", "3", "None"]
    cut = Counter((r.doc_id, r.text) for r in cp.repeated_passages(spark, docs, SF).collect())
    assert cut == Counter((r.doc_id, "k " if r.n_chars == 1 else r.text or "") for r in docs.collect())
    mixed = Counter(r.doc_id for r in cp.source_mix(spark, docs, SF).collect())
    assert set(mixed) <= {1, None, 2, 3} and max(mixed.values()) <= 6
    pieces = cp.packing(spark, docs, SF).collect()
    check(docs, pieces)


MORE = {
    "m": "map(cast(coalesce(doc_id, 0) % 2 as int), cast(5 as int), 9, cast(null as int))", "t": "timestamp'2024-01-01 01:02:03.123456'", "d": "cast(12.345 as decimal(9, 4))",
    "n_removed": "'own'", "a": "array(named_struct('b', binary('x'), 'm', map('k', 1.5d)))", "c0": "date'2024-02-29'", "block": "cast(null as string)", "kept": "cast(1.5 as float)",
}


def test_columns_of_any_type_come_back(spark):
    """Maps, microseconds, decimals, nested values and names that the stages use themselves."""
    text = " ".join(map(str, range(60)))
    rows = spark.createDataFrame([(1, text), (2, text + " end"), (2, text + " end"), (None, None), (4, "")], "doc_id long, text string")
    docs = rows.selectExpr("*", "'s' as source", "cast(3 as bigint) as n_chars", *(f"{v} as {k}" for k, v in MORE.items()))
    plain = lambda r: repr([r[c] for c in docs.columns if c not in ("text", "n_chars")])
    cut = cp.repeated_passages(spark, docs, SF)
    assert cut.schema.simpleString() == docs.schema.simpleString()
    assert Counter(map(plain, cut.collect())) == Counter(map(plain, docs.collect()))
    assert sorted((r.doc_id or 9, r.text) for r in cut.collect())[0] == (1, text)
    one = cp.near_duplicates(spark, docs, SF).collect()
    assert {plain(r) for r in one} <= {plain(r) for r in docs.collect()} and [r.doc_id for r in one if r.text] == [1]  # one word more is a near copy
    mixed = cp.source_mix(spark, docs, SF)
    assert mixed.schema.simpleString() == docs.schema.simpleString() and {plain(r) for r in mixed.collect()} <= {plain(r) for r in docs.collect()}
