"""JSON records: unknown fields, patches, deletes, odd lines."""

import json

import pytest
from pyspark.sql import functions as F

from barloom.sources import records


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def patches(spark, *rows):
    return spark.createDataFrame([(i, s, json.dumps(d)) for i, s, d in rows], "id string, seq int, text string").select("id", "seq", F.parse_json("text").alias("doc"))


def docs(df):
    return {r.id: json.loads(r.text) for r in df.select("id", F.to_json("doc").alias("text")).collect()}


def test_round_trip_keeps_unknown_fields(spark, tmp_path):
    store = records.RecordStore(spark, str(tmp_path / "r"), parts=4)
    assert docs(store.read("trades")) == {}
    store.put("trades", records.parsed(lines(spark, '{"id": 1, "side": "long", "own": {"a": [1, "é"]}}', '{"id": "2", "notes": null}', "", "  ")).withColumn("seq", F.lit(0)))
    store.put("trades", patches(spark, ("1", 2, {"notes": "b"}), ("1", 1, {"notes": "a", "side": None}), ("3", 0, {"id": 3}), ("9", 0, {})))
    assert docs(store.read("trades")) == {"1": {"id": 1, "side": None, "own": {"a": [1, "é"]}, "notes": "b"}, "2": {"id": "2", "notes": None}, "3": {"id": 3}}
    store.delete("trades", spark.createDataFrame([(2,), (77,)], "id long"))
    out = sorted(r.value for r in records.as_lines(store.read("trades")).collect())
    assert [json.loads(x)["id"] for x in out] == [1, 3] and '"own":{"a":[1,"é"]}' in out[0]
    again = records.RecordStore(spark, str(tmp_path / "again"))
    again.put("trades", records.parsed(lines(spark, *out)).withColumn("seq", F.lit(0)))
    assert docs(again.read("trades")) == docs(store.read("trades"))
    store.delete("trades", store.read("trades"))
    assert docs(store.read("trades")) == {}


def test_a_change_writes_its_own_parts(spark, tmp_path):
    store = records.RecordStore(spark, str(tmp_path / "r"), parts=8)
    store.put("trades", patches(spark, *((str(k), 0, {"k": k}) for k in range(60))))
    before = {(r.part, r.version) for r in store.table.partitions().collect()}
    store.put("trades", patches(spark, ("7", 0, {"k": 0})))
    after = {(r.part, r.version) for r in store.table.partitions().collect()}
    assert len(before) == 8 and len(before & after) == 7
    assert docs(store.read("trades")) == {str(k): {"k": k if k != 7 else 0} for k in range(60)}


def test_typed_fields_and_bad_lines(spark):
    some = records.parsed(lines(spark, '{"id": 1, "q": "x", "p": 2.5}', '{"id": 2, "q": 3}'))
    got = {r.id: (r.q, r.p) for r in records.fields(some, {"q": "int", "p": "double"}).collect()}
    assert got == {"1": (None, 2.5), "2": (3, None)}
    for bad in ("oops", "[1]", '{"no": 1}', "3"):
        with pytest.raises(records.BadRecords):
            records.parsed(lines(spark, '{"id": 1}', bad))
        assert records.parsed(lines(spark, '{"id": 1}', bad), strict=False).count() == 1


def test_settings(spark, tmp_path):
    store = records.RecordStore(spark, str(tmp_path / "r"))
    assert docs(store.settings()) == {"journal": records.SETTINGS}
    store.save_settings({"min_rr_ratio": 2, "theme": {"dark": True}})
    store.save_settings({"risk_percentage": 1.0})
    want = records.SETTINGS | {"min_rr_ratio": 2, "theme": {"dark": True}, "risk_percentage": 1.0}
    assert docs(store.settings()) == {"journal": want}
    assert docs(store.settings("else")) == {"else": records.SETTINGS}
