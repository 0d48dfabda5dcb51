"""Stores of JSON records: trades of a journal, settings, layouts. A record is a VARIANT, so fields that nobody here knows stay.

Changes are patches: the fields that they name are set, all others stay as they are. A store is a versioned table, dealt by
hashed id, so that a change writes only the parts that it touches.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tables import materialize
from .versions import VersionedTable

SCHEMA = T.StructType([T.StructField("store", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("id", T.StringType()), T.StructField("doc", T.VariantType())])
#: The settings of a journal that has none.
SETTINGS = {"account_balance": 10_000.0, "risk_percentage": 2.0, "preferred_timeframes": ["5m"], "min_rr_ratio": 1.5}


class BadRecords(ValueError):
    """Lines that are no JSON objects with an id."""


def parsed(lines: DataFrame, text: str = "value", id_field: str = "id", strict: bool = True) -> DataFrame:
    """id (as text) and doc of lines of JSON. A line that is no object, or has no id, is an error if `strict`, else left out;
    empty lines always are."""
    doc = F.try_parse_json(F.trim(text))
    rows = lines.where(F.trim(text) != "").select(doc.alias("doc"))
    kind = F.schema_of_variant("doc")
    rows = rows.withColumn("doc", F.when(kind.startswith("OBJECT"), F.col("doc")))
    rows = rows.select(F.try_variant_get("doc", f"$.{id_field}", "string").alias("id"), "doc")
    if strict:
        bad = rows.where("id is null").count()
        if bad:
            raise BadRecords(f"{bad} lines are no JSON objects with {id_field}")
    return rows.where("id is not null")


def fields(records: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The records with a column for each named field, typed; null where it is missing or of another kind."""
    return records.withColumns({n: F.try_variant_get("doc", f"$.{n}", k) for n, k in kinds.items()})


def _fields_of(records: DataFrame, seq: Column) -> DataFrame:
    return records.select("id", seq.cast("long").alias("seq"), F.explode(F.col("doc").cast("map<string,variant>")).alias("field", "value"))


def merged(records: DataFrame, patches: DataFrame) -> DataFrame:
    """id, doc after the patches (id, seq, doc), in order of seq; an id that is new makes a record. A field's last value counts,
    null as any other; objects within a field are replaced whole. Records and patches without fields change nothing."""
    rows = _fields_of(records, F.lit(-1)).unionByName(_fields_of(patches, F.greatest(F.col("seq"), F.lit(0))))
    last = rows.groupBy("id", "field").agg(F.max_by("value", "seq").alias("value"))
    docs = last.groupBy("id").agg(F.to_variant_object(F.map_from_entries(F.collect_list(F.struct("field", "value")))).alias("doc"))
    return docs


def as_lines(records: DataFrame) -> DataFrame:
    """One line of JSON for each record, fields by name."""
    return records.select(F.to_json("doc").alias("value"))


class RecordStore:
    """Named stores of records in one folder."""

    def __init__(self, spark: SparkSession, path: str, parts: int = 16):
        self.spark, self.parts, self.table = spark, parts, VersionedTable(spark, path, SCHEMA, ["store", "part"])

    def read(self, store: str) -> DataFrame:
        return self.table.read().where(F.col("store") == store).select("id", "doc")

    def _dealt(self, rows: DataFrame, store: str) -> DataFrame:
        return rows.withColumns({"store": F.lit(store), "part": F.pmod(F.xxhash64("id"), F.lit(self.parts)).cast("int")})

    def _replace(self, store: str, ids: DataFrame, change) -> None:
        touched = materialize(self._dealt(ids.select("id"), store).select("store", "part").distinct())
        old = self.table.read().join(touched, ["store", "part"], "left_semi").select("id", "doc")
        self.table.replace(self._dealt(change(old), store).select(*SCHEMA.names), touched)

    def put(self, store: str, patches: DataFrame) -> None:
        """Apply patches (id, seq, doc)."""
        patches = materialize(patches.select("id", "seq", "doc").where("id is not null"))
        self._replace(store, patches, lambda old: merged(old, patches))

    def delete(self, store: str, ids: DataFrame) -> None:
        """Delete records by id; unknown ids do nothing."""
        ids = materialize(ids.select(F.col("id").cast("string").alias("id")).distinct())
        self._replace(store, ids, lambda old: old.join(ids, "id", "left_anti"))

    def settings(self, user: str = "journal", defaults: dict | None = None) -> DataFrame:
        """The one record of a user's settings: what is stored over the defaults."""
        defaults = SETTINGS if defaults is None else defaults
        base = self.spark.createDataFrame([(user, json.dumps(defaults))], "id string, text string").select("id", F.parse_json("text").alias("doc"))
        return merged(base, self.read("settings").where(F.col("id") == user).withColumn("seq", F.lit(0)))

    def save_settings(self, updates: dict, user: str = "journal") -> None:
        self.put("settings", self.spark.createDataFrame([(user, 0, json.dumps(updates))], "id string, seq int, text string").select("id", "seq", F.parse_json("text").alias("doc")))
