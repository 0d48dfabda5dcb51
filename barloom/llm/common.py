"""What the operators of this subpackage share: reading, hashing and durable intermediate tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tables import discard, materialize, shared_dir  # noqa: F401

#: Word separators: space and the bytes 9 to 13. A word is a maximal run of other characters.
SEPARATORS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8: bytes.split() cuts at space and bytes 9 to 13, and nowhere else."""
    return [] if text is None else text.encode().split()


def lower_words_of(text: str | None) -> list[bytes]:
    """The same with A-Z lowered; bytes.lower() changes no other letter."""
    return [] if text is None else text.encode().lower().split()


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def row_hash(df: DataFrame) -> Column:
    """A hash over all columns of a row. Maps, which Spark won't hash, count by their entries in order of keys, and columns with
    maps inside by their JSON."""

    def plain(field: T.StructField) -> Column:
        inside = field.dataType.valueType if isinstance(field.dataType, T.MapType) else field.dataType
        if "map<" in inside.simpleString() or "variant" in inside.simpleString():
            return F.to_json(F.struct(F.col(f"`{field.name}`")))
        return F.array_sort(F.map_entries(f"`{field.name}`")) if inside is not field.dataType else F.col(f"`{field.name}`")

    return F.xxhash64(*map(plain, df.schema.fields))


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id written in decimal, modulo `modulus`; null ids count as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def bucketed(df: DataFrame, n: int, key: str, compression: str = "zstd") -> DataFrame:
    """Like materialize(), laid out in `n` buckets of `key`: later joins and groupings by it need no shuffle. The catalogue
    forgets the table at once; its files stay, and what is returned reads them."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    name = "barloom_" + path.rsplit("-", 1)[1]
    df.write.option("compression", compression).option("path", path).format("parquet").bucketBy(n, key).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def spread(spark: SparkSession, least: int = 96) -> int:
    """Groups to deal hashed keys into: several for every shuffle partition."""
    return max(least, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def pack(values: np.ndarray) -> bytes:
    """Compress integers: bytes of equal weight together, then zstandard."""
    import zstandard

    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(data)), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(dtype)


def pack_sorted(values: np.ndarray) -> bytes:
    """Compress ascending unsigned 64-bit values as differences."""
    return pack(np.diff(values.astype(np.uint64), prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)
