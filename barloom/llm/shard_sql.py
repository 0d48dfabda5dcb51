"""The hash tree of sixteen shards and its slots in DuckDB SQL, for the driver's comparison."""

from __future__ import annotations

PARTS = 256


def draw(name: str, weight: float) -> str:
    return f"ln((cast(('0x' || substr(md5('{name}:' || key), 1, 13)) as bigint) + 0.5::double) / 4503599627370496.0::double) / {weight!r}::double"


def best(names: list[str], weight: float, first: int) -> str:
    """The number of the child with the largest draw."""
    draws = [draw(n, weight) for n in names]
    out = str(first + len(names) - 1)
    for i in range(len(names) - 2, -1, -1):
        out = f"case when {draws[i]} > greatest({', '.join(draws[i + 1:])}) then {first + i} else {out} end"
    return out


def choose(column: str, ways: dict[int, str]) -> str:
    return f"case {column} " + " ".join(f"when {k} then {v}" for k, v in ways.items()) + " end"


def table() -> list[int]:
    """The remainders of all bytes, from the polynomial."""
    made = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        made.append(n)
    return made


def folded(tab: str, values: str) -> str:
    """The unsigned CRC-32 of a list of bytes, one after another."""
    step = f"xor(a >> 8, ({tab})[cast(xor(a, b) & 255 as integer) + 1])"
    return f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), {values}), lambda a, b: {step}), 4294967295)"


def crc_of(ascii_text: str) -> str:
    """The unsigned CRC-32 of a short ASCII text."""
    return folded(f"{table()} :: bigint[]", f"list_transform(range(1, length({ascii_text}) + 1), lambda i: cast(ascii(substr({ascii_text}, i, 1)) as bigint))")


def crc32() -> str:
    """The same of whole texts, from their hexadecimal form."""
    values = "list_transform(range(0, strlen(text)), lambda i: cast(('0x' || substr(h, 2 * i + 1, 2)) as bigint))"
    return f"with z as (select *, hex(encode(text)) as h, {table()} :: bigint[] as tab from t) select *, {folded('tab', values)} as crc from z"


def oracle() -> str:
    racks = {r: best([f"k{2 * r}", f"k{2 * r + 1}"], 4.0, 2 * r) for r in range(2)}
    shards = {k: best([f"s{4 * k + i}" for i in range(4)], 1.0, 4 * k) for k in range(4)}
    new = f"{draw('x16', 1.0)} > greatest({draw('r0', 8.0)}, {draw('r1', 8.0)})"
    return f"""with t as (select doc_id, coalesce(text, '') as text, coalesce(cast(doc_id as varchar), '') as key from documents), c as materialized ({crc32()}),
r as (select *, {best(['r0', 'r1'], 8.0, 0)} as region from c), k as (select *, {choose('region', racks)} as rack from r),
s as (select *, cast({choose('rack', shards)} as integer) as shard, cast(('0x' || substr(md5('slot:' || key || ':' || (strlen(text) + 1) || ':' || crc), 1, 8)) as bigint) % {PARTS} as part, cast(strlen(text) + 1 as bigint) as size from k)
select doc_id, size, crc as text_crc32, 'key' as law, shard, cast(row_number() over (partition by shard order by part, doc_id, size, crc) - 1 as bigint) as slot, case when {new} then 16 else shard end as grown_shard from s"""
