"""Blocks that ask hashed parts about their keys and get answers in the order asked.

A block is a few million bytes of documents, stored bucketed, so that answers can come back to it without moving it. It
sends each distinct key once, whatever it repeats inside, in compressed runs for each part; a part sees every key in one
place, and sends back a value for each key it was asked, to each block that asked. Frequent keys therefore cost a part no
more than one entry for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import mix64, pack, pack_sorted, unpack


class Parted:
    """Keys in order of (part, key): how a block sends them and reads its answers. Keys may repeat."""

    def __init__(self, keys: np.ndarray, parts: int):
        part = (mix64(keys) >> np.uint64(16)) % np.uint64(parts)
        self.order = np.lexsort((keys, part))
        self.part, self.keys = part[self.order].astype(np.int64), keys[self.order]
        self.names, self.start = np.unique(self.part, return_index=True)
        self.stop = np.append(self.start[1:], len(keys))[: len(self.names)]

    def ask(self, block: int, **columns: np.ndarray) -> Iterator[dict]:
        """A row for each part: its keys ascending, and the packed columns that go with them."""
        for p, a, b in zip(self.names, self.start, self.stop, strict=True):
            at = self.order[a:b]
            yield {"part": int(p), "block": block, "keys": pack_sorted(self.keys[a:b])} | {k: pack(v[at]) for k, v in columns.items()}

    def answers(self, told: pd.DataFrame, column: str, dtype) -> np.ndarray:
        """The values of the keys, in their order as given."""
        out = np.empty(len(self.order), dtype)
        by = dict(zip(told["part"], told[column], strict=True))
        for p, a, b in zip(self.names, self.start, self.stop, strict=True):
            out[self.order[a:b]] = unpack(by[p], dtype)
        return out


def answers_to(blocks: DataFrame, told: DataFrame, run, schema: str) -> DataFrame:
    """Give every block its answers. The blocks are bucketed, so only answers are shuffled."""
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(run, schema)
