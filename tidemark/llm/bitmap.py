"""A bitmap over keys, of bounded size: a filter that may let through more than the keys, never less."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PART = 1 << 16


def _bit(keys: np.ndarray, bits: int) -> np.ndarray:
    x = keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(32))) % np.uint64(bits)


def bitmap(keys: DataFrame, column: str, bits: int, most: int) -> np.ndarray:
    """Bytes of eight bits each, a power of two of them near bits, most bits at most: all that the driver gets."""
    size = max(8 * _PART, min(most, 1 << (max(1, bits) - 1).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros(size // 8, np.uint8)
        for batch in batches:
            bit = _bit(np.asarray(batch.column(0)), size)
            np.bitwise_or.at(packed, (bit >> np.uint64(3)).astype(np.int64), np.left_shift(1, bit & np.uint64(7)).astype(np.uint8))
        packed = packed.reshape(-1, _PART)
        some = np.flatnonzero(packed.any(axis=1))
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array([packed[i].tobytes() for i in some], pa.binary())], ["part", "bits"])

    def join(table: pa.Table) -> pa.Table:
        both = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in table.column("bits")])
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int64()), "bits": pa.array([both.tobytes()], pa.binary())})

    out = np.zeros(size // 8, np.uint8)
    marked = keys.select(column).mapInArrow(mark, "part long, bits binary")
    for r in marked.groupBy("part").applyInArrow(join, "part long, bits binary").collect():
        out[r["part"] * _PART : (r["part"] + 1) * _PART] = np.frombuffer(r["bits"], np.uint8)
    return out


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = _bit(keys, 8 * len(bits))
    return (bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def without(rows: DataFrame, ids: DataFrame, key: str, most: int = 1 << 29) -> DataFrame:
    """rows whose key is not in ids (of distinct longs). Rows that a bitmap clears stay where they are; only the others, which
    are to go but for a few, are joined. A null key stays."""
    bits = rows.sparkSession.sparkContext.broadcast(bitmap(ids, key, 32 * ids.count(), most))

    @F.pandas_udf("boolean")
    def hit(keys: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(bits.value, keys.to_numpy(np.int64)))

    marked = hit(F.coalesce(F.col(key).cast("long"), F.lit(-1))) & F.col(key).isNotNull()
    return rows.where(~marked).unionByName(rows.where(marked).join(ids.select(F.col(key).cast(rows.schema[key].dataType)), key, "left_anti").select(*rows.columns))
