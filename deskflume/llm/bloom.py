"""Bloom filters of a fixed size, built by slices: once seen, seen twice, membership of ids.

A filter has ``bits`` bits and two positions a hash. Tasks list the positions of their own hashes
by slice, all rows of a slice meet in one task whose memory is two slices, and the finished slices
are collected. What is collected and broadcast is bits / 8 bytes whatever the input.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE = 1 << 20
ROWS = "slice int, twice boolean, places binary"


def batch(names, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns], names=names)


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two filter positions for each 64-bit hash: first all first ones, then all second ones."""
    return np.concatenate([hashes & np.uint64(bits - 1), (hashes >> np.uint64(34)) & np.uint64(bits - 1)])


def by_slice(hashes: np.ndarray, twice: np.ndarray | bool, bits: int) -> pa.RecordBatch:
    """Rows of ROWS: positions of distinct hashes by slice; those marked twice go to the second filter at once."""
    slices, again, places = [], [], []
    rounds = [(False, hashes), (True, hashes[twice])] if isinstance(twice, np.ndarray) else [(twice, hashes)]
    for mark, own in rounds:
        at = np.unique(positions(own, bits))
        part = (at // np.uint64(SLICE)).astype(np.int64)
        for one in np.split(at, np.flatnonzero(np.diff(part)) + 1) if len(at) else ():
            slices.append(int(one[0]) // SLICE)
            again.append(mark)
            places.append((one % np.uint64(SLICE)).astype(np.uint32).tobytes())
    return batch(["slice", "twice", "places"], (slices, pa.int32()), (again, pa.bool_()), (places, pa.binary()))


def _merge(batches):
    """The second filter's slices. All rows of a slice come to one task, in any order."""
    once: dict[int, np.ndarray] = {}
    again: dict[int, np.ndarray] = {}
    for b in batches:
        for s, twice, places in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            at = np.frombuffer(places, np.uint32)
            if s not in once:
                once[s], again[s] = np.zeros(SLICE, bool), np.zeros(SLICE, bool)
            if twice:
                again[s][at] = True
            else:
                again[s][at[once[s][at]]] = True
                once[s][at] = True
    for s, seen in again.items():
        if seen.any():
            yield batch(["slice", "bits"], ([s], pa.int32()), ([zlib.compress(np.packbits(seen, bitorder="little").tobytes(), 1)], pa.binary()))


def second_filter(rows: DataFrame, bits: int) -> bytes:
    """From rows of ROWS, the filter of what was seen twice: bits / 8 bytes."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = bytearray(bits // 8)
    for s, seen in rows.repartition(n, "slice").mapInArrow(_merge, "slice int, bits binary").toLocalIterator():
        out[s * SLICE // 8 : (s + 1) * SLICE // 8] = zlib.decompress(seen)
    return bytes(out)


def holds(filter_bytes: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = positions(hashes, bits).astype(np.int64)
    hit = (filter_bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1
    return (hit[: len(hashes)] & hit[len(hashes) :]).astype(bool)


def mixed(ids: np.ndarray) -> np.ndarray:
    """64-bit hashes of 64-bit integers."""
    x = ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def membership(ids: DataFrame, id_column: str, bits: int = 1 << 26):
    """A function from a column of ids to a boolean column: surely false where the id is not in
    ``ids`` but for a small share of false alarms; never false for an id that is in it."""

    def list_places(batches):
        for b in batches:
            own = b.column(0).drop_null().to_numpy(zero_copy_only=False)
            if len(own):
                yield by_slice(mixed(own), True, bits)

    found = ids.select(F.col(id_column).cast("long")).mapInArrow(list_places, ROWS)
    shared = ids.sparkSession.sparkContext.broadcast(second_filter(found, bits))

    @F.pandas_udf("boolean")
    def may_hold(s: pd.Series) -> pd.Series:
        here = s.notna().to_numpy()
        out = np.zeros(len(s), bool)
        if here.any():
            out[here] = holds(np.frombuffer(shared.value, np.uint8), mixed(s[here].astype("int64").to_numpy()), bits)
        return pd.Series(out)

    def mark(column: Column) -> Column:
        return may_hold(column.cast("long"))

    return mark
