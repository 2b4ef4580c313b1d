"""Sharding by jump consistent hashing.

A stable key and the number of shards alone decide a row's shard: the key seeds
a linear congruential generator whose draws say at which shard counts the key
would have moved; the last such count not above the present one is its shard.
There is no ring table, and one more shard takes 1/(n+1) of the rows, all of
them into itself.

Slots number a shard's rows from 0 in key order without one task holding a
shard: keys are cut into ranges by quantiles (one that fills several is dealt over
them by its texts' checksums), rows are numbered within each (range, shard), and
the counts of the ranges before are added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, unused
from .tidy import tidy
from .words import mix

ROWS_PER_RANGE = 200_000
MOST_RANGES = 4096
#: Further ranges for rows without a key, dealt by checksum.
NULL_RANGES = 64


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, by Lamping and Veach's algorithm."""
    key, n = keys.astype(np.uint64), len(keys)
    b, j = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    live = np.arange(n)
    while len(live):
        b[live] = j[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        j[live] = ((b[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        live = live[j[live] < shards]
    return b


@tidy
def _placed(rows: Iterator[pa.RecordBatch], shards: int, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        null = np.asarray(batch.column(0).is_null().to_numpy(zero_copy_only=False))
        ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
        crc = batch.column(2).to_numpy(zero_copy_only=False)
        keys = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        # a key that fills several ranges is dealt over them by checksum
        first = np.searchsorted(bounds, ids, side="left")
        several = np.maximum(np.searchsorted(bounds, ids, side="right") - first, 1)
        part = np.where(null, -1 - crc % NULL_RANGES, first + (crc * several >> 32))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(jump(keys, shards).astype(np.int32)), pa.array(jump(keys, shards + 1).astype(np.int32)), pa.array(part.astype(np.int32))], [*batch.schema.names, "shard", "grown_shard", "part"])


def assign_shards(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law ("key"), shard, slot, grown_shard; with `keep` also the other columns.

    size is the text's UTF-8 bytes (null: none) plus 1; text_crc32 is that of
    the text (null: of no bytes). Rows with equal keys go to one shard, rows
    with a null key to one fixed shard; both still get slots of their own.
    Other columns are ignored or, with `keep`, kept; one that is named like a
    column of this table is kept under its name and "_". An empty table gives
    no rows.
    """
    slim = [F.col(key).cast("long").alias("doc_id"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("bytes"), F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")).alias("text_crc32")]
    rows = docs.select(*slim)
    n = rows.select("doc_id").count()
    ranges = max(1, min(MOST_RANGES, n // ROWS_PER_RANGE + 1))
    bounds = rows.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0] if ranges > 1 else None
    bounds = np.array(bounds or [], np.int64)
    schema = "doc_id long, bytes long, text_crc32 long, shard int, grown_shard int, part int"
    placed = cut(rows.mapInArrow(lambda batches: _placed(batches, shards, bounds), schema))
    counts = placed.groupBy("part", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # at most (MOST_RANGES + NULL_RANGES) * shards rows
    kept = []
    if keep:
        # a row's place follows from its key, so the rows with all columns are placed again instead of kept twice
        taken = ["doc_id", "bytes", "text_crc32", "shard", "grown_shard", "part", "size", "law", "slot", "rank", "base"]
        for c in docs.columns:
            if c != key:
                kept.append((c, unused(c, taken)))
                taken.append(kept[-1][1])
        whole = docs.select(*slim, *(F.col(f"`{c}`").alias(name) for c, name in kept))
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema.fields), "shard int, grown_shard int, part int"])
        placed = whole.mapInArrow(lambda batches: _placed(batches, shards, bounds), schema)
    order = Window.partitionBy("part", "shard").orderBy("doc_id", "bytes", "text_crc32")
    numbered = placed.withColumn("rank", F.row_number().over(order) - 1).join(F.broadcast(base), ["part", "shard"])
    return numbered.select("doc_id", (F.col("bytes") + 1).alias("size"), "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("rank")).cast("long").alias("slot"), "grown_shard", *(name for _, name in kept))


def write_shards(rows: DataFrame, path: str) -> None:
    """One folder per shard below `path`, as Parquet files in order of slots."""
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
