"""Jump hashing: stable, even, moving only what it must; slots without gaps."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from indexalg.llm import jump_sharding as M


def reference(key, buckets):
    b, j = -1, 0
    while j < buckets:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump():
    keys = np.random.default_rng(1).integers(0, 2**64, 3000, dtype=np.uint64)
    before = None
    for n in range(1, 20):
        shards = M.jump(keys, n)
        assert shards.tolist()[:200] == [reference(int(k), n) for k in keys[:200]]
        if before is not None:
            moved = shards != before
            assert (shards[moved] == n - 1).all() and abs(moved.mean() - 1 / n) < 0.04
        before = shards


@pytest.mark.parametrize("per_range", [200_000, 40])
def test_rows(spark, monkeypatch, per_range):
    monkeypatch.setattr(M, "ROWS_PER_RANGE", per_range)
    r = random.Random(2)
    texts = [None, "", "é漢", "same", "long " * 50_000]
    rows = [(r.choice([None, r.randrange(-500, 500), 7]), r.choice(texts), "c", 1) for _ in range(900)]
    got = M.assign_shards(spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int")).collect()
    assert len(got) == len(rows) and all(x.law == "key" for x in got)
    raw = [(i, (t or "").encode()) for i, t, *_ in rows]
    assert Counter((x.doc_id, x.size, x.text_crc32) for x in got) == Counter((i, len(b) + 1, zlib.crc32(b)) for i, b in raw)
    of, slots = {}, {}
    for x in got:
        assert of.setdefault(x.doc_id, (x.shard, x.grown_shard)) == (x.shard, x.grown_shard)
        assert x.grown_shard in (x.shard, 8) and 0 <= x.shard < 8
        slots.setdefault(x.shard, []).append(x.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert M.assign_shards(empty).count() == 0
    rows = M.assign_shards(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"), 3)
    M.write_shards(rows, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_texts_are_kept_and_written(spark, tmp_path):
    rows = [(i % 40, f"text {i}" if i % 7 else None, f"k{i}", i) for i in range(300)] + [(None, "no key", "k", 1), (None, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot string, rank long")
    kept = M.assign_shards(docs, keep=True)
    assert kept.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "text", "slot_", "rank_"]
    got = kept.collect()
    assert sorted(((r.doc_id, r.text, r.slot_, r.rank_) for r in got), key=str) == sorted(rows, key=str)
    slim = M.assign_shards(docs).collect()
    assert sorted(tuple(r)[:7] for r in map(tuple, got) if r[0] is not None) == sorted(tuple(r) for r in map(tuple, slim) if r[0] is not None)
    M.write_shards(kept, str(tmp_path / "shards"))
    read = spark.read.parquet(str(tmp_path / "shards")).collect()
    assert sorted((r.shard, r.slot, r.text or "") for r in read) == sorted((r.shard, r.slot, r.text or "") for r in got)
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in read if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_a_hot_key_fills_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(M, "ROWS_PER_RANGE", 20)
    rows = [(i, f"t{i}") for i in range(100)] + [(50, f"hot {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = M.assign_shards(docs).collect()
    for shard in {r.shard for r in got}:
        own = sorted((r for r in got if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own))) and [r.doc_id for r in own] == sorted(r.doc_id for r in own)
    bounds = np.array([10, 50, 50, 50, 70])
    batch = pa.RecordBatch.from_arrays([pa.array([50] * 3 + [9, 60, 71]), pa.array([1] * 6), pa.array([0, 2**31, 2**32 - 1, 5, 5, 5])], ["doc_id", "bytes", "text_crc32"])
    assert next(M._placed(iter([batch]), 8, bounds)).column(5).to_pylist() == [1, 2, 3, 0, 4, 5]
