"""Plane files: exact round trips, and ids equal to the library's."""

import random
import zlib

import numpy as np
import pytest

from indexalg.llm import token_id_files as M
from indexalg.llm.bit_planes import PlaneReader, PlaneWriter, from_planes, to_planes

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


class Memory:
    def __init__(self):
        self.data = b""

    size = property(lambda self: len(self.data))

    def write(self, data):
        at = len(self.data)
        self.data += data
        return at

    def read(self, at, n):
        return self.data[at : at + n]


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("block", [1, 3, 64, 1000])
def test_round_trip(kind, block):
    r = np.random.default_rng(block)
    docs = [(int(k), r.integers(0, 2 ** int(r.choice([1, 8, 16, 32])), int(r.choice([0, 1, 5, 200])), dtype=np.uint32)) for k in range(-3, 40)]
    out = Memory()
    writer = PlaneWriter(out, kind, block)
    for k, ids in docs:
        writer.add(k, ids.tobytes())
    assert writer.close() == sum(len(x) for _, x in docs)
    before = 0
    for (k, ids), (key, at, parts) in zip(docs, PlaneReader(out).documents(), strict=True):
        assert key == k and at == before and b"".join(p.tobytes() for p in parts) == ids.tobytes()
        before += len(ids)
    assert PlaneReader(out).block(0).tolist() == np.concatenate([x for _, x in docs])[:block].tolist()


def test_planes_and_damage():
    ids = np.array([1, 70_000, 2**32 - 1], np.uint32)
    for kind in ("byte", "bit"):
        assert from_planes(to_planes(ids, kind), 3).tolist() == ids.tolist()
    out = Memory()
    out.write(b"something else that is long enough")
    with pytest.raises(ValueError):
        PlaneReader(out)


def odd_texts(n):
    r = random.Random(n)
    signs = ["a", "Be", "don't", " ", "  ", "\n", "\n\n", "\t", "é", "漢", "𐍈", ".", "...", "!?", "12", "'s", " '", "<|endoftext|>", "　", "᠎", " ", "\x00", "word", "word."]
    return ["".join(r.choice(signs) for _ in range(r.randrange(30))) for _ in range(n)] + ["", " ", "\n", "\n a", "a\n", "a \n", "x᠎ b"]


def test_words_give_the_librarys_ids(monkeypatch):
    monkeypatch.setattr(M, "CACHE", 40)
    monkeypatch.setattr(M, "CORE", 20)
    encoder = M.WordEncoder(PATH)
    for _ in range(3):
        texts = odd_texts(800)
        want = [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        for lo in range(0, len(texts), 50):
            assert encoder(texts[lo : lo + 50]) == want[lo : lo + 50]


def test_files_against_brute_force(spark):
    rows = [(i * 7 % 101, t, "clash") for i, t in enumerate(odd_texts(100)[:101])] + [(500, None, "c"), (None, "null key", "c"), (600, "same", "c"), (600, "same", "c"), (601, "long " * 40_000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = M.token_ids(docs, PATH).collect()
    tokenizer = M.WordEncoder(PATH).tokenizer
    want, start = [], 0
    for key, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert M.token_ids(docs.limit(0), PATH).count() == 0


def test_one_key_over_several_files(spark):
    rows = [(5, f"text {i} " * (i % 7)) for i in range(400)] + [(None, f"no key {i}") for i in range(50)] + [(-(2**63), "least"), (2**63 - 1, "most"), (6, "x")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files, folder = M.write_token_ids(spark.createDataFrame(rows, "doc_id long, text string"), PATH, kind="bit")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sorted(M.read_token_ids(files, folder).collect(), key=lambda r: r.start)
    assert files.count() > 1
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order) and [r.doc_id for r in got] == [None] * 50 + [-(2**63)] + [5] * 400 + [6, 2**63 - 1]
    starts = np.cumsum([0, *(r.n_tokens for r in got)])
    assert [r.start for r in got] == starts[:-1].tolist()
    tokenizer = M.WordEncoder(PATH).tokenizer
    want = sorted(zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for _, t in rows)
    assert sorted(r.ids_crc32 for r in got) == want


def test_other_vocabularies_encode_whole_texts():
    import json

    good = json.load(open(PATH, encoding="utf-8"))
    assert M.composes(good)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": good["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": good["model"] | {"dropout": 0.1}}):
        assert not M.composes(good | change)
    encoder = M.WordEncoder(PATH)
    encoder.composed = False
    texts = odd_texts(50)
    assert encoder(texts) == [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_pieces_are_not_looked_up_one_by_one():
    import time

    r = random.Random(1)
    words = [f"w{k}" for k in range(2000)]
    texts = [" ".join(r.choices(words, k=600)) for _ in range(500)]
    encoder = M.WordEncoder(PATH)
    want = [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder(texts) == want and encoder([]) == []

    def least(f):
        times = []
        for _ in range(9):
            began = time.thread_time()
            f()
            times.append(time.thread_time() - began)
        return min(times)

    ids = dict.fromkeys(words, b"")
    one_by_one = least(lambda: [b"".join(map(ids.__getitem__, t.split(" "))) for t in texts])
    assert least(lambda: encoder(texts)) < one_by_one
