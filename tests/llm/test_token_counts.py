"""Counts equal to the library's, however texts are cut into chunks."""

import random

import pytest

from indexalg.llm.token_counts import Counter, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize(("chunk", "overlap"), [(200, 16), (64, 4), (1000, 300)])
def test_chunks(chunk, overlap):
    counter = Counter(PATH, chunk, overlap)
    r = random.Random(chunk)
    signs = ["a", "b", " ", "  ", "\n", "é", "𐍈", "<s>", "▁", " ▁", "the ", "x" * 5, "\t", "。", "　"]
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(1, 1200))) for _ in range(150)]
    texts += ["x" * 4000, "é" * 3000, " " * 3000, "a " * 3000, "\n " * 2000, "x" * 900 + " y" + "z" * 3000]
    assert [counter.long(t) for t in texts] == [len(counter.model.encode(t)) for t in texts]


def test_a_vocabulary_without_stable_places_is_encoded_whole():
    counter = Counter(PATH, 100, 10)
    counter.apart = lambda pair: False
    text = "some words and more " * 40
    assert counter.long(text) == len(counter.model.encode(text))


@pytest.mark.parametrize("text", ["漢字仮名交文" * 20_000, "x" * 400_000, "\n" * 400_000, "plain words, and more of them. " * 10_000, "é" * 100_000, "漢" * 50_000 + " a" * 50_000])
def test_bytes_encoded_are_linear(text):
    counter = Counter(PATH)
    assert counter.counts([text]) == [len(counter.model.encode(text))]
    assert counter.encoded <= 3 * len(text.encode())


def test_pieces_do_not_reach_over_stable_places():
    counter, r = Counter(PATH), random.Random(3)
    signs = "aeé漢字かなкий, .ᄀ가́ "
    for _ in range(400):
        left, right = ("".join(r.choice(signs) for _ in range(r.randrange(1, 12))) for _ in range(2))
        if counter.apart(left[-1] + right[0]):
            whole = [p.begin for p in counter.model.encode(left + right, return_type="proto").pieces]
            assert len(left.encode()) in whole
            assert sum(b < len(left.encode()) for b in whole) == len(counter.model.encode(left))


def test_rows(spark):
    long = "A long text of many words, é and 漢. " * 3000
    rows = [(1, None, "c"), (2, "", "c"), (3, "two words", "c"), (3, "two words", "c"), (None, long, "c")]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH).collect()
    model = Counter(PATH).model
    want = [(i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
