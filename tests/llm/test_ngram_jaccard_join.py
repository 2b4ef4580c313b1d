"""Links and components against brute force."""

import random
import re

import numpy as np
import pytest

from indexalg.llm.ngram_jaccard_join import jaccard_components, one_of_each_class, signatures


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words)} if len(words) < width else {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, threshold=80):
    sets = {i: shingles(t) for i, t in rows}
    home = {i: i for i in sets}

    def find(a):
        while home[a] != a:
            a = home[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                p, q = find(a), find(b)
                home[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def made_up(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [r.choice(vocabulary) for _ in range(40)]
    rows, bases = [], []
    for i in range(n):
        kind = r.random()
        if kind < 0.35 or not bases:
            words = [r.choice(vocabulary) for _ in range(r.choice([1, 3, 5, 8, 12, 13, 14, 20, 60, 200, 600]))]
            if kind < 0.1:
                words = words + passage
            bases.append(words)
        else:
            words = list(r.choice(bases))
            for _ in range(r.choice([0, 1, 1, 2, 3, 4, 6, 10])):
                at = r.randrange(len(words) + 1)
                change = r.random()
                if change < 0.4 and words:
                    words[min(at, len(words) - 1)] = r.choice(vocabulary)
                elif change < 0.7:
                    words.insert(at, r.choice(vocabulary))
                elif len(words) > 1:
                    words.pop(min(at, len(words) - 1))
            bases.append(words)
        text = " ".join(words)
        rows.append((i * 3 + 1, text.upper() if r.random() < 0.1 else text.replace(" ", "\n\t", 1)))
    return rows


@pytest.mark.parametrize("threshold", [80, 85, 90, 60])
def test_linked_sets_share_a_signature(threshold):
    r = np.random.default_rng(threshold)
    for _ in range(600):
        size = int(r.choice([1, 2, 3, 4, 5, 7, 8, 9, 10, 17, 18, 33, 120, 500]))
        a = r.integers(0, 2**64, size, dtype=np.uint64)
        if r.random() < 0.3:  # crowded prefixes
            a >>= np.uint64(int(r.integers(1, 50)))
        a = np.unique(a)
        drop = int(r.integers(0, len(a) // 3 + 1))
        b = np.unique(np.concatenate((r.permutation(a)[drop:], r.integers(0, 2**64, int(r.integers(0, len(a) // 4 + 1)), dtype=np.uint64))))
        shared = len(np.intersect1d(a, b))
        if len(b) and 100 * shared >= threshold * (len(a) + len(b) - shared):
            x = set(signatures(a, np.array([len(a)]), threshold / 100)[0].tolist())
            y = set(signatures(b, np.array([len(b)]), threshold / 100)[0].tolist())
            assert x & y, (len(a), len(b), shared)


def test_components_match_brute_force(spark):
    rows = made_up(1, 220)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_all_links_are_counted(spark):
    passage = [f"p{k}" for k in range(200)]
    rows = made_up(5, 80) + [(1000 + i, " ".join(passage[i:])) for i in range(12)]
    sets = {i: frozenset(shingles(t)) for i, t in rows}
    different = set(sets.values()) - {frozenset()}
    want = {i: sum(x != y and 100 * len(x & y) >= 80 * len(x | y) for y in different) if x else 0 for i, x in sets.items()}
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), all_links=True).collect()
    assert {r.doc_id: r.n_links for r in got} == want
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_joins_beyond_the_broadcast_bound(spark, monkeypatch):
    from indexalg.llm import ngram_jaccard_join

    monkeypatch.setattr(ngram_jaccard_join, "BROADCAST_IDS", 0)
    rows = made_up(3, 120)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_large_bucket_is_compared_in_blocks(spark, monkeypatch):
    from indexalg.llm import ngram_jaccard_join

    monkeypatch.setattr(ngram_jaccard_join, "BLOCK", 3)
    rows = made_up(2, 120)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n ", None), (4, "a b", None), (5, "A  b", "y"), (5, "A  b", "y"), (None, "a b", "z"), (7, "word " * 50_000, "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, rep string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_components(frame).collect())
    assert got == [(0, 1, None), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (5, 1, 4), (7, 1, 7)]
    assert jaccard_components(frame.limit(0)).count() == 0


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    from indexalg.llm import shared

    monkeypatch.setattr(shared, "HOT_ROWS", 1)
    monkeypatch.setattr(shared, "HOT_KEYS", 5)
    rows = made_up(4, 60) + [(1000 + i, "the same text " * 9) for i in range(8)] + [(2000 + i, "") for i in range(4)]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_one_of_each_class_takes_any_column_names(spark):
    rows = [(1, "some words that are the same", 7, "a"), (2, "some words that are the same", 8, "b"), (3, "other words", 9, "c"), (3, "other words", 9, "d")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, near_id long, near_first string")
    got = one_of_each_class(frame)
    assert got.columns == frame.columns and sorted((r.doc_id, r.near_id) for r in got.collect()) == [(1, 7), (3, 9)]


def test_large_sets_that_share_a_passage_make_few_pairs(spark, monkeypatch):
    from indexalg.llm import ngram_jaccard_join

    r = random.Random(6)
    passage, made, cut = [f"p{k}" for k in range(1500)], [], ngram_jaccard_join.cut

    def counted(df):
        out = cut(df)
        if out.columns == ["a", "b"]:
            made.append(out.count())
        return out

    monkeypatch.setattr(ngram_jaccard_join, "cut", counted)
    rows = [(k, " ".join(passage + [f"w{r.randrange(10**9)}" for _ in range(500)])) for k in range(60)]
    rows.append((60, rows[41][1] + " one more"))
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), all_links=True).collect()  # all pairs of a bucket are compared, none first with its smallest
    assert {x.doc_id: (x.component_id, x.n_links) for x in got} == {k: (41 if k == 60 else k, int(k in (41, 60))) for k in range(61)}
    assert max(made) <= 2 * len(rows), made  # no two but 41 and 60 link; all pairs are 1,830


def test_empty_texts_of_a_shared_id_do_not_link(spark):
    r = random.Random(7)
    passage = [f"p{k}" for k in range(357)]  # sets of 400, of which 353 are shared: 78.97 percent, which sketches let pass
    rows = [(k, " ".join(passage + [f"w{r.randrange(10**9)}" for _ in range(47)])) for k in range(6)] + [(k, "") for k in range(6)]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.component_id for x in got if x.n_shingles} == set(range(6))


def test_pairs_of_a_group_are_sifted_in_turns(spark):
    from indexalg.llm import ngram_jaccard_join as J

    sets = [np.unique(np.random.default_rng(k // 3).integers(0, 2**64, 700 + k % 3, dtype=np.uint64)) for k in range(9)]
    parity = [np.packbits((np.bincount((J.mix(v ^ J.U(0x2545F491)) & J.U(2047)).astype(np.int64), minlength=2048) & 1).astype(np.uint8), bitorder="little").view(J.U) for v in sets]
    group = J._Group([np.arange(9)], [np.array([len(v) for v in sets])], parity, 1 / 9)
    for members in ([0, 1, 2, 3], [0, 1, 2, 4], [3, 4, 5]):
        group.add(np.array(members), np.zeros(len(members), int), np.array(members), False)
    x = group.pairs()
    assert sorted(zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)) == [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5)]
    assert group.pairs().num_rows == 0
