"""Water-filling against step-by-step sharing, sampling against its targets."""

import random

import pytest

from indexalg.llm.source_mixing import mix_sources


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > cap * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        free -= over
    return out


def made_up(seed, n):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        source = r.choices(["hot", "b", "c", "Z", "é", "𐍈", None, "tiny"], [10, 5, 4, 3, 2, 2, 2, 0.2])[0]
        rows.append((i, source, r.choice([None, "", "one", "two words", "w " * r.randrange(1, 80), "x\ty\nz"])))
    return rows


@pytest.mark.parametrize("limit", [20_000, 0])
def test_against_brute_force(spark, monkeypatch, limit):
    from indexalg.llm import source_mixing

    monkeypatch.setattr(source_mixing, "BROADCAST_SOURCES", limit)
    rows = made_up(1, 1500)
    frame = spark.createDataFrame([(*r, "c", 7) for r in rows], "doc_id long, source string, text string, taken string, other int")
    got = mix_sources(frame).collect()
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    assert len(got) == len(rows)
    taken, largest = dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0)
    for r in got:
        assert r.size == len((rows[r.doc_id][2] or "").split()) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    assert sorted(map(tuple, mix_sources(frame).collect())) == sorted(map(tuple, got)) if None not in sizes else True
    again = {r.doc_id: r.taken for r in mix_sources(frame.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_only_dataframe_functions(spark):
    docs = spark.createDataFrame([(1, "a", "x y"), (2, "b", "z")], "doc_id long, source string, text string")
    plan = mix_sources(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_odd_rows(spark):
    frame = spark.createDataFrame([(None, None, None), (1, "a", "x"), (1, "a", "x"), (2, "b", ""), (None, "a", "long " * 60_000)], "doc_id long, source string, text string")
    got = mix_sources(frame).collect()
    assert len(got) == 5 and {r.target for r in got if r.source in ("b", None)} == {0.0}
    assert mix_sources(frame.limit(0)).count() == 0
    assert [r.taken for r in mix_sources(frame.where("source = 'b'")).collect()] == [0]


def test_columns_may_have_any_names(spark):
    names = ["mix_draw", "mix_source", "_mix_size", "mix_extra", "bucket", "before", "at"]
    rows = [(i, "ab"[i % 2], "w " * i, *[f"{n}{i}" for n in names]) for i in range(40)]
    frame = spark.createDataFrame(rows, ["doc_id", "source", "text", *names])
    got = mix_sources(frame)
    assert got.columns == [*frame.columns, "size", "source_size", "target", "taken"]
    assert sorted(tuple(r)[:10] for r in got.collect()) == sorted(rows)
    plain = mix_sources(frame.select("doc_id", "source", "text"))
    assert sorted((r.doc_id, r.taken) for r in got.collect()) == sorted((r.doc_id, r.taken) for r in plain.collect())
