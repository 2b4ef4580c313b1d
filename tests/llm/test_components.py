"""Components against union and find."""

import random

from indexalg.llm.components import components


def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(40)] + [(200, 300 + k) for k in range(50)] + [(7, 7)]
    home = {}

    def find(a):
        while home.setdefault(a, a) != a:
            a = home[a]
        return a

    for a, b in links:
        if a != b:
            p, q = find(a), find(b)
            home[max(p, q)] = min(p, q)
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {a: find(a) for a in home}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
