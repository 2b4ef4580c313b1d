"""Compiled expressions against small tables worked out by hand."""

import pytest

from indexalg.operators.compile import Bindings, CompileError, Compiler
from indexalg.sources.parser import Registry, parse_equation, parse_expression

R = Registry(parameters=["p", "q", "s"], mappings=["mv"], sets=["r", "y"], aliases=[["r", "rp"]])


@pytest.fixture(scope="module")
def compiler(spark):
    make = spark.createDataFrame
    return Compiler(
        Bindings(
            values={
                "p": make([("a", 1, 2.0), ("a", 2, 3.0), ("b", 1, 5.0)], "r string, y int, value double"),
                "q": make([(1, 10.0), (2, 20.0)], "y int, value double"),
                "s": make([(3.0,)], "value double"),
            },
            mappings={"mv": make([("a", 1), ("b", 1)], "r string, y int")},
            sets={"r": make([("a", 1), ("b", 2)], "member string, ord int"), "y": make([(1, 1), (2, 2)], "member int, ord int")},
            domains={"rp": "r"},
        )
    )


def cells(compiler, text):
    return {tuple(r[:-1]): r[-1] for r in compiler.table(parse_expression(text, R)).collect()}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("p(r,y) * q(y)", {("a", 1): 20, ("a", 2): 60, ("b", 1): 50}),
        ("p(r,y) + q(y)", {("a", 1): 12, ("a", 2): 23, ("b", 1): 15, ("b", 2): 20}),
        ("sum((r,y)$mv(r,y), p(r,y) * q(y))", {(): 70}),
        ("sum(mv(r,y), p(r,y))", {(): 7}),
        ("prod(y, p(r,y))", {("a",): 6, ("b",): 0}),
        ("prod(y$(q(y) > 10), p(r,y))", {("a",): 3, ("b",): 0}),
        ("smin(y, p(r,y))", {("a",): 2, ("b",): 0}),
        ("smax(y, p(r,y))", {("a",): 3, ("b",): 5}),
        ("sand(y, p(r,y) > 1)", {("a",): 1, ("b",): 0}),
        ("sor(y, p(r,y) > 4)", {("b",): 1}),
        ("p(r,y)$(q(y) > 10)", {("a", 2): 3}),
        ("p(r,y)$(not mv(r,y))", {("a", 2): 3}),
        ("p(r,y-1)", {("a", 2): 2, ("b", 2): 5}),
        ("p(r,y+1)", {("a", 1): 3}),
        ("p('a',y)", {(1,): 2, (2,): 3}),
        ("card(r) + s", {(): 5}),
        ("card(mv)", {(): 2}),
        ("s * 2", {(): 6}),
        ("2$(s > 1)", {(): 2}),
        ("sum(r, 1)", {(): 2}),
        ("p(r,y)**2", {("a", 1): 4, ("a", 2): 9, ("b", 1): 25}),
        ("mod(p(r,y), 2)", {("a", 1): 0, ("a", 2): 1, ("b", 1): 1, ("b", 2): 0}),
        ("sum(rp$(ord(rp) < ord(r)), p(rp,y))", {(1, "b"): 2, (2, "b"): 3}),
        ("max(p(r,y), 4)", {("a", 1): 4, ("a", 2): 4, ("b", 1): 5, ("b", 2): 4}),
    ],
)
def test_values(compiler, text, want):
    assert cells(compiler, text) == pytest.approx(want)


def test_logical_terms_are_cells(compiler):
    assert {tuple(r) for r in compiler.table(parse_expression("p(r,y) > 2 or mv(r,y)", R)).collect()} == {("a", 1), ("a", 2), ("b", 1)}
    assert {tuple(r) for r in compiler.table(parse_expression("p(r,y) <= 2", R)).collect()} == {("a", 1), ("b", 2)}


def test_division_by_nothing_is_null(compiler):
    assert cells(compiler, "q(y) / sum(r$mv(r,y), p(r,y))") == {(1,): pytest.approx(10 / 7), (2,): None}


def test_equations(compiler):
    got = compiler.equation(parse_equation("p(r,y) =l= q(y) - 5", R, "e", ["r", "y"], "mv(r,y)")).collect()
    assert {tuple(r) for r in got} == {("a", 1, 2.0, 5.0, "<=", -3.0, True), ("b", 1, 5.0, 5.0, "<=", 0.0, True)}
    got = compiler.equation(parse_equation("p(r,y) =e= 2", R, "e", ["r", "y"])).collect()
    assert {(r.r, r.y, r.holds) for r in got} == {("a", 1, True), ("a", 2, False), ("b", 1, False), ("b", 2, False)}
    got = compiler.equation(parse_equation("s =e= sum((r,y), p(r,y))", R, "e")).collect()
    assert [(r.residual, r.holds) for r in got] == [(-7.0, False)]
    with pytest.raises(CompileError):
        compiler.equation(parse_equation("p(r,y) =e= 1", R, "e", ["r"]))


def test_unbound_names(compiler):
    for text in ("nothing(r)", "p(r)", "sum(z, q(z) + 1)", "'a' + 1"):
        with pytest.raises(CompileError):
            compiler.table(parse_expression(text, R))


def test_conditions_reach_the_join(compiler):
    plan = compiler.table(parse_expression("sum((r,y)$mv(r,y), p(r,y) * q(y))", R))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_sums_over_the_facts_are_computed_once(spark):
    from indexalg import queries

    df = queries.entry_total(spark, "/root/testdata/sf0.001")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan
