"""Lexer, parser, renderers: known texts and a round trip of generated trees."""

import random
from dataclasses import replace

import pytest

from indexalg.nodes import ast, ast_constant, ast_dims, ast_equation, ast_expression, ast_func, ast_mapping, ast_parameter, ast_prod, ast_set, ast_sum, ast_symbol, ast_unary, ast_variable, ast_when, ast_where, canon, depth, from_rows, func_to, node_hash, node_rows, node_type, rewrite
from indexalg.plans import rewrite as plans
from indexalg.plans.render import latex
from indexalg.plans.render.gams import as_gams, pretty
from indexalg.plans.render.jump import as_jump
from indexalg.plans.render.text import as_text, show
from indexalg.functions.scan import sort_by_precedence, split_at, top_level_operators
from indexalg.sources.lexer import ParseError
from indexalg.sources.parser import Registry, infer_vtype, parse_equation, parse_expression

R = Registry(variables=["vTotal"], parameters=["cost"], mappings=["mv"], sets=["r", "y"])


def shape(n):
    if n.kind == "expression":
        return f"({shape(n.get('lhs'))}{n.op}{shape(n.get('rhs'))})"
    if n.kind == "unary":
        return f"({n.op} {shape(n.get('rhs'))})"
    return str(n.value) if n.kind == "constant" else n.name


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("a-b-c", "((a-b)-c)"),
        ("a-b+c", "((a-b)+c)"),
        ("a/b*c", "((a/b)*c)"),
        ("-a+b", "((- a)+b)"),
        ("a**b*c", "((a**b)*c)"),
        ("a*-b", "(a*(- b))"),
        ("a or b and c", "(aor(bandc))"),
        ("(a<=b and c<=d)+(e)", "(((a<=b)and(c<=d))+e)"),
        ("x+1 LE y", "((x+1.0)ley)"),
        ("0.5", "0.5"),
        (".5", "0.5"),
        ("1e-5", "1e-05"),
        ("-1", "-1.0"),
        ("-x", "(- x)"),
        ("not a = b", "(not (a=b))"),
        ("{a + [b]}", "(a+b)"),
    ],
)
def test_trees(text, tree):
    assert shape(parse_expression(text)) == tree


def test_flat_chains_have_no_limit_and_nesting_has_one():
    assert parse_expression("+".join(["a"] * 200)) is not None
    with pytest.raises(ParseError):
        parse_expression("(" * 30 + "a" + ")" * 30)
    assert parse_expression("  ") is None


@pytest.mark.parametrize("text", ["a +", "a =e= b", "sum(i)", "(a", "a b", "min(a)", "#"])
def test_errors(text):
    with pytest.raises(ParseError):
        parse_expression(text)


def test_registry_order_and_case():
    r = Registry(variables=["x"], parameters=["X2", "x"], mappings=["m"], sets=["S"], aliases=[["S", "t"]])
    assert [r.find(n) for n in ("x", "m", "s", "t", "sum", "SQRT", "q")] == [("variable", "x"), ("mapping", "m"), ("set", "S"), ("set", "t"), ("func_indexed", "sum"), ("func", "sqrt"), ("symbol", "q")]
    assert r.warnings == ["s differs in case from the declared S"]


def made_up(r, d):
    k = r.random()
    if d == 0 or k < 0.2:
        return r.choice([ast_constant(r.choice([0.5, 2, 1e-5, -1])), ast_parameter("cost", ["r", "y"]), ast_variable("vTotal"), ast_symbol("q")])
    if k < 0.7:
        return ast_expression(r.choice(["+", "-", "*", "/", "**", "<=", "and", "or", "="]), made_up(r, d - 1), made_up(r, d - 1))
    if k < 0.8:
        return ast_unary(r.choice(["-", "not"]), made_up(r, d - 1))
    if k < 0.9:
        return ast_when(made_up(r, d - 1), made_up(r, d - 1))
    return ast_func("sum", made_up(r, d - 1), ast_when(ast_mapping("mv", ["r", "y"]), ast_dims("r", "y")))


def test_rendered_text_parses_to_the_same_tree():
    def plain(n):
        return rewrite(n, lambda x: replace(x, kind="symbol") if x.kind == "set" else x)

    for seed in range(1500):
        tree = made_up(random.Random(seed), 4)
        assert canon(plain(parse_expression(as_gams(tree), R, 200))) == canon(plain(tree)), as_gams(tree)


def test_published_equation():
    registry = Registry(["vObjective", "vTotalCost"], ["pPeriodLen", "pDiscountFactor"], ["mvTotalCost"], ["region", "year"])
    eq = parse_equation("vObjective =e= sum((region,year)$mvTotalCost(region,year), vTotalCost(region,year)*pPeriodLen(year)*pDiscountFactor(region,year))", registry, "eqObjective")
    assert as_gams(eq) == "eqObjective..\n  vObjective =e=\n  sum(([region,year])$mvTotalCost[region,year], vTotalCost[region,year] * pPeriodLen[year] * pDiscountFactor[region,year]);"
    assert show(eq).split("\n")[:3] == ["<AST equation> eqObjective", "  relation:  ==", "  lhs:  vObjective"]
    assert "\\in \\mathsf{mvTotalCost}" in latex.as_latex(eq.get("rhs"))
    assert as_jump(eq.get("rhs")) == "sum(vTotalCost[region, year] * pPeriodLen[year] * pDiscountFactor[region, year] for (region, year) in mvTotalCost)"
    assert pretty(as_gams(eq))[0] == "eqObjective.." and pretty(as_gams(eq))[-1] == ";"


def test_equation_errors_name_the_equation():
    for body in ("a =n= b", "a", "a =e= b =e= c", "=e= b"):
        with pytest.raises(ParseError, match="e1"):
            parse_equation(body, R, "e1")


def test_constructors_check():
    for bad in (lambda: ast_mapping("m", []), lambda: ast_unary("*", ast_constant(1)), lambda: ast_equation(ast_constant(1), ast_constant(1), "~"), lambda: ast_set(""), lambda: func_to("sum", ast_func("exp", ast_constant(1)))):
        with pytest.raises(ValueError):
            bad()
    for bad in (lambda: ast_constant(True), lambda: ast_when("a", ast_constant(1)), lambda: ast_sum(ast_dims("i"), 1)):
        with pytest.raises(TypeError):
            bad()
    assert node_type(ast_prod(ast_dims("i"), ast_symbol("x"))) == "prod" and node_type(3) is None
    assert ast("own", name="n", note="text").note("note") == "text"


def test_hash_tells_kinds_apart_and_rows_give_the_tree_back():
    assert node_hash(ast_parameter("a", ["i"])) != node_hash(ast_mapping("a", ["i"]))
    tree = made_up(random.Random(5), 4)
    rows = [dict(zip(["model_id", "eq", "node_id", "parent_id", "slot", "ord", "level", "node_type", "name", "op", "num_value", "text_value", "brackets"], r[:13], strict=True)) for r in node_rows(tree, "m", "e")]
    assert canon(from_rows(rows)) == canon(tree)
    assert depth(ast_constant(1)) == 1 and depth(ast_expression("+", ast_constant(1), ast_constant(2))) == 2


def test_scanning():
    assert [x[0] for x in top_level_operators("a+b*(c-d) and e")] == ["and", "+", "*"]
    assert split_at("a+b*(c+d)+e", {"+"}) == ["a", "b*(c+d)", "e"]
    assert sort_by_precedence(["+", "*", "**", "and"]) == ["**", "*", "+", "and"]
    with pytest.raises(ValueError):
        sort_by_precedence(["~"])


def test_shared_conditions_get_names():
    text = "x$(mv(r,y) and q > 1) + z$(mv(r,y) and q > 1) + w$(q > 2 or mv(r,y))"
    tree = plans.number_conditions(parse_expression(text, R), lambda n: len(as_text(n, None)))
    assert sorted(plans.where_nodes(tree)) == ["m1", "m2"]
    assert as_gams(tree) == as_gams(parse_expression(text, R))
    assert len(latex.distinct_parts(tree)) == 2 and "\\psi_{1}" in latex.placeholders(latex.as_latex(tree))


def test_rewrites():
    tree = parse_expression("sum(y, cost(r,y) * k * cost(r,y))", R)
    assert as_gams(plans.hoisted(parse_expression("sum(y, cost(r,y) * k)", R))) == "k * sum(y, cost[r,y])"
    assert as_gams(plans.renamed(tree, {"cost": "c"}, ("parameter",))) == "sum(y, c[r,y] * k * c[r,y])"
    assert len(plans.elements(tree, "dims")) == 2
    assert as_gams(plans.replaced(tree, "index", ast_set("z"))) == "sum(z, cost[r,y] * k * cost[r,y])"
    assert plans.resolve_alias("region", plans.SHORT_NAMES) == "r" and plans.resolve_full_name("r", plans.SHORT_NAMES) == "region" and plans.resolve_alias("q", {}, default="d") == "d"
    assert as_gams(plans.map_leaves(parse_expression("a + b"), lambda x: replace(x, name=x.name.upper()))) == "A + B"
    assert as_gams(plans.annotate_brackets(ast_expression("*", ast_expression("+", ast_symbol("a"), ast_symbol("b")), ast_symbol("c")))) == "(a + b) * c"
    assert ast_where("w", ast_symbol("a")).get("content").name == "a"


def test_latex_lines_break_at_the_last_operator_that_fits():
    lines = latex.split_lines("aaaaaaaaaa + bbbbbbbbbb + cccccccccc", 25)
    assert lines == ["aaaaaaaaaa + bbbbbbbbbb", "+ cccccccccc"]
    assert latex.top_level_operators("\\left[ a + b \\right] + \\frac{c+d}{e} \\cdot f") == [("+", 21), ("\\cdot", 37)]
    assert latex.aligned("a", "=", "b") == "&a = b \\\\"
    assert latex.width("\\sum_{i} x") == 9 and latex.width("") == 0


def test_variable_types():
    assert [infer_vtype(*x) for x in ((0, 1), (0, None), (None, None), (2, 3, True), (2, 3))] == ["binary", "positive", "free", "integer", None]
