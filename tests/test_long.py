"""Long flat sums through reader, rows, rewrites and renderers; text functions against plain loops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from indexalg.functions import text as T
from indexalg.nodes import ast_where, canon, canons, from_rows, node_hash, node_rows, rewrite, walk
from indexalg.plans.render import latex
from indexalg.plans.render.gams import as_gams, model_lines
from indexalg.plans.render.jump import as_jump
from indexalg.plans.render.text import as_text, show
from indexalg.plans.rewrite import annotate_brackets, hoisted, map_leaves, number_conditions, renamed, shared_names
from indexalg.sources.reader import read_model, read_models


def chain(n):
    terms = " + ".join(f"p{k % 7}(i) * {k}" for k in range(n))
    return f"set i; parameters {', '.join(f'p{k}(i)' for k in range(7))}; variable v; equation e; e.. v =e= {terms};"


def everything(n):
    model = read_model(chain(n), "m")
    node = model.equation("e")
    rows = node_rows(node, "m", "e")
    names = ["model_id", "eq", "node_id", "parent_id", "slot", "ord", "level", "node_type", "name", "op", "num_value", "text_value", "brackets"]
    again = from_rows([dict(zip(names, r, strict=False)) for r in reversed(rows)])
    assert canons(again) == canons(node) and [r[-1] for r in rows][0] == len(rows)
    same = rewrite(node, lambda x: x)
    assert same is node
    for change in (annotate_brackets, hoisted, shared_names, lambda x: map_leaves(x, lambda y: y), lambda x: renamed(x, {"v": "w"}), lambda x: number_conditions(x, lambda c: len(latex.as_latex(c)))):
        assert len(list(walk(change(node)))) == len(rows)
    assert as_gams(node).count("+") == as_jump(node).count("+") == as_text(node.get("rhs"), None).count("+") == n - 1
    assert len(as_text(node.get("rhs"))) <= 53
    lines = latex.model_document(model).split("\n")
    body = [x for x in lines if x.startswith("&")]
    assert sum(x.count("+") for x in body) == n - 1
    assert read_model("\n".join(model_lines(model)), "m").equation("e") is not None
    return rows


def test_long_sums_take_linear_time():
    seconds = {}
    for n in (30, 300, 1000, 5000):
        start = time.perf_counter()
        rows = everything(n)
        seconds[n] = time.perf_counter() - start
        # of each term a product, its factor, dims and index, and its number; the sums between them; equation and variable
        assert len(rows) == 5 * n + n - 1 + 2
    assert seconds[5000] < 40 * max(seconds[1000], 0.05)
    node = read_model(chain(200), "m").equation("e")
    assert show(node.get("rhs")).count("<AST expression>") == 2 * 200 - 1


def test_long_sums_as_rows(spark):
    texts = spark.createDataFrame([("a", chain(30)), ("b", chain(5000))], "model_id string, text string")
    got = {r.model_id: r.n for r in read_models(texts, "ast_nodes").where("op = '+'").groupBy("model_id").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 29, "b": 4999}


def test_equal_trees_share_digests():
    node = read_model("set i; parameters a(i), b; variable v; equation e; e.. v =e= (a(i) + b) * (a(i) + b) - (b + a(i));", "m").equation("e")
    sums = [x for *_, x in walk(node) if x.op == "+"]
    assert canon(sums[0]) == canon(sums[1]) != canon(sums[2]) and node_hash(sums[0]) == node_hash(sums[1])
    twice = rewrite(node, lambda x: ast_where("s", x) if x.op == "+" else x)
    assert [x.name for *_, x in walk(shared_names(twice)) if x.kind == "where"] == ["m1", "m1", "m2"]


def plain_split(text, limit, operators=latex.BREAKS):
    lines = []
    while latex.width(text) > limit:
        for op in operators:
            places = [p for _, p in latex.top_level_operators(text, (op,)) if p > 0]
            if places:
                fits = [p for p in places if latex.width(text[:p]) <= limit]
                cut = fits[-1] if fits else places[0]
                lines.append(text[:cut].strip())
                text = f"{op} {text[cut + len(op) :].strip()}"
                operators = (op,)
                break
        else:
            break
    return [*lines, text]


def test_lines_break_as_step_by_step():
    r = random.Random(5)
    parts = ["\\mathsf{cost}_{\\text{r},\\text{y}}", "x", "\\frac{a + b}{c}", "[ a  -  b ]", "\\sum_{i} y", "\\left[z + 1\\right]", "\\texttt{m12}", "12.5", " "]
    for _ in range(300):
        text = r.choice(parts)
        for _ in range(r.randrange(40)):
            text += r.choice(["  +  ", "  -  ", " + ", "  \\cdot  ", "  \\div  ", "  =  ", " "]) + r.choice(parts)
        for limit in (5, 20, 80):
            assert latex.split_lines(text, limit) == plain_split(text, limit)


def levels(text):
    level, out = 0, []
    for c in text:
        if c == ")":
            level = max(level - 1, 0)
        out.append(level)
        if c == "(":
            level += 1
    return out


def top_parts(text, mark):
    out, part, level = [], "", 0
    for c in text:
        if c == mark and level == 0:
            out, part = [*out, part], ""
            continue
        level = level + 1 if c == "(" else max(level - 1, 0) if c == ")" else level
        part += c
    return [*out, part]


def test_levels_and_splits_against_plain_loops(spark):
    r = random.Random(9)
    texts = ["".join(r.choice("ab,$()é漢 +") for _ in range(r.randrange(40))) for _ in range(300)] + ["", ")(", ",,", "$", "((a,b),c),d", "x" * 5000 + ",(" * 300 + ")" * 300 + ",y"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    c = F.col("t")
    pair = T.split_top_level_dollar(c)
    got = rows.select("k", T.paren_levels(c).alias("levels"), T.split_top_level(c, ",").alias("commas"), T.split_top_level(c, "$").alias("dollars"), pair["left"].alias("x"), pair["right"].alias("y"), T.is_expression(c).alias("e")).collect()
    for row in got:
        t = texts[row.k]
        assert row.levels == levels(t)
        assert row.commas == top_parts(t, ",")
        parts = top_parts(t, "$")
        assert row.dollars == parts
        assert (row.x, row.y) == ((parts[0].strip(" "), "$".join(parts[1:]).strip(" ")) if len(parts) > 1 else (None, None))


@pytest.mark.parametrize(("text", "want"), [("a + b", True), ("(a + b)", True), ("f(a + b)", False), ("(a)+(b)", True), ("((a or b))", False), ("x and y", True), ("", False), (None, False), ("name", False)])
def test_is_expression(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.is_expression(F.col("t")).alias("e")).first().e is want
