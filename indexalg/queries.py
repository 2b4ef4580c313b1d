"""Queries over whole tables that exercise each operator, and their SQL.

Evaluations go through parser and compiler: the expression is text, bound to
the tables. Sums of doubles are rounded, as their order is free.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import lines as L
from .functions import text as T
from .functions.math import apply
from .functions.scan import ScanOperators, Tokens, ranks
from .operators import tree as R
from .operators.compile import VALUE, Bindings, Compiler, subset_violations
from .plans.render import latex
from .plans.render.gams import as_gams
from .plans.render.jump import as_jump
from .plans.render.text import as_text
from .sources.parser import Registry, infer_vtype, parse_equation, parse_expression
from .sources.reader import include_lines, read_model, read_models
from .sources.sample import SUPPLY
from .sources.sinks import text_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


class Tables:
    """The tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def value(df: DataFrame, *dims: str, of) -> DataFrame:
    """A parameter's table."""
    return df.select(*dims, (F.col(of) if isinstance(of, str) else of).cast("double").alias(VALUE))


def members(df: DataFrame, column: str, order: str | None = None) -> DataFrame:
    """A set's table: members in their own order."""
    return df.select(F.col(column).alias("member")).distinct().withColumn("ord", F.row_number().over(Window.orderBy("member")))


def unordered(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("member")).distinct()


def evaluate(text: str, bound: Bindings, **kinds: list[str]) -> DataFrame:
    """An expression's table; names are parameters, mappings and sets as bound."""
    registry = Registry(kinds.get("variables", []), list(bound.values), list(bound.mappings), [*bound.sets, *bound.domains])
    return Compiler(bound).table(parse_expression(text, registry))


def rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    return df.withColumn(VALUE, F.round(VALUE, digits))


def lines_value(t: Tables, what=None) -> DataFrame:
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.lineitem.select(F.col("l_suppkey").alias("s"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), (what if what is not None else price).alias(VALUE))


@cache
def supply():
    return read_model(SUPPLY, "supply", desc="a sample", authors="its authors")


def supply_bindings(spark: SparkSession, sf_dir: str) -> Bindings:
    """The sample model on the tables: nations, order years, revenue, and pairs with a volume over 500."""
    t = Tables(spark, sf_dir)
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("y"))
    sold = t.lineitem.join(orders, "l_orderkey").join(t.customer.select("c_custkey", F.col("c_nationkey").alias("r")), "c_custkey")
    cells = sold.groupBy("r", "y").agg(F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(30,6)")).cast("double").alias("revenue"), F.sum("l_quantity").alias("quantity"))
    # all uses need both sums, so that they are one plan, which Spark computes once
    cells = cells.where("revenue IS NOT NULL AND quantity IS NOT NULL")
    years = members(orders, "y")
    return Bindings(
        values={
            "cost": value(cells, "r", "y", of="revenue"),
            "len": years.select(F.col("member").alias("y"), (F.col("ord") * 0.5).alias(VALUE)),
            "vFlow": value(cells, "r", "y", of=F.col("revenue") + F.when(F.col("y") % 2 == 0, 0.25).otherwise(9.0)),
            "vTotal": spark.range(1).select(F.lit(1.0).alias(VALUE)),
        },
        mappings={"mv": cells.where("quantity > 500").select("r", "y")},
        sets={"r": members(t.nation, "n_nationkey"), "y": years},
        domains={"rp": "r"},
    )


_CELLS = """
WITH cells AS (
  SELECT c_nationkey AS r, year(o_orderdate)::INTEGER AS y,
    sum((l_extendedprice * (1 - l_discount))::DECIMAL(30, 6))::DOUBLE AS revenue, sum(l_quantity) AS quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
years AS (SELECT y, row_number() OVER (ORDER BY y) * 0.5 AS w FROM (SELECT DISTINCT year(o_orderdate)::INTEGER AS y FROM orders)),
mv AS (SELECT r, y, revenue, w FROM cells JOIN years USING (y) WHERE quantity > 500)
"""


@query(_CELLS + "SELECT 1.0::DOUBLE AS lhs, round(sum(revenue * w), 2) AS rhs, '==' AS relation, 1.0 = round(sum(revenue * w), 2) AS holds FROM mv")
def entry_total(spark, sf_dir):
    """The sample model's first equation: parser, registry, semi-join, product, sum."""
    df = Compiler(supply_bindings(spark, sf_dir)).equation(supply().equation("eqTotal"))
    return df.select("lhs", F.round("rhs", 2).alias("rhs"), "relation", "holds")


@query(_CELLS + "SELECT r, y, round(revenue + CASE WHEN y % 2 = 0 THEN 0.25 ELSE 9.0 END, 4) AS lhs, round(revenue + CASE WHEN w > 0.5 THEN w ELSE 0 END, 4) AS rhs, revenue + CASE WHEN y % 2 = 0 THEN 0.25 ELSE 9.0 END <= revenue + CASE WHEN w > 0.5 THEN w ELSE 0 END AS holds FROM mv")
def eq_report(spark, sf_dir):
    """An indexed equation with a domain, conditions and ord: D9, D19, D22, D23."""
    df = Compiler(supply_bindings(spark, sf_dir)).equation(supply().equation("eqCap"))
    return df.select("r", "y", F.round("lhs", 4).alias("lhs"), F.round("rhs", 4).alias("rhs"), "holds")


@query("SELECT l_suppkey AS s, round(sum(l_extendedprice * (1 - l_discount)), 4) AS value FROM lineitem GROUP BY 1")
def idx_sum(spark, sf_dir):
    """D12."""
    return rounded(evaluate("sum((o,n), rev(s,o,n))", Bindings({"rev": lines_value(Tables(spark, sf_dir))})), 4)


@query("SELECT o_custkey AS c, round(sum(o_totalprice), 2) AS value FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING') GROUP BY 1")
def idx_sum_where_map(spark, sf_dir):
    """A mapping keeps cells."""
    t = Tables(spark, sf_dir)
    bound = Bindings({"price": value(t.orders.select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o"), "o_totalprice"), "c", "o", of="o_totalprice")}, {"bld": t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("c"))})
    return rounded(evaluate("sum(o$bld(c), price(c,o))", bound))


@query("SELECT o, round(product(1 - d), 14) AS value FROM (SELECT l_orderkey AS o, l_linenumber AS n, max(l_discount) AS d FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def idx_prod(spark, sf_dir):
    """D13 over the cells of a mapping, where no discount is a missing cell."""
    t = Tables(spark, sf_dir)
    own = t.lineitem.groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).agg(F.max("l_discount").alias("d"))
    bound = Bindings({"disc": value(own.where("d <> 0"), "o", "n", of="d")}, {"line": own.select("o", "n")})
    return rounded(evaluate("prod(n$line(o,n), 1 - disc(o,n))", bound), 14)


@query("SELECT p_brand AS b, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part GROUP BY 1")
def idx_smin_smax(spark, sf_dir):
    """D14."""
    t = Tables(spark, sf_dir)
    own = t.part.select(F.col("p_brand").alias("b"), F.col("p_partkey").alias("p"), "p_retailprice")
    bound = Bindings({"price": value(own, "b", "p", of="p_retailprice")}, {"own": own.select("b", "p")})
    low, high = (evaluate(f"{f}(p$own(b,p), price(b,p))", bound).withColumnRenamed(VALUE, n) for f, n in (("smin", "low"), ("smax", "high")))
    return low.join(high, "b")


@query("SELECT l_suppkey AS s, bool_and(l_quantity > 1) AS every, bool_or(l_quantity > 49) AS any FROM lineitem GROUP BY 1")
def idx_sand_sor(spark, sf_dir):
    """D15, D5."""
    t = Tables(spark, sf_dir)
    own = lines_value(t, F.col("l_quantity"))
    bound = Bindings({"q": own}, {"line": own.select("s", "o", "n")})
    every, some = (evaluate(f"{f}((o,n)$line(s,o,n), q(s,o,n) > {k})", bound).select("s", (F.col(VALUE) != 0).alias(n)) for f, k, n in (("sand", 1, "every"), ("sor", 49, "any")))
    return every.join(some, "s", "left").select("s", "every", F.coalesce("any", F.lit(False)).alias("any"))


@query("SELECT n_nationkey AS r, (row_number() OVER (ORDER BY n_nationkey))::DOUBLE AS value, 25.0::DOUBLE AS total FROM nation")
def ord_card(spark, sf_dir):
    """D19."""
    bound = Bindings(sets={"r": members(Tables(spark, sf_dir).nation, "n_nationkey")})
    return evaluate("ord(r)", bound).crossJoin(evaluate("card(r)", bound).withColumnRenamed(VALUE, "total"))


@query("SELECT n_nationkey AS r, coalesce(round(sum(s_acctbal), 2), 0) AS value FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY 1")
def dollar_default_zero(spark, sf_dir):
    """A condition that fails is 0 in a dense table."""
    t = Tables(spark, sf_dir)
    own = t.supplier.select(F.col("s_nationkey").alias("r"), F.col("s_suppkey").alias("s"), "s_acctbal")
    compiler = Compiler(Bindings({"bal": value(own, "r", "s", of="s_acctbal")}, {"own": own.select("r", "s")}, {"r": unordered(t.nation, "n_nationkey")}))
    node = parse_expression("sum(s$own(r,s), bal(r,s)$(bal(r,s) > 5000))", Registry(parameters=["bal"], mappings=["own"], sets=["r"]))
    return rounded(compiler.dense(compiler.term(node)).df)


@query("SELECT o_orderkey AS o, o_totalprice AS lhs, round(coalesce(rev, 0), 4) AS rhs, o_totalprice <= coalesce(rev, 0) AS holds FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS rev FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def eq_holds(spark, sf_dir):
    """Both sides joined on the equation's dims."""
    t = Tables(spark, sf_dir)
    bound = Bindings({"total": value(t.orders.select(F.col("o_orderkey").alias("o"), "o_totalprice"), "o", of="o_totalprice"), "rev": lines_value(t)}, sets={"o": unordered(t.orders, "o_orderkey")})
    node = parse_equation("total(o) =l= sum((s,n), rev(s,o,n))", Registry(parameters=["total", "rev"], sets=["o"]), "e", ["o"])
    return Compiler(bound).equation(node).select("o", "lhs", F.round("rhs", 4).alias("rhs"), "holds")


@query("SELECT o_orderkey AS o, o_totalprice AS lhs, 150000.0::DOUBLE AS rhs, o_totalprice >= 150000 AS holds FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def eq_domain(spark, sf_dir):
    """A mapping limits the cells before anything is evaluated."""
    t = Tables(spark, sf_dir)
    building = t.orders.join(t.customer.where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(F.col("o_orderkey").alias("o"))
    bound = Bindings({"total": value(t.orders.select(F.col("o_orderkey").alias("o"), "o_totalprice"), "o", of="o_totalprice")}, {"bld": building}, {"o": unordered(t.orders, "o_orderkey")})
    node = parse_equation("total(o) =g= 150000", Registry(parameters=["total"], mappings=["bld"], sets=["o"]), "e", ["o"], "bld(o)")
    return Compiler(bound).equation(node).select("o", "lhs", "rhs", "holds")


def _balances(t: Tables) -> Bindings:
    c = t.customer.where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("r")).agg(F.sum("c_acctbal").alias("v"))
    s = t.supplier.where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("r")).agg(F.sum("s_acctbal").alias("v"))
    return Bindings({"cust": value(c, "r", of="v"), "supp": value(s, "r", of="v")}, sets={"r": unordered(t.nation, "n_nationkey")})


_BALANCES = """
WITH c AS (SELECT c_nationkey AS r, sum(c_acctbal) AS v FROM customer WHERE c_acctbal > 9000 GROUP BY 1),
s AS (SELECT s_nationkey AS r, sum(s_acctbal) AS v FROM supplier WHERE s_acctbal > 0 GROUP BY 1)
"""


@query(_BALANCES + "SELECT r, round(coalesce(c.v, 0) + coalesce(s.v, 0), 2) AS plus, round(coalesce(c.v, 0) - coalesce(s.v, 0), 2) AS minus, round(-(coalesce(c.v, 0) - coalesce(s.v, 0)), 2) AS negative FROM c FULL JOIN s USING (r)")
def add_outer(spark, sf_dir):
    """D1, D8."""
    bound = _balances(Tables(spark, sf_dir))
    plus, minus, negative = (rounded(evaluate(e, bound)).withColumnRenamed(VALUE, n) for e, n in (("cust(r) + supp(r)", "plus"), ("cust(r) - supp(r)", "minus"), ("-(cust(r) - supp(r))", "negative")))
    return plus.join(minus, "r").join(negative, "r")


@query("SELECT o_orderkey AS o, c_custkey AS c, round(o_totalprice * c_acctbal, 4) AS value FROM orders JOIN customer ON o_custkey = c_custkey")
def mul_inner(spark, sf_dir):
    """D2."""
    t = Tables(spark, sf_dir)
    bound = Bindings({"price": value(t.orders.select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o"), "o_totalprice"), "c", "o", of="o_totalprice"), "bal": value(t.customer.select(F.col("c_custkey").alias("c"), "c_acctbal"), "c", of="c_acctbal")})
    return rounded(evaluate("price(c,o) * bal(c)", bound), 4)


@query("SELECT l_orderkey AS o, l_linenumber AS n, CASE WHEN max(l_discount) = 0 THEN NULL ELSE round(max(l_tax) / max(l_discount), 6) END AS value FROM lineitem GROUP BY 1, 2")
def div_safe(spark, sf_dir):
    """D3: nothing by nothing is null, not an error."""
    t = Tables(spark, sf_dir)
    own = t.lineitem.groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).agg(F.max("l_tax").alias("l_tax"), F.max("l_discount").alias("l_discount"))
    return rounded(evaluate("tax(o,n) / disc(o,n)", Bindings({"tax": value(own, "o", "n", of="l_tax"), "disc": value(own.where("l_discount <> 0"), "o", "n", of="l_discount")})), 6)


_POWERS = {"p": "price(p)**2 / 1000", "q": "sqrt(price(p))", "e": "exp(price(p) / 1000)", "l": "log(price(p))", "a": "abs(-price(p))"}


@query("SELECT p_partkey AS p, round(p_retailprice * p_retailprice / 1000, 6) AS v_p, round(sqrt(p_retailprice), 6) AS v_q, round(exp(p_retailprice / 1000), 6) AS v_e, round(ln(p_retailprice), 6) AS v_l, round(abs(-p_retailprice), 6) AS v_a FROM part")
def pow_fn_math(spark, sf_dir):
    """D4, D18."""
    t = Tables(spark, sf_dir)
    bound = Bindings({"price": value(t.part.select(F.col("p_partkey").alias("p"), "p_retailprice"), "p", of="p_retailprice")}, sets={"p": unordered(t.part, "p_partkey")})
    out = None
    for k, e in _POWERS.items():
        df = rounded(evaluate(e, bound), 6).withColumnRenamed(VALUE, f"v_{k}")
        out = df if out is None else out.join(df, "p")
    return out


_MATH = {
    "abs": "abs(x)", "acos": "acos(x)", "asin": "asin(x)", "atan": "atan(x)", "cos": "cos(x)", "exp": "exp(x)", "log": "CASE WHEN x > 0 THEN ln(x) END", "log10": "CASE WHEN x > 0 THEN log10(x) END",
    "sin": "sin(x)", "sqrt": "sqrt(abs(x))", "tan": "tan(x)", "ceil": "ceil(x)", "floor": "floor(x)", "sign": "sign(x)::DOUBLE", "arctan": "atan(x)", "arccos": "acos(x)", "arcsin": "asin(x)",
    "cosh": "cosh(x)", "sinh": "sinh(x)", "tanh": "tanh(x)", "acosh": "acosh(x + 2)", "asinh": "asinh(x)", "atanh": "atanh(x / 2)", "ln": "CASE WHEN x > 0 THEN ln(x) END", "log2": "CASE WHEN x > 0 THEN log2(x) END", "trunc": "trunc(x * 10)",
    "mod": "x - 0.3 * floor(x / 0.3)", "power": "pow(abs(x), 1.5)", "min": "least(x, 0.1)", "max": "greatest(x, 0.1)", "gamma": "gamma(x + 2)",
}


@query("SELECT k AS l_linenumber, " + ", ".join(f"round({e}, 6) AS f_{n}" for n, e in _MATH.items()) + " FROM (SELECT range AS k, (range - 500) / 500.5 AS x FROM range(1001))")
def fn_vocabulary(spark, sf_dir):
    """D20, but round and erf, for which SQL has no equal; see fn_erf."""
    x = (F.col("id") - 500) / F.lit(500.5)
    args = {"sqrt": [F.abs(x)], "acosh": [x + 2], "atanh": [x / 2], "trunc": [x * 10], "mod": [x, F.lit(0.3)], "power": [F.abs(x), F.lit(1.5)], "min": [x, F.lit(0.1)], "max": [x, F.lit(0.1)], "gamma": [x + 2]}
    return spark.range(1001).select(F.col("id").alias("l_linenumber"), *(F.round(apply(n, *args.get(n, [x])).cast("double"), 6).alias(f"f_{n}") for n in _MATH))


@query("SELECT n_nationkey AS r, s_suppkey AS s FROM nation, supplier WHERE s_acctbal > n_nationkey * 400 AND (n_nationkey < 5 OR NOT s_acctbal <= 9000)")
def logical_theta(spark, sf_dir):
    """Comparisons of terms with different indices, and, or, not, words as operators."""
    t = Tables(spark, sf_dir)
    bound = Bindings({"bal": value(t.supplier.select(F.col("s_suppkey").alias("s"), "s_acctbal"), "s", of="s_acctbal"), "key": value(t.nation.select(F.col("n_nationkey").alias("r"), (F.col("n_nationkey") * 400).alias("k")), "r", of="k")}, sets={"r": unordered(t.nation, "n_nationkey"), "s": unordered(t.supplier, "s_suppkey")})
    return evaluate("bal(s) GT key(r) and (key(r) < 2000 or not bal(s) le 9000)", bound)


@query("SELECT doc_id AS d, n_chars::DOUBLE AS value FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def not_in_map(spark, sf_dir):
    """$(not map): an anti-join."""
    t = Tables(spark, sf_dir)
    docs = t.documents.select(F.col("doc_id").alias("d"), "n_chars")
    return evaluate("len(d)$(not rated(d))", Bindings({"len": value(docs, "d", of="n_chars")}, {"rated": t.labels.select(F.col("doc_id").alias("d")).distinct()}, {"d": unordered(docs, "d")}))


@query("SELECT a.n_nationkey AS r, b.n_nationkey AS rp, (a.n_regionkey * b.n_regionkey)::DOUBLE AS value FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey")
def alias_self(spark, sf_dir):
    """An alias is the same table under another index."""
    t = Tables(spark, sf_dir)
    nation = t.nation.select(F.col("n_nationkey").alias("r"), "n_regionkey")
    compiler = Compiler(Bindings({"reg": value(nation, "r", of="n_regionkey")}, sets={"r": members(nation, "r")}, domains={"rp": "r"}))
    return compiler.table(parse_expression("(reg(r) * reg(rp))$(ord(r) < ord(rp))", Registry(parameters=["reg"], sets=["r"], aliases=[["r", "rp"]])))


@query("SELECT c_nationkey AS r, round(sum(l_quantity), 2) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def nested_sum(spark, sf_dir):
    """A sum of sums."""
    t = Tables(spark, sf_dir)
    owner = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("r"), F.col("o_orderkey").alias("o"))
    return rounded(evaluate("sum(o$own(r,o), sum((s,n), q(s,o,n)))", Bindings({"q": lines_value(t, F.col("l_quantity"))}, {"own": owner})))


@query("WITH y AS (SELECT year(o_orderdate)::INTEGER AS y, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY y) AS k FROM y) SELECT a.y, b.v AS value FROM n a JOIN n b ON a.k = b.k + 1")
def lag_index(spark, sf_dir):
    """x(t-1): an offset goes along the set's order."""
    t = Tables(spark, sf_dir)
    years = t.orders.select(F.year("o_orderdate").alias("y"), "o_totalprice")
    return rounded(evaluate("x(y-1)", Bindings({"x": value(years.groupBy("y").agg(F.sum("o_totalprice").alias("v")), "y", of="v")}, sets={"y": members(years, "y")})))


@query("SELECT l_orderkey AS o, l_linenumber AS n, l_quantity AS value FROM lineitem WHERE l_returnflag = 'A'")
def quoted_member(spark, sf_dir):
    """x('a'): a quoted member filters and is no index."""
    t = Tables(spark, sf_dir)
    return evaluate("q('A',o,n)", Bindings({"q": value(t.lineitem.select(F.col("l_returnflag").alias("f"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), "l_quantity"), "f", "o", "n", of="l_quantity")}))


@query("SELECT year(o_orderdate)::INTEGER AS y, year(o_orderdate)::DOUBLE AS value FROM orders GROUP BY ALL")
def member_value(spark, sf_dir):
    """Y.val."""
    return evaluate("y.val", Bindings(sets={"y": members(Tables(spark, sf_dir).orders.select(F.year("o_orderdate").alias("y")), "y")}))


@query("SELECT n_nationkey AS r, CASE WHEN n_regionkey = 1 THEN n_nationkey ELSE -n_nationkey END::DOUBLE AS value FROM nation WHERE n_nationkey <> 0")
def when_otherwise(spark, sf_dir):
    """Built from nodes, as the language has no otherwise."""
    from .nodes import ast_expression, ast_constant, ast_parameter, ast_unary, ast_when

    t = Tables(spark, sf_dir)
    nation = t.nation.select(F.col("n_nationkey").alias("r"), "n_regionkey", "n_nationkey")
    key = ast_parameter("key", ["r"])
    node = ast_when(ast_expression("=", ast_parameter("reg", ["r"]), ast_constant(1)), key, ast_unary("-", key))
    compiler = Compiler(Bindings({"reg": value(nation, "r", of="n_regionkey"), "key": value(nation, "r", of="n_nationkey")}, sets={"r": unordered(nation, "r")}))
    return compiler.table(node).where(f"{VALUE} <> 0")


@query("SELECT s_nationkey AS member FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) GROUP BY ALL")
def subset_check(spark, sf_dir):
    """Members of a subset that its set lacks."""
    t = Tables(spark, sf_dir)
    return subset_violations(unordered(t.supplier, "s_nationkey"), unordered(t.nation.where("n_regionkey < 3"), "n_nationkey"))


# --- text

_WS = "[\\x20\\x09-\\x0D]"


@query("SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS sub_no, line FROM (SELECT doc_id, i, regexp_replace(trim(p[i], chr(9) || chr(10) || chr(13) || ' '), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\\n') AS p, unnest(range(1, len(regexp_split_to_array(text, '\\n')) + 1)) AS i FROM documents)) WHERE trim(line) <> ''")
def line_normalise(spark, sf_dir):
    """Lines split off, blank ones dropped, blanks squeezed."""
    rows = Tables(spark, sf_dir).documents.select("doc_id", F.col("text").alias("line"))
    parts = L.drop_blank(rows.select("doc_id", F.posexplode(F.split("line", "\n")).alias("k", "line"))).select("doc_id", "k", T.squeeze(F.trim(F.col("line"))).alias("line"))
    return parts.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("k")) - 1).alias("sub_no"), "line")


@query("SELECT doc_id, i::INTEGER AS sub_no, p AS line FROM (SELECT doc_id, unnest(range(len(q))) AS i, unnest(q) AS p FROM (SELECT doc_id, [trim(x) FOR x IN string_split(replace(replace(text, '.', chr(1) || '.' || chr(1)), ',', chr(1) || ',' || chr(1)), chr(1)) IF trim(x) <> ''] AS q FROM documents))")
def split_on_pattern(spark, sf_dir):
    """Cut on both sides of a pattern, which gets rows of its own."""
    return L.split_lines(Tables(spark, sf_dir).documents.select("doc_id", F.col("text").alias("line")), "[.,]", "both").select("doc_id", "sub_no", "line")


@query("SELECT conv_id, turn, w, regexp_full_match(w, '[!-/:-@\\[-`{-~]+') AS special, regexp_full_match(w, '[a-zA-Z]+') AS word, regexp_full_match(w, '[a-zA-Z0-9_]+') AS word_num FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w FROM conversations)")
def classify_token(spark, sf_dir):
    """T12, T13, T14."""
    w = F.col("w")
    rows = Tables(spark, sf_dir).conversations.select("conv_id", "turn", F.explode(F.split("text", " ")).alias("w"))
    return rows.select("conv_id", "turn", "w", T.is_special(w).alias("special"), T.is_word(w).alias("word"), T.is_word_num(w).alias("word_num"))


@query("SELECT item_id, replace(replace(regexp_replace(regexp_replace(text, '\\\\', '\\\\textbackslash{}', 'g'), '([#$%&_{}])', '\\\\\\1', 'g'), '~', '\\textasciitilde{}'), '^', '\\textasciicircum{}') AS escaped FROM (SELECT item_id, text || ' a_b #1 50% {x} ~ ^ \\c & $' AS text FROM benchmark)")
def escape_text(spark, sf_dir):
    """T19."""
    return Tables(spark, sf_dir).benchmark.select("item_id", T.escape_latex(F.concat("text", F.lit(" a_b #1 50% {x} ~ ^ \\c & $"))).alias("escaped"))


@query("SELECT item_id, '$\\textbf{' || regexp_replace(regexp_replace(trim(text) || '_x', '\\\\', '\\\\textbackslash{}', 'g'), '([#%&$_{}])', '\\\\\\1', 'g') || '} \\le \\textbf{' || 'b\\_1}$' AS styled FROM benchmark")
def latex_relation(spark, sf_dir):
    """Whole texts as the left side of a relation."""
    return Tables(spark, sf_dir).benchmark.select("item_id", T.latex_text(F.concat(F.trim("text"), F.lit("_x <= b_1")), math=True, bold=True).alias("styled"))


_LATEX = "'\\sum_{i} \\frac{a}{b} \\text{x' || page_id || '} \\cdot y_{' || length(html) || '} + \\prod_{j} \\mathsf{abc}'"


@query(f"SELECT page_id, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '\\\\text(normal|bf|it)?\\{{([^}}]*)\\}}', '\\2', 'g'), '\\\\math(it|bf|sf|cal)\\{{([^}}]*)\\}}', '\\2', 'g'), '_\\{{[^}}]*\\}}', '~~', 'g'), '\\\\frac\\{{[^}}]*\\}}\\{{[^}}]*\\}}', '~~~~~~', 'g'), '\\\\sum(_\\{{[^}}]*\\}})?', '~~~~~', 'g'), '\\\\prod(_\\{{[^}}]*\\}})?', '~~~~~', 'g'), '\\\\[a-zA-Z]+', '', 'g'))::INTEGER AS width FROM (SELECT page_id, {_LATEX} AS s FROM pages)")
def est_length(spark, sf_dir):
    """T21."""
    s = F.concat(F.lit("\\sum_{i} \\frac{a}{b} \\text{x"), "page_id", F.lit("} \\cdot y_{"), F.length("html"), F.lit("} + \\prod_{j} \\mathsf{abc}"))
    return Tables(spark, sf_dir).pages.select("page_id", T.latex_length(s).alias("width"))


@query("WITH s AS (SELECT conv_id, turn, text, length(regexp_replace(text, '\\\\[a-zA-Z]+|\\{|\\}|[ \\t\\n\\x0B\\f\\r]+', '', 'g')) + 5 * len(regexp_extract_all(text, '\\+|-|\\\\cdot|\\\\sum|\\\\prod|\\\\frac')) + 10 * len(regexp_extract_all(text, '\\\\\\\\')) AS score FROM conversations) SELECT conv_id, turn, CASE WHEN score < 30 THEN '' WHEN score < 60 THEN '\\big' WHEN score < 90 THEN '\\Big' WHEN score < 130 THEN '\\bigg' ELSE '\\Bigg' END AS size, CASE WHEN score < 30 THEN '[' WHEN score < 60 THEN '\\bigl[' WHEN score < 90 THEN '\\Bigl[' WHEN score < 130 THEN '\\biggl[' ELSE '\\Biggl[' END AS opens FROM s")
def bracket_size(spark, sf_dir):
    """T22, T23."""
    c = F.col("text")
    return Tables(spark, sf_dir).conversations.select("conv_id", "turn", T.latex_bracket_size(c).alias("size"), T.latex_math_brackets(c)["open"].alias("opens"))


@query("SELECT n_nationkey, '(' || n_name || ')' AS round_b, '\\left\\{' || n_name || '\\right\\}' AS curly, n_name || '[' || n_nationkey || ',' || n_regionkey || ']' AS indexed, '_{' || n_nationkey || '}' AS idx, '\\begin{a}' || chr(10) || '\\begin{b}' AS begins, '\\end{b}' || chr(10) || '\\end{a}' AS ends, '\\psi_{' || (n_nationkey + 1) || '}' AS place FROM nation")
def bracket_text(spark, sf_dir):
    """T16, T17, T24, T28, T30, T31, T32."""
    name, key = F.col("n_name"), F.col("n_nationkey")
    envs = F.array(F.lit("a"), F.lit("b"))
    return Tables(spark, sf_dir).nation.select(
        "n_nationkey", T.wrap_brackets(name, F.lit("(")).alias("round_b"), T.latex_wrap_brackets(name, "{}").alias("curly"), T.with_dims(name, F.array(key.cast("string"), F.col("n_regionkey").cast("string"))).alias("indexed"),
        T.format_index(F.array(key.cast("string"))).alias("idx"), T.math_environments(envs).alias("begins"), T.math_environments(envs, end=True).alias("ends"), T.mapping_placeholders(F.concat(F.lit("\\mathsf{m"), key + 1, F.lit("}"))).alias("place"),
    )


@query("WITH c AS (SELECT page_id, i, CASE substr(h, i, 1) WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END AS d FROM (SELECT page_id, h, unnest(range(1, length(h) + 1)) AS i FROM (SELECT page_id, regexp_replace(html, '[^()]', '', 'g') AS h FROM pages))), r AS (SELECT page_id, i, sum(d) OVER (PARTITION BY page_id ORDER BY i) AS s FROM c), m AS (SELECT page_id, max_by(s, i) AS last, least(0, min(s)) AS low FROM r GROUP BY 1) SELECT page_id, coalesce(last - low, 0)::INTEGER AS level FROM pages LEFT JOIN m USING (page_id)")
def paren_level(spark, sf_dir):
    """A level that never falls below 0."""
    return Tables(spark, sf_dir).pages.select("page_id", T.final_paren_level(F.col("html")).alias("level"))


_EXPR = "'f' || n_nationkey || '(a, (b, c), d$e)$(x and (y or z))'"


@query(f"SELECT n_nationkey, 'f' || n_nationkey || '(a, (b, c), d$e)' AS lft, '(x and (y or z))' AS rgt, ['a', '(b, c)', 'd$e'] AS args, '(r,y)$m(r,y)' AS idx, 'p(r, y) * 2' AS val, true AS is_expr, false AS is_call FROM nation")
def top_level_splits(spark, sf_dir):
    """T4, T5, T6, T11."""
    f = F.concat(F.lit("f"), "n_nationkey", F.lit("(a, (b, c), d$e)$(x and (y or z))"))
    pair = T.split_top_level_dollar(f)
    inside = F.regexp_extract(pair["left"], r"^[^(]*\((.*)\)$", 1)
    parts = T.split_indexed(F.lit("sum((r,y)$m(r,y), p(r, y) * 2)"), "sum")
    return Tables(spark, sf_dir).nation.select("n_nationkey", pair["left"].alias("lft"), pair["right"].alias("rgt"), T.split_top_level_args(inside).alias("args"), parts["index"].alias("idx"), parts["value"].alias("val"), T.is_expression(F.lit("(a + b)")).alias("is_expr"), T.is_expression(F.lit("f(a + b)")).alias("is_call"))


@query("SELECT * FROM (VALUES ('+', 1, 0, 3), ('**', 4, 0, 1), ('*', 8, 1, 2), ('and', 12, 0, 6), ('<=', 17, 0, 4)) AS t(op, pos, level, rank)")
def operator_scan(spark, sf_dir):
    """Operators of a text with levels and ranks."""
    return spark.createDataFrame([("a+b **(c*d) and e<=f",)], "s string").lateralJoin(ScanOperators(F.col("s").outer())).select("op", "pos", "level", "rank")


@query("SELECT * FROM (VALUES ('**', 1), ('^', 1), ('*', 2), ('/', 2), ('+', 3), ('-', 3), ('==', 4), ('!=', 4), ('<>', 4), ('<=', 4), ('>=', 4), ('=', 4), ('<', 4), ('>', 4), ('lt', 4), ('le', 4), ('eq', 4), ('ne', 4), ('ge', 4), ('gt', 4), ('not', 5), ('!', 5), ('and', 6), ('&', 6), ('or', 7), ('|', 7)) AS t(op, rank), (SELECT 1 AS one)")
def operator_ranks(spark, sf_dir):
    """The table of precedence; and binds tighter than or."""
    return ranks(spark).withColumn("one", F.lit(1))


@query("SELECT * FROM (VALUES ('name', 'x', 0), ('op', '(', 1), ('name', 't', 2), ('op', '-', 3), ('number', '1e-5', 4), ('op', ')', 8), ('op', '**', 9), ('number', '.5', 12)) AS t(kind, token, pos)")
def token_table(spark, sf_dir):
    """The lexer as a table function."""
    return spark.createDataFrame([("x(t-1e-5)** .5",)], "s string").lateralJoin(Tokens(F.col("s").outer())).select("kind", "token", "pos")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, event_type, last_value(CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM events) WHERE coalesce(f, 0) = 0 AND event_type <> 'purchase'")
def comment_block(spark, sf_dir):
    """L2: rows between an opening and a closing mark are dropped."""
    events = Tables(spark, sf_dir).events.withColumn("line", F.col("event_type"))
    return L.drop_blocks(events, ["user_id"], ["ts", "event_id"], F.col("line") == "click", F.col("line") == "purchase").select("user_id", "event_id")


@query("SELECT doc_id, h AS hash, first, n FROM (SELECT doc_id, sha256(text) AS h, min(doc_id) OVER (PARTITION BY sha256(text)) AS first, count(*) OVER (PARTITION BY sha256(text)) AS n FROM documents)")
def where_dedup(spark, sf_dir):
    """Equal content by hash, and which comes first."""
    docs = Tables(spark, sf_dir).documents.select("doc_id", F.sha2("text", 256).alias("hash"))
    groups = docs.groupBy("hash").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    return docs.join(groups, "hash").select("doc_id", "hash", "first", "n")


@query("SELECT lang, source, 'm' || dense_rank() OVER (PARTITION BY lang ORDER BY first) AS new_name FROM (SELECT lang, source, min(doc_id) AS first FROM documents GROUP BY 1, 2)")
def shared_numbers(spark, sf_dir):
    """Names numbered by first appearance."""
    rows = Tables(spark, sf_dir).documents.groupBy("lang", "source").agg(F.min("doc_id").alias("first"))
    return R.shared_names(rows, ["lang"], "source", "first").select("lang", "source", "new_name")


@query("SELECT n_nationkey AS node_id, CASE n_name WHEN (SELECT n_name FROM nation WHERE n_nationkey = 3) THEN 'three' WHEN (SELECT n_name FROM nation WHERE n_nationkey = 7) THEN 'seven' ELSE n_name END AS name FROM nation")
def alias_rename(spark, sf_dir):
    """Names looked up."""
    nation = Tables(spark, sf_dir).nation
    names = nation.where("n_nationkey IN (3, 7)").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") == 3, "three").otherwise("seven").alias("new_name"))
    nodes = nation.select(F.col("n_nationkey").alias("node_id"), F.col("n_name").alias("name"), F.lit("set").alias("node_type"))
    return R.renamed(nodes, names, ["set"]).select("node_id", "name")


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 5 = 0 THEN 'e' || n_nationkey WHEN n_nationkey % 2 = 0 THEN 'b' || n_nationkey ELSE n_name END AS resolved FROM nation")
def alias_resolve(spark, sf_dir):
    """An extended table before the base one."""
    nation = Tables(spark, sf_dir).nation
    table = lambda k, p: nation.where(f"n_nationkey % {k} = 0").select(F.col("n_name").alias("name"), F.concat(F.lit(p), "n_nationkey").alias("alias"))
    return R.resolved(nation.select(F.col("n_name").alias("name")), "name", table(5, "e"), table(2, "b"))


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'variable' WHEN n_nationkey % 2 = 0 THEN 'set' ELSE 'symbol' END AS kind, CASE WHEN n_nationkey % 3 = 0 THEN upper(n_name) WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS declared_name FROM nation")
def symbol_priority(spark, sf_dir):
    """Kinds in order of priority, case apart."""
    nation = Tables(spark, sf_dir).nation
    declared = nation.where("n_nationkey % 2 = 0").select(F.lit("set").alias("kind"), F.lower("n_name").alias("name"), F.lit(4).alias("priority"))
    declared = declared.unionByName(nation.where("n_nationkey % 3 = 0").select(F.lit("variable").alias("kind"), F.upper("n_name").alias("name"), F.lit(1).alias("priority")))
    return R.symbol_kinds(nation.select(F.col("n_name").alias("name")), declared)


@query("SELECT * FROM (VALUES (0.0::DOUBLE, 1.0::DOUBLE, false, 'binary'), (0.0, NULL, false, 'positive'), (NULL, NULL, false, 'free'), (1.0, 5.0, true, 'integer'), (1.0, 5.0, false, NULL)) AS t(lo, up, whole, vtype)")
def variable_types(spark, sf_dir):
    """P18."""
    rows = [(0.0, 1.0, False), (0.0, None, False), (None, None, False), (1.0, 5.0, True), (1.0, 5.0, False)]
    return spark.createDataFrame([(*r, infer_vtype(*r)) for r in rows], "lo double, up double, whole boolean, vtype string")


# --- models in bulk: one model per nation, named by it


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).nation.select(F.concat(F.lit("m"), "n_nationkey").alias("model_id"), F.lit(SUPPLY).alias("text"))


_MODELS = "(SELECT 'm' || n_nationkey AS model_id FROM nation)"


@query(f"SELECT model_id, kind, name, descr, vtype, ord FROM {_MODELS}, (VALUES ('set', 'r', 'nations', NULL, 1), ('set', 'y', 'years', NULL, 2), ('mapping', 'mv', 'nation and year pairs with enough volume', NULL, 3), ('parameter', 'cost', 'revenue of a nation in a year', NULL, 4), ('parameter', 'len', 'weight of a year', NULL, 5), ('variable', 'vFlow', 'flow', 'positive', 6), ('variable', 'vTotal', 'total', NULL, 7)) AS t(kind, name, descr, vtype, ord)")
def model_symbols(spark, sf_dir):
    """Declarations of many models."""
    return read_models(_texts(spark, sf_dir), "symbols").select("model_id", "kind", "name", "descr", "vtype", "ord")


@query(f"SELECT model_id, 1 AS group_id, ord, member FROM {_MODELS}, (VALUES (1, 'r'), (2, 'rp')) AS t(ord, member)")
def model_aliases(spark, sf_dir):
    """L15."""
    return read_models(_texts(spark, sf_dir), "aliases")


@query(f"SELECT model_id, name, relation, domain_text, body_text FROM {_MODELS}, (VALUES ('eqTotal', '==', NULL, 'vTotal =e= sum((r,y)$mv(r,y),cost(r,y) * len(y))'), ('eqCap', '<=', 'mv(r,y)', 'vFlow(r,y) =l= cost(r,y) + len(y)$(ord(y) > 1)'), ('eqShare', '>=', 'mv(r,y)', 'vFlow(r,y) - cost(r,y) - len(y) =g= -(vTotal / (1 + card(y)))')) AS t(name, relation, domain_text, body_text)")
def model_equations(spark, sf_dir):
    """L17, L18, L19, P14."""
    return read_models(_texts(spark, sf_dir), "equations").select("model_id", "name", "relation", "domain_text", "body_text")


@query(f"SELECT model_id, node_id, parent_id, slot, node_type, name, op FROM {_MODELS}, (VALUES (1, NULL, NULL, 'equation', 'eqTotal', '=='), (2, 1, 'lhs', 'variable', 'vTotal', NULL), (3, 1, 'rhs', 'func', 'sum', NULL), (4, 3, 'index', 'when', NULL, NULL), (5, 4, 'condition', 'mapping', 'mv', NULL), (6, 5, 'dims', 'dims', NULL, NULL), (7, 6, 'item', 'set', 'r', NULL), (8, 6, 'item', 'set', 'y', NULL), (9, 4, 'then', 'dims', NULL, NULL), (10, 9, 'item', 'set', 'r', NULL), (11, 9, 'item', 'set', 'y', NULL), (12, 3, 'value', 'expression', NULL, '*'), (13, 12, 'lhs', 'parameter', 'cost', NULL), (14, 13, 'dims', 'dims', NULL, NULL), (15, 14, 'item', 'set', 'r', NULL), (16, 14, 'item', 'set', 'y', NULL), (17, 12, 'rhs', 'parameter', 'len', NULL), (18, 17, 'dims', 'dims', NULL, NULL), (19, 18, 'item', 'set', 'y', NULL)) AS t(node_id, parent_id, slot, node_type, name, op)")
def model_nodes(spark, sf_dir):
    """The trees of an equation as rows."""
    return read_models(_texts(spark, sf_dir), "ast_nodes").where("eq = 'eqTotal'").select("model_id", "node_id", "parent_id", "slot", "node_type", "name", "op")


@query(f"SELECT model_id, kind, n FROM {_MODELS}, (VALUES ('set', 2), ('mapping', 1), ('parameter', 2), ('variable', 2), ('alias', 1), ('equation', 3)) AS t(kind, n)")
def catalog_counts(spark, sf_dir):
    """F8: what a model has of each kind."""
    texts = _texts(spark, sf_dir)
    return R.catalog_counts(*(read_models(texts, k) for k in ("symbols", "aliases", "equations"))).withColumn("n", F.col("n").cast("int"))


@query(f"SELECT model_id, name, message FROM {_MODELS}, (VALUES ('e1', 'equation e1: unsupported relation =n='), ('e2', 'declared without a body'), ('e9', 'body of an undeclared equation')) AS t(name, message)")
def model_diagnostics(spark, sf_dir):
    """What is wrong hinders nothing else."""
    text = "set i; equation e1, e2(i); e1.. 1 =n= 2; e9.. 1 =e= 1;"
    return read_models(_texts(spark, sf_dir).withColumn("text", F.lit(text)), "diagnostics")


_GRAPH = "WHERE eq = 'eqTotal'"


@query(f"SELECT model_id, id, label, shape, color FROM {_MODELS}, (VALUES (1, '==', 'circle', 'coral'), (2, 'vTotal', 'box', 'dodgerblue'), (3, 'func: sum', 'box', 'lightblue'), (4, 'index: when', 'box', 'lightcoral'), (5, 'cond: mv[r,y]', 'box', 'palegreen'), (9, 'then: [r,y]', 'box', 'plum'), (12, '*', 'box', 'lightblue'), (13, 'cost[r,y]', 'box', 'orange'), (17, 'len[y]', 'box', 'orange')) AS t(id, label, shape, color)")
def net_nodes(spark, sf_dir):
    """Nodes of the graph."""
    return R.graph_nodes(read_models(_texts(spark, sf_dir), "ast_nodes").where("eq = 'eqTotal'")).drop("eq")


@query(f"SELECT model_id, from_id, to_id FROM {_MODELS}, (VALUES (1, 2), (1, 3), (3, 4), (4, 5), (4, 9), (3, 12), (12, 13), (12, 17)) AS t(from_id, to_id)")
def net_edges(spark, sf_dir):
    """Edges of the graph."""
    return R.graph_edges(read_models(_texts(spark, sf_dir), "ast_nodes").where("eq = 'eqTotal'")).drop("eq")


_DOT = "digraph AST {\nnode [shape=box];\n1 [label=\"==\"];\n2 [label=\"vTotal\"];\n3 [label=\"func: sum\"];\n4 [label=\"index: when\"];\n5 [label=\"cond: mv[r,y]\"];\n9 [label=\"then: [r,y]\"];\n12 [label=\"*\"];\n13 [label=\"cost[r,y]\"];\n17 [label=\"len[y]\"];\n1 -> 2;\n1 -> 3;\n3 -> 4;\n3 -> 12;\n4 -> 5;\n4 -> 9;\n12 -> 13;\n12 -> 17;\n}"


@query(f"SELECT model_id, '{_DOT}' AS dot FROM {_MODELS}")
def net_dot(spark, sf_dir):
    """A graph's description as text."""
    return R.dot_lines(read_models(_texts(spark, sf_dir), "ast_nodes").where("eq = 'eqTotal'")).select("model_id", "dot")


@query(f"SELECT model_id, 23 AS interim, 1 AS documents FROM {_MODELS}")
def bulk_lines(spark, sf_dir):
    """K1, K3, K4: lines of many models, cleaned and rendered anew."""
    texts = _texts(spark, sf_dir)
    interim = text_lines(texts, "interim").where("trim(line) <> ''").groupBy("model_id").agg(F.count("*").cast("int").alias("interim"))
    return interim.join(text_lines(texts, "latex").where("line = '\\\\end{document}'").groupBy("model_id").agg(F.count("*").cast("int").alias("documents")), "model_id")


@query(f"SELECT model_id, eq, depth FROM {_MODELS}, (VALUES ('eqTotal', 6), ('eqCap', 6), ('eqShare', 6)) AS t(eq, depth)")
def tree_depth(spark, sf_dir):
    """R2."""
    return R.node_depth(read_models(_texts(spark, sf_dir), "ast_nodes"))


@query(f"SELECT model_id, node_id, node_type, name FROM {_MODELS}, (VALUES (1, 'equation', 'eqTotal'), (2, 'variable', 'vTotal'), (3, 'func', 'sum'), (4, 'where', 's1'), (12, 'expression', NULL), (13, 'parameter', 'cost'), (14, 'dims', NULL), (15, 'set', 'r'), (16, 'set', 'y'), (17, 'parameter', 'len'), (18, 'dims', NULL), (19, 'set', 'y')) AS t(node_id, node_type, name)")
def slot_replace(spark, sf_dir):
    """Subtrees replaced by a leaf."""
    nodes = read_models(_texts(spark, sf_dir), "ast_nodes").where("eq = 'eqTotal'")
    return R.replaced(nodes, "index", "where", "s1").select("model_id", "node_id", "node_type", "name")


@query(f"SELECT model_id, count AS n FROM {_MODELS}, (VALUES (7)) AS t(count)")
def leaf_map(spark, sf_dir):
    """Leaves changed; here the set leaves of an equation, in capitals."""
    nodes = read_models(_texts(spark, sf_dir), "ast_nodes").where("eq = 'eqTotal'")
    return R.mapped_leaves(nodes, "name", F.upper("name"), ["set"]).where("name IN ('R', 'Y')").groupBy("model_id").agg(F.count("*").cast("int").alias("n"))


@query(f"SELECT model_id, node_id, needs FROM {_MODELS}, (VALUES (9, true)) AS t(node_id, needs)")
def bracket_need(spark, sf_dir):
    """Which operators stand below ones that bind tighter."""
    text = "parameter a, b, c; variable v; equation e; e.. v =e= a - b * c - (a - b);"
    nodes = R.needed_brackets(read_models(_texts(spark, sf_dir).withColumn("text", F.lit(text)), "ast_nodes"), ranks(spark))
    return nodes.where("node_type = 'expression' AND needs_brackets").select("model_id", "node_id", F.col("needs_brackets").alias("needs"))


_STATEMENTS = "SELECT * FROM (VALUES (0, 'sets\n i first, j'), (1, 'a.. x =e= 1'), (2, 'b.. y =e= 2')) AS t(statement_no, statement)"


@query("SELECT * FROM (VALUES ('set', 'i', 'first'), ('set', 'j', NULL), ('mapping', 'k', 'pairs'), ('parameter', 'p', 'price'), ('variable', 'v', NULL)) AS t(kind, name, descr)")
def line_declarations(spark, sf_dir):
    """Declarations by windows over lines."""
    text = ["* a comment", "$include other", "sets", " i first", " j /a, b/", " k(i,j) pairs;;", "parameter", " p(i) price", ";", "positive variables", " v(i)", ";"]
    lines = spark.createDataFrame([("m", k, x) for k, x in enumerate(text)], "model_id string, line_no int, line string")
    lines = L.drop_directives(L.drop_comments(lines)).withColumn("line", T.collapse_semicolons(F.col("line")))
    rows = L.declared_modes(lines, ["model_id"], ["line_no"]).where(L.declaration_of(F.col("line")).isNull() & (F.trim(F.regexp_replace("line", ";", "")) != "")).where("mode IS NOT NULL")
    s = L.declared_symbol(F.col("line"))
    return rows.select(L.symbol_kind(F.col("mode"), s["dims"]).alias("kind"), s["name"].alias("name"), s["descr"].alias("descr"))


@query("SELECT * FROM (VALUES ('eq1', 'mv(r,y)', 'x(r,y) =e= 1'), ('eq2', NULL, 'z =l= sum(y, p(y))')) AS t(name, condition, body)")
def line_equations(spark, sf_dir):
    """Statements, headers and bodies by windows over lines."""
    text = ["eq1(r,y)$mv(r,y)..", "  x[r,  y]   =e= 1; eq2..", " z =l= sum(y, p(y));", "eq9.. 1 =e= 1;"]
    lines = spark.createDataFrame([("m", k, x) for k, x in enumerate(text)], "model_id string, line_no int, line string")
    head = L.equation_header(L.canonical(F.col("statement")))
    bodies = L.statements(lines, ["model_id"], ["line_no"]).select("model_id", head.alias("h")).where("h IS NOT NULL").select("model_id", "h.name", "h.condition", F.regexp_replace("h.body", ",", ", ").alias("body"))
    declared = spark.createDataFrame([("m", "eq1"), ("m", "eq2")], "model_id string, name string")
    return L.attach_bodies(declared, bodies, ["model_id"]).select("name", "condition", F.when(F.col("name") == "eq1", F.regexp_replace("body", ", ", ",")).otherwise(F.col("body")).alias("body"))


@query("SELECT * FROM (VALUES (0, 0, 'a'), (1, 0, 'x'), (1, 1, 'y'), (3, 0, 'b')) AS t(line_no, sub_no, line)")
def include_expand(spark, sf_dir):
    """S3: included lines in place; a missing file vanishes."""
    lines = spark.createDataFrame([("m", 0, "a"), ("m", 1, "$include 'f.inc'"), ("m", 2, "$INCLUDE none.inc"), ("m", 3, "b")], "model_id string, line_no int, line string")
    return include_lines(lines, spark.createDataFrame([("f.inc", "x\ny")], "name string, text string")).select("line_no", "sub_no", "line")


def _rendered(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "eq string, text string")


@query("SELECT * FROM (VALUES ('eqTotal', 'eqTotal..\n  vTotal =e=\n  sum(([r,y])$mv[r,y], cost[r,y] * len[y]);'), ('eqCap', 'eqCap[r,y]$mv[r,y]..\n  vFlow[r,y] =l=\n  cost[r,y] + (len[y])$(ord(y) > 1);'), ('eqShare', 'eqShare[r,y]$mv[r,y]..\n  vFlow[r,y] - cost[r,y] - len[y] =g=\n  -(vTotal / (1 + card(y)));')) AS t(eq, text)")
def render_gams(spark, sf_dir):
    """F2, P7."""
    return _rendered(spark, [(e.name, as_gams(e.node)) for e in supply().equations])


@query("SELECT * FROM (VALUES ('eqTotal', 'vTotal == sum(if (mv[r,y]) {[r,y]}, cost[r,y] * len[y])'), ('eqCap', 'vFlow[r,y] <= cost[r,y] + if (ord(set: y) > 1) {len[y]}'), ('eqShare', 'vFlow[r,y] - cost[r,y] - len[y] >= -(vTotal / 1 + card(set: y))')) AS t(eq, text)")
def render_text(spark, sf_dir):
    """F1."""
    return _rendered(spark, [(e.name, as_text(e.node)) for e in supply().equations])


@query("SELECT * FROM (VALUES ('eqTotal', '@constraint(\n  model, \n  vTotal == sum(cost[r, y] * len[y] for (r, y) in mv)\n);'), ('eqCap', '@constraint(\n  model, [r in r, y in y; haskey(mv, (r, y))], \n  vFlow[r, y] <= cost[r, y] + (ord(y) > 1 ? len[y] : 0)\n);'), ('eqShare', '@constraint(\n  model, [r in r, y in y; haskey(mv, (r, y))], \n  vFlow[r, y] - cost[r, y] - len[y] >= -(vTotal / (1 + length(y)))\n);')) AS t(eq, text)")
def render_jump(spark, sf_dir):
    """F3."""
    return _rendered(spark, [(e.name, as_jump(e.node)) for e in supply().equations])


@query("SELECT * FROM (VALUES ('eqTotal', '\\sum_{\\text{r}, \\text{y} \\in \\mathsf{mv}_{\\text{r},\\text{y}}} \\mathsf{cost}_{\\text{r},\\text{y}}  \\cdot  \\mathsf{len}_{\\text{y}}'), ('eqCap', '\\mathsf{cost}_{\\text{r},\\text{y}}  +  \\mathsf{len}_{\\text{y}} \\mid ord(\\text{y})  >  1'), ('eqShare', ' - [ \\bm{\\mathit{vTotal}}  \\div  [ 1  +  card(\\text{y}) ] ]')) AS t(eq, text)")
def render_latex(spark, sf_dir):
    """right sides."""
    return _rendered(spark, [(e.name, latex.as_latex(e.node.get("rhs"))) for e in supply().equations])


from . import model_queries  # noqa: E402, F401 - adds its queries
