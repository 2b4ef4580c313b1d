"""Trees over bound symbols to DataFrames.

A parameter is a table of its dimensions and a value; cells that are not there
are 0. A mapping is a table of keys, a set a table of members in an order.
Compiling gives joins on shared indices, semi-joins for conditions and
group-bys for indexed operations, and leaves their strategy to Catalyst:

* a product is an inner join, since a missing factor makes it 0;
* a sum of terms is a full outer join with missing cells as 0; a term with
  fewer indices is first spread over the sets of those it lacks;
* a condition keeps cells: a mapping or a logical term is a semi-join;
* sum groups what is there; prod, smin, smax and sand see missing cells, so
  they are spread over the index space first.

Indices are renamed by position, from declared to used names, so that an alias
is another use of the same table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.math import function
from ..nodes import Node, index_name

VALUE = "value"
LOGICAL = ("and", "&", "or", "|")
COMPARISONS: dict[str, Callable[[Column, Column], Column]] = {
    **dict.fromkeys(("=", "==", "eq"), lambda a, b: a == b),
    **dict.fromkeys(("<>", "!=", "ne"), lambda a, b: a != b),
    **dict.fromkeys(("<", "lt"), lambda a, b: a < b),
    **dict.fromkeys(("<=", "le"), lambda a, b: a <= b),
    **dict.fromkeys((">", "gt"), lambda a, b: a > b),
    **dict.fromkeys((">=", "ge"), lambda a, b: a >= b),
}


class CompileError(ValueError):
    """A tree that the bound symbols give no meaning."""


@dataclass
class Bindings:
    """Data of symbols.

    values: parameters and variables, columns the declared dims and `value`.
    mappings: columns the declared dims, distinct. sets: columns `member` and,
    for ord and offsets, `ord` from 1. domains: the set an index ranges over, if
    it is not the set of the same name (aliases go here).
    """

    values: dict[str, DataFrame] = field(default_factory=dict)
    mappings: dict[str, DataFrame] = field(default_factory=dict)
    sets: dict[str, DataFrame] = field(default_factory=dict)
    domains: dict[str, str] = field(default_factory=dict)

    def members(self, index: str) -> DataFrame:
        name = self.domains.get(index, index)
        if name not in self.sets:
            raise CompileError(f"no set is bound to index {index!r}")
        return self.sets[name]

    def over(self, index: str) -> DataFrame:
        return self.members(index).select(F.col("member").alias(index))


@dataclass
class Term:
    """Cells of a value. df None: one value, `scalar`, everywhere. logical: rows are the cells that hold."""

    df: DataFrame | None
    dims: tuple[str, ...] = ()
    scalar: Column | None = None
    logical: bool = False


def _merged(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[str, ...]:
    return a + tuple(x for x in b if x not in a)


class Compiler:
    def __init__(self, bindings: Bindings):
        self.bound = bindings
        #: cells that conditions around the present node leave; others don't matter to it
        self.around: list[Term] = []

    # --- tables of symbols

    def _indexed(self, df: DataFrame, columns: list[str], items: list[Node], keep: list[str]) -> tuple[DataFrame, tuple[str, ...]]:
        """Declared columns renamed to the used indices; quoted members filter, offsets shift, an index used twice compares."""
        if len(columns) != len(items):
            raise CompileError(f"{len(items)} indices for dims {columns}")
        used: dict[str, str] = {}
        df = df.select(*(F.col(c).alias(f"__{k}") for k, c in enumerate(columns)), *keep)
        for k, item in enumerate(items):
            own = f"__{k}"
            if item.kind == "constant":
                df = df.where(F.col(own) == F.lit(item.value)).drop(own)
            elif item.kind == "expression" and item.op in ("+", "-") and item.get("rhs").kind == "constant":
                # x(t-1) for index t: a cell at member m is seen from the member one further on
                index, by = item.get("lhs").name, int(item.get("rhs").value) * (1 if item.op == "-" else -1)
                here = self.bound.members(index)
                df = df.join(here.select(F.col("member").alias(own), F.col("ord").alias("__at")), own).drop(own)
                df = df.join(here.select(F.col("member").alias(index), (F.col("ord") - by).alias("__at")), "__at").drop("__at")
                used[index] = index
            else:
                name = index_name(item)
                if name in used:
                    df = df.where(F.col(own) == F.col(used[name])).drop(own)
                else:
                    used[name] = own
        for name, own in used.items():
            df = df.withColumnRenamed(own, name)
        return df, tuple(used)

    def _symbol(self, node: Node) -> Term:
        if node.name in self.bound.values:
            df = self.bound.values[node.name]
            columns = [c for c in df.columns if c != VALUE]
            if not columns and not node.dims:
                return Term(df.select(VALUE), ())
            return Term(*self._indexed(df, columns, node.dims, [VALUE]))
        if node.name in self.bound.mappings:
            df = self.bound.mappings[node.name]
            df, dims = self._indexed(df, df.columns, node.dims or [Node("symbol", name=c) for c in df.columns], [])
            return Term(df, dims, logical=True)
        if node.name in self.bound.sets and node.dims:  # s(x): x is a member of s
            df, dims = self._indexed(self.bound.sets[node.name].select("member"), ["member"], node.dims, [])
            return Term(df, dims, logical=True)
        raise CompileError(f"no data for {node.name!r}")

    # --- shapes

    def value(self, t: Term) -> Term:
        """A logical term as 1 where it holds."""
        if not t.logical:
            return t
        return Term(t.df.withColumn(VALUE, F.lit(1.0)), t.dims) if t.df is not None else Term(None, (), t.scalar.cast("double"))

    def space(self, dims: tuple[str, ...]) -> DataFrame:
        """All combinations of the members of the indices' sets, or those that the conditions around leave."""
        for t in reversed(self.around):
            if set(dims) <= set(t.dims):
                df = t.df.select(*dims)
                return df if len(dims) == len(t.dims) else df.distinct()
        return reduce(lambda a, b: a.crossJoin(b), (self.bound.over(d) for d in dims))

    def spread(self, t: Term, dims: tuple[str, ...]) -> Term:
        """A term over more indices: the same for all members of those it lacked."""
        more = tuple(d for d in dims if d not in t.dims)
        if t.df is None:
            return Term(self.space(dims).withColumn(VALUE, t.scalar), dims) if dims else t
        return Term(t.df.crossJoin(self.space(more)), _merged(t.dims, more), logical=t.logical) if more else t

    def dense(self, t: Term, dims: tuple[str, ...] | None = None, cells: DataFrame | None = None) -> Term:
        """With a row for every cell, 0 where there was none."""
        t = self.value(t)
        dims = dims if dims is not None else t.dims
        if t.df is None or not dims:
            return t
        cells = cells if cells is not None else self.space(dims)
        return Term(cells.join(t.df, list(t.dims), "left").withColumn(VALUE, F.coalesce(VALUE, F.lit(0.0))), dims)

    def _both(self, a: Term, b: Term, how: str) -> tuple[DataFrame, tuple[str, ...]]:
        """Two tables side by side on shared indices, values as __a and __b."""
        x, y = a.df.withColumnRenamed(VALUE, "__a"), b.df.withColumnRenamed(VALUE, "__b")
        on = [d for d in a.dims if d in b.dims]
        dims = _merged(a.dims, b.dims)
        return (x.join(y, on, how) if on else x.crossJoin(y)).select(*dims, "__a", "__b"), dims

    def combine(self, a: Term, b: Term, f: Callable[[Column, Column], Column], how: str) -> Term:
        """f of two terms; how: inner (missing makes 0), outer (missing is 0), left (missing right is 0) or dense (all cells)."""
        a, b = self.value(a), self.value(b)
        if a.df is None and b.df is None:
            return Term(None, (), f(a.scalar, b.scalar))
        dims = _merged(a.dims, b.dims)
        if how == "dense":
            a, b = self.dense(self.spread(a, dims)), self.dense(self.spread(b, dims))
            how = "inner"
        if how == "inner":
            if a.df is None or b.df is None:
                t = b if a.df is None else a
                value = f(a.scalar, F.col(VALUE)) if a.df is None else f(F.col(VALUE), b.scalar)
                return Term(t.df.select(*t.dims, value.alias(VALUE)), t.dims)
            df, dims = self._both(a, b, "inner")
            return Term(df.select(*dims, f(F.col("__a"), F.col("__b")).alias(VALUE)), dims)
        if how == "left" and set(b.dims) <= set(a.dims) and a.df is not None:
            if b.df is None:
                return Term(a.df.select(*a.dims, f(F.col(VALUE), b.scalar).alias(VALUE)), a.dims)
            df, dims = self._both(a, b, "left")
            return Term(df.select(*dims, f(F.col("__a"), F.coalesce("__b", F.lit(0.0))).alias(VALUE)), dims)
        a, b = self.spread(a, dims), self.spread(b, dims)
        if not dims:  # two tables of one value
            df = a.df.withColumnRenamed(VALUE, "__a").crossJoin(b.df.withColumnRenamed(VALUE, "__b")) if a.df is not None and b.df is not None else (a.df or b.df).withColumnRenamed(VALUE, "__a" if a.df is not None else "__b").withColumn("__b" if a.df is not None else "__a", b.scalar if a.df is not None else a.scalar)
        else:
            df, dims = self._both(a, b, "full")
        return Term(df.select(*dims, f(F.coalesce("__a", F.lit(0.0)), F.coalesce("__b", F.lit(0.0))).alias(VALUE)), dims)

    def truth(self, t: Term) -> Term:
        """A value as the cells where it is not 0."""
        if t.logical:
            return t
        return Term(None, (), t.scalar != 0, True) if t.df is None else Term(t.df.where(F.col(VALUE) != 0).select(*t.dims), t.dims, logical=True)

    # --- nodes

    def within(self, condition: Term | None, node: Node) -> Term:
        """A node's value, as far as a condition holds."""
        if condition is None or condition.df is None or not condition.dims:
            return self.term(node)
        self.around.append(condition)
        try:
            return self.term(node)
        finally:
            self.around.pop()

    def term(self, node: Node) -> Term:
        return getattr(self, f"_{node.kind}", self._unknown)(node)

    def _unknown(self, node: Node) -> Term:
        raise CompileError(f"a {node.kind} has no value")

    def _constant(self, node: Node) -> Term:
        if isinstance(node.value, str):
            raise CompileError(f"{node.value!r} is a member, not a value")
        return Term(None, (), F.lit(float(node.value)))

    _parameter = _variable = _mapping = _symbol

    def _set(self, node: Node) -> Term:
        return Term(self.bound.over(node.name), (node.name,), logical=True)

    def _where(self, node: Node) -> Term:
        return self.term(node.get("content"))

    def _unary(self, node: Node) -> Term:
        t = self.term(node.get("rhs"))
        if node.op in ("-", "+"):
            t = self.value(t)
            if node.op == "+":
                return t
            return Term(None, (), -t.scalar) if t.df is None else Term(t.df.withColumn(VALUE, -F.col(VALUE)), t.dims)
        t = self.truth(t)
        if t.df is None:
            return Term(None, (), ~t.scalar, True)
        if not t.dims:
            return Term(t.df.agg(F.count("*").alias("__n")).where("__n = 0").select(), (), logical=True)
        return Term(self.space(t.dims).join(t.df, list(t.dims), "left_anti"), t.dims, logical=True)

    def _expression(self, node: Node) -> Term:
        a, b, op = self.term(node.get("lhs")), self.term(node.get("rhs")), node.op
        if op == "*":
            return self.combine(a, b, lambda x, y: x * y, "inner")
        if op in ("+", "-"):
            return self.combine(a, b, (lambda x, y: x + y) if op == "+" else (lambda x, y: x - y), "outer")
        if op == "/":  # division by 0 or by a missing cell: null
            return self.combine(a, b, F.try_divide, "left")
        if op in ("**", "^"):
            return self.combine(a, b, F.pow, "inner" if b.df is None else "dense")
        if op in COMPARISONS:
            zero = op in ("=", "==", "eq", "<=", "le", ">=", "ge")  # holds between missing cells
            one_sided = a.df is None or b.df is None
            t = self.combine(a, b, COMPARISONS[op], "dense" if zero or one_sided and (a.dims or b.dims) else "outer")
            return Term(None, (), t.scalar, True) if t.df is None else Term(t.df.where(VALUE).select(*t.dims), t.dims, logical=True)
        if op in LOGICAL:
            return self._logic(self.truth(a), self.truth(b), op in ("and", "&"))
        raise CompileError(f"no meaning for operator {op!r}")

    def _logic(self, a: Term, b: Term, both: bool) -> Term:
        if a.df is None and b.df is None:
            return Term(None, (), a.scalar & b.scalar if both else a.scalar | b.scalar, True)
        if a.df is None or b.df is None:
            t, s = (b, a.scalar) if a.df is None else (a, b.scalar)
            return Term(t.df.where(s), t.dims, logical=True) if both else Term(t.df.union(self.space(t.dims).where(s).select(*t.dims)).distinct(), t.dims, logical=True)
        dims = _merged(a.dims, b.dims)
        if both:
            on = [d for d in a.dims if d in b.dims]
            if set(b.dims) <= set(a.dims) and on:
                return Term(a.df.join(b.df, on, "left_semi").select(*dims), dims, logical=True)
            return Term((a.df.join(b.df, on) if on else a.df.crossJoin(b.df)).select(*dims), dims, logical=True)
        x, y = self.spread(a, dims), self.spread(b, dims)
        return Term(x.df.select(*dims).union(y.df.select(*dims)).distinct(), dims, logical=True)

    def restrict(self, t: Term, condition: Term) -> Term:
        """The cells of t where a condition holds; the condition's further indices are added."""
        c = self.truth(condition)
        if c.df is None:
            if t.df is None:
                return Term(None, (), F.when(c.scalar, t.scalar).otherwise(F.lit(0.0)))
            return Term(t.df.where(c.scalar), t.dims, logical=t.logical)
        if t.df is None:
            return Term(c.df.withColumn(VALUE, t.scalar), c.dims) if not t.logical else Term(c.df.where(t.scalar), c.dims, logical=True)
        on = [d for d in t.dims if d in c.dims]
        if on and set(c.dims) <= set(t.dims):
            return Term(t.df.join(c.df, on, "left_semi"), t.dims, logical=t.logical)
        dims = _merged(t.dims, c.dims)
        return Term((t.df.join(c.df, on) if on else t.df.crossJoin(c.df)).select(*dims, *([] if t.logical else [VALUE])), dims, logical=t.logical)

    def _when(self, node: Node) -> Term:
        condition = self.truth(self.term(node.get("condition")))
        t = self.restrict(self.value(self.within(condition, node.get("then"))), condition)
        if (other := node.get("otherwise")) is None:
            return t
        rest = self.restrict(self.value(self.term(other)), self._unary_not(condition))
        return self.combine(t, rest, lambda x, y: x + y, "outer")

    def _unary_not(self, t: Term) -> Term:
        t = self.truth(t)
        return Term(None, (), ~t.scalar, True) if t.df is None else Term(self.space(t.dims).join(t.df, list(t.dims), "left_anti"), t.dims, logical=True)

    def index_space(self, index: Node) -> tuple[tuple[str, ...], Term | None]:
        """(indices, condition) of an indexed operation."""
        if index.kind == "when":
            dims, inner = self.index_space(index.get("then"))
            condition = self.truth(self.term(index.get("condition")))
            return dims, condition if inner is None else self._logic(inner, condition, True)
        if index.kind == "dims":
            return tuple(index_name(d) for d in index.dims), None
        if index.kind in ("set", "symbol") and not index.dims:
            return (index.name,), None
        if index.kind in ("mapping", "symbol", "set"):
            return tuple(index_name(d) for d in index.dims), self.truth(self.term(index))
        raise CompileError(f"a {index.kind} is no index")

    def _reduce(self, name: str, index: Node, value: Node) -> Term:
        over, condition = self.index_space(index)
        t = self.within(condition, value)
        if name in ("sand", "sor"):
            t = self.value(self.truth(t))
        t = self.value(t)
        free = tuple(d for d in _merged(t.dims, condition.dims if condition else ()) if d not in over)
        dims = _merged(free, over)
        if name in ("sum", "sor"):  # missing cells add nothing
            if condition is not None:
                t = self.restrict(t, condition)
            t = self.spread(t, _merged(t.dims, over))
        else:
            if condition is not None and condition.df is not None:
                cells = self.spread(condition, dims).df.select(*dims)
            else:
                cells = self.space(dims) if condition is None else self.space(dims).where(condition.scalar)
            t = self.dense(t, dims, cells)
        agg = {
            "sum": F.sum(VALUE),
            "prod": F.product(VALUE),
            "smin": F.min(VALUE),
            "smax": F.max(VALUE),
            "sand": F.bool_and(F.col(VALUE) != 0).cast("double"),
            "sor": F.bool_or(F.col(VALUE) != 0).cast("double"),
        }[name]
        if free:
            return Term(t.df.groupBy(*free).agg(agg.alias(VALUE)), free)
        empty = {"sum": 0.0, "prod": 1.0, "sand": 1.0, "sor": 0.0}.get(name)
        return Term(t.df.agg(F.coalesce(agg, F.lit(empty)).alias(VALUE) if empty is not None else agg.alias(VALUE)), ())

    def _sum(self, node: Node) -> Term:
        return self._reduce(node.kind, node.get("index"), node.get("value"))

    _prod = _sum

    def _func(self, node: Node) -> Term:
        args = node.all("value")
        if (index := node.get("index")) is not None:
            return self._reduce(node.name, index, args[0])
        if node.name in ("ord", "val"):
            index = index_name(args[0])
            members = self.bound.members(index)
            value = F.col("ord").cast("double") if node.name == "ord" else F.col("member").cast("double")
            return Term(members.select(F.col("member").alias(index), value.alias(VALUE)), (index,))
        if node.name == "card":
            name = args[0].name
            df = self.bound.mappings[name] if name in self.bound.mappings else self.bound.members(name)
            return Term(df.agg(F.count("*").cast("double").alias(VALUE)), ())
        f, keeps_zero = function(node.name)
        terms = [self.value(self.term(a)) for a in args]
        if len(terms) == 1:
            t = terms[0] if keeps_zero else self.dense(terms[0])
            return Term(None, (), f(t.scalar)) if t.df is None else Term(t.df.withColumn(VALUE, f(F.col(VALUE))), t.dims)
        return reduce(lambda a, b: self.combine(a, b, f, "dense"), terms)

    def equation(self, node: Node) -> DataFrame:
        """dims, lhs, rhs, relation, residual (lhs - rhs) and holds, for every cell of the equation's domain."""
        dims = tuple(index_name(d) for d in node.dims)
        around = None
        if dims and (domain := node.get("domain")) is not None:
            around = self.truth(self.term(domain))
        lhs, rhs = (self.value(self.within(around, node.get(s))) for s in ("lhs", "rhs"))
        extra = [d for d in _merged(lhs.dims, rhs.dims) if d not in dims]
        if extra:
            raise CompileError(f"indices {extra} of equation {node.name} are not controlled")
        cells = None
        if dims:
            # the domain's own cells, spread over the indices it lacks
            if around is None or around.df is None:
                cells = self.space(dims) if around is None else self.space(dims).where(around.scalar)
            else:
                cells = self.spread(around, _merged(around.dims, dims)).df.select(*dims).distinct()

        def side(t: Term, name: str) -> Callable[[DataFrame], DataFrame]:
            def add(df: DataFrame) -> DataFrame:
                if t.df is None:
                    return df.withColumn(name, t.scalar)
                own = t.df.withColumnRenamed(VALUE, name)
                return df.join(own, list(t.dims), "left") if t.dims else df.crossJoin(own)

            return add

        start = cells if cells is not None else (lhs.df if lhs.df is not None else rhs.df).sparkSession.range(1).select()
        df = side(rhs, "rhs")(side(lhs, "lhs")(start))
        left, right = F.coalesce("lhs", F.lit(0.0)), F.coalesce("rhs", F.lit(0.0))
        holds = COMPARISONS[node.op](left, right)
        return df.select(*dims, left.alias("lhs"), right.alias("rhs"), F.lit(node.op).alias("relation"), (left - right).alias("residual"), holds.alias("holds"))

    def table(self, node: Node) -> DataFrame:
        """dims and value of an expression; of a logical one the cells that hold."""
        t = self.term(node)
        if t.df is None:
            raise CompileError("a constant has no table")
        return t.df.select(*t.dims, *([] if t.logical else [VALUE]))


def subset_violations(subset: DataFrame, of: DataFrame) -> DataFrame:
    """Members of a subset that its set lacks."""
    return subset.select("member").join(of.select("member"), "member", "left_anti")
