"""Functions of values. All are built in but erf, erfc and gamma, which go by Arrow batches."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _mapped(f):
    def own(x: pd.Series) -> pd.Series:
        return x.map(f, na_action="ignore")

    return F.pandas_udf(own, "double")


def _gamma(x: float) -> float | None:
    try:
        return math.gamma(x)
    except (ValueError, OverflowError):
        return None


def _positive(f):
    """Null where a logarithm is not defined."""
    return lambda x: F.when(x > 0, f(x))


#: name -> (function of Columns, whether missing values, which are 0, give 0)
FUNCTIONS = {
    "abs": (F.abs, True), "sqrt": (F.sqrt, True), "exp": (F.exp, False), "sign": (F.signum, True),
    "log": (_positive(F.ln), False), "ln": (_positive(F.ln), False), "log10": (_positive(F.log10), False), "log2": (_positive(F.log2), False),
    "sin": (F.sin, True), "cos": (F.cos, False), "tan": (F.tan, True), "asin": (F.asin, True), "acos": (F.acos, False), "atan": (F.atan, True),
    "arcsin": (F.asin, True), "arccos": (F.acos, False), "arctan": (F.atan, True),
    "sinh": (F.sinh, True), "cosh": (F.cosh, False), "tanh": (F.tanh, True), "asinh": (F.asinh, True), "acosh": (F.acosh, False), "atanh": (F.atanh, True),
    "ceil": (lambda x: F.ceil(x).cast("double"), True), "floor": (lambda x: F.floor(x).cast("double"), True), "round": (lambda x: F.round(x), True),
    "trunc": (lambda x: F.signum(x) * F.floor(F.abs(x)), True),
    "mod": (lambda x, y: x - y * F.floor(F.try_divide(x, y)), False), "power": (F.pow, False),
    "min": (F.least, False), "max": (F.greatest, False),
}


def function(name: str):
    """(function, keeps zero)."""
    if name in FUNCTIONS:
        return FUNCTIONS[name]
    if name in ("erf", "erfc", "gamma"):
        return _mapped({"erf": math.erf, "erfc": math.erfc, "gamma": _gamma}[name]), name == "erf"
    raise ValueError(f"no function {name!r}")


def apply(name: str, *columns: Column) -> Column:
    """A function by name."""
    return function(name)[0](*columns)
