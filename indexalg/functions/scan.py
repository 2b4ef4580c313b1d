"""Scanning expressions: operators with their levels and ranks, as a table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.lexer import OPERATOR_RANKS, ParseError, tokens


def operators(text: str, only: set[str] | None = None) -> list[tuple[str, int, int, int]]:
    """(operator, place, level, rank) of all operators, multi-character ones whole."""
    out, level = [], 0
    for t in tokens(text):
        if t.kind == "op" and t.text == "(":
            level += 1
        elif t.kind == "op" and t.text == ")":
            level = max(level - 1, 0)
        elif t.kind == "op" and t.text in OPERATOR_RANKS and (only is None or t.text in only):
            out.append((t.text, t.at, level, OPERATOR_RANKS[t.text]))
    return out


def top_level_operators(text: str) -> list[tuple[str, int, int]]:
    """(operator, place, rank) outside parentheses, loosest first, then by place."""
    return sorted(((op, at, rank) for op, at, level, rank in operators(text) if level == 0), key=lambda x: (-x[2], x[1]))


def split_at(text: str, ops: set[str]) -> list[str]:
    """Parts between top-level operators of a set."""
    out, at = [], 0
    for op, place, level, _ in operators(text):
        if level == 0 and op in ops:
            out.append(text[at:place].strip())
            at = place + len(op)
    return [*out, text[at:].strip()]


def sort_by_precedence(ops: list[str], descending: bool = False) -> list[str]:
    """By rank, then longer first; an unknown operator is an error."""
    for op in ops:
        if op not in OPERATOR_RANKS:
            raise ValueError(f"unknown operator {op!r}")
    return sorted(ops, key=lambda op: ((-1 if descending else 1) * OPERATOR_RANKS[op], -len(op)))


def ranks(spark: SparkSession) -> DataFrame:
    """(op, rank): the table of precedence."""
    return spark.createDataFrame(list(OPERATOR_RANKS.items()), "op string, rank int")


@F.udtf(returnType="op string, pos int, level int, rank int")
class ScanOperators:
    """Rows of operators() for a text; text that is no expression has none."""

    def eval(self, text: str) -> Iterator[tuple]:
        try:
            yield from operators(text or "")
        except ParseError:
            return


@F.udtf(returnType="kind string, token string, pos int")
class Tokens:
    """The tokens of a text; none if it is no expression."""

    def eval(self, text: str) -> Iterator[tuple]:
        try:
            yield from ((t.kind, t.text, t.at) for t in tokens(text or ""))
        except ParseError:
            return
