"""Tokens of the algebraic modelling language."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Operators and their ranks; a lower rank binds tighter.
OPERATOR_RANKS = {
    "**": 1, "^": 1,
    "*": 2, "/": 2,
    "+": 3, "-": 3,
    "==": 4, "!=": 4, "<>": 4, "<=": 4, ">=": 4, "=": 4, "<": 4, ">": 4,
    "lt": 4, "le": 4, "eq": 4, "ne": 4, "ge": 4, "gt": 4,
    "not": 5, "!": 5,
    "and": 6, "&": 6,
    "or": 7, "|": 7,
}
WORD_OPERATORS = ("and", "or", "not", "lt", "le", "eq", "ne", "ge", "gt")
#: Relations of equations.
EQUATION_RELATIONS = {"e": "==", "l": "<=", "g": ">=", "le": "<=", "ge": ">="}

_TOKEN = re.compile(
    r"""\s*(?:
      (?P<relation>=[a-zA-Z]{1,2}=)
    | (?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?![A-Za-z_]))
    | (?P<name>[A-Za-z_][A-Za-z0-9_]*)
    | (?P<quoted>'[^']*'|"[^"]*")
    | (?P<op>\*\*|<=|>=|<>|==|!=|[-+*/^<>=&|!$(),.])
    )""",
    re.VERBOSE,
)


class ParseError(ValueError):
    """Text that is no expression of the language."""


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


def tokens(text: str) -> list[Token]:
    """Linear in the text; other kinds of brackets count as parentheses."""
    text = text.translate(str.maketrans("{}[]", "()()"))
    out, at = [], 0
    end = len(text.rstrip())
    while at < end:
        found = _TOKEN.match(text, at)
        if not found:
            raise ParseError(f"unexpected {text[at : at + 10].strip()!r} at {at} in {text!r}")
        kind = found.lastgroup
        word = found[kind]
        if kind == "name" and word.lower() in WORD_OPERATORS:
            kind, word = "op", word.lower()
        out.append(Token(kind, word, found.start(found.lastgroup)))
        at = found.end()
    return out
