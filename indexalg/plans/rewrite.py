"""Rewrites of trees before they are planned or rendered."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from ..nodes import Node, ast_where, below, canons, node_hash, rewrite, walk

#: Short names of common indices.
SHORT_NAMES = {
    "comm": "c", "region": "r", "year": "y", "slice": "t", "sup": "s", "dem": "d", "tech": "n", "stg": "g", "trade": "z",
    "expp": "x", "imp": "m", "weather": "w", "process": "p", "aux": "a", "input": "i", "output": "o", "group": "u",
    "techp": "np", "regionp": "rp", "region2": "r2", "src": "rs", "dst": "rd", "yearp": "yp", "yeare": "ye", "yearn": "yn",
    "year2": "y2", "slicep": "tp", "slicepp": "tpp", "slice2": "t2", "groupp": "up", "commp": "cp", "acomm": "ca", "comme": "ce", "supp": "sp",
}
LEAST_LENGTH = 10


def elements(node: Node, slot: str) -> list[Node]:
    """All children in a slot, in pre-order."""
    return [x for _, _, s, _, _, x in walk(node) if s == slot]


def replaced(node: Node, slot: str, by: Node) -> Node:
    """Every child in a slot replaced."""
    return rewrite(node, lambda x: replace(x, parts=tuple((s, by if s == slot else c) for s, c in x.parts)))


def number_conditions(node: Node, length: Callable[[Node], int], kind: str = "when", slot: str = "condition", least: int = LEAST_LENGTH, prefix: str = "s") -> Node:
    """Children in a slot of nodes of a kind that render to at least `least` characters, as named where nodes; equal ones share a name."""
    n = 0

    def name(x: Node) -> Node:
        nonlocal n
        if x.kind != kind:
            return x
        parts = []
        for s, c in x.parts:
            if s == slot and c.kind != "where" and length(c) >= least:
                n += 1
                c = ast_where(f"{prefix}{n}", c, node_hash(c))
            parts.append((s, c))
        return replace(x, parts=tuple(parts))

    return shared_names(rewrite(node, name))


def shared_names(node: Node, prefix: str = "m") -> Node:
    """Where nodes with equal content get one name: m1, m2, ... in order of first appearance."""
    rows, kids = below(node)
    digests, names, named = canons(node), {}, {}
    for (i, *_, x), own in zip(rows, kids, strict=True):
        if x.kind == "where":
            content = next(j for j in own if rows[j][2] == "content")
            named[i] = names.setdefault(digests[content], f"{prefix}{len(names) + 1}")
    return _with_names(rows, kids, named) if named else node


def _with_names(rows: list[tuple], kids: list[list[int]], names: dict[int, str]) -> Node:
    out = [x for *_, x in rows]
    for i in range(len(rows) - 1, -1, -1):
        x = out[i]
        parts = tuple((s, out[j]) for (s, _), j in zip(x.parts, kids[i], strict=True))
        out[i] = replace(x, parts=parts, name=names.get(i + 1, x.name))
    return out[0]


def where_nodes(node: Node) -> dict[str, Node]:
    """Where nodes by name; of equal names the last."""
    return {x.name: x for *_, x in walk(node) if x.kind == "where"}


def renamed(node: Node, names: dict[str, str], kinds: tuple[str, ...] | None = None) -> Node:
    """Nodes whose name is a key of `names` get its value."""
    return rewrite(node, lambda x: replace(x, name=names[x.name]) if x.name in names and (kinds is None or x.kind in kinds) else x)


def resolve_alias(name: str, base: dict[str, str], extended: dict[str, str] | None = None, default: str | None = None) -> str:
    """The short name: of `extended`, else of `base`, else the default, else the name."""
    return (extended or {}).get(name) or base.get(name) or default or name


def resolve_full_name(alias: str, base: dict[str, str], extended: dict[str, str] | None = None, default: str | None = None) -> str:
    """The name an alias stands for."""
    turn = lambda d: {v: k for k, v in (d or {}).items()}
    return turn(extended).get(alias) or turn(base).get(alias) or default or alias


def map_leaves(node: Node, change: Callable[[Node], Node], kinds: tuple[str, ...] | None = None) -> Node:
    """`change` applied to nodes without children."""
    return rewrite(node, lambda x: change(x) if not x.parts and (kinds is None or x.kind in kinds) else x)


def annotate_brackets(node: Node) -> Node:
    """Parentheses exactly where operands need them by rank."""
    from ..sources.lexer import OPERATOR_RANKS
    from .render.gams import _rank

    def mark(x: Node) -> Node:
        if x.kind not in ("expression", "unary"):
            return x
        rank = OPERATOR_RANKS[x.op] if x.kind == "expression" else 2
        parts = []
        for s, c in x.parts:
            own = _rank(c)
            parts.append((s, c.bracketed(c.kind in ("expression", "unary") and (own > rank or (own == rank and (s == "rhs" or rank == 4))))))
        return replace(x, parts=tuple(parts))

    return rewrite(node, mark)


def hoisted(node: Node) -> Node:
    """Factors of a sum's value that don't depend on its index, moved outside."""
    from ..nodes import ast_expression

    def names(x: Node) -> set[str]:
        return {y.name for *_, y in walk(x) if y.kind in ("set", "symbol") and not y.dims}

    def move(x: Node) -> Node:
        if x.kind != "func" or x.name != "sum":
            return x
        over, value, outer = names(x.get("index")), x.get("value"), []
        while value.kind == "expression" and value.op == "*":
            lhs, rhs = value.get("lhs"), value.get("rhs")
            if not names(rhs) & over:
                outer.append(rhs)
                value = lhs
            elif not names(lhs) & over:
                outer.append(lhs)
                value = rhs
            else:
                break
        if not outer:
            return x
        out = replace(x, parts=tuple((s, value if s == "value" else c) for s, c in x.parts))
        for factor in reversed(outer):
            out = ast_expression("*", factor, out)
        return out

    return rewrite(node, move)
