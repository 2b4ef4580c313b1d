"""Syntax trees of models: one immutable node type, checked constructors, rows.

A node has a kind, at most one each of name, op and value, a flag that it stood
in parentheses, and parts: (slot, child) pairs in reading order. In bulk, trees
are rows of a table (see NODE_SCHEMA), numbered in pre-order.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

RELATIONS = ("==", "<=", ">=", "<", ">")
UNARY_OPERATORS = ("-", "not", "+", "!")
#: Kinds that are a name with dimensions.
NAMED = ("parameter", "variable", "mapping", "symbol")


@dataclass(frozen=True)
class Node:
    kind: str
    name: str | None = None
    op: str | None = None
    value: float | str | None = None
    brackets: bool = False
    parts: tuple[tuple[str, Node], ...] = ()
    #: further text: desc, vtype
    info: tuple[tuple[str, str], ...] = ()

    def get(self, slot: str) -> Node | None:
        """The first child in a slot."""
        return next((x for s, x in self.parts if s == slot), None)

    def all(self, slot: str) -> list[Node]:
        return [x for s, x in self.parts if s == slot]

    @property
    def dims(self) -> list[Node]:
        """Indices of a dims node, or of a node that has one."""
        own = self if self.kind == "dims" else self.get("dims")
        return own.all("item") if own else []

    def note(self, key: str) -> str | None:
        return dict(self.info).get(key)

    def bracketed(self, flag: bool = True) -> Node:
        return replace(self, brackets=flag)


def _text(x: object, what: str) -> str:
    if not isinstance(x, str) or not x:
        raise ValueError(f"{what} must be a non-empty string")
    return x


def _is_node(x: object, what: str) -> Node:
    if not isinstance(x, Node):
        raise TypeError(f"{what} must be a node")
    return x


def ast(kind: str, **fields) -> Node:
    """Any node; fields that are nodes, or lists of them, become parts."""
    parts, plain = [], {}
    for k, v in fields.items():
        if isinstance(v, Node):
            parts.append((k, v))
        elif isinstance(v, (list, tuple)):
            parts += [(k, _is_node(x, k)) for x in v]
        elif v is not None:
            plain[k] = v
    known = {k: plain.pop(k) for k in ("name", "op", "value", "brackets") if k in plain}
    return Node(_text(kind, "kind"), parts=tuple(parts), info=tuple((k, str(v)) for k, v in plain.items()), **known)


def ast_set(name: str) -> Node:
    return Node("set", name=_text(name, "name"))


def ast_dims(*items: Node | str) -> Node:
    """Ordered indices; strings become symbols, nodes stay as they are."""
    return Node("dims", parts=tuple(("item", ast_symbol(x) if isinstance(x, str) else _is_node(x, "index")) for x in items))


def _named(kind: str, name: str, dims: Node | tuple | list | None, **info) -> Node:
    dims = dims if isinstance(dims, Node) and dims.kind == "dims" else ast_dims(*([dims] if isinstance(dims, (Node, str)) else dims or ()))
    return Node(kind, name=_text(name, "name"), parts=(("dims", dims),) if dims.parts else (), info=tuple((k, str(v)) for k, v in info.items() if v is not None))


def ast_mapping(name: str, dims) -> Node:
    out = _named("mapping", name, dims)
    if not out.dims:
        raise ValueError("a mapping needs at least one dimension")
    return out


def ast_parameter(name: str, dims=None) -> Node:
    return _named("parameter", name, dims)


def ast_variable(name: str, dims=None, vtype: str | None = None) -> Node:
    return _named("variable", name, dims, vtype=vtype)


def ast_symbol(name: str, dims=None) -> Node:
    return _named("symbol", name, dims)


def ast_constant(value: float | str) -> Node:
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        raise TypeError("a constant is a number or a string")
    return Node("constant", value=value if isinstance(value, str) else float(value))


def ast_when(condition: Node, then: Node, otherwise: Node | None = None) -> Node:
    return ast("when", condition=_is_node(condition, "condition"), then=_is_node(then, "then"), otherwise=otherwise)


def ast_sum(index: Node, value: Node) -> Node:
    return ast("sum", index=_is_node(index, "index"), value=_is_node(value, "value"))


def ast_prod(index: Node, value: Node) -> Node:
    return ast("prod", index=_is_node(index, "index"), value=_is_node(value, "value"))


def ast_func(name: str, value: Node | list[Node], index: Node | None = None) -> Node:
    return ast("func", name=_text(name, "name"), index=index, value=value if isinstance(value, Node) else list(value))


def ast_expression(op: str, lhs: Node, rhs: Node, brackets: bool = False) -> Node:
    return ast("expression", op=_text(op, "op"), lhs=_is_node(lhs, "lhs"), rhs=_is_node(rhs, "rhs"), brackets=brackets)


def ast_unary(op: str, rhs: Node) -> Node:
    if op not in UNARY_OPERATORS:
        raise ValueError(f"unrecognised unary operator {op!r}")
    return ast("unary", op=op, rhs=_is_node(rhs, "rhs"))


def ast_equation(lhs: Node, rhs: Node, relation: str = "==", name: str | None = None, domain: Node | None = None, desc: str | None = None, dims=None) -> Node:
    if relation not in RELATIONS:
        raise ValueError(f"unrecognised relation {relation!r}")
    dims = dims if dims is None or isinstance(dims, Node) else ast_dims(*dims)
    return ast("equation", name=name, op=relation, dims=dims, domain=domain, lhs=_is_node(lhs, "lhs"), rhs=_is_node(rhs, "rhs"), desc=desc)


def ast_where(name: str, content: Node, digest: str | None = None) -> Node:
    return ast("where", name=_text(name, "name"), content=_is_node(content, "content"), hash=digest)


def func_to(kind: str, node: Node) -> Node:
    """A func named sum or prod as a node of that kind."""
    if node.kind != "func" or node.name != kind:
        raise ValueError(f"not a function {kind}")
    value = node.all("value")
    return ast(kind, index=node.get("index"), value=value[0] if len(value) == 1 else ast_dims(*value)).bracketed(node.brackets)


def node_type(x: object) -> str | None:
    """The kind of a node; None for anything else."""
    return x.kind if isinstance(x, Node) else None


def walk(node: Node, parent: int | None = None, slot: str | None = None, order: int = 0, level: int = 0, ids: list[int] | None = None) -> Iterator[tuple[int, int | None, str | None, int, int, Node]]:
    """(id, parent, slot, place among its siblings, level, node) in pre-order, ids from 1."""
    stack, n = [(node, parent, slot, order, level)], 0
    while stack:
        x, up, s, k, depth_ = stack.pop()
        n += 1
        yield n, up, s, k, depth_, x
        for i in range(len(x.parts) - 1, -1, -1):
            stack.append((x.parts[i][1], n, x.parts[i][0], i, depth_ + 1))


def depth(node: Node) -> int:
    """Levels of nesting: 1 for a leaf."""
    return 1 + max(level for *_, level, _ in walk(node))


def below(node: Node) -> tuple[list[tuple], list[list[int]]]:
    """(rows of walk(), for each the places of its children in that list); parents come before children."""
    rows = list(walk(node))
    kids: list[list[int]] = [[] for _ in rows]
    for i, (_, up, *_) in enumerate(rows):
        if up is not None:
            kids[up - 1].append(i)
    return rows, kids


def canons(node: Node) -> list[str]:
    """Of all nodes in pre-order, a digest that is the same for trees that mean the same: parentheses and notes don't count, kinds do."""
    rows, kids = below(node)
    out = [""] * len(rows)
    for i in range(len(rows) - 1, -1, -1):
        x = rows[i][-1]
        own = [x.kind, x.name, x.op, x.value, *([rows[j][2], out[j]] for j in kids[i])]
        out[i] = hashlib.sha256(json.dumps(own, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    return out


def canon(node: Node) -> str:
    """The digest of a whole tree."""
    return canons(node)[0]


def node_hash(node: Node) -> str:
    """CRC-32 of canon(), as eight hexadecimal digits."""
    return _short(canon(node))


def _short(digest: str) -> str:
    return f"{zlib.crc32(digest.encode()):08x}"


def rewrite(node: Node, change: Callable[[Node], Node]) -> Node:
    """`change` applied to all nodes, children first."""
    rows, kids = below(node)
    out: list[Node] = [x for *_, x in rows]
    for i in range(len(rows) - 1, -1, -1):
        x = rows[i][-1]
        parts = tuple((s, out[j]) for (s, _), j in zip(x.parts, kids[i], strict=True))
        out[i] = change(replace(x, parts=parts) if any(a is not b for (_, a), (_, b) in zip(parts, x.parts, strict=True)) else x)
    return out[0]


def left_spine(node: Node) -> tuple[Node, list[Node]]:
    """(the innermost left operand, the binary expressions from there out to `node`): flat chains may be very long."""
    outer = []
    while node.kind == "expression":
        outer.append(node)
        node = node.get("lhs")
    return node, outer[::-1]


NODE_SCHEMA = "model_id string, eq string, node_id int, parent_id int, slot string, ord int, level int, node_type string, name string, op string, num_value double, text_value string, brackets boolean, dims array<string>, canon string, hash string, last_id int"


def index_name(node: Node) -> str:
    """How an index is written inside brackets: a name, a name with an offset, or a quoted member."""
    if node.kind == "constant":
        return f"'{node.value}'" if isinstance(node.value, str) else number(node.value)
    if node.kind == "expression":
        return f"{index_name(node.get('lhs'))}{node.op}{index_name(node.get('rhs'))}"
    return node.name or ""


def number(x: float) -> str:
    """A number without exponent, whole ones without a point."""
    if x == int(x) and abs(x) < 1e15:
        return str(int(x))
    text = f"{x:.15g}"
    if "e" in text:
        text = f"{x:.340f}".rstrip("0").rstrip(".") if abs(x) < 1 else f"{x:.0f}"
    return text


def node_rows(node: Node, model_id: str, eq: str) -> list[tuple]:
    """Rows of NODE_SCHEMA; last_id is the last node below each, as ids are in pre-order."""
    rows, kids = below(node)
    digests, last = canons(node), list(range(1, len(rows) + 1))
    for i in range(len(rows) - 1, -1, -1):
        if kids[i]:
            last[i] = last[kids[i][-1]]
    return [
        (model_id, eq, i, up, s, k, level, x.kind, x.name, x.op, x.value if isinstance(x.value, float) else None, x.value if isinstance(x.value, str) else None, x.brackets, [index_name(d) for d in x.dims], digests[i - 1], _short(digests[i - 1]), last[i - 1])
        for i, up, s, k, level, x in rows
    ]


def from_rows(rows: list) -> Node:
    """The tree of one equation's rows, in any order."""
    rows = sorted(rows, key=lambda r: r["node_id"])
    parts: dict[int, list] = {r["node_id"]: [] for r in rows}
    for r in reversed(rows):  # children before parents
        own = tuple((s, x) for _, s, x in sorted(parts[r["node_id"]], key=lambda p: p[0]))
        value = r["num_value"] if r["num_value"] is not None else r["text_value"]
        out = Node(r["node_type"], name=r["name"], op=r["op"], value=value, brackets=bool(r["brackets"]), parts=own)
        if r["parent_id"] in parts:
            parts[r["parent_id"]].append((r["ord"], r["slot"], out))
    return out
