"""The print form: short, one line, for reading."""

from __future__ import annotations

from ...nodes import Node, index_name, left_spine, number

WIDTH = 50


def cut(text: str, width: int | None) -> str:
    return text if width is None or len(text) <= width else text[:width] + "..."


def dims_text(node: Node, left: str = "[", right: str = "]") -> str:
    items = node.dims
    return left + ",".join(index_name(d) for d in items) + right if items else ""


def as_text(node: Node, width: int | None = WIDTH) -> str:
    """Expressions and sums are cut at `width` characters, with dots."""
    k = node.kind
    if k == "constant":
        return node.value if isinstance(node.value, str) else number(node.value)
    if k == "dims":
        return dims_text(node)
    if k == "set":
        return f"set: {node.name}"
    if k == "expression":
        first, outer = left_spine(node)
        return cut("".join([as_text(first, None), *(f" {x.op} {as_text(x.get('rhs'), None)}" for x in outer)]), width)
    if k == "unary":
        return f"{node.op}({as_text(node.get('rhs'))})"
    if k == "when":
        return f"if ({as_text(node.get('condition'))}) {{{as_text(node.get('then'))}}}"
    if k in ("sum", "prod"):
        text = f"{k}({as_text(node.get('index'), None)}, {as_text(node.get('value'), None)})"
        return cut(text, width) if k == "sum" else text
    if k == "func":
        parts = ([node.get("index")] if node.get("index") else []) + node.all("value")
        return f"{node.name}({', '.join(as_text(x, None) for x in parts)})"
    if k == "where":
        return as_text(node.get("content"), width)
    if k == "equation":
        return f"{as_text(node.get('lhs'))} {node.op} {as_text(node.get('rhs'))}"
    return (node.name or "") + dims_text(node)


def show(node: Node) -> str:
    """Some lines about a node, its parts below it."""
    out, todo = [], [(0, node)]
    while todo:
        indent, x = todo.pop()
        lines, below = ([x], []) if isinstance(x, str) else _shown(x)
        out += [" " * indent + line for line in lines]
        for slot, child in reversed(below):
            todo += [(indent + 4, child), (indent + 2, f"{slot}:")]
    return "\n".join(out)


def _shown(node: Node) -> tuple[list[str], list[tuple[str, Node]]]:
    """(a node's own lines, the parts that are shown below them)."""
    k = node.kind
    if k == "equation":
        domain = [f"  domain:  {as_text(node.get('domain'))}"] if node.get("domain") else []
        return [f"<AST equation> {node.name}", *domain, f"  relation:  {node.op}", f"  lhs:  {as_text(node.get('lhs'))}", f"  rhs:  {as_text(node.get('rhs'))}"], []
    if k in ("sum", "prod"):
        return [f"<AST {k}> {as_text(node.get('index'))}", f"  value:  {as_text(node.get('value'))}"], []
    if k == "where":
        return [f"<AST where> {node.name}", f"content:  {as_text(node.get('content'))}"], []
    if k == "func":
        index = node.get("index")
        return ["<func>", f"  name:    {node.name}", *([f"  index:  {as_text(index)}"] if index else []), *(f"  value:  {as_text(v)}" for v in node.all("value"))], []
    if k == "dims":
        return ["<AST dims>", dims_text(node)], []
    head = f"<AST {k}> {node.op or node.name or (as_text(node) if k == 'constant' else '')}".rstrip()
    if k in ("expression", "unary", "when"):
        return [head], list(node.parts)
    return [head, *([f"  dims:  {dims_text(node)}"] if node.dims else [])], []


def show_model(model) -> str:
    """Name and counts of a model."""
    head = [f"Model: {model.name}", *(f"{k.capitalize()}: {v}" for k, v in model.extra.items())]
    counts = [(f"{k.capitalize()}s", len(model.of(k))) for k in ("set", "mapping")] + [("Aliases", len(model.aliases))] + [(f"{k.capitalize()}s", len(model.of(k))) for k in ("parameter", "variable")] + [("Equations", len(model.equations))]
    return "\n".join(head + [f"{k}: {n}" for k, n in counts])
