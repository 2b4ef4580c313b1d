"""Trees as Julia/JuMP code."""

from __future__ import annotations

from collections import deque

from ...nodes import Node, index_name, left_spine, number

#: Spellings of operators.
SPELLINGS = {"<>": "!=", "=": "==", "**": "^", "and": "&&", "&": "&&", "or": "||", "|": "||", "not": "!", "lt": "<", "le": "<=", "eq": "==", "ne": "!=", "ge": ">=", "gt": ">"}
REDUCERS = {"sum": "sum", "prod": "prod", "smin": "minimum", "smax": "maximum", "sand": "all", "sor": "any"}


def _group(node: Node) -> str:
    text = as_jump(node)
    return f"({text})" if node.kind in ("expression", "unary") and (node.brackets or node.kind == "unary") else text


def _over(index: Node) -> str:
    """`(r, y) in mv if condition` of an index."""
    then, condition = (index.get("then"), index.get("condition")) if index.kind == "when" else (index, None)
    names = [index_name(d) for d in then.dims] if then.kind in ("dims", "mapping") else [then.name]
    tuple_text = f"({', '.join(names)})" if len(names) > 1 else names[0]
    if condition is not None and condition.kind == "mapping" and [index_name(d) for d in condition.dims] == names:
        return f"{tuple_text} in {condition.name}"
    loops = f"{tuple_text} in {then.name}" if then.kind == "mapping" else ", ".join(f"{n} in {n}" for n in names)
    return loops + (f" if {as_jump(condition)}" if condition is not None else "")


def as_jump(node: Node) -> str:
    k = node.kind
    if k == "constant":
        return f'"{node.value}"' if isinstance(node.value, str) else number(node.value)
    if k == "set":
        return node.name
    if k == "mapping":
        return f"haskey({node.name}, ({', '.join(index_name(d) for d in node.dims)}))"
    if k in ("parameter", "variable", "symbol"):
        return node.name + (f"[{', '.join(index_name(d) for d in node.dims)}]" if node.dims else "")
    if k == "dims":
        return f"({', '.join(index_name(d) for d in node.dims)})"
    if k == "expression":
        first, outer = left_spine(node)
        out = deque([_group(first)])
        for k, x in enumerate(outer):
            if k and outer[k - 1].brackets:
                out.appendleft("(")
                out.append(")")
            out.append(f" {SPELLINGS.get(x.op, x.op)} {_group(x.get('rhs'))}")
        return "".join(out)
    if k == "unary":
        x = node.get("rhs")
        return f"{SPELLINGS.get(node.op, node.op)}{f'({as_jump(x)})' if x.kind == 'expression' else as_jump(x)}"
    if k == "when":
        other = as_jump(node.get("otherwise")) if node.get("otherwise") else "0"
        return f"({as_jump(node.get('condition'))} ? {as_jump(node.get('then'))} : {other})"
    if k in ("sum", "prod") or node.get("index") is not None:
        return f"{REDUCERS[node.name if k == 'func' else k]}({', '.join(as_jump(v) for v in node.all('value'))} for {_over(node.get('index'))})"
    if k == "func":
        if node.name == "card":
            return f"length({as_jump(node.get('value'))})"
        return f"{node.name}({', '.join(as_jump(v) for v in node.all('value'))})"
    if k == "where":
        return as_jump(node.get("content"))
    if k == "equation":
        dims = [index_name(d) for d in node.dims]
        over = ""
        if dims:
            over = f"[{', '.join(f'{d} in {d}' for d in dims)}" + (f"; {as_jump(node.get('domain'))}" if node.get("domain") else "") + "], "
        return f"@constraint(\n  model, {over}\n  {as_jump(node.get('lhs'))} {node.op} {as_jump(node.get('rhs'))}\n);"
    raise ValueError(f"no text for a {k}")


def declaration(s) -> str:
    """A symbol's line."""
    desc = f"  # {s.desc}" if s.desc else ""
    if s.kind == "variable":
        dims = f"[{', '.join(f'{d} in {d}' for d in s.dims)}]" if s.dims else ""
        bound = {"positive": " >= 0", "nonnegative": " >= 0", "negative": " <= 0", "binary": ", Bin", "integer": ", Int"}.get(s.vtype or "", "")
        return f"@variable(model, {s.name}{dims}{bound}){desc}"
    if s.kind == "parameter":
        return f"# Parameter: {s.name}" + (f" - {s.desc}" if s.desc else "")
    return f"{s.name} = []{desc}"
