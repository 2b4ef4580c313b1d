"""Model text to declarations and trees.

read_model() works on one text; read_models() on a table of texts, as tables of
symbols, aliases, equations, tree nodes, data and diagnostics.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..nodes import NODE_SCHEMA, Node, node_rows, walk
from .lexer import ParseError
from .parser import Registry, parse_equation

#: Words that open a declaration, and types of variables.
DECLARATIONS = {"set": "set", "sets": "set", "alias": "alias", "aliases": "alias", "parameter": "parameter", "parameters": "parameter", "scalar": "scalar", "scalars": "scalar", "table": "table", "variable": "variable", "variables": "variable", "equation": "equation", "equations": "equation", "model": "model", "models": "model"}
VARIABLE_TYPES = ("free", "positive", "negative", "binary", "integer", "nonnegative")
_OPEN = re.compile(rf"\s*(?:({'|'.join(VARIABLE_TYPES)})\s+)?({'|'.join(DECLARATIONS)})\b", re.IGNORECASE)
_ENTRY = re.compile(r"\s*,?\s*([A-Za-z_]\w*)\s*(?:[(\[{]([^()\[\]{}]*)[)\]}])?")


@dataclass
class Symbol:
    kind: str
    name: str
    dims: list[str] = field(default_factory=list)
    desc: str | None = None
    vtype: str | None = None
    data: list[tuple] = field(default_factory=list)


@dataclass
class EquationText:
    name: str
    dims: list[str]
    desc: str | None
    domain: str | None = None
    body: str | None = None
    node: Node | None = None


@dataclass
class Model:
    name: str | None
    symbols: list[Symbol] = field(default_factory=list)
    aliases: list[list[str]] = field(default_factory=list)
    equations: list[EquationText] = field(default_factory=list)
    diagnostics: list[tuple[str, str]] = field(default_factory=list)
    extra: dict[str, str] = field(default_factory=dict)

    def of(self, kind: str) -> list[Symbol]:
        return [s for s in self.symbols if s.kind == kind]

    def registry(self) -> Registry:
        names = {k: [s.name for s in self.of(k)] for k in ("variable", "parameter", "mapping", "set")}
        return Registry(names["variable"], names["parameter"], names["mapping"], names["set"], self.aliases)

    def equation(self, name: str) -> Node:
        return next(e.node for e in self.equations if e.name == name)


def decode(raw: bytes) -> str:
    """UTF-8; each run of invalid bytes gives question marks."""
    return raw.decode("utf-8", errors="replace").replace("�", "?")


def expand_includes(lines: list[str], read: Callable[[str], str | None], levels: int = 1) -> tuple[list[str], list[str]]:
    """(lines with `$include file` replaced by the file's lines, missing files). Included lines are looked at again levels - 1 times."""
    out, missing = [], []
    for line in lines:
        found = re.match(r"\s*\$include\b\s*(.*)", line, re.IGNORECASE)
        if not found:
            out.append(line)
            continue
        name = found[1].strip().strip("'\"")
        text = read(name)
        if text is None:
            missing.append(name)
            continue
        more = text.splitlines()
        if levels > 1:
            more, lost = expand_includes(more, read, levels - 1)
            missing += lost
        out += more
    return out, missing


def clean_lines(lines: list[str]) -> list[str]:
    """Without comments in column 1, text blocks (an unclosed one reaches to the end) and `$` directives."""
    out, inside = [], False
    for line in lines:
        word = line.strip().lower()
        if word.startswith("$ontext"):
            inside = True
        elif word.startswith("$offtext"):
            inside = False
        elif not inside and not line.startswith("*") and not word.startswith("$"):
            out.append(line)
    return out


def _statements(text: str) -> Iterator[str]:
    """Parts that end with a semicolon or before a declaration at the start of a line; semicolons in quotes or data don't count."""
    part, quote = [], None
    for line in text.split("\n"):
        if quote is None and "".join(part).strip() and _OPEN.match(line) and ".." not in "".join(part):
            yield "".join(part)
            part = []
        for c in line + "\n":
            if quote:
                quote = None if c == quote or c == "\n" else quote
            elif c in "'\"" and not (part and part[-1].isalpha()):
                quote = c
            if c == ";" and quote is None:
                yield "".join(part)
                part = []
            else:
                part.append(c)
    if "".join(part).strip():
        yield "".join(part)


def _members(text: str, scalar: bool = False) -> list[tuple]:
    """Items between slashes: (keys..., value or nothing); of a scalar one number."""
    out = []
    for item in re.split(r"[,\n]", text):
        words = item.split()
        if not words:
            continue
        span = re.fullmatch(r"([A-Za-z_]*)(\d+)\*\1(\d+)", words[0])
        if span:
            out += [(f"{span[1]}{k:0{len(span[2]) if span[2][0] == '0' else 1}d}",) for k in range(int(span[2]), int(span[3]) + 1)]
            continue
        if len(words) == 1 and re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", words[0]) and scalar:
            out.append((float(words[0]),))
            continue
        keys = tuple(k.strip("'\"") for k in words[0].split("."))
        try:
            out.append((*keys, float(words[1])) if len(words) > 1 else keys)
        except ValueError:
            out.append(keys)
    return out


def _entries(text: str, scalar: bool = False) -> Iterator[tuple[str, list[str], str | None, list[tuple]]]:
    """(name, dims, description, data) of a declaration's lines."""
    data: dict[str, list[tuple]] = {}

    def keep(found: re.Match) -> str:
        key = f"\0{len(data)}\0"
        data[key] = _members(found[1], scalar)
        return key

    for line in re.sub(r"/([^/]*)/", keep, text).split("\n"):
        at = 0
        while found := _ENTRY.match(line, at):
            rest = line[found.end() :]
            again = re.match(r"(?:[^\0]*?\0\d+\0|\s*(?:'[^']*'|\"[^\"]*\")?)\s*,", rest)
            desc = rest[: again.end() - 1] if again else rest
            at = found.end() + (again.end() - 1 if again else len(rest))
            values = [row for key in re.findall(r"\0\d+\0", desc) for row in data[key]]
            desc = re.sub(r"\0\d+\0", "", desc).strip().strip("'\"").strip()
            yield found[1], [d.strip() for d in (found[2] or "").split(",") if d.strip()], desc or None, values
            if not again:
                break


def _table(text: str) -> tuple[str, list[str], str | None, list[tuple]]:
    """A two-way table: the header's words are the last key, by order."""
    lines = [x for x in text.split("\n") if x.strip()]
    name, dims, desc, _ = next(_entries(lines[0]))
    columns = lines[1].split() if len(lines) > 1 else []
    where = [(m.start() + m.end()) / 2 for m in re.finditer(r"\S+", lines[1])] if columns else []
    rows = []
    for line in lines[2:]:
        words = list(re.finditer(r"\S+", line))
        for m in words[1:]:
            k = min(range(len(where)), key=lambda i: abs(where[i] - (m.start() + m.end()) / 2))
            rows.append((*words[0][0].split("."), columns[k], float(m[0])))
    return name, dims, desc, rows


def _top_level(text: str, mark: str) -> int:
    """Where `mark` first stands outside parentheses; -1 if nowhere."""
    level = 0
    for k, c in enumerate(text):
        level = level + 1 if c in "([{" else max(level - 1, 0) if c in ")]}" else level
        if level == 0 and text.startswith(mark, k):
            return k
    return -1


def equation_header(text: str) -> tuple[str, list[str], str | None] | None:
    """(name, dims, condition) of `name(dims)$condition`; None if it is no header."""
    text = text.strip()
    k = _top_level(text, "$")
    head, condition = (text, None) if k < 0 else (text[:k], text[k + 1 :].strip())
    found = re.fullmatch(r"([A-Za-z_]\w*)\s*(?:\(([^()]*)\))?\s*", head.translate(str.maketrans("{}[]", "()()")))
    return (found[1], [d.strip() for d in (found[2] or "").split(",") if d.strip()], condition) if found else None


def read_model(text: str, name: str | None = None, include: Callable[[str], str | None] | None = None, strict: bool = True, levels: int = 1, **extra: str) -> Model:
    """Declarations and equations of a model's text.

    `include` gives the text of an included file, or None; without it include
    lines are dropped. strict leaves out bodies of equations that are not
    declared, else they declare themselves. What is left out, cannot be parsed
    or has no body is told in `diagnostics`, and hinders nothing else.
    """
    model = Model(name, extra=extra)
    lines = text.split("\n")
    if include:
        lines, missing = expand_includes(lines, include, levels)
        model.diagnostics += [("include", f"missing file {m}") for m in missing]
    equations: dict[str, EquationText] = {}
    for statement in _statements("\n".join(clean_lines(lines))):
        opened = _OPEN.match(statement)
        k = statement.find("..")
        if k >= 0 and not (opened and "\n" in statement[:k].strip()) and (header := equation_header(statement[:k])):
            own, dims, condition = header
            body = re.sub(r"\s+", " ", statement[k + 2 :].translate(str.maketrans("{}[]", "()()"))).strip()
            if own not in equations:
                if strict:
                    model.diagnostics.append((own, "body of an undeclared equation"))
                    continue
                equations[own] = EquationText(own, dims, None)
            if condition is not None:
                condition = re.sub(r"\s+", " ", condition)
            equations[own].domain, equations[own].body = condition, re.sub(r"\s*,\s+", ",", body)
            equations[own].dims = equations[own].dims or dims
            continue
        if not opened:
            if statement.strip():
                model.diagnostics.append(("", f"statement left out: {statement.strip()[:60]}"))
            continue
        kind, rest = DECLARATIONS[opened[2].lower()], statement[opened.end() :]
        vtype = opened[1].lower() if opened[1] else None
        if kind == "alias":
            model.aliases += [g for g in ([x.strip() for x in m.split(",") if x.strip()] for m in re.findall(r"\(([^()]*)\)", rest)) if len(g) > 1]
        elif kind == "table":
            own, dims, desc, data = _table(rest)
            model.symbols.append(Symbol("parameter", own, dims, desc, data=data))
        elif kind == "equation":
            for own, dims, desc, _ in _entries(rest):
                equations[own] = EquationText(own, dims, desc)
        elif kind != "model":
            for own, dims, desc, data in _entries(rest, kind == "scalar"):
                what = {"scalar": "parameter", "set": "mapping" if dims else "set"}.get(kind, kind)
                model.symbols.append(Symbol(what, own, dims, desc, vtype if kind == "variable" else None, data))
    registry = model.registry()
    for e in equations.values():
        if e.body is None:
            model.diagnostics.append((e.name, "declared without a body"))
            continue
        try:
            e.node = parse_equation(e.body, registry, e.name, e.dims, e.domain, e.desc)
        except ParseError as error:
            model.diagnostics.append((e.name, str(error)))
    model.equations = list(equations.values())
    model.diagnostics += [("case", w) for w in dict.fromkeys(registry.warnings)]
    return model


SCHEMAS = {
    "symbols": "model_id string, kind string, name string, descr string, dims array<string>, vtype string, ord int",
    "aliases": "model_id string, group_id int, ord int, member string",
    "equations": "model_id string, name string, descr string, dims array<string>, relation string, domain_text string, body_text string, ord int",
    "ast_nodes": NODE_SCHEMA,
    "named_nodes": NODE_SCHEMA,
    "lengths": "model_id string, eq string, node_id int, latex_length int",
    "data": "model_id string, kind string, name string, keys array<string>, value double",
    "diagnostics": "model_id string, name string, message string",
}


def table_rows(model: Model, model_id: str, table: str) -> list[tuple]:
    """A model's rows of one of SCHEMAS: named_nodes are the trees with their long conditions named, lengths those of conditions in LaTeX."""
    if table == "symbols":
        return [(model_id, s.kind, s.name, s.desc, s.dims, s.vtype, k) for k, s in enumerate(model.symbols, 1)]
    if table == "aliases":
        return [(model_id, g, k, m) for g, group in enumerate(model.aliases, 1) for k, m in enumerate(group, 1)]
    if table == "equations":
        return [(model_id, e.name, e.desc, e.dims, e.node.op if e.node else None, e.domain, e.body, k) for k, e in enumerate(model.equations, 1)]
    if table == "ast_nodes":
        return [r for e in model.equations if e.node for r in node_rows(e.node, model_id, e.name)]
    if table in ("named_nodes", "lengths"):
        from ..plans.render.latex import as_latex
        from ..plans.rewrite import number_conditions

        if table == "named_nodes":
            return [r for e in model.equations if e.node for r in node_rows(number_conditions(e.node, lambda x: len(as_latex(x))), model_id, e.name)]
        return [(model_id, e.name, i, len(as_latex(x))) for e in model.equations if e.node for i, _, slot, *_, x in walk(e.node) if slot == "condition"]
    if table == "data":
        return [(model_id, s.kind, s.name, [str(x) for x in row[: len(s.dims) or (1 if s.kind == "set" else 0)]], float(row[-1]) if isinstance(row[-1], float) else None) for s in model.symbols for row in s.data]
    if table == "diagnostics":
        return [(model_id, n, m) for n, m in model.diagnostics]
    raise ValueError(f"no table {table}")


def read_models(texts: DataFrame, table: str, strict: bool = True) -> DataFrame:
    """One of SCHEMAS for all models of a table (model_id, text); a null text is an empty model.

    Models are parsed where they lie, in Arrow batches; there is no shuffle.
    """
    schema = texts.sparkSession.createDataFrame([], SCHEMAS[table]).schema

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows = [r for m, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in table_rows(read_model(t or "", m, strict=strict), m, table)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return texts.select(F.col("model_id").cast("string"), F.col("text").cast("string")).mapInArrow(parse, schema)


def read_model_files(spark: SparkSession, path: str) -> DataFrame:
    """(model_id, path, text) of text files; invalid bytes give question marks. model_id is the file's name."""
    raw = spark.read.format("binaryFile").load(path)
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\ufffd", "?")
    return raw.select(F.regexp_extract("path", "([^/]*)$", 1).alias("model_id"), "path", text.alias("text"))


def include_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """In bulk: lines (model_id, line_no, line) with `$include` lines replaced by those of files (name, text).

    One level; includes of files that are not there vanish. Lines are numbered
    anew only in order: by (line_no, sub_no).
    """
    name = F.regexp_extract("line", r"(?i)^\s*\$include\s+['\"]?([^'\"]*?)['\"]?\s*$", 1)
    named = lines.withColumn("include_name", F.when(F.col("line").rlike(r"(?i)^\s*\$include\b"), name))
    plain = named.where("include_name IS NULL").select("model_id", "line_no", F.lit(0).alias("sub_no"), "line")
    inner = named.where("include_name IS NOT NULL").join(files.select(F.col("name").alias("include_name"), "text"), "include_name")
    return plain.unionByName(inner.select("model_id", "line_no", F.posexplode(F.split("text", "\n")).alias("sub_no", "line")))
