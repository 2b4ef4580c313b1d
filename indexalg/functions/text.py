"""Scalar text functions, as Columns.

Everything here is built of Spark's own string functions and runs in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs of operators in LaTeX.
LATEX_OPERATORS = {
    "*": " \\cdot ", "/": " \\div ", "+": " + ", "-": " - ", "^": " ^ ", "**": " ^ ",
    "=": " = ", "==": " = ", "eq": " = ", "EQ": " = ",
    "<=": " \\leq ", "LE": " \\leq ", "le": " \\leq ", ">=": " \\geq ", "GE": " \\geq ", "ge": " \\geq ",
    "<": " < ", "LT": " < ", "lt": " < ", ">": " > ", "GT": " > ", "gt": " > ",
    "!=": " \\neq ", "<>": " \\neq ", "ne": " \\neq ", "NE": " \\neq ",
    "and": " \\land ", "AND": " \\land ", "or": " \\lor ", "OR": " \\lor ",
    "!": " \\lnot ", "not": " \\lnot ", "NOT": " \\lnot ",
    "&": " \\land ", "|": " \\lor ",
}
#: Opening and closing signs.
PAIRS = {"[": "[]", "]": "[]", "{": "{}", "}": "{}", "(": "()", ")": "()", "<": "<>", ">": "<>"}

#: What stands for parts of a formula in the rough printed width, in this order; $2 is the second group.
LATEX_WIDTHS = (
    (r"\\text(normal|bf|it)?\{([^}]*)\}", "$2"),
    (r"\\math(it|bf|sf|cal)\{([^}]*)\}", "$2"),
    (r"_\{[^}]*\}", "~~"),
    (r"\\frac\{[^}]*\}\{[^}]*\}", "~~~~~~"),
    (r"\\sum(_\{[^}]*\})?", "~~~~~"),
    (r"\\prod(_\{[^}]*\})?", "~~~~~"),
    (r"\\[a-zA-Z]+", ""),
)
#: Scores below which brackets have a size, what does not count, and what operators, line breaks and sums count.
BRACKET_SIZES, LARGEST = ((30, ""), (60, "\\big"), (90, "\\Big"), (130, "\\bigg")), "\\Bigg"
NOT_COUNTED, COUNTED_OPERATORS = r"\\[a-zA-Z]+|\{|\}|\s+", r"\+|\-|\\cdot|\\sum|\\prod|\\frac"
PER_OPERATOR, PER_BREAK, PER_SUM = 5, 10, 10


def is_special(c: Column) -> Column:
    """Only punctuation, at least one."""
    return c.rlike(r"^\p{Punct}+$")


def is_word(c: Column) -> Column:
    return c.rlike(r"^[a-zA-Z]+$")


def is_word_num(c: Column) -> Column:
    return c.rlike(r"^[a-zA-Z0-9_]+$")


def is_associative(op: Column) -> Column:
    return op.isin("+", "*", "and", "or", "&", "|")


def brackets_pair(c: Column) -> Column:
    """(open, close) of one or two signs; null for none; longer texts raise an error."""
    close = F.create_map(*(F.lit(x) for k, v in PAIRS.items() for x in (k, v)))
    one = F.coalesce(F.try_element_at(close, c), F.concat(c, c))
    both = F.when(F.char_length(c) == 2, c).when(F.char_length(c) == 1, one).otherwise(F.raise_error(F.lit("brackets have one or two characters")).cast("string"))
    return F.when(c.isNull() | (c == ""), F.lit(None)).otherwise(F.struct(F.substring(both, 1, 1).alias("open"), F.substring(both, 2, 1).alias("close")))


def wrap_brackets(c: Column, brackets: Column) -> Column:
    """Empty and null texts stay as they are, as do texts without brackets."""
    pair = brackets_pair(brackets)
    return F.when(c.isNull() | (c == "") | pair.isNull(), c).otherwise(F.concat(pair["open"], c, pair["close"]))


def clean_operators(c: Column) -> Column:
    """`*+` to `*`, `++` to `+`, blanks to one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\*\s*\+", "*"), r"\+\s*\+", "+"), r"\s+", " "))


def escape_latex(c: Column) -> Column:
    """Special signs for text mode; the braces of the backslash's own replacement are escaped too."""
    c = F.regexp_replace(c, r"\\", r"\\textbackslash{}")
    c = F.regexp_replace(c, r"([#$%&_{}])", r"\\$1")
    return F.regexp_replace(F.regexp_replace(c, "~", r"\\textasciitilde{}"), r"\^", r"\\textasciicircum{}")


def latex_text(c: Column, math: bool = False, bold: bool = False, italic: bool = False) -> Column:
    """Escaped and styled; split at the first of <= >= == into a relation, if there is just one."""

    def styled(x: Column) -> Column:
        x = F.regexp_replace(F.regexp_replace(x, r"\\", r"\\textbackslash{}"), r"([#%&$_{}])", r"\\$1")
        x = F.concat(F.lit("\\textbf{"), x, F.lit("}")) if bold else x
        return F.concat(F.lit("\\textit{"), x, F.lit("}")) if italic else x

    parts, found = F.split(c, "<=|>=|=="), F.regexp_extract(c, "(<=|>=|==)", 1)
    sign = F.when(found == "<=", F.lit("\\le")).when(found == ">=", F.lit("\\ge")).otherwise(F.lit("="))
    left, right = styled(F.trim(F.get(parts, F.lit(0)))), styled(F.trim(F.get(parts, F.lit(1))))
    dollar = F.lit("$")
    relation = F.concat(dollar, left, F.lit(" "), sign, F.lit(" "), right, dollar) if math else F.concat(left, F.lit(" $"), sign, F.lit("$ "), right)
    plain = F.concat(dollar, styled(c), dollar) if math else styled(c)
    return F.when((F.size(parts) == 2) & (F.get(parts, F.lit(1)) != ""), relation).otherwise(plain)


def latex_length(c: Column) -> Column:
    """Rough printed width; subscripts count 2 before sums count 5. Null and empty: 0."""
    for pattern, by in LATEX_WIDTHS:
        c = F.regexp_replace(c, pattern, by)
    return F.coalesce(F.char_length(c), F.lit(0))


def latex_bracket_size(content: Column, context: Column | None = None) -> Column:
    """The size command for brackets around `content`: by characters, operators and line breaks."""
    score = F.char_length(F.regexp_replace(content, NOT_COUNTED, "")) + PER_OPERATOR * F.regexp_count(content, F.lit(COUNTED_OPERATORS)) + PER_BREAK * F.regexp_count(content, F.lit(r"\\\\"))
    if context is not None:
        score = score + F.when(context.isin("sum", "prod"), PER_SUM).otherwise(0)
    return F.coalesce(*(F.when(score < limit, F.lit(size)) for limit, size in BRACKET_SIZES), F.lit(LARGEST))


def latex_math_brackets(content: Column, context: Column | None = None) -> Column:
    size = latex_bracket_size(content, context)
    return F.struct(F.when(size == "", "[").otherwise(F.concat(size, F.lit("l["))).alias("open"), F.when(size == "", "]").otherwise(F.concat(size, F.lit("r]"))).alias("close"))


def latex_wrap_brackets(c: Column, brackets: str | None = None, math: bool = False, autosize: bool = True) -> Column:
    if math:
        pair = latex_math_brackets(c) if autosize else latex_math_brackets(F.lit(""))
        return F.concat(pair["open"], F.lit(" "), c, F.lit(" "), pair["close"])
    if not brackets:
        return c
    left, right = PAIRS[brackets[0]]
    if left == "<":
        raise ValueError(f"unsupported brackets {brackets!r}")
    escape = "\\" if left == "{" and autosize else ""
    return F.concat(F.lit(("\\left" if autosize else "") + escape + left), c, F.lit(("\\right" if autosize else "") + escape + right))


def mapping_placeholders(c: Column, symbol: str = "\\psi") -> Column:
    """\\texttt{mN} and \\mathsf{mN} as a symbol with subscript N, for any N."""
    return F.regexp_replace(c, r"\\(?:texttt|mathsf)\{m([1-9][0-9]*)\}", symbol.replace("\\", "\\\\") + "_{$1}")


def with_dims(name: Column, dims: Column, show: bool = True) -> Column:
    return F.when(F.size(dims) > 0, F.concat(name, F.lit("["), F.array_join(dims, ","), F.lit("]"))).otherwise(name) if show else name


def format_index(dims: Column) -> Column:
    return F.when(F.size(dims) > 0, F.concat(F.lit("_{"), F.array_join(dims, ","), F.lit("}"))).otherwise("")


def math_environments(names: Column, end: bool = False) -> Column:
    """\\begin lines of nested environments, or their \\end lines in reverse."""
    word = "\\end{" if end else "\\begin{"
    lines = F.transform(F.reverse(names) if end else names, lambda x: F.concat(F.lit(word), x, F.lit("}")))
    return F.coalesce(F.array_join(lines, "\n"), F.lit(""))


def collapse_semicolons(c: Column) -> Column:
    return F.regexp_replace(c, ";+", ";")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


def round_brackets(c: Column) -> Column:
    return F.translate(c, "{}[]", "()()")


def tight_commas(c: Column) -> Column:
    """No blanks around commas that have one after them."""
    return F.regexp_replace(c, r"\s*,\s+", ",")


def drop_data_blocks(c: Column) -> Column:
    """Without the data between slashes."""
    return F.regexp_replace(c, r"(?s)/.*?/\s*", " ")


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `x`, which is computed once however often, and in whatever loop, the body names it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def _marked(c: Column, marks: str) -> Column:
    """(mark, at, level) of each of the signs in a character class, in order: its place from 0 and the level of parentheses before it, never below 0.

    The text falls apart once; what is folded are its marks, not its characters.
    """
    pieces, found = F.split(c, marks), F.regexp_extract_all(c, F.lit(f"({marks})"), F.lit(1))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("level"), F.array().cast("array<struct<mark:string,at:int,level:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        mark, at = x["mark"], acc["at"] + F.coalesce(x["size"], F.lit(0))
        level = F.when(mark == "(", acc["level"] + 1).when(mark == ")", F.greatest(acc["level"] - 1, F.lit(0))).otherwise(acc["level"])
        one = F.struct(mark.alias("mark"), at.cast("int").alias("at"), acc["level"].cast("int").alias("level"))
        # of a text without marks there is a null in the longer list
        out = F.when(mark.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(one)))
        return F.struct((at + 1).cast("int").alias("at"), level.cast("int").alias("level"), out.alias("out"))

    pairs = F.zip_with(found, pieces, lambda m, p: F.struct(m.alias("mark"), F.char_length(p).alias("size")))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def paren_levels(c: Column) -> Column:
    """The level of every character; a parenthesis has that outside it; closing ones never go below 0."""

    def runs(marks: Column) -> Column:
        # each run of characters up to a mark, then the mark; what follows the last
        one = lambda m, k: F.concat(F.array_repeat(m["level"], m["at"] - F.when(k == 0, F.lit(0)).otherwise(F.get(marks, k - 1)["at"] + 1)), F.array(F.when(m["mark"] == ")", F.greatest(m["level"] - 1, F.lit(0))).otherwise(m["level"])))
        end = F.when(F.size(marks) == 0, F.lit(0)).otherwise(F.get(marks, F.size(marks) - 1)["at"] + 1)
        return F.concat(F.flatten(F.transform(marks, one)), F.array_repeat(final_paren_level(c), F.char_length(c) - end).cast("array<int>"))

    return _let(_marked(c, "[()]"), runs)


def final_paren_level(c: Column) -> Column:
    """The level after the last character, by the same rule, without keeping the others."""

    def step(acc: Column, ch: Column) -> Column:
        return F.when(ch == "(", acc + 1).when(ch == ")", F.greatest(acc - 1, F.lit(0))).otherwise(acc)

    return F.aggregate(F.split(F.regexp_replace(c, "[^()]", ""), ""), F.lit(0), step)


def split_top_level(c: Column, mark: str) -> Column:
    """Parts between occurrences of a one-character mark outside all parentheses, as an array."""

    def parts(x: Column) -> Column:
        text, cuts = x["text"], x["cuts"]
        return F.transform(cuts, lambda end, k: _between(text, F.when(k == 0, F.lit(-1)).otherwise(F.get(cuts, k - 1)), end))

    def bound(text: Column) -> Column:
        found = F.filter(_marked(text, f"[(){re.escape(mark)}]"), lambda m: (m["mark"] == mark) & (m["level"] == 0))
        cuts = F.concat(F.transform(found, lambda m: m["at"]), F.array(F.char_length(text)))
        return _let(F.struct(text.alias("text"), cuts.alias("cuts")), parts)

    return F.when(c.isNotNull(), _let(c, bound))


def _between(text: Column, start: Column, end: Column) -> Column:
    """The characters after one place and before another, places from 0."""
    return F.substr(text, start + 2, end - start - 1)


def split_top_level_dollar(c: Column) -> Column:
    """(left, right) of the first `$` outside parentheses; null if there is none."""
    return _first_and_rest(split_top_level(c, "$"), "$", "left", "right")


def _first_and_rest(parts: Column, mark: str, first: str, rest: str) -> Column:
    def pair(x: Column) -> Column:
        return F.when(F.size(x) > 1, F.struct(F.trim(F.get(x, F.lit(0))).alias(first), F.trim(F.array_join(F.slice(x, F.lit(2), F.size(x)), mark)).alias(rest)))

    return _let(parts, pair)


def split_indexed(c: Column, name: str) -> Column:
    """(index, value) of `name(index, value)`; null for other text."""
    inside = F.regexp_extract(c, rf"(?is)^\s*{name}\s*\((.*)\)\s*$", 1)
    return _first_and_rest(split_top_level(inside, ","), ",", "index", "value")


def split_top_level_args(c: Column) -> Column:
    return F.transform(split_top_level(c, ","), lambda x: F.trim(x))


def is_expression(c: Column) -> Column:
    """Whether an operator stands outside all parentheses, outer ones stripped. Null and empty: no."""
    outer = F.regexp_replace(c, r"^\s*\((.*)\)\s*$", "$1")
    balanced = final_paren_level(outer) == 0
    text = F.when(c.rlike(r"^\s*\(.*\)\s*$") & balanced & ~outer.rlike(r"^[^(]*\)"), outer).otherwise(c)

    def top(x: Column) -> Column:
        text, marks = x["text"], x["marks"]
        # what stands at level 0 before each mark, and after the last
        before = lambda m, k: F.when(m["level"] == 0, _between(text, F.when(k == 0, F.lit(-1)).otherwise(F.get(marks, k - 1)["at"]), m["at"])).otherwise("")
        last = F.when(F.size(marks) == 0, F.lit(-1)).otherwise(F.get(marks, F.size(marks) - 1)["at"])
        after = F.when(final_paren_level(text) == 0, _between(text, last, F.char_length(text))).otherwise("")
        return F.concat(F.array_join(F.transform(marks, before), ""), after)

    outside = _let(text, lambda t: _let(F.struct(t.alias("text"), _marked(t, "[()]").alias("marks")), top))
    return F.coalesce(outside.rlike(r"[-+*/^<>=]|(?i)\b(and|or|not|lt|le|eq|ne|ge|gt)\b"), F.lit(False))
