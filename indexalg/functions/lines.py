"""Operations on tables of text lines (keys..., line_no, line).

Order-dependent ones use windows per key (a model, a file), which Spark sorts
and spills; there is no window over the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.reader import DECLARATIONS, VARIABLE_TYPES
from .text import round_brackets, squeeze, tight_commas

_WORDS = "|".join(DECLARATIONS)
_TYPES = "|".join(VARIABLE_TYPES)


def _running(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def drop_comments(lines: DataFrame) -> DataFrame:
    """Without lines that begin with `*`."""
    return lines.where(~F.col("line").startswith("*"))


def drop_directives(lines: DataFrame, word: str = "") -> DataFrame:
    """Without lines that begin with `$`, or with one directive."""
    return lines.where(~F.col("line").rlike(rf"(?i)^\s*\${word}\b" if word else r"^\s*\$"))


def drop_blocks(lines: DataFrame, keys: list[str], order: list[str], opens: Column, closes: Column) -> DataFrame:
    """Without rows from one that opens a block to the next that closes it; an unclosed block reaches to its key's end. Closing without opening drops that row only."""
    flag = F.when(opens, F.lit(True)).when(closes, F.lit(False))
    inside = F.coalesce(F.last(flag, ignorenulls=True).over(_running(keys, order)), F.lit(False))
    return lines.withColumn("inside_block", inside | F.coalesce(closes, F.lit(False))).where(~F.col("inside_block")).drop("inside_block")


def drop_text_blocks(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Without $ontext ... $offtext."""
    return drop_blocks(lines, keys, order, F.col("line").rlike(r"(?i)^\s*\$ontext\b"), F.col("line").rlike(r"(?i)^\s*\$offtext\b"))


def unmatched_closings(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of $offtext without an $ontext before it."""
    opens, closes = F.col("line").rlike(r"(?i)^\s*\$ontext\b"), F.col("line").rlike(r"(?i)^\s*\$offtext\b")
    before = F.last(F.when(opens, True).when(closes, False), ignorenulls=True).over(_running(keys, order).rowsBetween(Window.unboundedPreceding, -1))
    return lines.withColumn("opened", F.coalesce(before, F.lit(False))).where(closes & ~F.col("opened")).drop("opened")


def drop_blank(lines: DataFrame) -> DataFrame:
    return lines.where(F.trim("line") != "")


def split_lines(lines: DataFrame, pattern: str, position: str = "both", ignore_case: bool = False) -> DataFrame:
    """A row for each part, with sub_no: cut before, after or around matches of a pattern, which are kept; parts are trimmed."""
    found = ("(?i)" if ignore_case else "") + f"({pattern})"
    by = {"before": "\u0001$1", "after": "$1\u0001", "both": "\u0001$1\u0001"}[position]
    parts = F.split(F.regexp_replace("line", found, by), "\u0001")
    others = [c for c in lines.columns if c not in ("line", "sub_no")]
    return lines.select(*others, F.posexplode(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")).alias("sub_no", "line"))


def canonical(c: Column) -> Column:
    """One blank, round brackets, tight commas."""
    return tight_commas(round_brackets(squeeze(c)))


def statements(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, statement_no, statement: lines joined and cut at semicolons.

    A statement's number counts the semicolons before it, by a running sum per
    key; a declaration at the start of a line begins a new one too.
    """
    begins = F.col("line").rlike(rf"(?i)^\s*(({_TYPES})\s+)?({_WORDS})\b")
    parts = lines.select(*keys, *order, begins.alias("begins"), F.posexplode(F.split("line", ";")).alias("part_no", "part"))
    new = F.when((F.col("part_no") > 0) | F.col("begins"), 1).otherwise(0)
    numbered = parts.withColumn("statement_no", F.sum(new).over(_running(keys, [*order, "part_no"])))
    joined = numbered.groupBy(*keys, "statement_no").agg(F.array_sort(F.collect_list(F.struct(*order, "part_no", "part"))).alias("parts"))
    text = F.trim(F.array_join(F.transform("parts", lambda x: x["part"]), "\n"))
    return joined.select(*keys, "statement_no", text.alias("statement")).where("statement <> ''")


def declaration_of(c: Column) -> Column:
    """(vtype, word) a statement or line begins with; null if it declares nothing."""
    word = F.lower(F.regexp_extract(c, rf"(?i)^\s*(?:(?:{_TYPES})\s+)?({_WORDS})\b", 1))
    vtype = F.lower(F.regexp_extract(c, rf"(?i)^\s*({_TYPES})\s+(?:{_WORDS})\b", 1))
    singular = F.regexp_replace(word, "^(alias)es$|^(\\w+?)s$", "$1$2")
    return F.when(word != "", F.struct(F.nullif(vtype, F.lit("")).alias("vtype"), F.when(word == "alias", word).otherwise(singular).alias("word")))


def declared_modes(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """With `mode`: the declaration a line stands in, that is the last opened one with no semicolon since."""
    word = declaration_of(F.col("line"))["word"]
    flag = F.when(word.isNotNull(), word).when(F.lag(F.col("line").contains(";")).over(Window.partitionBy(*keys).orderBy(*order)), F.lit(""))
    return lines.withColumn("mode", F.nullif(F.last(flag, ignorenulls=True).over(_running(keys, order)), F.lit("")))


def declared_symbol(c: Column) -> Column:
    """name, dims, descr of a row `name(dims) description /data/`."""
    text = F.regexp_replace(F.regexp_replace(c, "(?s)/.*$", ""), ";", "")
    name = F.regexp_extract(text, r"^\s*([A-Za-z_]\w*)", 1)
    dims = F.regexp_extract(text, r"^\s*[A-Za-z_]\w*\s*\(([^()]*)\)", 1)
    descr = F.trim(F.regexp_replace(text, r"^\s*[A-Za-z_]\w*\s*(\([^()]*\))?", ""))
    return F.when(name != "", F.struct(name.alias("name"), F.filter(F.transform(F.split(dims, ","), lambda x: F.trim(x)), lambda x: x != "").alias("dims"), F.nullif(descr, F.lit("")).alias("descr")))


def symbol_kind(mode: Column, dims: Column) -> Column:
    """A set with dimensions is a mapping, a scalar a parameter without."""
    return F.when((mode == "set") & (F.size(dims) > 0), "mapping").when(mode.isin("scalar", "table"), "parameter").otherwise(mode)


def alias_groups(c: Column) -> Column:
    """All (a, b, ...) of at least two names, as an array of arrays."""
    groups = F.transform(F.regexp_extract_all(c, F.lit(r"\(([^()]*)\)"), 1), lambda g: F.transform(F.split(g, ","), lambda x: F.trim(x)))
    return F.filter(groups, lambda g: F.size(g) > 1)


def equation_header(c: Column) -> Column:
    """name, dims, condition of `name(dims)$condition .. body`, and body; null for other text."""
    pattern = r"(?s)^\s*([A-Za-z_]\w*)\s*(?:\(([^()]*)\))?\s*(?:\$(.*?))?\s*\.\.\s*(.*)$"
    name = F.regexp_extract(c, pattern, 1)
    dims = F.filter(F.transform(F.split(F.regexp_extract(c, pattern, 2), ","), F.trim), lambda x: x != "")
    return F.when(name != "", F.struct(name.alias("name"), dims.alias("dims"), F.nullif(F.trim(F.regexp_extract(c, pattern, 3)), F.lit("")).alias("condition"), F.trim(F.regexp_extract(c, pattern, 4)).alias("body")))


def attach_bodies(declared: DataFrame, bodies: DataFrame, keys: list[str], strict: bool = True) -> DataFrame:
    """Declarations (keys, name, ...) with bodies (keys, name, body): strictly only declared names, else all of both."""
    return declared.join(bodies, [*keys, "name"], "left" if strict else "full")
