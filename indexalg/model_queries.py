"""Queries over many models whose names and numbers come from the tables, and SQL that computes the same rows.

There is a model per nation: its symbols carry the nation's key, its first
equation is a sum with a term for each of the nation's parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import lines as L
from .functions import text as T
from .functions.math import apply
from .operators import tree as R
from .plans.render import latex
from .plans.rewrite import SHORT_NAMES
from .queries import Tables, query
from .sources.reader import include_lines, read_models
from .sources.sinks import text_lines

#: `~` stands for the nation's key, #n its name, #g its region's, #r the region's key, #c a number, #t the sum.
TEXT = """set i~ #n;
set j~;
set s;
set q~(i~,j~) pairs;
alias (i~, k~);
parameter p~(i~) #g;
positive variable w~(i~);
variable v~ total;
equations
 e~ sum of #n
 f~(i~)
;
e~.. v~ =e= #t;
f~(i~)$(p~(i~) > #r).. w~(i~) =l= sum(j~$q~(i~,j~), p~(i~)) + v~$(p~(i~) > #c) + w~(i~)$(p~(i~) > #c) + v~$s;
"""


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model_id, text), one per nation."""
    t = Tables(spark, sf_dir)
    parts = t.part.groupBy((F.col("p_partkey") % 25).cast("int").alias("n_nationkey")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_size"))).alias("parts"))
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).join(parts, "n_nationkey")
    key = F.lpad(F.col("n_nationkey").cast("string"), 2, "0")
    total = F.array_join(F.transform("parts", lambda p: F.concat(F.lit("p~(i~) * "), p["p_size"] + 49)), " + ")
    text = F.lit(TEXT)
    for mark, by in (("#t", total), ("#n", F.col("n_name")), ("#g", F.col("r_name")), ("#r", F.col("n_regionkey").cast("string")), ("#c", (F.col("n_nationkey") + 10).cast("string")), ("~", key)):
        text = F.replace(text, F.lit(mark), by)
    return n.select(F.concat(F.lit("m"), key).alias("model_id"), text.alias("text"))


_WITH = """
WITH terms AS (
  SELECT (p_partkey % 25)::INTEGER AS k, row_number() OVER (PARTITION BY p_partkey % 25 ORDER BY p_partkey) AS j, (p_size + 49)::VARCHAR AS c FROM part),
sums AS (SELECT k, count(*) AS n, list(c ORDER BY j) AS cs FROM terms GROUP BY k),
m AS (
  SELECT n_nationkey AS k, lpad(n_nationkey::VARCHAR, 2, '0') AS kk, 'm' || lpad(n_nationkey::VARCHAR, 2, '0') AS model_id, n_name, r_name, n_regionkey, n, cs
  FROM nation JOIN region ON n_regionkey = r_regionkey JOIN sums ON sums.k = n_nationkey)
"""


def _list(lines: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in lines) + "]"


def _lines(parts: str) -> str:
    """SQL for lines given as a list of texts with marks."""
    marks = "x"
    for mark, by in (("#n", "n_name"), ("#l", "replace(n_name, '_', '\\_')"), ("#g", "r_name"), ("#r", "n_regionkey::VARCHAR"), ("#c", "(k + 10)::VARCHAR"), ("~", "kk")):
        marks = f"replace({marks}, '{mark}', {by})"
    return f"{_WITH}, whole AS (SELECT model_id, list_transform({parts}, lambda x: {marks}) AS l FROM m) SELECT model_id, unnest(range(len(l)))::INTEGER AS ord, unnest(l) AS line FROM whole"


_GAMS_HEAD = ["* Model: m~", "", "sets", "i~  #n", "j~", "s", ";", "alias (i~, k~);", "", "sets", "q~[i~,j~]  pairs", ";", "", "parameters", "p~[i~]  #g", ";", "", "positive variables", "w~[i~]", ";", "", "variables", "v~  total", ";", "", "equation e~   sum of #n;", "e~..", "    v~ =e="]
_GAMS_TAIL = [";", "", "equation f~;", "f~[i~]$(p~[i~] > #r)..", "    w~[i~] =l=", "        sum(j~$q~[i~,j~],", "            p~[i~])", "    +", "    (v~)$(p~[i~] > #c)", "    +", "    (w~[i~])$(p~[i~] > #c)", "    +", "    (v~)$s", ";", ""]


@query(_lines(f"{_list(_GAMS_HEAD)} || list_slice(flatten(list_transform(cs, lambda c: ['    +', '    p~[i~]', '    * ' || c])), 2, 3 * n) || {_list(_GAMS_TAIL)}"))
def write_gams_lines(spark, sf_dir):
    """models' texts rendered anew, line by line."""
    return text_lines(models(spark, sf_dir), "gams")


_SUM = "array_to_string(list_transform(cs, lambda c: 'p~[i~] * ' || c), ' + ')"
_JUMP_HEAD = ["i~ = []  # #n", "j~ = []", "s = []", "q~ = []  # pairs", "# Parameter: p~ - #g", "@variable(model, w~[i~ in i~] >= 0)", "@variable(model, v~)  # total", "@constraint(", "  model, "]
_JUMP_TAIL = [");", "@constraint(", "  model, [i~ in i~; p~[i~] > #r], ", "  w~[i~] <= sum(p~[i~] for j~ in j~ if haskey(q~, (i~, j~))) + (p~[i~] > #c ? v~ : 0) + (p~[i~] > #c ? w~[i~] : 0) + (s ? v~ : 0)", ");"]


@query(_lines(f"{_list(_JUMP_HEAD)} || ['  v~ == ' || {_SUM}] || {_list(_JUMP_TAIL)}"))
def write_jump_lines(spark, sf_dir):
    """models in JuMP, line by line."""
    return text_lines(models(spark, sf_dir), "jump")


_PRINT_HEAD = ["Model: m~", "Sets: 3", "Mappings: 1", "Aliases: 1", "Parameters: 1", "Variables: 2", "Equations: 2", "<AST equation> e~", "  relation:  ==", "  lhs:  v~"]
_PRINT_TAIL = ["<AST equation> f~", "  domain:  p~[i~] > #r", "  relation:  <=", "  lhs:  w~[i~]"]


@query(_lines(f"{_list(_PRINT_HEAD)} || ['  rhs:  ' || replace(substr(s, 1, 50) || CASE WHEN length(s) > 50 THEN '...' ELSE '' END, 'p' || kk, 'p~')] || {_list(_PRINT_TAIL)} || ['  rhs:  ' || substr(replace('sum(if (q~[i~,j~]) {{set: j~}}, p~[i~]) + if (p~[i~] > 1', '~', kk), 1, 50) || '...']").replace("FROM m)", f"FROM (SELECT *, replace({_SUM}, '~', kk) AS s FROM m))").replace("{{", "{").replace("}}", "}"))
def print_model(spark, sf_dir):
    """F1, F8: models in print form, cut at 50 characters."""
    return text_lines(models(spark, sf_dir), "print")


_P = "\\mathsf{p~}_{\\text{i~}}"
_LATEX_HEAD = [*latex.PREAMBLE, "", "\\title{Model: m~}", "\\date{\\today}", "\\maketitle", "", "\\section{Sets}", "\\texttt{i~} -- #l", "\\\\", "\\texttt{j~}", "\\\\", "\\texttt{s}", "\\\\", "", "\\section{Aliases}", "\\begin{flushleft}", "\\{\\texttt{i~}, \\texttt{k~}\\}\\\\", "\\end{flushleft}", "", "\\section{Parameters}", f"${_P}$ -- #g\\\\", "", "\\section{Variables}", "$\\bm{\\mathit{w~}}_{\\text{i~}}$\\\\", "$\\bm{\\mathit{v~}}$ -- total\\\\", "", "\\section{Equations}"]
_OPEN = ["\\begin{equation*}", "\\begin{adjustbox}{max width=\\textwidth}", "$\\begin{aligned}"]
_CLOSE = ["\\end{aligned}$", "\\end{adjustbox}", "\\end{equation*}"]
_END = ["\\vspace{1em}", "\\end{flushleft}"]
_F_HEAD = ["\\begin{flushleft}", "\\subsection{\\textbf{f~}} ", "\\quad$\\textbf{f~}_{\\text{i~}}$ ", f"$\\mid\\left\\{{\\text{{i~}}\\right\\}} \\in {_P}  >  #r$ \\\\"]
_F_BODY = f"&\\bm{{\\mathit{{w~}}}}_{{\\text{{i~}}}} \\le \\sum_{{\\text{{j~}} \\in \\psi_{{1}}}} {_P}  +  \\bm{{\\mathit{{v~}}}} \\mid \\psi_{{2}}  +  \\bm{{\\mathit{{w~}}}}_{{\\text{{i~}}}} \\mid \\psi_{{2}}  +  \\bm{{\\mathit{{v~}}}} \\mid \\text{{s}} \\\\"
_WHERE = ["\\texttt{where:} \\\\", "\\begin{multicols}{2}", "$\\psi_{1} = \\mathit{q~}_{\\text{i~},\\text{j~}}$ \\\\", f"$\\psi_{{2}} = {_P}  >  #c$ \\\\", "\\end{multicols}"]
# a line of an aligned sum holds six terms, which are all of the same width; up to six stand beside the left side
_BODY = f"""CASE WHEN n <= 6 THEN ['&\\bm{{\\mathit{{v~}}}} = ' || array_to_string(list_transform(cs, lambda c: '{_P}  \\cdot  ' || c), '  +  ') || ' \\\\']
  ELSE ['&\\bm{{\\mathit{{v~}}}} = \\\\'] || list_transform(range((n + 5) // 6), lambda g: '&\\qquad\\qquad ' || CASE WHEN g > 0 THEN '+ ' ELSE '' END || array_to_string(list_transform(list_slice(cs, 6 * g + 1, 6 * g + 6), lambda c: '{_P}  \\cdot  ' || c), '  +  ') || ' \\\\') END"""
_E_HEAD = ["\\begin{flushleft}", "\\subsection{\\textit{sum of #l}} ", "\\quad$\\textbf{e~}$", *_OPEN]


@query(_lines(f"{_list([*_LATEX_HEAD, *_E_HEAD])} || ({_BODY}) || {_list([*_CLOSE, *_END, '', *_F_HEAD, *_OPEN, _F_BODY, *_CLOSE, *_WHERE, *_END, '', '', latex.ENDING])}"))
def write_latex_lines(spark, sf_dir):
    """models' documents, line by line; long sums over several lines."""
    return text_lines(models(spark, sf_dir), "latex")


_COND = f"{_P}  >  #c"
_MODES = {
    "plain": f"&\\bm{{\\mathit{{w~}}}}_{{\\text{{i~}}}} \\le \\sum_{{\\text{{j~}} \\in \\mathsf{{q~}}_{{\\text{{i~}},\\text{{j~}}}}}} {_P}  +  \\bm{{\\mathit{{v~}}}} \\mid {_COND}  +  \\bm{{\\mathit{{w~}}}}_{{\\text{{i~}}}} \\mid {_COND}  +  \\bm{{\\mathit{{v~}}}} \\mid \\text{{s}} \\\\",
    "indicator": f"&\\bm{{\\mathit{{w~}}}}_{{\\text{{i~}}}} \\le \\sum_{{\\text{{j~}} \\in \\mathsf{{q~}}_{{\\text{{i~}},\\text{{j~}}}}}} {_P}  +  \\bm{{\\mathit{{v~}}}} \\cdot \\mathbf{{1}}_{{{_COND}}}  +  \\bm{{\\mathit{{w~}}}}_{{\\text{{i~}}}} \\cdot \\mathbf{{1}}_{{{_COND}}}  +  \\bm{{\\mathit{{v~}}}} \\cdot \\mathbf{{1}}_{{\\text{{s}}}} \\\\",
}


@query(_lines(_list(list(_MODES.values()))).replace("AS ord, unnest(l) AS line FROM whole", "AS ord, unnest(['plain', 'indicator']) AS mode, unnest(l) AS line FROM whole").replace("SELECT model_id, unnest(range(len(l)))::INTEGER AS ord, ", "SELECT model_id, "))
def latex_modes(spark, sf_dir):
    """conditions written out, and as indicators with a sign of choice."""
    out = None
    for mode, style in (("plain", latex.Style(width=1000)), ("indicator", latex.Style(use_indicator=True, indicator="\\mathbf{1}", width=1000))):
        rows = text_lines(models(spark, sf_dir), "latex", sections=("equations",), substitute=False, date=False, style=style)
        rows = rows.where(F.col("line").contains("\\le ")).select("model_id", F.lit(mode).alias("mode"), "line")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    _WITH
    + """, t AS (SELECT model_id, kk, n, unnest(range(1, n + 1)) AS j, unnest(cs) AS c FROM m),
top AS (
  SELECT model_id, n, unnest(range(1, n)) AS x FROM m)
SELECT model_id, 1 AS node_id, NULL::INTEGER AS parent_id, NULL AS slot, 'equation' AS node_type, 'e' || kk AS name, '==' AS op, NULL::DOUBLE AS num_value, (n + 1 + 5 * n)::INTEGER AS last_id FROM m
UNION ALL SELECT model_id, 2, 1, 'lhs', 'variable', 'v' || kk, NULL, NULL, 2 FROM m
UNION ALL SELECT model_id, (x + 2)::INTEGER, CASE WHEN x = 1 THEN 1 ELSE x + 1 END::INTEGER, CASE WHEN x = 1 THEN 'rhs' ELSE 'lhs' END, 'expression', NULL, '+', NULL, (n + 1 + 5 * (n - x + 1))::INTEGER FROM top
UNION ALL SELECT model_id, (n + 2 + 5 * (j - 1))::INTEGER, CASE WHEN n = 1 THEN 1 WHEN j = 1 THEN n + 1 ELSE n + 3 - j END::INTEGER, CASE WHEN n = 1 THEN 'rhs' WHEN j = 1 THEN 'lhs' ELSE 'rhs' END, 'expression', NULL, '*', NULL, (n + 6 + 5 * (j - 1))::INTEGER FROM t
UNION ALL SELECT model_id, (n + 3 + 5 * (j - 1))::INTEGER, (n + 2 + 5 * (j - 1))::INTEGER, 'lhs', 'parameter', 'p' || kk, NULL, NULL, (n + 5 + 5 * (j - 1))::INTEGER FROM t
UNION ALL SELECT model_id, (n + 4 + 5 * (j - 1))::INTEGER, (n + 3 + 5 * (j - 1))::INTEGER, 'dims', 'dims', NULL, NULL, NULL, (n + 5 + 5 * (j - 1))::INTEGER FROM t
UNION ALL SELECT model_id, (n + 5 + 5 * (j - 1))::INTEGER, (n + 4 + 5 * (j - 1))::INTEGER, 'item', 'set', 'i' || kk, NULL, NULL, (n + 5 + 5 * (j - 1))::INTEGER FROM t
UNION ALL SELECT model_id, (n + 6 + 5 * (j - 1))::INTEGER, (n + 2 + 5 * (j - 1))::INTEGER, 'rhs', 'constant', NULL, NULL, c::DOUBLE, (n + 6 + 5 * (j - 1))::INTEGER FROM t
"""
)
def chain_nodes(spark, sf_dir):
    """Flat sums of many terms as rows of nodes, with the end of each subtree."""
    nodes = read_models(models(spark, sf_dir), "ast_nodes")
    return nodes.where(F.col("eq").startswith("e")).select("model_id", "node_id", "parent_id", "slot", "node_type", "name", "op", "num_value", "last_id")


@query(_WITH + "SELECT model_id, s_name, name FROM m, (VALUES ('s1', 'q'), ('s2', '>'), ('s3', '>')) AS v(s_name, name)")
def slot_elements(spark, sf_dir):
    """Conditions whose LaTeX is long enough to be worth a name; one of a single letter is not."""
    texts = models(spark, sf_dir)
    nodes = read_models(texts, "ast_nodes").join(read_models(texts, "lengths"), ["model_id", "eq", "node_id"], "left")
    found = R.where_candidates(nodes, F.col("latex_length"))
    return found.select("model_id", "s_name", F.when(F.col("node_type") == "mapping", F.substring("name", 1, 1)).otherwise(F.col("op")).alias("name"))


@query(_WITH + "SELECT model_id, name, uses FROM m, (VALUES ('m1', 1), ('m2', 2)) AS v(name, uses)")
def where_names(spark, sf_dir):
    """Named conditions; two that are equal share a name, and the last of a name is the one that is listed."""
    nodes = read_models(models(spark, sf_dir), "named_nodes")
    uses = nodes.where("node_type = 'where'").groupBy("model_id", "eq", "name").agg(F.count("*").cast("int").alias("uses"), F.max("node_id").alias("node_id"))
    return R.where_nodes(nodes).join(uses, ["model_id", "eq", "name", "node_id"]).select("model_id", "name", "uses")


@query("SELECT n_nationkey, n_nationkey <= 20 AS parsed, CASE WHEN n_nationkey > 20 THEN 'nested deeper than 20' END AS message FROM nation")
def nesting_limit(spark, sf_dir):
    """Parentheses as deep as the nation's key."""
    n = Tables(spark, sf_dir).nation
    body = F.concat(F.repeat(F.lit("("), F.col("n_nationkey")), F.lit("a"), F.repeat(F.lit(")"), F.col("n_nationkey")))
    texts = n.select(F.col("n_nationkey").cast("string").alias("model_id"), F.concat(F.lit("parameter a; variable v; equation e; e.. v =e= "), body, F.lit(";")).alias("text"))
    told = read_models(texts, "diagnostics").select("model_id", F.regexp_extract("message", "^[^:]*", 0).alias("message"))
    return texts.join(told, "model_id", "left").select(F.col("model_id").cast("int").alias("n_nationkey"), F.col("message").isNull().alias("parsed"), "message")


@query("SELECT n_nationkey, 'equation e: a side is missing in ' || chr(39) || CASE WHEN n_nationkey % 2 = 0 THEN '=e= 1' ELSE 'v =e=' END || chr(39) AS message FROM nation")
def missing_side(spark, sf_dir):
    """An empty side of an equation."""
    body = F.when(F.col("n_nationkey") % 2 == 0, "=e= 1").otherwise("v =e=")
    texts = Tables(spark, sf_dir).nation.select(F.col("n_nationkey").cast("string").alias("model_id"), F.concat(F.lit("variable v; equation e; e.. "), body, F.lit(";")).alias("text"))
    return read_models(texts, "diagnostics").select(F.col("model_id").cast("int").alias("n_nationkey"), "message")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, event_type, last_value(CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM events) WHERE event_type = 'purchase' AND coalesce(f, 0) = 0")
def unmatched_end(spark, sf_dir):
    """L3: ends of text blocks that were never opened."""
    line = F.when(F.col("event_type") == "click", "$ontext").when(F.col("event_type") == "purchase", " $OffText;").otherwise("text")
    return L.unmatched_closings(Tables(spark, sf_dir).events.withColumn("line", line), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("SELECT conv_id, turn, upper(role) || ' ' || text AS dropped, trim(regexp_replace(role || ' * ' || text, '\\s+', ' ', 'g')) AS cleaned, turn % 4 IN (0, 1) AS associative FROM conversations WHERE text NOT LIKE '%/%' AND text NOT LIKE '%*%' AND text NOT LIKE '%+%'")
def text_cleanup(spark, sf_dir):
    """Data blocks dropped, operators tidied, which operators associate."""
    c = Tables(spark, sf_dir).conversations.where("text NOT LIKE '%/%' AND text NOT LIKE '%*%' AND text NOT LIKE '%+%'")
    block = F.concat(F.upper("role"), F.lit("/ 1 2,\n 3 /\n"), "text")
    operator = F.element_at(F.array(*(F.lit(x) for x in ("+", "and", "-", "/"))), (F.col("turn") % 4 + 1).cast("int"))
    return c.select("conv_id", "turn", T.drop_data_blocks(block).alias("dropped"), T.clean_operators(F.concat("role", F.lit(" *  + "), "text")).alias("cleaned"), T.is_associative(operator).alias("associative"))


@query("SELECT n_nationkey, coalesce(short, n_name) AS resolved FROM (SELECT n_nationkey, n_name, CASE n_nationkey WHEN 0 THEN 'comm' WHEN 1 THEN 'region' WHEN 2 THEN 'yearp' WHEN 3 THEN 'slice2' END AS long FROM nation) LEFT JOIN (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in SHORT_NAMES.items()) + ") AS s(long, short) USING (long)")
def short_names(spark, sf_dir):
    """The table of short names, looked up."""
    name = F.when(F.col("n_nationkey") == 0, "comm").when(F.col("n_nationkey") == 1, "region").when(F.col("n_nationkey") == 2, "yearp").when(F.col("n_nationkey") == 3, "slice2").otherwise(F.col("n_name"))
    base = spark.createDataFrame(list(SHORT_NAMES.items()), "name string, alias string")
    none = base.limit(0)
    return R.resolved(Tables(spark, sf_dir).nation.select("n_nationkey", name.alias("name")), "name", none, base).select("n_nationkey", "resolved")


@query("SELECT page_id, line_no, sub_no, line FROM (SELECT page_id, 0 AS line_no, 0 AS sub_no, 'set ' || page_id AS line FROM pages UNION ALL SELECT page_id, 1, i::INTEGER, parts[i + 1] FROM (SELECT page_id, parts, unnest(range(len(parts))) AS i FROM (SELECT page_id, string_split(html, chr(10)) AS parts FROM pages WHERE page_id % 2 = 0)) UNION ALL SELECT page_id, 2, 0, 'end' FROM pages)")
def include_files(spark, sf_dir):
    """S3: lines of files in place of those that include them; files that are not there vanish."""
    pages = Tables(spark, sf_dir).pages
    lines = pages.select(F.col("page_id").alias("model_id"), F.posexplode(F.array(F.concat(F.lit("set "), "page_id"), F.concat(F.lit("$Include 'page"), "page_id", F.lit(".inc'")), F.lit("end"))).alias("line_no", "line"))
    files = pages.where("page_id % 2 = 0").select(F.concat(F.lit("page"), "page_id", F.lit(".inc")).alias("name"), F.col("html").alias("text"))
    return include_lines(lines, files).withColumnRenamed("model_id", "page_id")


@query("SELECT id, round(CASE WHEN x = 0 THEN 0 ELSE 2 / sqrt(pi()) * list_sum(list_transform(range(70), lambda n: CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END * exp((2 * n + 1) * ln(abs(x)) - lgamma(n + 1)) / (2 * n + 1))) * sign(x) END, 6) + 0.0 AS f_erf, round(1 - CASE WHEN x = 0 THEN 0 ELSE 2 / sqrt(pi()) * list_sum(list_transform(range(70), lambda n: CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END * exp((2 * n + 1) * ln(abs(x)) - lgamma(n + 1)) / (2 * n + 1))) * sign(x) END, 6) + 0.0 AS f_erfc, sign(x) * floor(abs(x) + 0.5) + 0.0 AS f_round FROM (SELECT range AS id, (range - 500) / 250 AS x FROM range(1001))")
def fn_erf(spark, sf_dir):
    """Erf, erfc, round, against erf's series."""
    x = (F.col("id") - 500) / 250
    six = lambda c: F.round(c, 6) + 0.0
    return spark.range(1001).select("id", six(apply("erf", x)).alias("f_erf"), six(apply("erfc", x)).alias("f_erfc"), (apply("round", x) + 0.0).alias("f_round"))
