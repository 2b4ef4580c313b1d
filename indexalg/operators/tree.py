"""Operations on tables of tree nodes (see nodes.NODE_SCHEMA), for many models at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import with_dims

_EQ = ["model_id", "eq"]
#: Colours of nodes by type.
COLOURS = {
    "variable": "dodgerblue", "parameter": "orange", "constant": "orange", "mapping": "palegreen", "set": "plum", "dims": "plum",
    "expression": "lightblue", "unary": "lightblue", "func": "lightblue", "sum": "lightblue", "prod": "lightblue", "when": "lightcoral", "where": "yellow",
}
PREFIXES = {"condition": "cond: ", "then": "then: ", "index": "index: ", "otherwise": "otherwise: "}


def node_depth(nodes: DataFrame) -> DataFrame:
    """Levels of each tree."""
    return nodes.groupBy(*_EQ).agg((F.max("level") - F.min("level") + 1).alias("depth"))


def hashes(nodes: DataFrame, kind: str = "crc32") -> DataFrame:
    """With `hash` of the digest of what a node means."""
    return nodes.withColumn("hash", F.lower(F.lpad(F.hex(F.crc32(F.encode("canon", "UTF-8"))), 8, "0")) if kind == "crc32" else F.sha2("canon", 256))


def elements(nodes: DataFrame, slot: str) -> DataFrame:
    """Nodes in a slot; order by (model_id, eq, node_id) for reading order."""
    return nodes.where(F.col("slot") == slot)


def replaced(nodes: DataFrame, slot: str, node_type: str, name: str) -> DataFrame:
    """Subtrees in a slot replaced by a leaf; ids are kept, so those below are gone."""
    cut = nodes.where(F.col("slot") == slot).select(*_EQ, F.col("node_id").alias("top"), "last_id")
    below = (F.col("n.model_id") == F.col("c.model_id")) & (F.col("n.eq") == F.col("c.eq")) & (F.col("n.node_id") > F.col("c.top")) & (F.col("n.node_id") <= F.col("c.last_id"))
    left = nodes.alias("n").join(cut.alias("c"), below, "left_anti")
    here = F.col("slot") == slot
    return left.withColumn("node_type", F.when(here, F.lit(node_type)).otherwise(F.col("node_type"))).withColumn("name", F.when(here, F.lit(name)).otherwise(F.col("name")))


def where_candidates(nodes: DataFrame, length: Column, least: int = 10) -> DataFrame:
    """Conditions of `when` nodes that are long enough to be named: with s_name s1, s2, ... per equation."""
    up = nodes.where("node_type = 'when'").select(*_EQ, F.col("node_id").alias("parent_id"))
    found = nodes.where("slot = 'condition'").join(up, [*_EQ, "parent_id"], "left_semi").where(length >= least)
    return found.withColumn("s_name", F.concat(F.lit("s"), F.row_number().over(Window.partitionBy(*_EQ).orderBy("node_id"))))


def where_nodes(nodes: DataFrame) -> DataFrame:
    """Where nodes by name; the last of a name."""
    return nodes.where("node_type = 'where'").groupBy(*_EQ, "name").agg(F.max("node_id").alias("node_id"), F.max_by("hash", "node_id").alias("hash"))


def shared_names(rows: DataFrame, keys: list[str], digest: str, order: str, prefix: str = "m") -> DataFrame:
    """With new_name m1, m2, ...: equal digests share one, numbered by first appearance, and duplicate, which is false for the first."""
    first = F.min(order).over(Window.partitionBy(*keys, digest))
    rows = rows.withColumn("first_seen", first)
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy("first_seen")) if keys else F.dense_rank().over(Window.orderBy("first_seen"))
    return rows.withColumn("new_name", F.concat(F.lit(prefix), rank)).withColumn("duplicate", F.col(order) != F.col("first_seen")).drop("first_seen")


def renamed(nodes: DataFrame, names: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Names looked up in (name, new_name); others stay. Spark broadcasts `names` if it is small."""
    keep = F.col("new_name").isNotNull() & (F.col("node_type").isin(kinds) if kinds else F.lit(True))
    return nodes.join(names.select("name", "new_name"), "name", "left").withColumn("name", F.when(keep, F.col("new_name")).otherwise(F.col("name"))).drop("new_name")


def resolved(rows: DataFrame, column: str, extended: DataFrame, base: DataFrame, out: str = "resolved") -> DataFrame:
    """A name's counterpart in (name, alias) tables: the extended one first, else the base, else itself."""
    e = extended.select(F.col("name").alias(column), F.col("alias").alias("alias_e"))
    b = base.select(F.col("name").alias(column), F.col("alias").alias("alias_b"))
    return rows.join(e, column, "left").join(b, column, "left").withColumn(out, F.coalesce("alias_e", "alias_b", column)).drop("alias_e", "alias_b")


def mapped_leaves(nodes: DataFrame, column: str, change: Column, kinds: list[str] | None = None) -> DataFrame:
    """A column changed in nodes that have no children."""
    up = nodes.select(*_EQ, F.col("parent_id").alias("node_id"), F.lit(True).alias("has_children")).where("node_id IS NOT NULL").distinct()
    leaf = F.col("has_children").isNull() & (F.col("node_type").isin(kinds) if kinds else F.lit(True))
    return nodes.join(up, [*_EQ, "node_id"], "left").withColumn(column, F.when(leaf, change).otherwise(F.col(column))).drop("has_children")


def needed_brackets(nodes: DataFrame, ranks: DataFrame) -> DataFrame:
    """With needs_brackets: an operator below one that binds tighter, or as tightly on its right side."""
    own = ranks.select(F.col("op"), F.col("rank").alias("own_rank"))
    up = nodes.where("op IS NOT NULL").join(ranks, "op").select(*_EQ, F.col("node_id").alias("parent_id"), F.col("rank").alias("up_rank"))
    rows = nodes.join(own, "op", "left").join(up, [*_EQ, "parent_id"], "left")
    need = (F.col("own_rank") > F.col("up_rank")) | ((F.col("own_rank") == F.col("up_rank")) & (F.col("slot") == "rhs"))
    return rows.withColumn("needs_brackets", F.coalesce(need, F.lit(False))).drop("own_rank", "up_rank")


def symbol_kinds(names: DataFrame, declared: DataFrame) -> DataFrame:
    """(name, kind, declared_name): the first kind of (kind, name, priority) that has a name, case apart; else symbol."""
    d = declared.select(F.lower("name").alias("low"), "kind", F.col("name").alias("declared_name"), "priority")
    best = d.groupBy("low").agg(F.min_by(F.struct("kind", "declared_name"), F.struct("priority", "declared_name")).alias("best"))
    return names.join(best, F.lower(names["name"]) == best["low"], "left").select("name", F.coalesce("best.kind", F.lit("symbol")).alias("kind"), F.coalesce("best.declared_name", "name").alias("declared_name"))


def _label(show_dims: bool) -> Column:
    kind, name, op = F.col("node_type"), F.coalesce("name", F.lit("")), F.col("op")
    with_own = with_dims(name, F.coalesce("dims", F.array().cast("array<string>")), show_dims)
    whole = F.col("num_value") == F.floor("num_value")
    value = F.coalesce(F.when(whole, F.col("num_value").cast("decimal(38,0)").cast("string")).otherwise(F.col("num_value").cast("string")), "text_value")
    return (
        F.when(kind.isin("sum", "prod", "when"), kind)
        .when(kind.isin("expression", "unary", "equation"), op)
        .when(kind.isin("mapping", "parameter", "variable", "symbol"), with_own)
        .when(kind == "dims", with_dims(F.lit(""), F.col("dims"), show_dims))
        .when(kind == "constant", value)
        .when(kind == "func", F.concat(F.lit("func: "), name))
        .when(kind.isin("set", "where"), name)
        .otherwise(F.concat(F.lit("<"), kind, F.lit(">")))
    )


def graph_nodes(nodes: DataFrame, show_dims: bool = True) -> DataFrame:
    """(model_id, eq, id, label, shape, color): one box per node, a circle for an equation's relation.

    Dimensions and the indices within them are part of their owner's label, not
    nodes.
    """
    drawn = _drawn(nodes)
    prefix = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in PREFIXES.items() for x in kv)), F.coalesce("slot", F.lit(""))), F.lit(""))
    colour = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in COLOURS.items() for x in kv)), F.col("node_type")), F.lit("lightgray"))
    relation = F.col("node_type") == "equation"
    return drawn.select(*_EQ, F.col("node_id").alias("id"), F.concat(prefix, _label(show_dims)).alias("label"), F.when(relation, "circle").otherwise("box").alias("shape"), F.when(relation, "coral").otherwise(colour).alias("color"))


def _drawn(nodes: DataFrame) -> DataFrame:
    """Without dims nodes and what is below them."""
    return nodes.where(~F.coalesce(F.col("slot").isin("dims", "item"), F.lit(False)))


def graph_edges(nodes: DataFrame) -> DataFrame:
    """(model_id, eq, from_id, to_id) between drawn nodes."""
    drawn = _drawn(nodes)
    up = drawn.select(*_EQ, F.col("node_id").alias("from_id"))
    return drawn.where("parent_id IS NOT NULL").select(*_EQ, F.col("parent_id").alias("from_id"), F.col("node_id").alias("to_id")).join(up, [*_EQ, "from_id"], "left_semi")


def dot_lines(nodes: DataFrame) -> DataFrame:
    """(model_id, eq, dot): a graph description per equation."""
    n = graph_nodes(nodes).groupBy(*_EQ).agg(F.array_sort(F.collect_list(F.struct("id", F.concat(F.col("id"), F.lit(' [label="'), F.regexp_replace("label", '"', "'"), F.lit('"];')).alias("line")))).alias("n"))
    e = graph_edges(nodes).groupBy(*_EQ).agg(F.array_sort(F.collect_list(F.struct("from_id", "to_id"))).alias("e"))
    lines = F.concat(F.array(F.lit("digraph AST {"), F.lit("node [shape=box];")), F.transform("n", lambda x: x["line"]), F.transform(F.coalesce("e", F.array().cast("array<struct<from_id:int,to_id:int>>")), lambda x: F.concat(x["from_id"], F.lit(" -> "), x["to_id"], F.lit(";"))), F.array(F.lit("}")))
    return n.join(e, _EQ, "left").select(*_EQ, F.array_join(lines, "\n").alias("dot"))


def catalog_counts(symbols: DataFrame, aliases: DataFrame, equations: DataFrame) -> DataFrame:
    """(model_id, kind, n) of sets, mappings, parameters, variables, alias groups and equations."""
    a = aliases.select("model_id", F.lit("alias").alias("kind"), "group_id").distinct().drop("group_id")
    return symbols.select("model_id", "kind").unionAll(a).unionAll(equations.select("model_id", F.lit("equation").alias("kind"))).groupBy("model_id", "kind").agg(F.count("*").alias("n"))
