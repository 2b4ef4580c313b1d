"""Mixing sources to target weights by capped water-filling.

Each source's share of the mix is proportional to its weight, but no source
gives more than `max_epochs` times its own size; what a capped source cannot
give goes to the others in proportion to their weights, until none is above
its cap. With sources in ascending order of cap per weight the capped ones are
a prefix, so one pass of window sums over the table of sources finds the level.

A source that gives r times its size repeats every document floor(r) times; the
fraction is drawn by a seeded hash of the document's key: documents in hash
order until the source's words are reached, to within half a document. The
order is cut into 4096 buckets of hash, whose sums are all that is added up by
source; only the one bucket where a source's level falls is ordered by row. So
a source with a third of all rows is no one task's work.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

WORDS = r"[^\x20\x09-\x0D]+"
#: The table of sources is broadcast up to this many rows; beyond, it is joined by sort and merge.
BROADCAST_SOURCES = 20_000
_OUT = ["size", "source_size", "target", "taken"]


def source_plan(sizes: DataFrame, weights: tuple[int, ...], share_percent: int, max_epochs: int) -> DataFrame:
    """Of (source, source_size): source, source_size, target."""
    order = Window.orderBy(F.asc_nulls_last("source"))
    wide = lambda c: c.cast("decimal(38,0)")
    w = sizes.withColumn("weight", F.element_at(F.array(*(F.lit(x).cast("long") for x in weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    # all amounts in hundredths of a word
    w = w.withColumn("cap", F.col("source_size") * (100 * max_epochs)).withColumn("total", F.sum("source_size").over(Window.partitionBy()) * share_percent)
    by = Window.orderBy(F.col("source_size") / F.col("weight"), F.asc_nulls_last("source"))
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    w = w.withColumn("over", wide(F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) * F.col("weight") > wide(F.col("cap")) * F.sum("weight").over(after))
    w = w.withColumn("capped", F.min(F.col("over")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    everything = Window.partitionBy()
    left = F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything)
    free = F.sum(F.when(F.col("capped"), F.lit(0)).otherwise(F.col("weight"))).over(everything)
    level = (F.col("weight") * left).cast("double") / F.nullif(free * 100, F.lit(0)).cast("double")
    return w.select("source", "source_size", F.when(F.col("capped"), (F.col("source_size") * max_epochs).cast("double")).otherwise(level).alias("target"))


def mix_sources(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (5, 2, 1), share_percent: int = 150, max_epochs: int = 2, seed: int = 6) -> DataFrame:
    """`docs` with size, source_size, target and taken.

    size is the document's number of words (null text: 0), source_size and
    target the words its source has and is to give, taken the words the mix
    takes of it, a multiple of size. Sources in code-point order, null last,
    take `weights` in turn; together they give share_percent of all words. A
    null key is hashed as the word "null". Rows with equal key, size and source
    may be taken unequally often; which of them is left open, as they are equal
    to the mix. Input columns named like one of the four are replaced. An empty
    table gives no rows; a source without words has target 0.
    """
    docs = docs.drop(*(c for c in docs.columns if c.lower() in _OUT))
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)).cast("long"), F.lit(0).cast("long"))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")
    bucket = F.shiftright(draw, 48)
    sums = cut(docs.select(F.col(source).alias("source"), bucket.alias("bucket"), size.alias("size")).groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    plan = source_plan(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share_percent, max_epochs)
    plan = plan.withColumn("whole", F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    run = Window.partitionBy("source").orderBy("bucket")
    levels = sums.withColumn("after", F.sum("words").over(run)).withColumn("before", F.col("after") - F.col("words"))
    one = levels.alias("l").join(plan.alias("p"), F.expr("l.source <=> p.source"))
    one = one.groupBy(F.col("p.source").alias("source"), "p.source_size", "p.target", "p.whole", "p.rest").agg(F.min(F.when(F.col("after") > F.col("rest"), F.struct("bucket", "before"))).alias("at"))
    # no column of `docs` begins like these
    own = "mix_"
    while any(c.lower().startswith(own) for c in docs.columns):
        own = f"_{own}"
    level = {"size": F.col("source_size"), "target": F.col("target"), "whole": F.col("whole"), "rest": F.col("rest"), "bucket": F.coalesce("at.bucket", F.lit(4096)), "before": F.coalesce("at.before", F.lit(0))}
    one = cut(one.select(F.col("source").alias(f"{own}source"), *(c.alias(f"{own}{k}") for k, c in level.items())))
    one = F.broadcast(one) if one.count() <= BROADCAST_SOURCES else one
    mine = lambda k: F.col(f"{own}{k}")
    named = docs.withColumn(f"{own}draw", draw).join(one, F.col(source).eqNullSafe(mine("source")))
    here = F.shiftright(mine("draw"), 48)
    inner = Window.partitionBy(mine("source")).orderBy(mine("draw"), "size", key).rowsBetween(Window.unboundedPreceding, 0)
    edge = named.where(here == mine("bucket")).withColumn("size", size)
    edge = edge.withColumn(f"{own}extra", ((F.sum("size").over(inner) + mine("before")) * 2 - F.col("size") <= mine("rest") * 2).cast("long"))
    rest = named.where(here != mine("bucket")).withColumn("size", size).withColumn(f"{own}extra", (here < mine("bucket")).cast("long"))
    return rest.unionByName(edge).select(*docs.columns, "size", mine("size").alias("source_size"), mine("target").alias("target"), (F.col("size") * (mine("whole") + mine("extra"))).alias("taken"))
