"""From raw documents to training shards, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indexalg.llm.decontamination import decontaminated
from indexalg.llm.jump_sharding import assign_shards, write_shards
from indexalg.llm.ngram_jaccard_join import one_of_each_class
from indexalg.llm.quality_classifier import classify, fit_classifier, rated
from indexalg.llm.shared import drop_shuffles, fresh_folder, table, unused
from indexalg.llm.source_mixing import mix_sources


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are less likely good than not, by a model of the rated ones."""
    model = fit_classifier(docs, rated(table(spark, sf_dir, "labels")))
    names = tuple(unused(n, docs.columns) for n in ("expected_grade", "tail_probability", "keep"))
    return classify(docs, model, names=names).where(F.col(names[2])).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each class of near copies."""
    drop_shuffles(spark)
    return one_of_each_class(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents; cuts the passages out of those with traces."""
    drop_shuffles(spark)
    clean = decontaminated(docs, table(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix of sources takes it: not at all, once or twice.

    Input columns named like those the mix adds (size, source_size, target, taken) come back unchanged.
    """
    drop_shuffles(spark)
    added = ["size", "source_size", "target", "taken"]
    away, names = {}, [*docs.columns, *added]
    for c in docs.columns:
        if c.lower() in added:
            away[c] = unused(f"{c}_", names)
            names.append(away[c])
    mixed = mix_sources(docs.withColumnsRenamed(away)).where("taken > 0")
    repeat = unused("repeat", names)
    mixed = mixed.withColumn(repeat, F.explode(F.sequence(F.lit(1).cast("long"), F.expr("taken div size"))))
    return mixed.select(*(F.col(away.get(c, c)).alias(c) for c in docs.columns))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes every row, with its text, to one of 8 shards in order of slots; what is returned is read from their files.

    Repeats of a document have slots of their own in its shard.
    """
    drop_shuffles(spark)
    folder = fresh_folder(spark, "shards")
    rows = assign_shards(docs, keep=True)
    write_shards(rows, folder)
    return spark.read.schema(rows.schema).parquet(folder).select(*rows.columns)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources to target weights", mixture),
    ("sharding", shards),
]

#: The first stage trains a classifier, which SQL cannot; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        folder = fresh_folder(spark, f"stage-{k + 1}")
        out.write.parquet(folder)
        docs = spark.read.parquet(folder)
