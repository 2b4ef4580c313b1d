from pyspark.sql import functions as F

from indexalg.llm.shared import TASKS, cut


def test_small_tables_are_read_back_by_few_tasks(spark):
    fewest = TASKS * spark.sparkContext.defaultParallelism
    many = spark.range(0, 5000, numPartitions=4 * fewest).withColumn("text", F.when(F.col("id") % 7 > 0, F.repeat(F.lit("x"), (F.col("id") % 5).cast("int"))))
    out = cut(many)
    assert out.rdd.getNumPartitions() == fewest
    assert sorted(out.collect(), key=lambda r: r.id) == many.orderBy("id").collect()


def test_few_parts_and_empty_tables_stay(spark):
    assert cut(spark.range(0, 10, numPartitions=2)).rdd.getNumPartitions() == 2
    assert cut(spark.range(0, 100, numPartitions=64).where("id < 0")).collect() == []
