"""Folders and tables that the driver and all executors see."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it has more rows than HOT_ROWS; the HOT_KEYS keys with most rows are joined apart.
HOT_ROWS, HOT_KEYS = 256, 1000
#: Rows and bytes for the hot keys that are broadcast; beyond, they are joined like the others.
HOT_MATCHES, HOT_BYTES = 100_000, 64 << 20
#: A table in the checkpoint folder is read back in parts of so many bytes, but in no fewer than TASKS for each core.
PART_BYTES, TASKS = 8 << 20, 2


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset a new temporary folder, on a local master only."""
    sc, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="indexalg-"))
    return named or sc.getCheckpointDir()


def fresh_folder(spark: SparkSession, what: str) -> str:
    """The name of a new folder below shared_folder()."""
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the checkpoint folder, without lineage.

    Many small files are read back by few tasks: what follows then writes a
    shuffle file for each of those instead of one for each file.
    """
    shared_folder(df.sparkSession)
    out, sc = df.checkpoint(eager=True), df.sparkSession.sparkContext
    rdd = out._jdf.queryExecution().logical().rdd()
    path = sc._jvm.org.apache.hadoop.fs.Path(rdd.getCheckpointFile().get())
    size = path.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    parts = max(TASKS * sc.defaultParallelism, -(-size // PART_BYTES))
    return out.coalesce(parts) if 2 * parts <= rdd.getNumPartitions() else out


def join_hot(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", size: str | None = None, counted: DataFrame | None = None) -> DataFrame:
    """`left` joined with `right`; left's hot keys by broadcast, so that no task gets all of one.

    `right` has one row or few for each key; `size` names a column of it whose
    bytes tell its rows' sizes. Keys are counted in `counted`, by default in
    `left`, which should be cut, as it is read several times.
    """
    rows = (left if counted is None else counted).groupBy(*on).agg(F.count("*").alias("__rows")).where(F.col("__rows") > HOT_ROWS)
    hot = rows.orderBy(F.desc("__rows"), *on).limit(HOT_KEYS).drop("__rows")
    found = hot.collect()
    if not found:
        return left.join(right, on, how)
    few = F.broadcast(left.sparkSession.createDataFrame(found, hot.schema))
    own = cut(right.join(few, on, "left_semi"))
    matches, length = own.agg(F.count("*"), F.sum(F.octet_length(size) if size else F.lit(0))).first()
    if matches > HOT_MATCHES or (length or 0) > HOT_BYTES:
        return left.join(right, on, how)
    rest = left.join(few, on, "left_anti").join(right, on, how)
    return rest.unionByName(left.join(few, on, "left_semi").join(F.broadcast(own), on, how))


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of tables that nothing refers to any more; else that waits for the driver's next garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unused(name: str, columns: list[str]) -> str:
    """`name`, lengthened until no column is named so, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for what is computed inside; for rows that are large each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
