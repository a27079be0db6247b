"""Intermediate tables in the shared folder, and connected components over them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.session import scratch_dir, tune

# Rows of one Arrow batch: a batch of ordinary documents is a few megabytes.
ARROW_ROWS = "1000"


def prepare(spark: SparkSession) -> SparkSession:
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


class Scratch:
    """A folder of tables of one job.  What is written here survives a lost executor; what is dropped frees its disk."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.folder = f"{scratch_dir(spark)}/{what}-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept.scratch_path = path
        return kept

    def drop(self, *kept: DataFrame) -> None:
        for df in kept:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def rename_away(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c in names])


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first()
    return tuple(row)


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Smallest node of every linked node's component, as ``(node, root)``.

    ``links`` has columns ``u`` and ``v``.  Alternates two steps until nothing changes: every larger neighbour of a
    node moves to the node's smallest neighbour, then every smaller one does.  Each step is an aggregate with map-side
    combining and a join, so a node with very many neighbours isn't gathered in one place; the number of rounds
    grows with the logarithm of the longest path.
    """
    now = scratch.keep(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.keep(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        after = scratch.keep(small.select("e.u", "e.v").where("u <> v").distinct())
        scratch.drop(large, now)
        now, before = after, state
        state = _state(now)
        if state == before:
            break
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )


def over_batches(fn: Callable) -> Callable:
    """A ``mapInArrow`` function from one that turns a record batch into a record batch, or into none."""

    def run(batches):
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return run
