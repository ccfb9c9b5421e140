"""Helpers shared by the training-data operators: tables, shared storage, components."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of a few MB, so that a worker's memory does not follow the row count,
    and drop the shuffle files of each written table when it is written."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a session names none and runs on one machine (tests) a temporary folder is set.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no later plan reads."""
    for path in paths:
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


_HELD: dict[str, dict] = {}


def held_by(module: str) -> dict:
    """What a module keeps in a worker between tasks; it goes when another module's tasks come."""
    return _HELD.setdefault(module, {})


def only_keep(module: str) -> None:
    for name, held in _HELD.items():
        if name != module:
            held.clear()


def released(run):
    """A function over batches that gives the memory it has freed back to the system when its last batch is out.

    A worker lives on for the next task, and what one operator's task had needed must not add to another's.
    """

    @functools.wraps(run)
    def then_released(batches):
        only_keep(run.__module__)
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not this C library
            pass

    return then_released


def crc_mod(col: str, n: int):
    """crc32 of the column as text, modulo ``n`` (null for null)."""
    return F.crc32(F.col(col).cast("string")) % n


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every node of ``edges`` (columns a, b of type long).

    Alternating large-star and small-star contraction: each round links every
    node's neighbours to its smallest neighbour, with partial aggregation before
    each shuffle, and writes the shrunken edge list to the shared folder.  The
    loop ends when the edges form stars, after about log(diameter) rounds.
    Returns (node, component) for the nodes that occur in ``edges``.
    """
    spark = edges.sparkSession
    current = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc"
    )
    for _ in range(max_rounds):
        before = current
        # large star: neighbours above a node hang on its smallest neighbour (itself included)
        both = before.select("u", "v").union(before.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the minima are written so that both sides of the join are plain shuffles, which can be split where a hub is hot
        low = written(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")), "cc")
        large = (
            both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        large = written(large, "cc")
        # small star: neighbours below a node hang on its smallest neighbour
        low2 = written(large.groupBy("u").agg(F.min("v").alias("m")), "cc")
        small = (
            large.join(low2, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        current = written(small, "cc")
        # stars only: no node is both a child and a parent, and every child has one parent
        parents = current.groupBy("u").agg(F.count("*").alias("n"), F.lit(0).alias("p"))
        roles = parents.union(current.select(F.col("v").alias("u"), F.lit(0).cast("long"), F.lit(1)).distinct())
        bad = roles.groupBy("u").agg(F.max("n").alias("n"), F.max("p").alias("p")).where("n > 1 OR (n > 0 AND p > 0)").limit(1).count()
        remove(spark, before.scratch_path, low.scratch_path, large.scratch_path, low2.scratch_path)
        if not bad:
            break
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
