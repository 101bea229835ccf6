"""Shared pieces: the scratch folder, table reads, components of a graph."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the data folder `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, where that is
    unset on a local master, a new temporary folder that is then set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lofted-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Scratch:
    """A folder of its own under the shared one, for tables that cut lineage.

    Spark deletes it when its JVM ends; `drop` deletes a table before.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        where, fs = self._fs(self.path)
        fs.mkdirs(where)
        fs.deleteOnExit(where)

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def folder(self, name: str) -> str:
        """A new empty folder in the scratch folder."""
        path = f"{self.path}/{name}"
        where, fs = self._fs(path)
        fs.mkdirs(where)
        return path

    def save(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        """Writes `df` as Parquet and returns the written table."""
        path = f"{self.path}/{name}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        schema = df.schema
        return self.spark.read.schema(schema).parquet(path)

    def keep(self, name: str) -> None:
        """Deletes all tables but one."""
        where, fs = self._fs(self.path)
        for status in fs.listStatus(where):
            if status.getPath().getName() != name:
                fs.delete(status.getPath(), True)

    def drop(self, name: str) -> None:
        where, fs = self._fs(f"{self.path}/{name}")
        fs.delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """`names`, each with underscores put before it until no column of `df` is called so (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def q(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def components(edges: DataFrame, scratch: Scratch, label: str = "cc") -> DataFrame:
    """Connected components of `edges` (a, b longs, no nulls): rows (node, comp),
    comp being one node of the component, for each node that has an edge.

    Each round maps every vertex to its least neighbour and contracts the edges
    by that map, so stars vanish in one round and chains shrink geometrically.
    """
    e = scratch.save(edges.select("a", "b").where("a <> b").distinct(), f"{label}-e0")
    nodes, turn = None, 0
    while not e.isEmpty():
        turn += 1
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.save(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("m")), f"{label}-m{turn}")
        if nodes is None:
            nodes = least.select(F.col("v").alias("node"), F.col("m").alias("comp"))
        else:
            moved = nodes.join(least, nodes.comp == least.v, "left").select("node", F.coalesce("m", "comp").alias("comp"))
            nodes = scratch.save(moved, f"{label}-n{turn}")
        la, lb = least.select(F.col("v").alias("va"), F.col("m").alias("ma")), least.select(F.col("v").alias("vb"), F.col("m").alias("mb"))
        nxt = e.join(la, e.a == la.va).join(lb, e.b == lb.vb).where("ma <> mb").select(F.col("ma").alias("a"), F.col("mb").alias("b")).distinct()
        e = scratch.save(nxt, f"{label}-e{turn}")
    if nodes is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return nodes
