"""Connected components, ranks, and the scratch tables that iterations leave behind."""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; where none is set, the warehouse, or in local mode a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and spark.sparkContext.master.split("[")[0] == "local":
        root = tempfile.mkdtemp(prefix="lautwerk-")
        spark.conf.set("spark.checkpoint.dir", root)
    return (root or f"{spark.conf.get('spark.sql.warehouse.dir')}/lautwerk").rstrip("/")


#: The folder of the scratch that is open, if any: scratches made meanwhile lie in it.
_open: ContextVar[str | None] = ContextVar("lautwerk_scratch", default=None)


class Scratch:
    """Tables written into the shared folder, which cut lineage and outlive executors.

    ``drop`` removes those that no later step reads; what a returned frame
    still reads stays until its owner no longer needs it.  An owner opens a
    scratch (``with``) around calls whose own scratches shall lie in it, and
    removes them all with ``clear`` once their results are written elsewhere.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{_open.get() or scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def __enter__(self) -> Scratch:
        self._token = _open.set(self.base)
        return self

    def __exit__(self, *_) -> None:
        _open.reset(self._token)

    def keep(self, df: DataFrame, label: str = "t", bucket: str | None = None) -> DataFrame:
        """``df``, written and read back; bucket: a column by which it stays dealt out, so grouping by it (and more) takes no shuffle."""
        self.count += 1
        path = f"{self.base}/{label}{self.count}"
        schema = df.schema
        if bucket:
            name = f"lautwerk_{uuid.uuid4().hex}"
            parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            df.write.format("parquet").bucketBy(parts, bucket).option("path", path).saveAsTable(name)
            out = self.spark.table(name)
        else:
            df.write.parquet(path)
            out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def _delete(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if "_scratch_path" in df.__dict__:
                self._delete(df._scratch_path)

    def remove(self, name: str) -> None:
        """What lies under a name of the scratch, written by tasks themselves."""
        self._delete(f"{self.base}/{name}")

    def clear(self) -> None:
        self._delete(self.base)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs): ``node, comp`` for each node with an edge to another.

    ``comp`` is the smallest node reachable.  Each round hooks every node onto
    its smallest neighbour (a minimum, summed up before the shuffle, so hubs
    don't concentrate in a task), shortens the chains of hooks, and contracts
    the graph to what is left; rounds grow with the logarithm of the graph.
    """
    spark = scratch.spark
    left = scratch.keep(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(
            left.select(F.col("b").alias("node"), F.col("a").alias("to"))
        )
        hook = both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("up"))
        up = hook.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        twice = hook.join(up, "up").select("node", F.col("up2").alias("up"))
        up4 = twice.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        hooked = scratch.keep(twice.join(up4, "up").select("node", F.col("up2").alias("up")), "up")
        rounds.append(hooked)
        a = hooked.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        b = hooked.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        fresh = left.join(a, "a").join(b, "b").where("ua <> ub")
        fresh = fresh.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct()
        fresh = scratch.keep(fresh, "edges")
        scratch.drop(left)
        left = fresh
    scratch.drop(left)
    if not rounds:
        return spark.createDataFrame([], "node long, comp long")
    out = rounds[0].withColumnRenamed("up", "comp")
    for later in rounds[1:]:
        step = later.select(F.col("node").alias("comp"), "up")
        out = out.join(step, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
    out = scratch.keep(out, "comp")
    scratch.drop(*rounds)
    return out


def ranked(df: DataFrame, column: str, name: str = "place", width: int = 4096) -> DataFrame:
    """``df`` with the rank (from 0) of a column of distinct longs, without a window over all rows.

    Ids fall into blocks of ``width``; counts of blocks are summed up in order,
    and rows are numbered within their block.
    """
    rows = df.withColumn("block", F.floor(F.col(column) / width))
    blocks = rows.groupBy("block").agg(F.count(F.lit(1)).alias("members")).withColumn("many", F.floor(F.col("block") / width))
    many = blocks.groupBy("many").agg(F.sum("members").alias("of_many"))
    before = Window.orderBy("many").rowsBetween(Window.unboundedPreceding, -1)
    many = many.select("many", F.coalesce(F.sum("of_many").over(before), F.lit(0)).alias("offset_many"))
    within = Window.partitionBy("many").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("offset", F.coalesce(F.sum("members").over(within), F.lit(0))).join(many, "many")
    blocks = blocks.select("block", (F.col("offset") + F.col("offset_many")).alias("offset"))
    place = F.row_number().over(Window.partitionBy("block").orderBy(column)) - 1
    out = rows.withColumn("within", place).join(blocks, "block")
    return out.withColumn(name, (F.col("within") + F.col("offset")).cast("long")).select(*df.columns, name)


def label_components(df: DataFrame, key: str, labels: list[list[str]], scratch: Scratch) -> DataFrame:
    """``key, comp``: rows are connected where they share a label (a list of columns); comp is the smallest key reachable.

    Each label's rows are linked to its smallest key, so a hot label is a star, not all pairs.
    """
    edges = None
    for own in labels:
        least = df.groupBy(*own).agg(F.min(key).alias("least"))
        met = df.select(key, *own).join(least, own).where(F.col(key) != F.col("least")).select(F.col(key).alias("a"), F.col("least").alias("b"))
        edges = met if edges is None else edges.unionByName(met)
    comp = components(edges, scratch)
    return df.select(key).distinct().join(comp.withColumnRenamed("node", key), key, "left").withColumn("comp", F.coalesce("comp", key))
