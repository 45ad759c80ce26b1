"""Connected components on DataFrames, and the shared folder that iterative steps write to."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a session in one process may do without: there it is one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{os.path.join(tempfile.gettempdir(), 'changelens-shared')}"
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As cut(), with the path, for a table that remove() takes away once what follows has been written."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back."""
    return cut_at(df, name)[0]


def partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def join_spread(left: DataFrame, right: DataFrame, key: str, n: str, total: int, by: list[Column]) -> DataFrame:
    """left, with the other columns of right where key matches and nulls elsewhere; no key of left is one task's burden.

    right has one row a key, and in its column n how many rows of left, `total` in all, have that key. Keys with more than a
    partition's share, of which there are fewer than partitions, come by a broadcast, and their rows are dealt out by the
    hash of `by`; all other keys meet in the shuffle. Both inputs are read once. Names that start with `_sj` are taken.
    """
    parts = partitions(left.sparkSession)
    added = [c for c in right.columns if c not in (key, n)]
    hot = F.col(n) * parts > total
    value = F.struct(F.lit(True).alias("found"), *added)
    few = F.broadcast(right.filter(hot).select(F.col(key).alias("_sj_k"), value.alias("_sj_few")))
    # Key and share are one value: as two, the share of rest, a constant, would leave the join's keys and with them the shuffle.
    rest = right.filter(~hot).select(F.struct(F.col(key).alias("k"), F.lit(0).cast("long").alias("s")).alias("_sj_r"), value.alias("_sj_rest"))
    dealt = left.join(few, F.col(key) == F.col("_sj_k"), "left")
    share = F.when(F.col("_sj_few").isNull(), F.lit(0).cast("long")).otherwise(1 + F.pmod(F.xxhash64(*by), F.lit(parts)))
    dealt = dealt.withColumn("_sj_l", F.struct(F.col(key).alias("k"), share.alias("s")))
    met = dealt.join(rest, F.col("_sj_l") == F.col("_sj_r"), "left")
    met = met.withColumn("_sj", F.coalesce("_sj_few", "_sj_rest"))
    return met.select(*left.columns, *[F.col("_sj")[c].alias(c) for c in added])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) of each node that has an edge to another, the smallest included; component is the smallest node that it reaches.

    Alternating large-star and small-star rounds: the edge table shrinks towards stars around each component's minimum,
    in a number of rounds that grows with the logarithm of the diameter. Minima per node are map-side combined
    aggregates; they come back by joins that deal out the edges of a node of high degree. Self-loops and null ends are
    ignored. More than most_rounds rounds are an error, never a result that is half done.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u != v")
    pairs, path = cut_at(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    n = pairs.count()
    if not n:
        return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    seen = None
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = join_spread(both, low, "u", "n", 2 * n, [F.col("v")]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_spread(large, low, "u", "n", n, [F.col("v")]).select("v", "m").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs, after = cut_at(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        remove(spark, path)
        path = after
        now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == seen:
            break
        seen, n = now, now["n"]
    else:
        raise RuntimeError(f"components are not settled after {most_rounds} rounds")
    ends = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(ends)
