"""Connected components of a graph in tables: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_key_join, own_shuffles, removed, shared_path


def _linked(edges: DataFrame, small: bool) -> DataFrame:
    """One star round over edges (a, b): every neighbour of u that is larger (small: not larger) than u goes to u's least one."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if small:
        turned = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        turned = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = turned.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
    if small:
        rows = hot_key_join(turned, least, ["u"], "n", 2 * edges.count())
        rows = rows.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        rows = hot_key_join(turned.where("v > u"), least, ["u"], "n", 2 * edges.count()).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return rows.where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a long, b long), any order. (a, b) with b the least node of a's component, for each node a but the least ones.

    Each round is written to the shared folder; it ends when a round changes nothing, by count and hash sum. A graph that isn't done
    after most_rounds is an error, never a partial result.
    """
    spark = edges.sparkSession
    schema = "a long, b long"

    def put(df: DataFrame) -> tuple[str, DataFrame]:
        path = shared_path(spark, "star")
        with own_shuffles(spark):
            df.write.parquet(path)
        return path, spark.read.schema(schema).parquet(path)

    path, now = put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(most_rounds):
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == mark or not found[0]:
            return now
        mark = found
        half_path, half = put(_linked(now, small=False))
        new_path, new = put(_linked(half, small=True))
        removed(spark, path)
        removed(spark, half_path)
        path, now = new_path, new
    raise RuntimeError(f"no end after {most_rounds} rounds")
