"""Worlds made from plain tables: keyed rows with a payload that is digested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.digest import commit_digest, content_digest


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chunks: (dim, kind, x, z, k, payload, volatile)."""
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        F.substring("o_orderpriority", 1, 1).cast("int").alias("dim"),
        F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("kind"),
        (k.bitwiseAND(F.lit(255)).cast("int") - 128).alias("x"),
        (F.shiftright(k, 8).cast("int") - 32).alias("z"),
        k.alias("k"),
        F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderstatus", "o_orderpriority").alias("payload"),
        F.col("o_totalprice").alias("volatile"),
    )


def version(spark: SparkSession, sf_dir: str, number: int) -> DataFrame:
    """Version 1, 2 or 3 of the orders world, digested; 3 drops a dimension and changes only what is volatile."""
    world = orders_world(spark, sf_dir)
    k = F.col("k") % 10
    if number == 1:
        world = world.where(k != 0)
    else:
        edited: Column = F.when(k == 2, F.concat("payload", F.lit("#2"))).otherwise(F.col("payload"))
        world = world.where(k != 1).withColumn("payload", edited)
    if number == 3:
        world = world.where(F.col("dim") != 5).withColumn("volatile", F.col("volatile") + 1)
    return world.withColumn("hash", content_digest(F.col("payload")))


def documents_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks in a row, one dimension for each language; many share a payload."""
    dims = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).when(F.col("lang") == "fr", 2).otherwise(3)
    return read(spark, sf_dir, "documents").select(
        dims.alias("dim"), F.lit(0).alias("kind"), F.col("doc_id").cast("int").alias("x"), F.lit(0).alias("z"),
        F.col("text").alias("payload"), content_digest(F.col("text")).alias("hash"),
    )


def events_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as commits: one for each, with the user's event before as its parent."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    name = lambda c: content_digest(c.cast("string"))
    rows = read(spark, sf_dir, "events").select("event_id", F.lag("event_id").over(order).alias("before"))
    commits = rows.select(
        name(F.col("event_id")).alias("id"), F.col("event_id").alias("seq"), F.col("event_id").alias("created_at_ms"),
        name(F.concat(F.lit("root"), F.col("event_id").cast("string"))).alias("root_hash"),
    )
    edges = rows.where(F.col("before").isNotNull()).select(
        name(F.col("event_id")).alias("child_id"), name(F.col("before")).alias("parent_id")
    )
    return commits, edges


def with_commit_ids(commits: DataFrame, edges: DataFrame) -> DataFrame:
    """Commits with the digest of their parents, time and root as ``commit_id``."""
    parents = edges.groupBy(F.col("child_id").alias("id")).agg(F.collect_set("parent_id").alias("parents"))
    none = F.array().cast("array<string>")
    joined = commits.join(parents, "id", "left")
    digest = commit_digest(F.coalesce("parents", none), F.col("created_at_ms"), F.col("root_hash"))
    return joined.withColumn("commit_id", digest).drop("parents")
