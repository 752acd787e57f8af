"""Splits by hashed clusters and by families of repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions.text import split_of
from lodestrand.operators.components import connected


def cluster_split(records: DataFrame, seed: int = 42, train: float = 0.9, validation: float = 0.05) -> DataFrame:
    """Adds split. Where no included cluster hashes to validation or test, the last and one of its neighbours are
    moved there, decided on one row of aggregates: the first, last and last but one cluster."""
    clusters = records.where("included").groupBy("dedup_cluster").agg(F.lit(1).alias("one")).select("dedup_cluster", split_of(F.col("dedup_cluster"), seed, train, validation).alias("hashed"))
    # max_by over pre-aggregated rows: no sort of all clusters
    ends = clusters.agg(F.count("*").alias("n"), F.max("dedup_cluster").alias("last"), F.min("dedup_cluster").alias("first"), F.max(F.col("hashed") == "validation").alias("has_v"), F.max(F.col("hashed") == "test").alias("has_t"))
    second = clusters.join(F.broadcast(ends.select("last")), F.col("dedup_cluster") < F.col("last")).agg(F.max_by(F.struct("dedup_cluster", "hashed"), "dedup_cluster").alias("second"))
    rule = ends.join(second).select(
        F.when((F.col("n") >= 2) & ~F.col("has_v"), F.col("last")).alias("to_v"),
        # whether test is missing is asked after the last cluster may have been taken from it
        "n", "has_t", "first", "second", "last",
    )
    marked = clusters.join(F.broadcast(rule)).withColumn("one_split", F.when(F.col("dedup_cluster") == F.col("to_v"), "validation").otherwise(F.col("hashed")))
    test_left = marked.agg(F.max(F.col("one_split") == "test").alias("test_left"))
    final = marked.join(F.broadcast(test_left)).withColumn(
        "split", F.when((F.col("n") >= 3) & ~F.col("test_left") & (F.col("dedup_cluster") == F.when(F.col("second.hashed") == "train", F.col("second.dedup_cluster")).otherwise(F.col("first"))), "test").otherwise(F.col("one_split"))
    )
    return records.drop("split").join(final.select("dedup_cluster", F.col("split").alias("s")), "dedup_cluster", "left").withColumn("split", F.when(F.col("included"), F.col("s")).otherwise("excluded")).drop("s")


def repository_families(records: DataFrame) -> DataFrame:
    """repository_id, family: repositories of included records that share a cluster, directly or not; the smallest names all."""
    ties = records.where("included").select("repository_id", "dedup_cluster").dropna().distinct()
    least = ties.groupBy("dedup_cluster").agg(F.min("repository_id").alias("v"))
    joined = connected(ties.join(least, "dedup_cluster").select(F.col("repository_id").alias("u"), "v"))
    return ties.select("repository_id").distinct().join(joined.withColumnRenamed("node", "repository_id"), "repository_id", "left").select("repository_id", F.coalesce("root", "repository_id").alias("family"))


def family_split(records: DataFrame, seed: int = 42, train: float = 0.9, validation: float = 0.05) -> DataFrame:
    """repository_id, family, weight, split. Up to three families go by rank; more are hashed, with the two
    smallest held back where validation or test would stay empty."""
    families = repository_families(records)
    weights = records.where("included").groupBy("repository_id").agg(F.count("*").alias("rows"))
    ranked = families.join(weights, "repository_id").groupBy("family").agg(F.sum("rows").alias("weight"))
    order = Window.orderBy(F.desc("weight"), "family")
    # one row per family, so a single sort is what is asked for
    ranked = ranked.withColumn("rank", F.row_number().over(order)).withColumn("hashed", split_of(F.concat(F.lit("repository-family:"), F.col("family")), seed, train, validation))
    facts = ranked.agg(F.max("rank").alias("n"), F.max(F.col("hashed") == "validation").alias("has_v"))
    one = ranked.join(F.broadcast(facts)).withColumn("s", F.when(~F.col("has_v") & (F.col("rank") == F.col("n")), "validation").otherwise(F.col("hashed")))
    test = one.agg(F.max(F.col("s") == "test").alias("has_t"), F.max_by("s", F.when(F.col("rank") == F.col("n") - 1, 1).otherwise(0)).alias("second_last"))
    moved = F.when(F.col("second_last") == "train", F.col("n") - 1).otherwise(F.col("n"))
    hashed = F.when(~F.col("has_t") & (F.col("rank") == moved), "test").otherwise(F.col("s"))
    few = F.when(F.col("rank") == 1, "train").when(F.col("rank") == 2, "validation").otherwise("test")
    decided = one.join(F.broadcast(test)).select("family", "weight", F.when(F.col("n") <= 3, few).otherwise(hashed).alias("split"))
    return families.join(decided, "family").select("repository_id", "family", "weight", "split")
