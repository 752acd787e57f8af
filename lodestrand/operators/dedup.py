"""Exact and near duplicates: first per key, similarity joins, greedy leader clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.text import shingles
from lodestrand.operators import segments
from lodestrand.session import cut


def mark_duplicates(records: DataFrame, key: str | list[str] = "normalized_sha256", order: str = "record_id", included: Column | None = None) -> DataFrame:
    """Adds is_duplicate: of the included rows of a key all but the one of the smallest `order`. One pre-aggregated
    shuffle on the key and a join, so a key may hold any share of the rows (a window would sort it in one task)."""
    ok = F.lit(True) if included is None else included
    keys = [key] if isinstance(key, str) else key
    first = records.where(ok).groupBy(*keys).agg(F.min(order).alias("first_of_key"))
    return records.join(first, keys, "left").withColumn("is_duplicate", ok & F.coalesce(F.col(order) > F.col("first_of_key"), F.lit(False))).drop("first_of_key")


def similar_pairs(sets: DataFrame, threshold: float = 0.85) -> DataFrame:
    """sets: id (unique), items (distinct hashes). Pairs a < b with Jaccard >= threshold, exact: a, b, common, jaccard.

    From 0.8 on by sketches of the sets (operators/segments.py), below by rare items. Threshold 0 joins all items. The sets
    are computed twice and never stored."""
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold must lie in [0, 1]")
    if threshold < segments.LEAST:
        return rare_item_pairs(sets, threshold)
    return sketched_pairs(cut(segments.sketches(sets, threshold)), sets, threshold)


def sketched_pairs(stored: DataFrame, rows: DataFrame, threshold: float, only: DataFrame | None = None) -> DataFrame:
    """The pairs among the ids of stored (segments.sketches, cut) whose sets are those of rows: id, and items or text. only: the
    numbers of the stored rows that take part."""
    name = stored.where("n > 0").select("number", "id")
    near = segments.candidates(stored, threshold, only).join(name.toDF("a", "id_a"), "a").join(name.toDF("b", "id_b"), "b").where("id_a <> id_b")
    near = cut(near.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct())
    return segments.counted(near, rows).where((F.col("common") > 0) & (F.col("jaccard") >= threshold))


def rare_item_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """Prefix filter: of n items, ordered rarest first, only n - ceil(t n) + 1 are joined, with the length filter on
    both sides; the sets themselves join only the surviving pairs. Items of one set alone, the first in that order, are
    never joined nor sorted: a set of which m items occur elsewhere joins m - ceil(t n) + 1 of those, or none at all."""
    sized = cut(sets.withColumn("n", F.size("items")).where("n > 0"))
    exploded = sized.select("id", "n", F.explode("items").alias("item"))
    shared = exploded.groupBy("item").agg(F.count("*").alias("df")).where("df > 1")
    order = exploded.join(shared, "item").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("s"))
    take = F.least(F.size("s"), F.size("s") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9).cast("int") + 1)
    prefix = cut(order.where(take > 0).select("id", "n", F.explode(F.transform(F.slice("s", 1, take), lambda x: x["item"])).alias("item")))
    a, b = prefix.toDF("a", "n_a", "item"), prefix.toDF("b", "n_b", "item")
    near = a.join(b, "item").where("a < b").where((F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9)).select("a", "b").distinct()
    x, y = sized.select(F.col("id").alias("a"), F.col("items").alias("x")), sized.select(F.col("id").alias("b"), F.col("items").alias("y"))
    full = near.join(x, "a").join(y, "b").withColumn("common", F.size(F.array_intersect("x", "y")))
    full = full.withColumn("jaccard", F.col("common") / (F.size("x") + F.size("y") - F.col("common")))
    return full.where((F.col("common") > 0) & (F.col("jaccard") >= threshold)).select("a", "b", F.col("common").cast("bigint").alias("common"), "jaccard")


def fingerprints(records: DataFrame, text: str = "text", id_col: str = "record_id", fast: bool = True) -> DataFrame:
    return records.select(F.col(id_col).alias("id"), shingles(F.col(text), fast=fast).alias("items"))


def leader_clusters(records: DataFrame, threshold: float = 0.85, max_rounds: int = 64, texts: DataFrame | None = None) -> DataFrame:
    """records: record_id, normalized_sha256, included and, unless texts has them, text. Adds dedup_cluster, the leader's record_id.

    The sequential scan by record_id is the lexicographically first maximal independent set of the similarity
    graph, which rounds of joins find: a record all of whose earlier neighbours follow leads; one with an
    earlier leader follows. Equal normalised texts are one node per (hash, included); only included nodes have
    shingles. Record ids are hashes, so a few rounds settle; each is cut by a checkpoint. No text is written: texts are
    read once more for the shingles of the pairs that sketches leave. Rows that stay undecided after max_rounds are an error."""
    included = F.coalesce("included", F.lit(True)).alias("included")
    if threshold < segments.LEAST:
        rows = cut(records.select("record_id", "normalized_sha256", included))
        nodes = cut(rows.groupBy("normalized_sha256", "included").agg(F.min("record_id").alias("id")))
        kept = (records if texts is None else texts).select("record_id", "text").join(nodes.where("included").select(F.col("id").alias("record_id")), "record_id", "left_semi").dropDuplicates(["record_id"])
        pairs = cut(similar_pairs(fingerprints(kept), threshold).select("a", "b"))
    else:
        sets = segments.text_rows(records if texts is None else texts)
        if texts is None:
            stored = cut(segments.sketches(segments.text_rows(records.withColumn("included", included), "text", "record_id", "normalized_sha256", "included"), threshold, "normalized_sha256", "included"))
            rows = stored.select(F.col("id").alias("record_id"), "normalized_sha256", "included")
        else:
            stored = cut(segments.sketches(sets, threshold))
            rows = cut(records.select("record_id", "normalized_sha256", included))
        nodes = cut(rows.groupBy("normalized_sha256", "included").agg(F.min("record_id").alias("id")))
        only = stored.select("id", "number").join(nodes.where("included"), "id").groupBy("id").agg(F.min("number").alias("number"))
        pairs = cut(sketched_pairs(stored, sets, threshold, only).select("a", "b"))
        del stored
    twins = nodes.groupBy("normalized_sha256").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("a", "b")
    edges = cut(pairs.unionByName(twins).distinct())
    # a node without an edge leads
    linked = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    state = cut(linked.withColumn("leads", F.lit(None).cast("boolean")))
    for _ in range(max_rounds):
        earlier = edges.join(state.select(F.col("id").alias("a"), F.col("leads").alias("a_leads")), "a")
        seen = earlier.groupBy("b").agg(F.max(F.coalesce("a_leads", F.lit(False))).alias("any_leader"), F.max(F.col("a_leads").isNull()).alias("any_open")).withColumnRenamed("b", "id")
        leads = F.coalesce(F.col("leads"), F.when(F.coalesce("any_leader", F.lit(False)), False).when(~F.coalesce("any_open", F.lit(False)), True))
        state = cut(state.join(seen, "id", "left").select("id", leads.alias("leads")))
        if state.where("leads is null").isEmpty():
            break
    else:
        raise RuntimeError(f"leaders did not settle in {max_rounds} rounds")
    leaders = nodes.join(state.where("not leads"), "id", "left_anti").select(F.col("id").alias("leader"))
    by_hash = nodes.join(leaders, F.col("id") == F.col("leader")).groupBy("normalized_sha256").agg(F.min("id").alias("hash_leader"))
    near = pairs.join(leaders, F.col("a") == F.col("leader")).groupBy("b").agg(F.min("a").alias("near_leader"))
    of_node = nodes.select("id", "normalized_sha256", "included").join(near, F.col("id") == F.col("b"), "left").select("normalized_sha256", "included", "near_leader")
    placed = rows.select("record_id", "normalized_sha256", "included").join(by_hash, "normalized_sha256", "left").join(of_node, ["normalized_sha256", "included"], "left")
    # an equal text that leads and isn't later wins; then the earliest similar leader; else the record leads
    cluster = F.when(F.col("hash_leader") <= F.col("record_id"), F.col("hash_leader")).otherwise(F.coalesce("near_leader", "record_id"))
    return placed.select("record_id", "normalized_sha256", "included", cluster.alias("dedup_cluster"))
