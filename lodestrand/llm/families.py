"""Problem 5: splits that keep related records together.

Documents with the same repository_id or the same dedup_cluster (trimmed, lower case, blanks are null) are
tied, directly or through others. Components are found over distinct keys, never over documents: each
cluster links its repositories to its smallest one, and labels of repositories are lowered by alternating
large-star and small-star steps, each cut by a checkpoint, until no edge changes (logarithmic rounds).

Method of the split: largest differencing. The components' weights are combined into many equal bins by
repeatedly joining the two partitions of the largest spread, the heaviest bins of one with the lightest of
the other; whole bins are then dealt to the splits in the target shares. Components are told apart by their
weight alone, so the driver sees how many there are of each weight, whatever the corpus holds, and every component
stays whole.

Defined results: a document without repository and cluster is its own component; null documents' texts
don't matter; repeated rows weigh as often as they occur; ties go to the smaller name; shares are taken
relative to their sum; an empty table has no families and no assignments.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.operators.components import connected
from lodestrand.session import cut


def key(column: str) -> Column:
    k = F.lower(F.trim(column))
    return F.when(k != "", k)


def keys_of(documents: DataFrame) -> DataFrame:
    return documents.select(key("repository_id").alias("repository_id"), key("dedup_cluster").alias("cluster"))


def repository_families(documents: DataFrame) -> DataFrame:
    """repository_id, family_id of repositories that can't be separated from another one."""
    ties = keys_of(documents).where("repository_id is not null and cluster is not null").distinct()
    least = ties.groupBy("cluster").agg(F.min("repository_id").alias("v"), F.max("repository_id").alias("top")).where("v <> top")
    edges = ties.join(least, "cluster").select(F.col("repository_id").alias("u"), "v").where("u <> v").distinct()
    return connected(edges).select(F.col("node").alias("repository_id"), F.col("root").alias("family_id"))


def document_components(documents: DataFrame) -> DataFrame:
    """doc_id, component: r:<family or repository>, c:<cluster> or d:<document>."""
    rows = documents.select("doc_id", key("repository_id").alias("repository_id"), key("dedup_cluster").alias("cluster"))
    family = cut(repository_families(documents))
    home = (
        rows.where("repository_id is not null and cluster is not null").select("cluster", "repository_id").groupBy("cluster").agg(F.min("repository_id").alias("home"))
    )
    # only documents without a repository look their cluster up, and only clusters that have such documents stay
    lost = rows.where("repository_id is null and cluster is not null")
    home = home.join(lost.select("cluster").distinct(), "cluster", "left_semi")
    found = lost.join(home, "cluster", "left").select("doc_id", F.col("home").alias("repository_id"), "cluster")
    known = rows.where("repository_id is not null").select("doc_id", "repository_id", "cluster").unionByName(found)
    placed = known.join(family, "repository_id", "left").select(
        "doc_id", F.when(F.col("repository_id").isNotNull(), F.concat(F.lit("r:"), F.coalesce("family_id", "repository_id"))).otherwise(F.concat(F.lit("c:"), F.col("cluster"))).alias("component")
    )
    alone = rows.where("repository_id is null and cluster is null").select("doc_id", F.concat(F.lit("d:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("component"))
    return placed.unionByName(alone)


def largest_differencing(weights: list[int], bins: int) -> list[int]:
    """The bin of each weight: repeatedly the two partitions of the largest spread are combined head to tail."""
    heap: list[tuple[int, int, np.ndarray]] = []
    # a partition is its bins' sums, lightest first, and for each a root in a forest of merged bins
    parent = np.arange(len(weights) * 1)
    roots: dict[int, np.ndarray] = {}
    for i, w in enumerate(weights):
        sums = np.zeros(bins, np.int64)
        sums[-1] = w
        members = np.full(bins, -1)
        members[-1] = i
        roots[i] = members
        heap.append((-w, i, sums))
    heapq.heapify(heap)

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    if not heap:
        return []
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heapq.heappop(heap)
        sums, x, y = a + b[::-1], roots.pop(i), roots.pop(j)[::-1]
        members = np.where(x < 0, y, x)
        for k in np.flatnonzero((x >= 0) & (y >= 0)).tolist():
            p, q = top(int(x[k])), top(int(y[k]))
            parent[q] = p
        order = np.argsort(sums, kind="stable")
        sums = sums[order]
        roots[i] = members[order]
        heapq.heappush(heap, (-int(sums[-1] - sums[0]), i, sums - 0))
    ((_, i, _),) = heap
    bin_of = {top(int(m)): k for k, m in enumerate(roots[i].tolist()) if m >= 0}
    return [bin_of[top(k)] for k in range(len(weights))]


def deal(sums: list[int], shares: list[tuple[str, float]]) -> list[str]:
    """The split of each bin: heaviest first, to the split that lacks most of its share."""
    total, whole = sum(sums), sum(s for _, s in shares)
    lack = {name: total * s / whole for name, s in shares}
    out = [""] * len(sums)
    for k in sorted(range(len(sums)), key=lambda k: (-sums[k], k)):
        name = max(lack, key=lambda n: (lack[n], n))
        out[k] = name
        lack[name] -= sums[k]
    return out


def positions(weights: DataFrame, buckets: int = 4096) -> DataFrame:
    """Adds position: each component's number among those of its weight, from 0. Numbers come from counts of hash buckets and
    ranks inside them, so no task sorts all components of a weight."""
    rows = weights.withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(buckets)))
    running = Window.partitionBy("weight").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("weight", "bucket").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("weight", "bucket").orderBy("component")) - 1
    return rows.withColumn("rank", rank).join(before, ["weight", "bucket"]).select("component", "weight", (F.col("before") + F.col("rank")).alias("position"))


def assign_splits(spark: SparkSession, documents: DataFrame, targets: DataFrame, bins: int = 100) -> DataFrame:
    """doc_id, component, split: the new split of every document; a component lies in one split.

    Of every weight, as many components as fill all bins alike are dealt round; so are they by differencing, which combines
    `bins` equal weights without a difference. The driver gets how many components have each weight (at most the square root of
    twice the documents many), and differences what is left, under `bins` components of each weight."""
    shares = sorted((r["split"], float(r["share"])) for r in targets.select("split", "share").dropna().collect() if r["share"] > 0)
    placed = cut(document_components(documents))
    weights = cut(placed.groupBy("component").agg(F.count("*").alias("weight")))
    counts = sorted((r["weight"], r["count"]) for r in weights.groupBy("weight").count().collect())
    if not counts or not shares:
        return placed.select("doc_id", "component", F.lit(None).cast("string").alias("split"))
    left = [(w, k) for w, n in counts for k in range(n % bins)]
    chosen = largest_differencing([w for w, _ in left], bins)
    sums = np.bincount(chosen, weights=[w for w, _ in left], minlength=bins).astype(int) if left else np.zeros(bins, int)
    sums = (sums + sum(w * (n // bins) for w, n in counts)).tolist()
    split = deal(sums, shares)
    rest: dict[int, list[str]] = {w: [] for w, _ in counts}
    for (w, _), k in zip(left, chosen):
        rest[w].append(split[k])
    # one row for each weight
    dealt = spark.createDataFrame([(w, n - n % bins, rest[w]) for w, n in counts], "weight bigint, level bigint, others array<string>")
    all_bins = F.array(*map(F.lit, split))
    which = F.when(F.col("position") < F.col("level"), F.element_at(all_bins, (F.col("position") % bins + 1).cast("int"))).otherwise(F.try_element_at("others", (F.col("position") - F.col("level") + 1).cast("int")))
    named = cut(positions(weights).join(F.broadcast(dealt), "weight").select("component", "weight", which.alias("split")))
    # fewer than a thousand components hold more than a thousandth of all documents each; they are broadcast, so none is a hot key
    heavy = F.col("weight") * 1000 > sum(w * n for w, n in counts)
    first = placed.join(F.broadcast(named.where(heavy).select("component", F.col("split").alias("heavy"))), "component", "left")
    others = first.where("heavy is null").drop("heavy").join(named.where(~heavy).select("component", "split"), "component")
    return first.where("heavy is not null").withColumnRenamed("heavy", "split").select("doc_id", "component", "split").unionByName(others.select("doc_id", "component", "split"))


def split_shares(assigned: DataFrame) -> DataFrame:
    total = assigned.agg(F.count("*").alias("total"))
    return assigned.groupBy("split").agg(F.count("*").alias("documents")).join(total).select("split", "documents", (F.col("documents") / F.col("total")).alias("share"))
