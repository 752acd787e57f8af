"""Generated or held-out texts against a corpus."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Products of lengths beyond this are not compared (a fixed limit of the measure).
CELLS = 2_000_000


def exact_matches(generated: DataFrame, corpus: DataFrame) -> DataFrame:
    """Rows of `generated` whose whole text occurs in `corpus`."""
    seen = corpus.where("text is not null").select(F.sha2("text", 256).alias("h")).distinct()
    return generated.withColumn("h", F.sha2("text", 256)).join(seen, "h", "left_semi").drop("h")


def nearest_lengths(queries: DataFrame, corpus: DataFrame, k: int = 16) -> DataFrame:
    """task_id, candidate_text hash, rank: per query the k corpus texts of the nearest length, ties by hash.

    Every distinct length keeps its k smallest hashes, which bounds what a length holds; a query then only meets
    the lengths within the k-th nearest, found by ranking the distinct lengths on both of its sides."""
    texts = corpus.where("text is not null").select(F.sha2("text", 256).alias("h"), F.length("text").alias("len"))
    per_length = texts.withColumn("copy", F.row_number().over(Window.partitionBy("len").orderBy("h"))).where(F.col("copy") <= k)
    wanted = queries.select("task_id", F.length("text").alias("want")).distinct()
    lengths = per_length.select("len").distinct()
    # ordered merge of query and corpus lengths: neighbours in one sorted column, k to each side
    both = lengths.select(F.col("len").alias("l"), F.lit(1).alias("real")).unionByName(wanted.select(F.col("want").alias("l"), F.lit(0).alias("real")).distinct())
    order = both.groupBy("l").agg(F.max("real").alias("real"))
    w = Window.orderBy("l")
    ranked = order.withColumn("pos", F.sum("real").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = wanted.join(ranked.select(F.col("l").alias("want"), "pos"), "want")
    spread = at.select("task_id", "want", F.explode(F.sequence(F.col("pos") - k, F.col("pos") + k)).alias("pos"))
    near = spread.join(ranked.where("real = 1").select("pos", F.col("l").alias("len")), "pos")
    rows = near.join(per_length, "len").withColumn("gap", F.abs(F.col("len") - F.col("want")))
    best = rows.withColumn("rank", F.row_number().over(Window.partitionBy("task_id").orderBy("gap", "h", "copy"))).where(F.col("rank") <= k)
    return best.select("task_id", F.col("h").alias("candidate_sha256"), F.col("len").alias("candidate_length"), "rank")


def common_substring(a: str, b: str) -> int:
    """The length of the longest common substring; 0 beyond CELLS. A suffix automaton of the shorter text, linear in both."""
    if not a or not b or len(a) * len(b) > CELLS:
        return 0
    if len(a) > len(b):
        a, b = b, a
    step, link, size, last = [{}], [-1], [0], 0
    for c in a:
        cur = len(step)
        step.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[q] == size[p] + 1:
                link[cur] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    best = at = n = 0
    for c in b:
        while at and c not in step[at]:
            at = link[at]
            n = size[at]
        if c in step[at]:
            at, n = step[at][c], n + 1
        best = max(best, n)
    return best


def longest_spans(pairs: DataFrame) -> DataFrame:
    """pairs: task_id, a, b. task_id, span: the longest common substring over a task's pairs."""

    def lcs(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([common_substring(x or "", y or "") for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())

    return pairs.select("task_id", F.arrow_udf(lcs, "int")("a", "b").alias("span")).groupBy("task_id").agg(F.max("span").alias("span"))
