"""Problem 8: fill containers of fixed capacity with texts, measured in tokens.

Method: sum-of-squares online packing. Each stream keeps a level array n[h], how many open containers are
filled to h; an item goes to the level for which the sum of the squared n[h] (0 < h < capacity) is least
afterwards, closing a container that becomes full. Ties go to the fuller container.

Documents are hashed to streams of a bounded number of items, which pack independently and in order of
doc_id, so any number of executors works at once and a lost task repeats exactly. The containers that a
stream leaves open are few for its length; their items are packed once more, largest first, in streams that
hold the rests of many earlier ones, and a last time where there was more than one such stream.

Defined results: a text longer than the capacity (and no other) is split into whole containers and a last
piece that is packed like a short text. Null and empty texts have 0 tokens and take no room; they get one
row with piece 0, length 0 and a null container. Repeated rows are items of their own, told apart by their
order. No capacities or no documents: no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm.tokens import TOKENIZER_DIR, token_counts
from lodestrand.session import cut

#: Items of one stream, on average. With 24 bytes an item a stream stays far below a task's memory.
STREAM_ITEMS = 100_000


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, 0 < size <= capacity, packed in order."""
    n = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, made = np.empty(len(sizes), np.int64), 0
    never = np.int64(1) << 60
    for i, s in enumerate(sizes.tolist()):
        # for a container at h, n[h] falls by one and n[h + s] grows by one; at h = 0 and h + s = capacity nothing is counted
        left, right = n[: capacity - s + 1], n[s:]
        cost = 2 * (right - left) + 2
        cost[left == 0] = never
        cost[0] = 2 * n[s] + 1 if s < capacity else 0
        if s < capacity and left[-1]:
            cost[-1] = 1 - 2 * left[-1]
        h = capacity - s - int(cost[::-1].argmin())
        if h:
            c = open_at[h].pop()
            n[h] -= 1
        else:
            c, made = made, made + 1
        if h + s < capacity:
            n[h + s] += 1
            open_at[h + s].append(c)
        out[i] = c
    return out


def _streams(items: DataFrame, capacity: int, tag: str, largest_first: bool) -> DataFrame:
    """items: stream, item, size. Adds the container's name and its fill level at the end of the stream."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", "item"], ascending=[False, True]) if largest_first else part.sort_values("item")
        bins = sum_of_squares(part["size"].to_numpy(), capacity)
        fill = np.bincount(bins, weights=part["size"].to_numpy(), minlength=1).astype(np.int64)
        names = np.array([f"{tag}-{part['stream'].iloc[0]}-{b}" for b in range(len(fill))], object)
        return pd.DataFrame({"item": part["item"].to_numpy(), "size": part["size"].to_numpy(), "container_id": names[bins], "fill": fill[bins]})

    return items.groupBy("stream").applyInPandas(pack, "item string, size bigint, container_id string, fill bigint")


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """doc_id, copy, piece, start, length: whole texts, or capacity-long pieces and a last one of longer texts."""
    c = F.lit(capacity).cast("bigint")
    return sizes.select(
        "doc_id", "copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.expr(f"(n_tokens - 1) div {capacity}")))).alias("piece"), "n_tokens"
    ).select("doc_id", "copy", "piece", (F.col("piece") * c).alias("start"), F.least(F.col("n_tokens") - F.col("piece") * c, c).alias("length"))


def pack_sizes(sizes: DataFrame, capacity: int, stream_items: int = STREAM_ITEMS, rounds: int = 2) -> DataFrame:
    """sizes: doc_id, copy, n_tokens. One row for each placed piece: doc_id, piece, start, length, container_id."""
    parts = pieces(sizes, capacity)
    full = parts.where(F.col("length") == capacity).withColumn("container_id", F.concat_ws("-", F.lit("whole"), "doc_id", "copy", "piece"))
    none = parts.where("length = 0").withColumn("container_id", F.lit(None).cast("string"))
    items = parts.where(f"length > 0 and length < {capacity}").withColumn("item", F.concat_ws("/", F.lpad(F.col("doc_id").cast("string"), 20, "0"), "copy", "piece"))
    items = cut(items)
    left, settled = items.select("item", F.col("length").alias("size")), None
    for k in range(rounds + 1):
        n = left.count()
        before, streams = (streams if k else 0), max(1, -(-n // stream_items))
        stream = F.pmod(F.xxhash64("item", F.lit(k)), F.lit(streams))
        packed = cut(_streams(left.select(stream.alias("stream"), "item", "size"), capacity, f"round{k}", k > 0))
        last = k == rounds or (k > 0 and before == 1)
        done = packed if last else packed.where(f"fill = {capacity}")
        settled = done.select("item", "container_id") if settled is None else settled.unionByName(done.select("item", "container_id"))
        if last:
            break
        left = packed.where(f"fill < {capacity}").select("item", "size")
    packed = items.join(settled, "item")
    columns = ["doc_id", "piece", "start", "length", "container_id"]
    return packed.select(columns).unionByName(full.select(columns)).unionByName(none.select(columns))


def pack_documents(
    spark: SparkSession, documents: DataFrame, limits: DataFrame, directory: str = TOKENIZER_DIR, stream_items: int = STREAM_ITEMS
) -> DataFrame:
    """tokenizer, capacity, doc_id, piece, start, length, container_id for each row of limits (a few rows, one a task at training)."""
    wanted = sorted({(r["tokenizer"], int(r["capacity"])) for r in limits.select("tokenizer", "capacity").dropna().collect() if r["capacity"] > 0})
    out = None
    for tokenizer in sorted({t for t, _ in wanted}):
        counts = token_counts(spark, documents, tokenizer, directory)
        sizes = cut(counts.withColumn("copy", F.lit(0)) if _unique(documents) else number_copies(counts))
        for t, capacity in wanted:
            if t == tokenizer:
                one = pack_sizes(sizes, capacity, stream_items).select(F.lit(t).alias("tokenizer"), F.lit(capacity).cast("bigint").alias("capacity"), "*")
                out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "tokenizer string, capacity bigint, doc_id bigint, piece bigint, start bigint, length bigint, container_id string")
    return out


def _unique(documents: DataFrame) -> bool:
    return documents.groupBy("doc_id").count().where("count > 1").isEmpty()


def number_copies(counts: DataFrame) -> DataFrame:
    """Rows that share a doc_id get copy 0, 1, ..; an id holds few rows, but one that held many would still only sort."""
    from pyspark.sql import Window

    return counts.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id").orderBy("n_tokens")) - 1)


def container_fill(packed: DataFrame) -> DataFrame:
    """Per capacity: containers, placed tokens and the share of room that is used."""
    return (
        packed.where("container_id is not null").groupBy("tokenizer", "capacity", "container_id").agg(F.sum("length").alias("fill"))
        .groupBy("tokenizer", "capacity").agg(F.count("*").alias("containers"), F.sum("fill").alias("tokens"), (F.sum("fill") / (F.count("*") * F.col("capacity"))).alias("utilization"))
    )
