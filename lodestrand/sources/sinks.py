"""Writers: manifests, document lines, numbered shards with digests, ledgers that only grow."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.operators.reports import build_summary


def canonical(df: DataFrame) -> DataFrame:
    """One JSON text per row with sorted keys, also inside structs."""

    def sort(name: str, kind) -> object:
        c = F.col(name)
        if kind.typeName() == "struct":
            return F.struct(*(c[f].alias(f) for f in sorted(kind.fieldNames()))).alias(name.split(".")[-1])
        return c

    fields = {f.name: f.dataType for f in df.schema.fields}
    return df.select(F.to_json(F.struct(*(sort(n, fields[n]) for n in sorted(fields))), {"ignoreNullFields": "false"}).alias("value"))


def write_manifest(records: DataFrame, path: str, replace: bool = False) -> None:
    """Canonical lines in order of record_id; refuses an existing manifest unless it may be replaced."""
    canonical(records.orderBy("record_id")).write.mode("overwrite" if replace else "errorifexists").text(path)


def write_documents(records: DataFrame, path: str, split: str | None = None, replace: bool = False) -> None:
    """{record, text} lines of the included records, sorted."""
    keep = records.where("included") if split is None else records.where(F.col("included") & (F.col("split") == split))
    fields = [c for c in records.columns if c != "text"]
    rows = keep.orderBy("record_id").select(F.struct(*fields).alias("record"), "text")
    rows.write.mode("overwrite" if replace else "errorifexists").json(path)


def number_shards(records: DataFrame, max_records: int = 1000) -> DataFrame:
    """Adds shard: rows are cut by the order of record_id. The numbers come from per-bucket counts of a range of id
    prefixes and offsets, so no task sorts all rows."""
    bucket = F.substring("record_id", 1, 3)
    sizes = records.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    # at most 4,096 buckets of hexadecimal ids; their running sum is one small sort
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy("record_id"))
    rows = records.withColumn("bucket", bucket).join(before.select("bucket", "before"), "bucket")
    return rows.withColumn("shard", F.floor((F.col("before") + inside - 1) / max_records).cast("bigint")).drop("bucket", "before")


def shard_index(sharded: DataFrame, line: str = "line") -> DataFrame:
    """shard, records, sha256 over a shard's lines in order; a shard is bounded by max_records."""
    return sharded.groupBy("shard").agg(F.count("*").cast("bigint").alias("records"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("record_id", F.col(line).alias("l")))), lambda x: x.l), "\n"), 256).alias("sha256"))


def write_shards(records: DataFrame, path: str, max_records: int = 1000) -> DataFrame:
    """Numbered folders of JSON lines, sorted inside; returns their index."""
    rows = number_shards(records, max_records)
    lines = rows.withColumn("line", F.to_json(F.struct(*sorted(records.columns))))
    lines.select("shard", "record_id", F.col("line").alias("value")).repartition("shard").sortWithinPartitions("shard", "record_id").select("shard", "value").write.partitionBy("shard").text(path)
    return shard_index(lines)


def stale_shards(index: DataFrame, found: DataFrame) -> DataFrame:
    """Shards whose records or digest aren't those of the index, or that one side lacks."""
    both = index.alias("i").join(found.alias("f"), "shard", "full")
    return both.where(~(F.col("i.records").eqNullSafe(F.col("f.records")) & F.col("i.sha256").eqNullSafe(F.col("f.sha256")))).select("shard")


def append_ledger(rows: DataFrame, path: str, key: str) -> None:
    """Appends rows to a JSON-lines ledger; ids that exist already are an error."""
    spark = rows.sparkSession
    # asked of the file system the path is on, which may be any
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        seen = spark.read.schema(rows.schema).json(path).select(key)
        if not rows.join(seen, key, "left_semi").isEmpty():
            raise ValueError(f"{key} exists already; append a distinct decision")
    if not rows.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} repeats")
    rows.write.mode("append").json(path)


def write_token_shard(rows: DataFrame, path: str) -> None:
    """Token records as JSON lines."""
    rows.write.mode("errorifexists").json(path)


def append_metrics(rows: DataFrame, path: str) -> None:
    """Metric lines with their utilisation, added behind those there are."""
    used = F.when(F.col("padded_tokens") > 0, F.col("batch_tokens") / F.col("padded_tokens")).otherwise(F.lit(0.0))
    rows.withColumn("token_utilization", used).write.mode("append").json(path)


def write_build(records: DataFrame, texts: DataFrame, folder: str, dry_run: bool = False, replace: bool = False) -> DataFrame:
    """Manifest and included documents of a build below a folder, unless it is a dry run; its summary either way."""
    if not dry_run:
        write_manifest(records, f"{folder}/manifest", replace)
        write_documents(records.join(texts, "record_id", "left"), f"{folder}/documents", replace=replace)
    return build_summary(records)


def write_report(value: dict, path: str) -> str:
    """A small JSON report, moved in place at once; its sha256."""
    data = json.dumps(value, sort_keys=True, separators=(",", ":")).encode()
    target = Path(path)
    with tempfile.NamedTemporaryFile(dir=target.parent, delete=False) as f:
        f.write(data)
    os.replace(f.name, target)
    return hashlib.sha256(data).hexdigest()


def manifest_hash(value: dict) -> str:
    """sha256 of the canonical JSON of a shard manifest."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
