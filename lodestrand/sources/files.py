"""Readers: repositories' files, JSON lines with strict schemas, shards with offsets, task files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Names that mark a folder as a repository of its own (fixed values).
REPOSITORY_MARKS = ("LICENSE", "COPYING", "package.json", "tsconfig.json")


class BoundError(ValueError):
    """A declared bound of a scan was exceeded."""


def repository_files(spark: SparkSession, root: str, max_files: int = 20_000, max_depth: int = 32, max_file_bytes: int = 1_048_576, max_total_bytes: int = 1 << 34) -> DataFrame:
    """relative_path, length, text, reasons of all files below root. Oversized files keep an empty text, invalid UTF-8 is
    replaced, both with a reason; too deep ones are left out. More files or bytes than allowed are an error.

    Lengths come from the listing; contents are read once, and never beyond the limit into a text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + "/" + base.lstrip("/") + "/", "")
    rows = files.select(rel.alias("relative_path"), "length", "content").where(F.size(F.split("relative_path", "/")) <= max_depth)
    totals = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.least("length", F.lit(max_file_bytes + 1))), F.lit(0)).alias("b")).first()
    if totals["n"] > max_files:
        raise BoundError(f"max_files: {totals['n']} files, {max_files} allowed")
    if totals["b"] > max_total_bytes:
        raise BoundError(f"max_total_bytes: {totals['b']} bytes, {max_total_bytes} allowed")
    big = F.col("length") > max_file_bytes
    bad = ~big & ~F.is_valid_utf8(F.col("content").cast("string"))
    reasons = F.filter(F.array(F.when(big, "oversized"), F.when(bad, "invalid-utf8")), lambda x: x.isNotNull())
    return rows.select("relative_path", "length", F.when(big, F.lit("")).otherwise(F.make_valid_utf8(F.col("content").cast("string"))).alias("text"), reasons.alias("reasons"), F.sha2(F.when(big, F.substring("content", 1, max_file_bytes)).otherwise(F.col("content")), 256).alias("content_sha256"), F.when(big, "prefix").otherwise("full").alias("content_hash_scope"))


def repositories(files: DataFrame) -> DataFrame:
    """Adds repository: '' if the root itself is one, else the first folder of the path."""
    root = files.where(F.col("relative_path").isin(*REPOSITORY_MARKS)).agg(F.count("*").alias("root_marks"))
    return files.join(F.broadcast(root)).withColumn("repository", F.when(F.col("root_marks") > 0, "").otherwise(F.regexp_extract("relative_path", r"^([^/]+)/", 1))).drop("root_marks")


def strict_json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines with exactly the schema's keys; a missing, unknown or malformed value fails the read."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    keys = F.array_sort(F.json_object_keys("value"))
    wanted = F.array(*(F.lit(n) for n in sorted(schema.fieldNames())))
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    ok = F.when(keys.isNull() | (keys != wanted), F.raise_error(F.concat(F.lit("unexpected or missing keys in: "), F.substring("value", 1, 80)))).otherwise(parsed)
    return rows.select(ok.alias("r")).select("r.*")


def token_shard(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Token records of a shard, each line by the schema or an error."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def shard_lines(spark: SparkSession, path: str, schema: StructType, max_line_bytes: int = 16_777_216) -> DataFrame:
    """shard, record_offset, record_id and the parsed line. Offsets count a file's lines, so every file is one partition's
    work; files are shards of bounded size (see sinks.write_shards)."""
    rows = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("shard"), F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("record_offset", "line"))
    checked = F.when(F.octet_length("line") > max_line_bytes, F.raise_error(F.lit("a line exceeds the limit"))).otherwise(F.from_json("line", schema, {"mode": "FAILFAST"}))
    parsed = rows.withColumn("value", checked)
    needs = F.when(F.col("value.record.record_id").isNull() | F.col("value.text").isNull(), F.raise_error(F.concat(F.lit("no record or text at line "), (F.col("record_offset") + 1).cast("string"))).cast("string")).otherwise(F.col("value.record.record_id"))
    shards = rows.select("shard").distinct().withColumn("shard_index", F.expr("row_number() over (order by shard) - 1"))
    return parsed.join(F.broadcast(shards), "shard").select("shard_index", "shard", F.col("record_offset").cast("bigint").alias("record_offset"), needs.alias("record_id"), "value")


def tasks(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Evaluation tasks of one JSON file: an object with `tasks`, or a list."""
    raw = spark.read.option("wholetext", "true").text(path).select(F.coalesce(F.get_json_object("value", "$.tasks"), F.col("value")).alias("t"))
    return raw.select(F.explode(F.from_json("t", f"array<{schema.simpleString()}>", {"mode": "FAILFAST"})).alias("t")).select("t.*")


def configuration(path: str, keys: dict[str, type]) -> dict:
    """A JSON (or YAML, where the library is installed) object with exactly these keys and types."""
    import json

    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        value = json.loads(text)
    except ValueError:
        import yaml

        value = yaml.safe_load(text)
    if not isinstance(value, dict) or set(value) != set(keys):
        raise ValueError(f"{path} must have exactly the keys {sorted(keys)}")
    for k, kind in keys.items():
        if not isinstance(value[k], kind) or (kind is int and isinstance(value[k], bool)):
            raise ValueError(f"{path}: {k} must be {kind.__name__}")
    return value


def known_only(wanted: list[str], configured: list[str]) -> list[str]:
    """The wanted names, or an error that lists those that aren't configured."""
    unknown = sorted(set(wanted) - set(configured))
    if unknown:
        raise ValueError(f"unknown sources: {', '.join(unknown)}")
    return wanted


def oversize(column: Column, limit: int) -> Column:
    return F.octet_length(column) > limit
