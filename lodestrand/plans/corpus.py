"""The corpus build as one plan: records from files, reasons, duplicates, clusters, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand import schemas
from lodestrand.functions import paths, secrets
from lodestrand.functions import text as T
from lodestrand.operators import dedup, splits
from lodestrand.operators.checks import check_licenses, path_parts
from lodestrand.operators.governance import ACCEPTED, repository_license
from lodestrand.session import cut

VERSION = "1"
#: What a files table may leave out, with the value that stands for it.
OPTIONAL = {"symlink": "boolean", "invalid_utf8": "boolean", "content_sha256": "string", "size_bytes": "bigint", "scope": "array<string>"}


def with_text(files: DataFrame, max_file_bytes: int) -> DataFrame:
    """files with every optional column, `body` (empty for links and oversized files), their hash and record_id."""
    for name, kind in OPTIONAL.items():
        if name not in files.columns:
            files = files.withColumn(name, F.lit(None).cast(kind))
    size = F.coalesce("size_bytes", F.octet_length("text").cast("bigint"), F.lit(0).cast("bigint"))
    rows = files.withColumn("size_bytes", size).withColumn("oversized", F.col("size_bytes") > max_file_bytes)
    rows = rows.withColumn("body", F.when(F.col("oversized") | F.coalesce("symlink", F.lit(False)), F.lit("")).otherwise(F.coalesce("text", F.lit(""))))
    # of an oversized file the hash is over its first max_file_bytes; a reader that has read no more gives it itself
    rows = rows.withColumn("content_sha256", F.coalesce("content_sha256", F.sha2(F.when(F.col("oversized"), F.substring(F.encode("text", "utf-8"), 1, max_file_bytes)).otherwise(F.encode(F.coalesce("text", F.lit("")), "utf-8")), 256)))
    return rows.withColumn("record_id", T.record_id(F.col("repository_id"), F.col("relative_path"), F.col("content_sha256")))


def file_records(
    files: DataFrame, max_file_bytes: int = 1_000_000, max_path_depth: int = 32, accepted: tuple[str, ...] = ACCEPTED, scope: list[str] | None = None, detector: secrets.Detector = secrets.findings, version: str = VERSION
) -> DataFrame:
    """files: repository_id, source_uri, commit_sha, retrieved_at, relative_path, text, and any of OPTIONAL. One record per
    file with all reasons for leaving it out; nothing is dropped, so every decision can be audited. No text is passed on."""
    check_licenses(set(accepted), ACCEPTED)
    rows = with_text(files, max_file_bytes)
    path, body = F.col("relative_path"), F.col("body")
    language = paths.language_reason(path, body)
    generated = paths.generated_reasons(path, body)
    found = detector(path, body)
    quality = T.quality_reasons(body)
    licences = repository_license(rows.select("repository_id", "relative_path", F.col("body").alias("text")), accepted).select("repository_id", F.col("spdx").alias("license_spdx"), F.col("status").alias("license_status"))
    rows = rows.withColumns({"found": found, "generated": generated, "quality": quality, "quality_metrics": T.quality_metrics(body), "language_reason": language})
    none = F.array().cast("array<string>")
    flags = T.reasons(
        (~paths.in_scope(path, scope), "outside-approved-scope"), (F.coalesce("symlink", F.lit(False)), "symlink"), (F.col("oversized") & ~F.coalesce("symlink", F.lit(False)), "oversized"),
        (F.size(path_parts(path)) > max_path_depth, "path-depth-limit"), (F.coalesce("invalid_utf8", F.lit(False)), "invalid-utf8"),
    )
    why = T.all_reasons(
        paths.path_reasons(path), flags, F.when(~F.col("language_reason").isin("typescript", "metadata"), F.array("language_reason")).otherwise(none), F.col("generated"), paths.harness_reasons(path, body),
        F.transform("found", lambda c: F.concat(F.lit("secret:"), c)), F.col("quality"),
    )
    suffix = F.lower(F.regexp_extract(paths.name_of(path), r".(\.[^.]+)$", 1))
    contextual = paths.name_of(path).isin("package.json", "tsconfig.json")
    rows = rows.withColumn("exclusion_reasons", why).select(
        "record_id", "repository_id", "source_uri", "commit_sha", "retrieved_at", "relative_path",
        F.when(suffix.isin(".ts", ".tsx"), "typescript").when(contextual, "metadata").otherwise("other").alias("language"), paths.source_type(path).alias("source_type"), "size_bytes",
        F.when(body == "", 0).otherwise(F.size(T.lines(body))).alias("line_count"), "content_sha256", F.when(F.array_contains("exclusion_reasons", "oversized"), "prefix").otherwise("full").alias("content_hash_scope"),
        T.sha256(T.normalized(body)).alias("normalized_sha256"), F.round(T.quality_score(F.size("quality"), F.col("quality_metrics.repetition_ratio")), 6).alias("quality_score"), "quality_metrics",
        F.when(F.size("found") > 0, "rejected").otherwise("clean").alias("secret_scan_status"), F.when(F.size("generated") > 0, "generated").otherwise("human").alias("generated_status"),
        F.lit("").alias("dedup_cluster"), F.lit("excluded").alias("split"), F.lit(version).alias("pipeline_version"), "exclusion_reasons",
    )
    # joined last, so that records are shuffled and no texts
    licence = F.when(F.col("license_status") != "accepted", F.array(F.concat(F.lit("license:"), F.col("license_status")))).otherwise(none)
    rows = rows.join(licences, "repository_id", "left").withColumn("exclusion_reasons", T.all_reasons(F.col("exclusion_reasons"), licence))
    return rows.withColumn("included", F.size("exclusion_reasons") == 0).select(*schemas.FILE_RECORD.fieldNames())


def without_duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of the included records of a key all but the first get the reason `duplicate` and aren't included any more."""
    marked = dedup.mark_duplicates(rows, key, included=F.col("included"))
    why = F.when(F.col("is_duplicate"), T.all_reasons(F.col("exclusion_reasons"), F.array(F.lit("duplicate")))).otherwise(F.col("exclusion_reasons"))
    return marked.withColumn("exclusion_reasons", why).withColumn("included", F.col("included") & ~F.col("is_duplicate")).drop("is_duplicate")


def build(files: DataFrame, threshold: float = 0.85, seed: int = 42, train: float = 0.9, validation: float = 0.05, by_family: bool = False, max_file_bytes: int = 1_000_000, **options) -> DataFrame:
    """Records (schemas.FILE_RECORD) with duplicates marked, clusters and splits. Checkpoints hold records and pairs, never
    texts: those are read again for the shingles, and by whoever writes the included ones (included_texts)."""
    records = cut(file_records(files, max_file_bytes, **options).dropDuplicates(["record_id"]))
    # what is decided on: the other fields are joined once, at the end
    slim = records.select("record_id", "repository_id", "normalized_sha256", "included", F.array().cast("array<string>").alias("exclusion_reasons"))
    # duplicates within a repository lose their shingles before clusters are made, those across repositories don't
    marked = cut(without_duplicates(slim, ["repository_id", "normalized_sha256"]))
    texts = with_text(files, max_file_bytes).select("record_id", F.col("body").alias("text"))
    clusters = cut(dedup.leader_clusters(marked, threshold, texts=texts).select("record_id", "dedup_cluster"))
    clustered = cut(without_duplicates(marked.join(clusters, "record_id"), ["normalized_sha256"]))
    if not by_family:
        placed = splits.cluster_split(clustered, seed, train, validation)
    else:
        families = splits.family_split(clustered, seed, train, validation).select("repository_id", F.col("split").alias("s"))
        placed = clustered.join(families, "repository_id", "left").withColumn("split", F.when(F.col("included"), F.col("s")).otherwise("excluded")).drop("s")
    placed = placed.select("record_id", "dedup_cluster", "included", "split", F.col("exclusion_reasons").alias("more"))
    out = records.drop("dedup_cluster", "included", "split").join(placed, "record_id").withColumn("exclusion_reasons", T.all_reasons(F.col("exclusion_reasons"), F.col("more")))
    return out.select(*schemas.FILE_RECORD.fieldNames())


def included_texts(records: DataFrame, files: DataFrame, max_file_bytes: int = 1_000_000) -> DataFrame:
    """The included records with their texts, for the sinks."""
    texts = with_text(files, max_file_bytes).select("record_id", F.col("body").alias("text")).dropDuplicates(["record_id"])
    return records.where("included").join(texts, "record_id")
