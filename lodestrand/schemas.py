"""Schemas of the corpus tables: one source of truth for readers, writers and checks."""

from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType

KINDS = {"string": StringType(), "bigint": LongType(), "int": IntegerType(), "double": DoubleType(), "boolean": BooleanType(), "strings": ArrayType(StringType()), "digests": MapType(StringType(), StringType())}


def struct(fields: str, **nested: DataType) -> StructType:
    """A schema from "name kind, .."; a kind is one of KINDS or the name of a nested type. Needs no session."""
    kinds = KINDS | nested
    return StructType([StructField(n, kinds[k]) for n, k in (x.split() for x in fields.split(", "))])


QUALITY = struct("size_bytes bigint, line_count bigint, mean_line_length double, max_line_length bigint, comment_ratio double, whitespace_ratio double, identifier_diversity double, repetition_ratio double")
FILE_RECORD = struct(
    "record_id string, repository_id string, source_uri string, commit_sha string, retrieved_at string, license_spdx string, license_status string, relative_path string, language string, "
    "source_type string, size_bytes bigint, line_count int, content_sha256 string, content_hash_scope string, normalized_sha256 string, quality_score double, quality_metrics quality, "
    "secret_scan_status string, generated_status string, dedup_cluster string, split string, pipeline_version string, included boolean, exclusion_reasons strings",
    quality=QUALITY,
)
APPROVAL = struct("approval_id string, source_id string, source_uri string, commit_sha string, license_spdx string, status string, approved_by string, approved_at string, scope strings, notes string, supersedes string")
RECEIPT = struct("schema_version int, source_id string, source_uri string, commit_sha string, tree_sha256 string, file_count bigint, total_bytes bigint, license_sha256 digests, retrieved_at string, git_version string")
AUTHORIZATION = struct(
    "schema_version int, authorization_id string, run_name string, training_config_sha256 string, model_config_sha256 string, manifest_sha256 string, corpus_sha256 string, tokenizer_sha256 string, "
    "max_tokens bigint, status string, approved_by string, approved_at string, notes string"
)
DOCUMENT_LINE = struct("record record, text string", record=FILE_RECORD)
METRICS = struct(
    "step bigint, tokens_processed bigint, loss double, learning_rate double, gradient_norm double, tokens_per_second double, batch_tokens bigint, sequence_length bigint, wall_clock_seconds double, "
    "loss_tokens bigint, padded_tokens bigint, padding_tokens bigint, token_utilization double"
)
COMPLETION_TASK = struct("id string, filename string, prompt string, max_new_tokens int")
FIM_TASK = struct("id string, filename string, prefix string, suffix string, middle string, max_new_tokens int")
SHARD = struct("shard_id string, path string, records bigint, tokens bigint, sha256 string")
CURSOR = struct("epoch int, shard_index int, record_offset bigint, token_offset int, rank int, world_size int")
