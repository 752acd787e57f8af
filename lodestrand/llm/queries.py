"""The registered queries of the training-data operators. Each reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrand.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows, "doc_id") if name == "documents" else rows


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrand.llm.syntax import broken

    return broken(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p6_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrand.llm.syntax import broken

    return broken(table(spark, sf_dir, "documents"))


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrand.llm.syntax import fault_rates

    return fault_rates(table(spark, sf_dir, "documents"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrand.llm.tokens import token_ids

    return token_ids(spark, table(spark, sf_dir, "documents"))


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrand.llm.packing import pack_documents

    return pack_documents(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_limits"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrand.llm.packing import container_fill

    return container_fill(p8_pack(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrand.llm.chars import same_looks

    return same_looks(table(spark, sf_dir, "documents"))


def p9_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrand.llm.chars import canonical_documents

    return canonical_documents(table(spark, sf_dir, "documents"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrand.llm.credentials import places

    return places(spark, table(spark, sf_dir, "documents"))


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrand.llm.credentials import redacted

    return redacted(spark, table(spark, sf_dir, "documents"))


def p1_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrand.llm.credentials import places, status_changes
    from lodestrand.session import cut

    documents = table(spark, sf_dir, "documents")
    return status_changes(cut(places(spark, documents)), documents, table(spark, sf_dir, "file_records"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrand.llm.handwritten import not_by_hand

    return not_by_hand(table(spark, sf_dir, "documents"))


def p2_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrand.llm.handwritten import beliefs

    return beliefs(table(spark, sf_dir, "documents"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrand.llm.overlap import split_overlaps

    return split_overlaps(table(spark, sf_dir, "documents")).select("doc_id_a", "doc_id_b")


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrand.llm.overlap import overlap_counts, split_overlaps

    return overlap_counts(split_overlaps(table(spark, sf_dir, "documents")))


def p4_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrand.llm.leakage import leaks

    return leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "fim_tasks"), table(spark, sf_dir, "completion_tasks"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrand.llm.leakage import leaked

    return leaked(p4_leaks(spark, sf_dir))


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrand.llm.leakage import without_leaks
    from lodestrand.session import cut

    return without_leaks(spark, table(spark, sf_dir, "documents"), cut(p4_leaks(spark, sf_dir)))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrand.llm.families import repository_families

    return repository_families(table(spark, sf_dir, "documents"))


def p5_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrand.llm.families import assign_splits

    return assign_splits(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "split_targets"))


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrand.llm.families import split_shares

    return split_shares(p5_assign(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_redacted, p1_status, p2_found, p2_labels, p3_found, p3_counts, p4_found, p4_leaks, p4_clean, p5_found, p5_assign, p5_shares, p6_found, p6_faults, p6_rates, p7_ids, p8_pack, p8_fill, p9_found, p9_forms)}
