"""The registered queries of the core operators. Each reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import model, paths, secrets
from lodestrand.functions import text as T
from lodestrand.operators import checks, contamination, dedup, governance, reports, segments, sequences, splits, tokenizers
from lodestrand.plans import corpus
from lodestrand.session import cut, spread
from lodestrand.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}
TOKENIZER_FILE = "/opt/tokenizers/byte_bpe_50k.json"


def query(f: Query) -> Query:
    REGISTERED[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).where("text is not null")


def once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_records without its repeated rows: one row per record, included where any says so."""
    return table(spark, sf_dir, "file_records").dropDuplicates()


@query
def corpus_overview(spark, sf_dir):
    """The flagship: reasons, exact duplicates, clusters' splits, and counts by split and source."""
    rows = texts(spark, sf_dir).select("doc_id", "source", T.sha256(T.normalized(F.col("text"))).alias("cluster"), (F.size(T.quality_reasons(F.col("text"))) + F.size(paths.generated_reasons(F.col("relative_path"), F.col("text")))).alias("reasons"))
    kept = rows.where("reasons = 0").groupBy("cluster").agg(F.min_by("source", "doc_id").alias("source"))
    return kept.groupBy(T.split_of(F.col("cluster")).alias("split"), F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("*").alias("documents"))


def corpus_files(spark, sf_dir):
    """The documents as files of their repositories, to each of which a licence is added: of most a known one."""
    d = documents(spark, sf_dir).where("repository_id is not null and relative_path is not null").select(F.lower(F.trim("repository_id")).alias("repository_id"), "relative_path", "text")
    known = F.substring(F.sha2("repository_id", 256), 1, 1) > "2"
    licences = d.select("repository_id").distinct().select("repository_id", F.lit("LICENSE").alias("relative_path"), F.when(known, "Permission is hereby granted, free of charge, to any person").otherwise("All rights reserved.").alias("text"))
    return d.unionByName(licences).select(
        "repository_id", F.concat(F.lit("https://github.com/corpus/"), "repository_id").alias("source_uri"), F.lit("fixture").alias("commit_sha"), F.lit("2024-01-01T00:00:00Z").alias("retrieved_at"), "relative_path", "text"
    )


@query
def corpus_records(spark, sf_dir):
    """The records of the build before duplicates are marked: every reason, hash and label. Documents delivered twice are one record."""
    rows = corpus.file_records(corpus_files(spark, sf_dir), 100_000, 12, scope=["include:*", "exclude:*/__snapshots__/*"]).dropDuplicates(["record_id"])
    return rows.select(
        "record_id", "license_spdx", "license_status", "language", "source_type", "size_bytes", "line_count", "content_hash_scope", "normalized_sha256", "quality_score", "secret_scan_status", "generated_status",
        "included", F.array_join("exclusion_reasons", ",").alias("exclusion_reasons"),
    )


@query
def corpus_build(spark, sf_dir):
    """The whole build: records, duplicates, clusters and splits."""
    return corpus.build(corpus_files(spark, sf_dir)).withColumn("exclusion_reasons", F.array_join("exclusion_reasons", ","))


@query
def secret_findings(spark, sf_dir):
    found = texts(spark, sf_dir).select("doc_id", secrets.findings(F.col("relative_path"), F.col("text")).alias("f"))
    return found.select("doc_id", F.array_join("f", ",").alias("categories"), (F.size("f") > 0).alias("contains_secret"))


@query
def repository_licenses(spark, sf_dir):
    d = texts(spark, sf_dir).where("repository_id is not null and relative_path is not null")
    # files that lie in a docs folder stand for those in the root, of which the corpus holds few
    return governance.repository_license(d.select(F.lower(F.trim("repository_id")).alias("repository_id"), F.when(F.col("relative_path").rlike("(?i)[.]md$"), F.concat(F.lit("LICENSE-"), F.col("doc_id").cast("string"))).otherwise(F.col("relative_path")).alias("relative_path"), "text"))


@query
def canonical_addresses(spark, sf_dir):
    uris = table(spark, sf_dir, "file_records").select("source_uri").where("source_uri is not null").distinct()
    return uris.select("source_uri", checks.canonical_github(F.col("source_uri")).alias("canonical"), checks.canonical_github(F.regexp_replace("source_uri", "[.]git$", "")).alias("canonical_without_git"))


@query
def tree_entries(spark, sf_dir):
    """Paths of the records as tree entries; modes by their first letters, so that every rule has rows that break it."""
    p = F.col("relative_path")
    mode = F.when(p.startswith("src"), "100644").when(p.startswith("packages"), "120000").when(p.startswith("test"), "040000").otherwise("100755")
    rows = table(spark, sf_dir, "file_records").select("relative_path").distinct()
    rows = rows.unionByName(rows.select(F.concat(F.lit("/"), p).alias("relative_path"))).unionByName(rows.select(F.concat(F.lit("a/../"), p).alias("relative_path")))
    return rows.select("relative_path", F.array_join(checks.tree_entry_violations(p, mode, F.lit("blob"), max_path_depth=4), ",").alias("violations"))


@query
def cursor_checks(spark, sf_dir):
    m = table(spark, sf_dir, "training_metrics").where("step is not null").select(
        "run_name", "step", (F.col("step") % 5 - 1).alias("epoch"), (F.col("step") % 3).alias("shard_index"), (F.col("step") - 3).alias("record_offset"), F.lit(0).alias("token_offset"), (F.col("step") % 4).alias("rank"), F.lit(3).alias("world_size")
    ).distinct()
    return m.select("run_name", "step", F.array_join(checks.cursor_violations(), ",").alias("violations"), checks.cursor_behind(F.col("epoch"))["record_offset"].alias("next_record"))


@query
def shard_totals(spark, sf_dir):
    """Sources as shards; a source with a text of unknown length has no token total, and so the whole hasn't."""
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("records"), F.when(F.count("*") == F.count("n_chars"), F.sum("n_chars")).alias("tokens"))
    return reports.shard_totals(d)


@query
def perplexity(spark, sf_dir):
    m = table(spark, sf_dir, "training_metrics").where("loss is not null").select("loss").distinct()
    return m.select("loss", F.round(model.perplexity(F.col("loss")), 6).alias("perplexity"))


@query
def step_horizon(spark, sf_dir):
    m = table(spark, sf_dir, "training_metrics").where("tokens_processed is not null").select("tokens_processed").distinct()
    return m.select("tokens_processed", sequences.step_horizon(F.col("tokens_processed"), 4096).alias("steps"))


@query
def batches(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.pmod(F.col("doc_id"), F.lit(64)).alias("worker"))
    return sequences.batches(rows, ["doc_id"], 32, ["worker"]).select("doc_id", "batch_no")


@query
def epochs(spark, sf_dir):
    return sequences.epochs(table(spark, sf_dir, "completion_tasks").select("id"), 3).select("epoch", "id")


@query
def resume(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 100).alias("shard_index"), (F.col("doc_id") % 100).alias("record_offset"))
    return sequences.resume(rows, 3, 41).select("doc_id")


@query
def supervised_tokens(spark, sf_dir):
    t = table(spark, sf_dir, "completion_tasks").select("id", sequences.code_points(F.col("prompt")).alias("ids"))
    return t.select("id", sequences.supervised_tokens(F.col("ids"), F.transform("ids", lambda x: (x != 32).cast("int"))).alias("supervised"))


@query
def infilling_prompts(spark, sf_dir):
    return table(spark, sf_dir, "fim_tasks").select("id", F.sha2(sequences.infilling_prompt(F.col("prefix"), F.col("suffix")), 256).alias("prompt_sha256"))


@query
def byte_tokens(spark, sf_dir):
    return table(spark, sf_dir, "completion_tasks").select("id", F.array_join(sequences.byte_ids(F.col("prompt"), 200), ",").alias("ids"))


@query
def objective_counts(spark, sf_dir):
    d = texts(spark, sf_dir).where("record_id is not null")
    return reports.objective_counts(d.select(F.when(T.uses_infilling(F.col("record_id"), 42, 0.5), "fim").otherwise("causal").alias("objective"), F.length("text").alias("tokens")))


@query
def weighted_repetition(spark, sf_dir):
    """The mean word repetition of sources by their documents."""
    each = texts(spark, sf_dir).groupBy("source").agg(F.avg(F.round(T.repetition_rate(F.col("text")), 6).cast("decimal(10,6)")).cast("double").alias("repetition"), F.count("*").alias("documents"))
    return reports.weighted_mean(each, "repetition", "documents").select(F.round("mean", 5).alias("mean"), "weight")


@query
def diagnostic_counts(spark, sf_dir):
    return reports.diagnostic_counts(once(spark, sf_dir).select("exclusion_reasons"), ["exclusion_reasons"])


@query
def unapproved_sources(spark, sf_dir):
    """Sources of receipts that no approval names."""
    return reports.not_in(table(spark, sf_dir, "receipts"), table(spark, sf_dir, "approvals").where("status = 'approved'"), ["source_id", "commit_sha"])


@query
def included_documents(spark, sf_dir):
    return reports.included_documents(once(spark, sf_dir), "train").groupBy("record_id").agg(F.count("*").alias("rows"))


@query
def owned_records(spark, sf_dir):
    return sequences.owned(table(spark, sf_dir, "documents").where("record_id is not null"), "record_id", 2, 5).select("doc_id")


@query
def snapshot_digests(spark, sf_dir):
    f = once(spark, sf_dir).where("repository_id is not null and relative_path is not null and content_sha256 is not null and size_bytes is not null")
    f = f.groupBy(F.lower(F.trim("repository_id")).alias("repository_id"), "relative_path").agg(F.min("size_bytes").alias("size_bytes"), F.min("content_sha256").alias("content_sha256")).withColumn("target", F.lit(None).cast("string"))
    return reports.snapshot_digest(f, ["repository_id"]).select("repository_id", "tree_sha256", "file_count", "total_bytes", F.size("license_sha256").alias("licenses"))


@query
def quality_metrics(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", T.quality_metrics(F.col("text")).alias("q")).select("doc_id", "q.*")


@query
def quality_reasons(spark, sf_dir):
    rows = texts(spark, sf_dir).select("doc_id", T.quality_reasons(F.col("text"), 100_000).alias("r"), T.quality_metrics(F.col("text"))["repetition_ratio"].alias("repetition"))
    return rows.select("doc_id", F.array_join("r", ",").alias("reasons"), T.quality_score(F.size("r"), F.col("repetition")).alias("score"))


@query
def generated_status(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(paths.generated_reasons(F.col("relative_path"), F.col("text"))), ",").alias("reasons"))


@query
def path_filters(spark, sf_dir):
    p = F.col("relative_path")
    return texts(spark, sf_dir).select("doc_id", F.array_join(paths.path_reasons(p), ",").alias("rejection"), paths.source_type(p).alias("source_type"), paths.language_reason(p, F.col("text")).alias("language"))


@query
def approved_scope(spark, sf_dir):
    scope = ["include:src/*", "include:packages/*.ts", "exclude:*.d.ts", "exclude:*/__snapshots__/*"]
    return table(spark, sf_dir, "documents").select("doc_id", paths.in_scope(F.col("relative_path"), scope).alias("in_scope"))


@query
def harness_filter(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.array_join(paths.harness_reasons(F.col("relative_path"), F.col("text")), ",").alias("reasons"), paths.stream_harness(F.col("text")).alias("in_stream"))


@query
def license_detect(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", governance.license_of(F.col("text")).alias("spdx"))


@query
def uri_sanitize(spark, sf_dir):
    return table(spark, sf_dir, "file_records").select("source_uri").where("source_uri is not null").distinct().select("source_uri", paths.safe_uri(F.col("source_uri")).alias("safe_uri"))


@query
def record_ids(spark, sf_dir):
    d = texts(spark, sf_dir).where("repository_id is not null")
    return d.select("doc_id", T.record_id(F.col("repository_id"), F.col("relative_path"), F.sha2("text", 256)).alias("made_id"), T.owner_of(F.col("record_id"), 8).alias("owner"), T.uses_infilling(F.col("record_id"), 42, 0.5).alias("fim"), T.split_of(F.col("record_id")).alias("hashed_split"))


@query
def normalized_hash(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", T.sha256(T.normalized(F.col("text"))).alias("normalized_sha256"))


@query
def exact_dedup(spark, sf_dir):
    rows = cut(texts(spark, sf_dir).select("doc_id", T.sha256(T.normalized(F.col("text"))).alias("normalized_sha256")))
    return dedup.mark_duplicates(rows, order="doc_id").select("doc_id", "is_duplicate")


@query
def shingle_stats(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", T.shingles(F.col("text")).alias("s")).select("doc_id", F.size("s").cast("bigint").alias("shingles"), F.array_min("s").alias("smallest"))


@query
def near_dup_pairs(spark, sf_dir):
    """Between classes of equal normalised texts; a class is named by its smallest document."""
    rows = texts(spark, sf_dir).select(F.col("doc_id").alias("id"), T.normalized(F.col("text")).alias("text"))
    stored = cut(segments.sketches(rows.withColumn("h", F.sha2("text", 256)), 0.85, "h"))
    classes = stored.groupBy("h").agg(F.min_by("number", "id").alias("number"))
    return dedup.sketched_pairs(stored, rows, 0.85, classes).select("a", "b", "common")


@query
def leader_clusters(spark, sf_dir):
    rows = texts(spark, sf_dir).select(F.sha2(F.concat_ws(":", "record_id", "doc_id"), 256).alias("record_id"), T.sha256(T.normalized(F.col("text"))).alias("normalized_sha256"), (F.coalesce("split", F.lit("")) != "excluded").alias("included"), "text")
    return dedup.leader_clusters(rows).select("record_id", "dedup_cluster")


@query
def cluster_split(spark, sf_dir):
    rows = once(spark, sf_dir).where("dedup_cluster is not null and included is not null").select("record_id", F.lower(F.trim("dedup_cluster")).alias("dedup_cluster"), "included").distinct()
    return splits.cluster_split(rows).groupBy("split").agg(F.count("*").alias("records"))


@query
def family_split(spark, sf_dir):
    rows = once(spark, sf_dir).where("included and repository_id is not null and dedup_cluster is not null").select(F.lower(F.trim("repository_id")).alias("repository_id"), F.lower(F.trim("dedup_cluster")).alias("dedup_cluster"), "included")
    return splits.family_split(rows)


@query
def build_summary(spark, sf_dir):
    return reports.build_summary(once(spark, sf_dir))


@query
def group_counts(spark, sf_dir):
    return reports.group_counts(once(spark, sf_dir))


@query
def reason_counts(spark, sf_dir):
    return reports.reason_counts(once(spark, sf_dir))


@query
def cluster_stats(spark, sf_dir):
    return reports.cluster_stats(once(spark, sf_dir).where("dedup_cluster is not null"))


@query
def leakage(spark, sf_dir):
    return reports.leakage(once(spark, sf_dir))


@query
def repositories_by_split(spark, sf_dir):
    return reports.repositories_by_split(once(spark, sf_dir))


@query
def latest_approval(spark, sf_dir):
    return governance.decisions(table(spark, sf_dir, "approvals").dropDuplicates(["approval_id"])).select("source_id", "source_uri", "commit_sha", "approval_id", "status")


@query
def approval_coverage(spark, sf_dir):
    return governance.coverage(once(spark, sf_dir), table(spark, sf_dir, "approvals"))


@query
def approval_violations(spark, sf_dir):
    return governance.validate_approvals(table(spark, sf_dir, "approvals")).select(F.explode("violations").alias("violation")).groupBy("violation").agg(F.count("*").alias("records"))


@query
def approval_status(spark, sf_dir):
    return governance.status_counts(table(spark, sf_dir, "approvals"))


@query
def duplicate_decisions(spark, sf_dir):
    return governance.duplicate_ids(table(spark, sf_dir, "approvals").where("approval_id is not null"))


@query
def license_disagreements(spark, sf_dir):
    return governance.license_disagreements(once(spark, sf_dir), table(spark, sf_dir, "approvals"))


@query
def receipt_violations(spark, sf_dir):
    """Of the receipts, and of each with one value of several changed, so that every rule has rows that break it."""
    r = table(spark, sf_dir, "receipts")
    rows = r.unionByName(r.withColumns({"schema_version": F.lit(2), "source_id": F.concat("source_id", F.lit(" ")), "commit_sha": F.upper("commit_sha")}))
    rows = rows.unionByName(r.withColumns({"tree_sha256": F.substring("tree_sha256", 2, 64), "file_count": F.lit(-1).cast("bigint"), "total_bytes": F.lit(10_737_418_241)}))
    none = F.create_map(F.lit("LICENSE"), F.lit("none"))
    rows = rows.unionByName(r.withColumns({"git_version": F.lit(" "), "source_uri": F.concat("source_uri", F.lit(".git")), "retrieved_at": F.replace("retrieved_at", F.lit("Z"), F.lit("+00:00")), "license_sha256": none}))
    return rows.select(F.explode(governance.receipt_violations()).alias("violation")).groupBy("violation").agg(F.count("*").alias("records"))


@query
def tree_totals(spark, sf_dir):
    files = once(spark, sf_dir).where("repository_id is not null and relative_path is not null").select(F.lower(F.trim("repository_id")).alias("repository_id"), "relative_path", F.coalesce("content_sha256", F.lit("")).alias("content_sha256"), "size_bytes").distinct()
    return reports.tree_digest(files).select("repository_id", "file_count", "total_bytes")


@query
def exact_contamination(spark, sf_dir):
    d = texts(spark, sf_dir).withColumn("split", F.lower(F.trim("split")))
    return contamination.exact_matches(d.where("split in ('validation', 'test')").select("doc_id", "text"), d.where("split = 'train'").select("text")).select("doc_id")


@query
def nearest_lengths(spark, sf_dir):
    q = table(spark, sf_dir, "fim_tasks").select(F.col("id").alias("task_id"), F.col("middle").alias("text"))
    return contamination.nearest_lengths(q, texts(spark, sf_dir).select("text").distinct())


@query
def longest_spans(spark, sf_dir):
    q = table(spark, sf_dir, "fim_tasks").select(F.col("id").alias("task_id"), F.col("middle").alias("text"))
    corpus = texts(spark, sf_dir).select("text").distinct()
    near = contamination.nearest_lengths(q, corpus)
    found = near.join(corpus.withColumn("candidate_sha256", F.sha2("text", 256)), "candidate_sha256").select("task_id", F.col("text").alias("b"))
    return contamination.longest_spans(found.join(q.withColumnRenamed("text", "a"), "task_id").select("task_id", "a", "b"))


@query
def repetition_rate(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", T.repetition_rate(F.col("text")).alias("repetition"))


@query
def causal_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "completion_tasks").select("id", sequences.code_points(F.col("prompt")).alias("ids"))
    w = sequences.causal_windows(rows, "ids", 128, 0)
    return w.select("id", "window_no", "token_start", F.array_join("input_ids", ",").alias("input_ids"), F.aggregate("loss_mask", F.lit(0), lambda a, x: a + x).alias("loss_positions"))


@query
def packed_blocks(spark, sf_dir):
    d = texts(spark, sf_dir).where("repository_id is not null").select(F.col("doc_id").cast("string").alias("record_id"), F.lower(F.trim("repository_id")).alias("repository_id"), sequences.code_points(F.col("text")).alias("ids"))
    b = sequences.packed_blocks(d, "ids", ["record_id"], 4096, 0, 0, "drop", by_repository=True)
    return b.select("repository_id", "block", "n_tokens", F.array_join("record_ids", ",").alias("record_ids"))


@query
def next_fit_packing(spark, sf_dir):
    d = texts(spark, sf_dir).where("repository_id is not null").select(F.col("doc_id").cast("string").alias("record_id"), F.lower(F.trim("repository_id")).alias("repository_id"), "relative_path", sequences.code_points(F.col("text")).alias("ids"))
    return sequences.next_fit(d, "ids", 8192, 0).select("repository_id", "bin", F.size("record_ids").alias("records"), F.size("token_ids").alias("tokens"))


@query
def fim_samples(spark, sf_dir):
    made = sequences.infilling_samples(texts(spark, sf_dir).select("doc_id", "text"), "doc_id", "text")
    return made.select("sample_id", "objective", "start", "end", F.when(F.col("objective") == "fim", F.sha2(sequences.reconstruct(F.col("serialized")), 256)).otherwise(F.sha2("serialized", 256)).alias("text_sha256"))


@query
def document_shards(spark, sf_dir):
    rows = once(spark, sf_dir).where("included").select("record_id").distinct()
    return sinks.shard_index(sinks.number_shards(rows, 100).withColumn("line", F.col("record_id")))


@query
def budget_prefix(spark, sf_dir):
    m = table(spark, sf_dir, "training_metrics").where("loss_tokens is not null").groupBy("run_name", "step").agg(F.max("loss_tokens").alias("loss_tokens"))
    return reports.within_budget(m, ["step"], "loss_tokens", 50_000, ["run_name"]).select("run_name", "step", "loss_tokens")


@query
def interval_boundaries(spark, sf_dir):
    m = table(spark, sf_dir, "training_metrics").where("tokens_processed is not null").groupBy("run_name", "step").agg(F.max("tokens_processed").alias("tokens_processed"))
    return reports.boundaries(m, ["step"], "tokens_processed", 25_000, ["run_name"]).select("run_name", "step", "tokens_processed", "crossed")


@query
def weighted_loss(spark, sf_dir):
    return reports.weighted_loss(table(spark, sf_dir, "training_metrics").dropDuplicates()).select("run_name", "loss_tokens", F.round("mean_loss", 6).alias("mean_loss"))


@query
def padding(spark, sf_dir):
    return reports.padding(table(spark, sf_dir, "training_metrics").where("tokens_processed is not null").dropDuplicates(["run_name", "step", "tokens_processed", "batch_tokens", "padded_tokens", "padding_tokens"])).select("run_name", "batch_tokens", "padded_tokens", "padding_tokens")


@query
def cosine_schedule(spark, sf_dir):
    steps = table(spark, sf_dir, "training_metrics").select("step").where("step is not null").distinct()
    return steps.select("step", F.round(model.cosine_rate(F.col("step"), 10, 200), 9).alias("factor"))


@query
def model_audit(spark, sf_dir):
    """Parameter totals of decoders as wide as the packing limits' capacities ask for."""
    shapes = table(spark, sf_dir, "pack_limits").select("capacity", (F.col("capacity") / 4).cast("bigint").alias("hidden"))
    p = model.parameter_totals(F.lit(50257), F.col("hidden"), F.lit(12), F.lit(8), F.lit(2), F.col("hidden") * 3, F.lit(True))
    b = model.training_bytes(p["total"], F.col("capacity"), F.col("hidden"), F.lit(12))
    return shapes.select("capacity", *(c.alias(k) for k, c in p.items()), *(c.alias(f"{k}_bytes") for k, c in b.items()))


@query
def repository_pack(spark, sf_dir):
    d = texts(spark, sf_dir).where("repository_id is not null").select(F.lower(F.trim("repository_id")).alias("repository_id"), "relative_path", "text", "doc_id")
    return reports.repository_parts(d).select("repository_id", "relative_path", F.sha2("part", 256).alias("part_sha256"))


@query
def tokenizer_metrics(spark, sf_dir):
    return tokenizers.tokenizer_metrics(table(spark, sf_dir, "documents"), TOKENIZER_FILE)


@query
def evaluation_rates(spark, sf_dir):
    """What a trivial generator that answers with the prefix would score."""
    t = table(spark, sf_dir, "fim_tasks").where("middle is not null").select("id", F.split("middle", r"\s+").alias("want"), F.split(F.coalesce("prefix", F.lit("")), r"\s+").alias("got"))
    scored = t.select("id", F.col("want").eqNullSafe(F.col("got")).alias("exact_match"), T.token_accuracy(F.col("want"), F.col("got")).alias("token_accuracy"))
    return reports.rates(scored, ["exact_match", "token_accuracy"]).select("n", "exact_match", F.round("token_accuracy", 9).alias("token_accuracy"))
