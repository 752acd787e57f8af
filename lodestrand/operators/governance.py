"""Ledgers of approvals, receipts and authorizations: validity, latest decisions, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.paths import COMMIT, SHA256, SOURCE_ID, UTC, safe_uri
from lodestrand.functions.text import joined_sha256, reasons
from lodestrand.operators.checks import CEILINGS, canonical_github

#: Fixed values of the policy: accepted licences, states of a decision, what marks a licence text.
ACCEPTED = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "CC0-1.0", "Unlicense")
STATUSES = ("approved", "review", "rejected", "removed")
#: The keys of an approval decision, of a receipt's identity, and of an authorization.
DECISION = ("source_id", "source_uri", "commit_sha")
AUTHORIZED = ("run_name", "training_config_sha256", "model_config_sha256", "manifest_sha256", "corpus_sha256", "tokenizer_sha256", "max_tokens")
MARKERS = (
    ("MIT", ("permission is hereby granted, free of charge",)), ("Apache-2.0", ("apache license", "version 2.0")), ("ISC", ("permission to use, copy, modify, and/or distribute",)),
    ("Unlicense", ("this is free and unencumbered software",)), ("CC0-1.0", ("cc0 1.0 universal",)),
)


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def approval_id() -> Column:
    return joined_sha256(*map(F.col, ("source_id", "source_uri", "commit_sha", "license_spdx", "status", "approved_at")))


def approval_violations() -> Column:
    """What an approval row breaks, as an array; empty: it is valid."""
    bad_scope = F.exists("scope", lambda s: (s != "typescript-source") & (~s.rlike(r"^(?:include|exclude):[^\x00\\]+$") | s.rlike(r"^\w+:/") | s.rlike(r"(?:^\w+:|/)\.\.(?:/|$)")))
    return reasons(
        (~F.coalesce(F.col("source_id").rlike(SOURCE_ID), F.lit(False)), "source-id"), (~F.coalesce(safe_uri(F.col("source_uri")) == F.col("source_uri"), F.lit(False)), "unsafe-uri"),
        (~F.coalesce(F.col("source_uri").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(False)), "no-scheme"), (~F.coalesce((F.col("commit_sha") == "fixture") | F.col("commit_sha").rlike(COMMIT), F.lit(False)), "commit"),
        (~F.coalesce(F.col("license_spdx").isin(*ACCEPTED), F.lit(False)), "license"), (~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "status"),
        ((F.col("status") == "approved") & (_blank("approved_by") | _blank("approved_at") | (F.coalesce(F.size("scope"), F.lit(0)) <= 0)), "incomplete-approval"),
        (bad_scope, "scope"), (~F.coalesce(F.col("approval_id") == approval_id(), F.lit(False)), "approval-id"), (F.col("supersedes") == F.col("approval_id"), "supersedes-itself"),
    )


def validate_approvals(ledger: DataFrame) -> DataFrame:
    return ledger.select("approval_id", "source_id", approval_violations().alias("violations"))


def duplicate_ids(ledger: DataFrame, column: str = "approval_id") -> DataFrame:
    return ledger.groupBy(column).agg(F.count("*").alias("rows")).where("rows > 1")


def latest(ledger: DataFrame, order: Column, keys: tuple[str, ...] = DECISION) -> DataFrame:
    """The last row of each key in ledger order; one pre-aggregating pass, no sort."""
    row = F.struct(*(c for c in ledger.columns if c not in keys))
    return ledger.groupBy(*keys).agg(F.max_by(row, order).alias("row")).select(*keys, "row.*")


def decisions(ledger: DataFrame) -> DataFrame:
    """Latest decision by time and id (the order within a file isn't kept by distributed reads)."""
    return latest(ledger, F.struct(F.coalesce("approved_at", F.lit("")).alias("t"), "approval_id"))


def coverage(records: DataFrame, ledger: DataFrame) -> DataFrame:
    """source_uri, commit_sha, state of the distinct sources of included records: approved, missing, or the status that blocks."""
    used = records.where("included").select(safe_uri(F.col("source_uri")).alias("source_uri"), "commit_sha").dropna().distinct()
    last = latest(ledger.select("source_uri", "commit_sha", "status", "approved_at", "approval_id"), F.struct(F.coalesce("approved_at", F.lit("")).alias("t"), "approval_id"), ("source_uri", "commit_sha"))
    return used.join(last, ["source_uri", "commit_sha"], "left").select("source_uri", "commit_sha", F.coalesce("status", F.lit("missing")).alias("state"))


def license_disagreements(records: DataFrame, ledger: DataFrame) -> DataFrame:
    """Sources whose approved licence isn't the detected one."""
    approved = decisions(ledger).where("status = 'approved'").select("source_uri", "commit_sha", F.col("license_spdx").alias("approved_spdx")).distinct()
    found = records.select(safe_uri(F.col("source_uri")).alias("source_uri"), "commit_sha", F.col("license_spdx").alias("detected_spdx")).dropna().distinct()
    return approved.join(found, ["source_uri", "commit_sha"]).where("approved_spdx <> detected_spdx")


def receipt_violations() -> Column:
    """What a receipt breaks; an empty map of licences is valid."""
    return reasons(
        (F.coalesce(F.col("schema_version") != 1, F.lit(True)), "schema-version"), (~F.coalesce(F.col("source_id").rlike(SOURCE_ID), F.lit(False)), "source-id"), (~F.coalesce(F.col("commit_sha").rlike(COMMIT), F.lit(False)), "commit"),
        (~F.coalesce(F.col("tree_sha256").rlike(SHA256), F.lit(False)), "tree"), (~F.coalesce(F.col("file_count").between(0, CEILINGS["max_files"]), F.lit(False)), "file-count"), (~F.coalesce(F.col("total_bytes").between(0, CEILINGS["max_total_bytes"]), F.lit(False)), "total-bytes"),
        (_blank("git_version"), "git-version"), (~canonical_github(F.col("source_uri")), "source-uri"),
        (~F.coalesce(F.col("retrieved_at").rlike(UTC) & F.try_to_timestamp(F.col("retrieved_at")).isNotNull(), F.lit(False)), "retrieved-at"),
        (F.col("license_sha256").isNull() | F.coalesce(F.exists(F.map_values("license_sha256"), lambda v: v.isNull() | ~v.rlike(SHA256)), F.lit(False)), "license-digest"),
    )


def receipts_match(receipts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Receipts of approved decisions: source_id, commit_sha and whether the receipt itself is valid."""
    ok = decisions(ledger).where("status = 'approved'").select(*DECISION)
    return receipts.join(ok, list(DECISION), "left_semi").select("source_id", "commit_sha", (F.size(receipt_violations()) == 0).alias("valid")).dropDuplicates()


def receipt_differences(receipts: DataFrame, snapshots: DataFrame) -> DataFrame:
    """source_uri, commit_sha, differs: in what a receipt isn't that of the snapshot of its source (reports.snapshot_digest,
    with source_uri and commit_sha); "missing" without one. No rows: all match."""
    kept = ("tree_sha256", "file_count", "total_bytes", "license_sha256")
    entries = lambda c: F.array_sort(F.map_entries(c))
    both = receipts.alias("r").join(snapshots.withColumn("found", F.lit(True)).alias("s"), ["source_uri", "commit_sha"], "left")
    unlike = [(~(entries(F.col(f"r.{k}")).eqNullSafe(entries(F.col(f"s.{k}"))) if k == "license_sha256" else F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}"))), k) for k in kept]
    names = F.when(F.col("found").isNull(), F.array(F.lit("missing"))).otherwise(reasons(*unlike))
    return both.select("source_uri", "commit_sha", F.explode(names).alias("differs"))


def matching_authorization(runs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per run the last authorization that agrees in all keys, approved or not."""
    last = latest(ledger.select(*AUTHORIZED, "status", "authorization_id", "approved_at"), F.struct("approved_at", "authorization_id"), AUTHORIZED)
    return runs.join(last, list(AUTHORIZED), "left").select("run_name", F.coalesce("status", F.lit("missing")).alias("state"))


def status_counts(ledger: DataFrame) -> DataFrame:
    """All statuses, also those that don't occur."""
    return ledger.agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES), F.count("*").alias("records"))


def license_of(text: Column) -> Column:
    """The licence a text declares or quotes; tags come in lower case, as the text is lowered before they are read."""
    low = F.lower(F.substring(text, 1, 100_001))
    tag = F.regexp_extract(low, r"spdx-license-identifier:\s*([a-z0-9.+-]+)", 1)
    out = F.when(tag != "", tag)
    for name, marks in MARKERS:
        c = F.lit(True)
        for m in marks:
            c = c & F.contains(low, F.lit(m))
        out = out.when(c, name)
    return out.otherwise("NOASSERTION")


def repository_license(files: DataFrame, accepted: tuple[str, ...] = ACCEPTED) -> DataFrame:
    """repository_id, spdx, status, evidence from the licence files in each repository's root."""
    root = files.where(F.lower("relative_path").rlike(r"^(?:license|copying)[^/]*$"))
    found = root.groupBy("repository_id").agg(F.array_sort(F.collect_set(license_of(F.col("text")))).alias("names"), F.array_join(F.array_sort(F.collect_set("relative_path")), ",").alias("evidence"))
    spdx = F.when(F.size("names") == 1, F.col("names")[0]).otherwise("CONFLICTING")
    decided = found.select("repository_id", spdx.alias("spdx"), F.when((F.size("names") == 1) & F.col("names")[0].isin(*accepted), "accepted").otherwise("review").alias("status"), "evidence")
    return files.select("repository_id").distinct().join(decided, "repository_id", "left").select("repository_id", F.coalesce("spdx", F.lit("NOASSERTION")).alias("spdx"), F.coalesce("status", F.lit("review")).alias("status"), F.coalesce("evidence", F.lit("no-license-file")).alias("evidence"))
