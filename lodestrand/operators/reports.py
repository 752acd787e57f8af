"""Group-by reports over records, splits, shards and training metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def build_summary(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count("*").alias("records"), F.count_if("included").alias("included"), F.count_if(~F.col("included")).alias("rejected"),
        F.sum("size_bytes").alias("bytes"), F.count_distinct("source_uri").alias("selected_sources"),
    )


def group_counts(records: DataFrame) -> DataFrame:
    """facet, value, records of licences, source types, secret statuses (all rows) and splits (included rows), in one pass."""
    facets = F.array(
        F.struct(F.lit("license").alias("facet"), F.col("license_spdx").alias("value")), F.struct(F.lit("source_type").alias("facet"), F.col("source_type").alias("value")),
        F.struct(F.lit("secret_status").alias("facet"), F.col("secret_scan_status").alias("value")), F.when(F.col("included"), F.struct(F.lit("split").alias("facet"), F.col("split").alias("value"))),
    )
    return records.select(F.explode(F.filter(facets, lambda x: x.isNotNull())).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("records"))


def reason_counts(records: DataFrame) -> DataFrame:
    return records.select(F.explode("exclusion_reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("records"))


def cluster_stats(records: DataFrame) -> DataFrame:
    sizes = records.groupBy("dedup_cluster").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("clusters"), F.count_if(F.col("n") > 1).alias("multi_record_clusters"), F.max("n").alias("largest_cluster"))


def leakage(records: DataFrame) -> DataFrame:
    """key, overlaps: clusters, normalised texts and repositories whose included rows lie in more than one split."""
    kinds = ("dedup_cluster", "normalized_sha256", "repository_id")
    keys = F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in kinds))
    rows = records.where("included").select("split", F.explode(keys).alias("k")).select("k.key", "k.value", "split")
    spread = rows.groupBy("key", "value").agg((F.min("split") < F.max("split")).cast("int").alias("more"))
    return spread.groupBy("key").agg(F.sum(F.coalesce("more", F.lit(0))).cast("bigint").alias("overlaps"))


def repositories_by_split(records: DataFrame) -> DataFrame:
    each = records.where("included").groupBy("repository_id").agg(F.when(F.min("split") == F.max("split"), F.min("split")).otherwise("mixed").alias("split"))
    return each.groupBy("split").agg(F.count("*").alias("repositories"))


def included_documents(records: DataFrame, split: str | None = None) -> DataFrame:
    rows = records.where("included")
    return rows if split is None else rows.where(F.col("split") == split)


def weighted_loss(metrics: DataFrame, by: str = "run_name") -> DataFrame:
    """Mean loss weighted by supervised tokens, and its perplexity. Rows without a loss don't count."""
    ok = metrics.where("loss is not null and loss_tokens > 0").groupBy(by).agg(F.sum(F.col("loss") * F.col("loss_tokens")).alias("s"), F.sum("loss_tokens").alias("n"))
    return ok.select(by, (F.col("s") / F.col("n")).alias("mean_loss"), F.exp(F.least(F.col("s") / F.col("n"), F.lit(80.0))).alias("perplexity"), F.col("n").alias("loss_tokens"))


def padding(metrics: DataFrame, by: str = "run_name") -> DataFrame:
    """Tokens, padded positions and utilisation of each run; steps logged twice count once (their last row by tokens)."""
    once = metrics.groupBy(by, "step").agg(F.max_by(F.struct("batch_tokens", "padded_tokens", "padding_tokens"), "tokens_processed").alias("m"))
    total = once.groupBy(by).agg(F.sum("m.batch_tokens").alias("batch_tokens"), F.sum("m.padded_tokens").alias("padded_tokens"), F.sum("m.padding_tokens").alias("padding_tokens"))
    return total.withColumn("token_utilization", F.when(F.col("padded_tokens") > 0, F.col("batch_tokens") / F.col("padded_tokens")).otherwise(0.0))


def within_budget(df: DataFrame, order: list[str], tokens: str, budget: int, group: list[str]) -> DataFrame:
    """Rows of each group, in order, until their tokens reach the budget; the row that crosses it is kept."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(tokens).over(w)).where(F.col("running") - F.col(tokens) < budget)


def boundaries(df: DataFrame, order: list[str], processed: str, interval: int, group: list[str]) -> DataFrame:
    """Rows at which the processed tokens pass another multiple of the interval."""
    w = Window.partitionBy(*group).orderBy(*order)
    before = F.coalesce(F.lag(processed).over(w), F.lit(0))
    return df.withColumn("crossed", F.floor(F.col(processed) / interval) - F.floor(before / interval)).where("crossed > 0")


def shard_totals(shards: DataFrame) -> DataFrame:
    """Records, and tokens if every shard knows them."""
    return shards.agg(F.count("*").alias("shards"), F.sum("records").alias("records"), F.when(F.count("*") == F.count("tokens"), F.sum("tokens")).alias("tokens"))


def rates(results: DataFrame, flags: list[str], by: str | None = None) -> DataFrame:
    """Means of boolean or numeric columns; 0 for no rows, null counts as false."""
    grouped = results.groupBy(by) if by else results.groupBy()
    return grouped.agg(*(F.coalesce(F.sum(F.coalesce(F.col(f).cast("double"), F.lit(0.0))) / F.greatest(F.count("*"), F.lit(1)), F.lit(0.0)).alias(f) for f in flags), F.count("*").alias("n"))


def tree_digest(files: DataFrame) -> DataFrame:
    """Per repository a digest over its (path, sha256) entries in order of the path's hash, with counts. Entries are first
    digested in 4,096 buckets by that hash, so no task holds more of a repository than a bucket."""
    entry = F.concat_ws("\u0000", "relative_path", "content_sha256")
    bucket = F.substring(F.sha2("relative_path", 256), 1, 3)
    small = files.groupBy("repository_id", bucket.alias("bucket")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), "\n"), 256).alias("d"), F.count("*").alias("n"), F.sum("size_bytes").alias("b"))
    return small.groupBy("repository_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\u0000", "bucket", "d"))), "\n"), 256).alias("tree_sha256"), F.sum("n").alias("file_count"), F.sum("b").alias("total_bytes"))


def weighted_mean(rows: DataFrame, value: str, weight: str) -> DataFrame:
    """One row: the mean of groups' values by their weights; 0 where nothing weighs."""
    ok = rows.where(F.col(value).isNotNull() & (F.col(weight) > 0))
    return ok.agg(F.coalesce(F.sum(F.col(value) * F.col(weight)) / F.sum(weight), F.lit(0.0)).alias("mean"), F.coalesce(F.sum(weight), F.lit(0)).cast("bigint").alias("weight"))


def diagnostic_counts(results: DataFrame, lists: list[str]) -> DataFrame:
    """One row: how many diagnostics the rows hold in each list column; null lists hold none."""
    return results.agg(*(F.coalesce(F.sum(F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))), F.lit(0)).cast("bigint").alias(c) for c in lists))


def objective_counts(samples: DataFrame, objective: str = "objective", tokens: str = "tokens") -> DataFrame:
    """One row: examples and supervised tokens of the causal and of the infilling objective."""
    of = {k: F.col(objective) == k for k in ("causal", "fim")}
    return samples.agg(*(F.count_if(c).alias(f"{k}_examples") for k, c in of.items()), *(F.coalesce(F.sum(F.when(c, F.col(tokens))), F.lit(0)).cast("bigint").alias(f"{k}_tokens") for k, c in of.items()))


def selected(results: DataFrame, names: dict[str, str]) -> DataFrame:
    """The named measures of an evaluation under their report's names."""
    return results.select(*(F.col(c).alias(n) for n, c in names.items()))


def not_in(part: DataFrame, whole: DataFrame, keys: list[str]) -> DataFrame:
    """What keeps `part` from being a subset of `whole`; no rows: it is one."""
    return part.select(*keys).distinct().join(whole.select(*keys).distinct(), keys, "left_anti")


def snapshot_digest(files: DataFrame, by: list[str], max_files: int = 1_000_000) -> DataFrame:
    """by columns, tree_sha256, file_count, total_bytes, license_sha256 of each snapshot. files: by, relative_path, size_bytes,
    content_sha256, and target (null but for links). The digest runs over the entries in order of their paths, so a
    snapshot is one task's work; more than max_files of one are an error. tree_digest has no such bound."""
    regular = F.concat(F.lit("regular\u0000"), "relative_path", F.lit("\u0000"), F.col("size_bytes").cast("string"), F.lit("\u0000"), "content_sha256", F.lit("\n"))
    link = F.concat(F.lit("symlink\u0000"), "relative_path", F.lit("\u0000"), "target", F.lit("\n"))
    is_license = F.lower(F.regexp_extract("relative_path", r"([^/]*)\z", 1)).rlike("^(?:license|copying)") & F.col("target").isNull()
    rows = files.select(*by, F.struct("relative_path", F.coalesce(link, regular).alias("line")).alias("e"), F.coalesce(F.octet_length("target").cast("bigint"), F.col("size_bytes")).alias("b"), F.when(is_license, F.struct("relative_path", "content_sha256")).alias("l"))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"))
    ok = rows.join(sizes, by).withColumn("e", F.when(F.col("n") > max_files, F.raise_error(F.lit("a snapshot has more than max_files files")).cast(rows.schema["e"].dataType)).otherwise(F.col("e")))
    return ok.groupBy(*by).agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda x: x.line), ""), 256).alias("tree_sha256"), F.count("*").alias("file_count"), F.sum("b").alias("total_bytes"),
        F.map_from_entries(F.array_sort(F.collect_list("l"))).alias("license_sha256"),
    )


def repository_parts(files: DataFrame) -> DataFrame:
    """repository_id, relative_path, part: each file between its marks. In order of the path the parts, between <repo> and
    </repo>, are the repository's text; kept apart they have no bound to mind. Paths that climb out are an error."""
    path = F.regexp_replace(F.regexp_replace("relative_path", r"\\", "/"), "^/+", "")
    checked = F.when(F.array_contains(F.split(path, "/"), ".."), F.raise_error(F.lit("repository path traversal")).cast("string")).otherwise(path)
    escaped = checked
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(entity))
    double, single = F.contains(escaped, F.lit('"')), F.contains(escaped, F.lit("'"))
    quoted = F.when(~double, F.concat(F.lit('"'), escaped, F.lit('"'))).when(~single, F.concat(F.lit("'"), escaped, F.lit("'"))).otherwise(F.concat(F.lit('"'), F.replace(escaped, F.lit('"'), F.lit("&quot;")), F.lit('"')))
    return files.select("repository_id", "relative_path", F.concat(F.lit("<file path="), quoted, F.lit(">\n"), F.coalesce("text", F.lit("")), F.lit("\n</file>")).alias("part"))


def repository_text(files: DataFrame, max_chars: int = 64_000_000) -> DataFrame:
    """repository_id, text: the parts of each repository as one text. A repository beyond max_chars is an error; use the
    parts for such ones."""
    parts = repository_parts(files)
    size = parts.groupBy("repository_id").agg(F.sum(F.length("part")).alias("n"))
    ok = parts.join(size, "repository_id").withColumn("part", F.when(F.col("n") > max_chars, F.raise_error(F.lit("the repository is too large for one text")).cast("string")).otherwise(F.col("part")))
    rows = ok.groupBy("repository_id").agg(F.array_sort(F.collect_list(F.struct("relative_path", "part"))).alias("parts"))
    return rows.select("repository_id", F.concat(F.lit("<repo>\n"), F.array_join(F.transform("parts", lambda x: x.part), "\n"), F.lit("\n</repo>")).alias("text"))
