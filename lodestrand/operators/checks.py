"""Constraints as columns: each gives the names of what is broken, an empty array for a valid row; plus driver-side checks of small settings."""

from __future__ import annotations

import math
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.paths import COMMIT, GITHUB, SHA256, UTC
from lodestrand.functions.text import joined_sha256, reasons
from lodestrand.session import cut

#: The modes of files and links in a tree, and the ceilings of acquisition.
MODES = ("100644", "100755", "120000")
CEILINGS = {"max_file_bytes": 64 * 1024 * 1024, "max_files": 1_000_000, "max_total_bytes": 10 * 1024 * 1024 * 1024, "max_path_depth": 256, "timeout_seconds": 600}
AUTHORIZATION_DIGESTS = ("training_config_sha256", "model_config_sha256", "manifest_sha256", "corpus_sha256", "tokenizer_sha256")


def _no(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(False))


def canonical_github(uri: Column) -> Column:
    """Whether an address is the one form of a repository's: https, owner and name, nothing behind, no .git."""
    return F.coalesce(uri.rlike(GITHUB) & ~uri.endswith(".git"), F.lit(False))


def path_parts(path: Column) -> Column:
    """The parts of a path; empty ones and single dots say nothing."""
    return F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))


def tree_entry_violations(path: Column, mode: Column, kind: Column, object_id: Column | None = None, max_path_depth: int = CEILINGS["max_path_depth"]) -> Column:
    """A tree holds files and links by relative paths of bounded depth; no folders, submodules or parent parts."""
    unsafe = path.isNull() | (path == "") | path.startswith("/") | path.rlike(r"[\x00\\]") | F.array_contains(path_parts(path), "..") | (F.size(path_parts(path)) > max_path_depth)
    special = _no(mode.isin(*MODES) & (kind == "blob") & (commit_ok(object_id) if object_id is not None else F.lit(True)))
    return reasons((F.coalesce(unsafe, F.lit(True)), "unsafe-path"), (special, "mode"))


def inside_target(link: Column, target: Column) -> Column:
    """Where a relative link leads, as a path below the root; null if it is empty, absolute or climbs out, or is the root
    itself. The path is a stack."""
    start = F.slice(path_parts(link), 1, F.greatest(F.size(path_parts(link)) - 1, F.lit(0)))
    empty = F.array().cast("array<string>")
    state = F.aggregate(
        F.split(target, "/"), F.struct(start.alias("at"), F.lit(True).alias("ok")),
        lambda s, p: F.when(p.isin("", "."), s).when(p == "..", F.struct(F.slice(s["at"], 1, F.greatest(F.size(s["at"]) - 1, F.lit(0))).alias("at"), (s["ok"] & (F.size(s["at"]) > 0)).alias("ok")))
        .otherwise(F.struct(F.concat(F.coalesce(s["at"], empty), F.array(p)).alias("at"), s["ok"].alias("ok"))),
    )
    refused = (target == "") | target.startswith("/") | target.rlike(r"[\x00\\]")
    return F.when(~refused & state["ok"] & (F.size(state["at"]) > 0), F.array_join(state["at"], "/"))


def dangling_links(links: DataFrame, entries: DataFrame, hops: int = 6) -> DataFrame:
    """links: path, target; entries: path of files and links. Links that, followed to their end, lead to no entry or folder
    ("dangling"), out of the root ("outside") or to no end ("cyclic").

    Each round doubles how far every link is followed, so 2**hops links in a row are followed; a longer chain counts as
    cyclic, as it does for a file system. Links inside a path's folders aren't followed."""
    at = cut(links.select("path", inside_target(F.col("path"), F.col("target")).alias("leads_to"), F.lit(True).alias("link")))
    for _ in range(hops):
        further = at.select(F.col("path").alias("leads_to"), F.col("leads_to").alias("next"), F.lit(True).alias("hop"))
        at = cut(at.join(further, "leads_to", "left").select("path", F.when(F.col("hop"), F.col("next")).otherwise(F.col("leads_to")).alias("leads_to"), "link"))
    names = entries.select("path").unionByName(links.select("path")).distinct()
    # a file's folders, each the path up to one of its slashes
    folders = names.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(path_parts(F.col("path")))), lambda k: F.array_join(F.slice(path_parts(F.col("path")), 1, k), "/"))).alias("leads_to"))
    still = at.select(F.col("path").alias("leads_to"), F.lit("cyclic").alias("cycle"))
    known = folders.distinct().withColumn("known", F.lit(True))
    fault = F.when(F.col("leads_to").isNull(), "outside").when(F.col("cycle").isNotNull(), "cyclic").when(F.col("known").isNull(), "dangling")
    return at.join(still, "leads_to", "left").join(known, "leads_to", "left").select("path", fault.alias("fault")).where("fault is not null").distinct()


def cursor_violations() -> Column:
    return reasons(
        *((F.coalesce(F.col(c) < 0, F.lit(True)), c) for c in ("epoch", "shard_index", "record_offset", "token_offset", "rank")),
        (F.coalesce(F.col("world_size") < 1, F.lit(True)), "world_size"), (F.coalesce(F.col("rank") >= F.col("world_size"), F.lit(False)), "rank-of-world"),
    )


def cursor_behind(token_offset: int | Column = 0) -> Column:
    """The cursor behind the one in the columns: the next record of the same shard, from one of its tokens on."""
    token = token_offset if isinstance(token_offset, Column) else F.lit(token_offset)
    return F.struct("epoch", "shard_index", (F.col("record_offset") + 1).alias("record_offset"), token.alias("token_offset"), "rank", "world_size")


def file_name(c: str) -> Column:
    """Whether a text is a plain file name: not empty, no folder, not the folder itself."""
    return F.coalesce((F.col(c) != "") & (F.col(c) != ".") & ~F.contains(F.col(c), F.lit("/")), F.lit(False))


def shard_violations() -> Column:
    return reasons(
        (~file_name("shard_id"), "shard-id"), (_no(~F.col("path").rlike(r"^/|(?:^|/)\.\.(?:/|\z)") & (F.col("path") != "")), "path"), (F.coalesce(F.col("records") < 0, F.lit(True)), "records"),
        (F.coalesce(F.col("tokens") < 0, F.lit(False)), "tokens"), (F.col("sha256").isNotNull() & _no(F.col("sha256").rlike(SHA256)), "sha256"),
    )


def authorization_id() -> Column:
    return joined_sha256(F.col("run_name"), *(F.col(c) for c in AUTHORIZATION_DIGESTS), F.col("max_tokens").cast("string"), F.col("status"), F.col("approved_at"))


def authorization_violations() -> Column:
    return reasons(
        (_no(F.col("schema_version") == 1), "schema-version"), (~file_name("run_name"), "run-name"), *((_no(F.col(c).rlike(SHA256)), c) for c in AUTHORIZATION_DIGESTS),
        (_no(F.col("max_tokens") > 0), "max-tokens"), (_no(F.col("status").isin("approved", "rejected", "revoked")), "status"), (_no(F.trim("approved_by") != ""), "approved-by"), (_no(F.col("approved_at").rlike(UTC) & F.try_to_timestamp(F.col("approved_at")).isNotNull()), "approved-at"),
        (_no(F.col("authorization_id") == authorization_id()), "authorization-id"),
    )


def manifest_violations(shards: DataFrame, header: dict) -> DataFrame:
    """violation: what a shard manifest breaks. shards: its descriptors; header: schema_version, tokenizer_hash,
    source_manifest_hash and, where given, the totals records and tokens. No rows: it is valid."""
    facts = shards.agg(
        F.count("*").alias("n"), F.count_distinct("shard_id").alias("ids"), F.count_distinct("path").alias("paths"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"),
        F.when(F.count("*") == F.count("tokens"), F.coalesce(F.sum("tokens"), F.lit(0))).alias("tokens"), F.count_if(F.size(shard_violations()) > 0).alias("bad"),
    )
    header_rules = [(F.lit(header.get("schema_version", 1) != 1), "schema-version"), *((F.lit(not isinstance(header.get(k), str) or not header.get(k)), k.replace("_", "-")) for k in ("tokenizer_hash", "source_manifest_hash"))]
    totals = [(~F.col(k).eqNullSafe(F.lit(header[k])), f"{k}-total") for k in ("records", "tokens") if k in header]
    unknown = set(header) - {"schema_version", "tokenizer_hash", "source_manifest_hash", "records", "tokens"}
    rules = [*header_rules, (F.lit(bool(unknown)), "unknown-keys"), (F.col("bad") > 0, "descriptor"), (F.col("ids") < F.col("n"), "shard-ids-repeat"), (F.col("paths") < F.col("n"), "paths-repeat"), *totals]
    return facts.select(F.explode(reasons(*rules)).alias("violation"))


def check_limits(**limits: int) -> None:
    """Positive, and within the ceilings."""
    for k, v in limits.items():
        if not isinstance(v, int) or isinstance(v, bool) or not 0 < v <= CEILINGS[k]:
            raise ValueError(f"{k} must be a whole number from 1 to {CEILINGS[k]}")


def check_licenses(accepted: set[str], allowed: tuple[str, ...]) -> None:
    """Accepted licences may only narrow the policy's list."""
    if more := sorted(set(accepted) - set(allowed)):
        raise ValueError(f"licences outside the policy: {', '.join(more)}")


def check_project_path(root: str, path: str) -> str:
    """The absolute form of a path, which must stay below the root."""
    base = os.path.realpath(root)
    full = os.path.realpath(os.path.join(base, path))
    if full != base and not full.startswith(base + os.sep):
        raise ValueError(f"{path} leaves {root}")
    return full


def check_world(rank: int, world_size: int, local_rank: int = 0) -> None:
    """A worker's place among all."""
    if world_size < 1 or not 0 <= rank < world_size or not 0 <= local_rank < world_size:
        raise ValueError("need 0 <= rank < world_size")


def commit_ok(commit: Column) -> Column:
    return F.coalesce(commit.rlike(COMMIT), F.lit(False))


def critical_differences(saved: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """key, saved, current of the identity keys in which a resumed run differs from the saved one (one row each)."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.col(f"s.{k}").cast("string").alias("saved"), F.col(f"c.{k}").cast("string").alias("current")) for k in keys))
    both = saved.limit(1).alias("s").join(current.limit(1).alias("c"))
    return both.select(F.explode(pairs).alias("p")).select("p.*").where(~F.col("saved").eqNullSafe(F.col("current")))


def check_shares(**shares: float) -> None:
    if any(not 0 <= v <= 1 for v in shares.values()) or not math.isclose(sum(shares.values()), 1.0, abs_tol=1e-9):
        raise ValueError("the shares of the splits must lie in [0, 1] and add up to 1")


def check_special_tokens(tokens: list[str], ids: dict[str, int]) -> None:
    if len(set(tokens)) != len(tokens) or any(not (t.startswith("<") and t.endswith(">")) for t in tokens):
        raise ValueError("special tokens must be distinct and in angle brackets")
    if [ids.get(t) for t in tokens] != list(range(len(tokens))):
        raise ValueError("special tokens must have the first ids, in order")
