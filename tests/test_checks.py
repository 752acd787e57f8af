import pytest
from pyspark.sql import functions as F

from lodestrand import schemas
from lodestrand.operators import checks


def test_links(spark):
    df = spark.createDataFrame([("a/b/l", "../c"), ("l", "../x"), ("a/l", "/etc"), ("a/m", "./m"), ("a/b/n", "../../d//e/.")], "path string, target string")
    assert [r.x for r in df.select(checks.inside_target(F.col("path"), F.col("target")).alias("x")).collect()] == ["a/c", None, None, "a/m", "d/e"]
    entries = spark.createDataFrame([("a/c",), ("a/m",)], "path string")
    assert {(r.path, r.fault) for r in checks.dangling_links(df, entries).collect()} == {("l", "outside"), ("a/l", "outside"), ("a/m", "cyclic"), ("a/b/n", "dangling")}
    chain = spark.createDataFrame([(f"l{i}", f"l{i + 1}") for i in range(40)] + [("x", "y"), ("y", "x"), ("z", "gone"), ("w", "z"), ("f", "a"), ("e", ""), ("b", "a\\c"), ("r", ".")], "path string, target string")
    found = {(r.path, r.fault) for r in checks.dangling_links(chain, spark.createDataFrame([("l40",), ("a/c",)], "path string")).collect()}
    assert found == {("x", "cyclic"), ("y", "cyclic"), ("z", "dangling"), ("w", "dangling"), ("e", "outside"), ("b", "outside"), ("r", "outside")}


def test_addresses(spark):
    good = ["https://github.com/a/b", "https://github.com/a--b/b.c", "https://github.com/A-/x_y"]
    bad = ["https://github.com/a/b.git", "https://github.com/a/b/", "http://github.com/a/b", "https://github.com/a/b?x", "https://github.com/-a/b", "https://github.com/a/.b", "https://u@github.com/a/b", None]
    df = spark.createDataFrame([(x,) for x in good + bad], "u string")
    assert [r.x for r in df.select(checks.canonical_github(F.col("u")).alias("x")).collect()] == [True] * 3 + [False] * len(bad)


def test_shard_manifests(spark):
    header = {"tokenizer_hash": "t", "source_manifest_hash": "m", "records": 3, "tokens": None}
    shards = spark.createDataFrame([("a", "x/a", 1, 5, None), ("b", "x/b", 2, None, None)], schemas.SHARD)
    of = lambda s, h: {r.violation for r in checks.manifest_violations(s, h).collect()}
    assert of(shards, header) == set()
    assert of(shards.unionByName(shards), header | {"schema_version": 2, "other": 1}) == {"schema-version", "unknown-keys", "shard-ids-repeat", "paths-repeat", "records-total"}
    assert of(spark.createDataFrame([("a/b", "/x", -1, 5, None)], schemas.SHARD), {"tokens": 4}) == {"tokenizer-hash", "source-manifest-hash", "descriptor", "tokens-total"}


def test_tree_entries(spark):
    df = spark.createDataFrame([("a/b.ts", "100644", "blob"), ("a/../b", "100644", "blob"), (".GIT/x", "100644", "blob"), ("a", "160000", "commit"), (None, "040000", "tree")], "p string, m string, k string")
    assert [r.x for r in df.select(checks.tree_entry_violations(F.col("p"), F.col("m"), F.col("k")).alias("x")).collect()] == [[], ["unsafe-path"], [], ["mode"], ["unsafe-path", "mode"]]


def test_cursor_and_shards(spark):
    df = spark.createDataFrame([(0, 1, 2, 3, 0, 2), (0, 1, 2, 3, 2, 2), (0, -1, None, 0, 0, 0)], schemas.CURSOR)
    rows = df.select(checks.cursor_violations().alias("v"), checks.cursor_behind().alias("n")).collect()
    assert rows[0].v == [] and rows[0].n.record_offset == 3 and rows[1].v == ["rank-of-world"] and {"shard_index", "record_offset", "world_size"} <= set(rows[2].v)
    shard = spark.createDataFrame([("s", "a/b", 1, None, None), ("", "../a", -1, -1, "x")], schemas.SHARD)
    assert [len(r.v) for r in shard.select(checks.shard_violations().alias("v")).collect()] == [0, 5]


def test_authorization_and_identity(spark):
    empty = spark.createDataFrame([tuple([None] * 13)], schemas.AUTHORIZATION)
    assert len(empty.select(checks.authorization_violations().alias("v")).first().v) == 12
    a, b = spark.createDataFrame([(1, "x")], "seed int, name string"), spark.createDataFrame([(2, "x")], "seed int, name string")
    assert [(r.key, r.saved, r.current) for r in checks.critical_differences(a, b, ["seed", "name"]).collect()] == [("seed", "1", "2")]


def test_authorizations_match_in_all_keys(spark):
    from lodestrand.operators import governance

    row = {"schema_version": 1, "run_name": "r", **{k: "0" * 64 for k in checks.AUTHORIZATION_DIGESTS}, "max_tokens": 10, "status": "rejected", "approved_by": "x", "approved_at": "2024-01-02T03:04:05Z", "notes": ""}
    ledger = spark.createDataFrame([row], "schema_version int, run_name string, training_config_sha256 string, model_config_sha256 string, manifest_sha256 string, corpus_sha256 string, tokenizer_sha256 string, max_tokens bigint, status string, approved_by string, approved_at string, notes string")
    ledger = ledger.withColumn("authorization_id", checks.authorization_id())
    assert ledger.select(checks.authorization_violations().alias("v")).first().v == []
    for c, value, name in (("approved_at", "2024-01-02T03:04:05+00:00", "approved-at"), ("approved_at", "2024-13-02T03:04:05Z", "approved-at"), ("status", "open", "status"), ("run_name", "a/b", "run-name")):
        changed = ledger.withColumn(c, F.lit(value)).withColumn("authorization_id", checks.authorization_id())
        assert changed.select(checks.authorization_violations().alias("v")).first().v == [name]
    runs = ledger.select(*governance.AUTHORIZED).unionByName(ledger.select(*governance.AUTHORIZED).withColumn("max_tokens", F.lit(11)))
    assert sorted(r.state for r in governance.matching_authorization(runs, ledger).collect()) == ["missing", "rejected"]


def test_settings(tmp_path):
    checks.check_limits(max_files=5, timeout_seconds=600)
    checks.check_licenses({"MIT"}, ("MIT", "ISC"))
    assert checks.check_project_path(str(tmp_path), "a/../b") == str(tmp_path.resolve() / "b")
    for wrong in (lambda: checks.check_limits(timeout_seconds=601), lambda: checks.check_limits(max_files=0), lambda: checks.check_licenses({"GPL-3.0"}, ("MIT",)), lambda: checks.check_project_path(str(tmp_path), "../x"), lambda: checks.check_world(2, 2)):
        with pytest.raises(ValueError):
            wrong()
    checks.check_shares(train=0.9, validation=0.05, test=0.05)
    with pytest.raises(ValueError):
        checks.check_shares(train=0.9, test=0.2)
    checks.check_special_tokens(["<pad>", "<eos>"], {"<pad>": 0, "<eos>": 1})
    with pytest.raises(ValueError):
        checks.check_special_tokens(["<pad>", "<pad>"], {"<pad>": 0})
