import json

import pytest
from pyspark.sql import functions as F

from lodestrand import schemas
from lodestrand.plans import corpus
from lodestrand.sources import files, sinks
from lodestrand.streaming import shards


def tree(root):
    for path, text in {"LICENSE": "Permission is hereby granted, free of charge", "src/a.ts": "export const a = 1;\n", "src/b.ts": "// again\nexport const a = 1;\n", "src/c.gen.ts": "export const c = 3;\n", "README.md": "# x\n"}.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (root / "src/bad.ts").write_bytes(b"const \xff = 1;")


def test_scan_and_build(spark, tmp_path):
    tree(tmp_path)
    scanned = files.repository_files(spark, str(tmp_path))
    rows = {r.relative_path: r for r in scanned.collect()}
    assert rows["src/bad.ts"].reasons == ["invalid-utf8"] and "�" in rows["src/bad.ts"].text
    with pytest.raises(files.BoundError, match="max_files"):
        files.repository_files(spark, str(tmp_path), max_files=1)
    assert {r.relative_path for r in files.repository_files(spark, str(tmp_path), max_file_bytes=16).where("array_contains(reasons, 'oversized')").collect()} == {"LICENSE", "src/a.ts", "src/b.ts", "src/c.gen.ts"}
    one = scanned.select(F.lit("r").alias("repository_id"), F.lit("https://x.example/r").alias("source_uri"), F.lit("fixture").alias("commit_sha"), F.lit("t").alias("retrieved_at"), "relative_path", "text")
    built = {r.relative_path: r for r in corpus.build(one).collect()}
    assert built["src/a.ts"].normalized_sha256 == built["src/b.ts"].normalized_sha256 and built["src/a.ts"].included != built["src/b.ts"].included
    assert "generated-filename" in built["src/c.gen.ts"].exclusion_reasons and not built["README.md"].included and built["src/a.ts"].dedup_cluster == built["src/b.ts"].dedup_cluster
    assert all(r.split == "excluded" for r in built.values() if not r.included)


def test_strict_json_lines(spark, tmp_path):
    good = {"id": "a", "filename": "f", "prompt": "p", "max_new_tokens": 3}
    (tmp_path / "ok").write_text(json.dumps(good) + "\n\n")
    assert files.strict_json_lines(spark, str(tmp_path / "ok"), schemas.COMPLETION_TASK).first().prompt == "p"
    for bad in (good | {"extra": 1}, {"id": "a"}):
        (tmp_path / "bad").write_text(json.dumps(bad) + "\n")
        with pytest.raises(Exception, match="keys"):
            files.strict_json_lines(spark, str(tmp_path / "bad"), schemas.COMPLETION_TASK).collect()
    (tmp_path / "tasks.json").write_text(json.dumps({"tasks": [good]}))
    assert files.tasks(spark, str(tmp_path / "tasks.json"), schemas.COMPLETION_TASK).count() == 1


def test_shards_round_trip_and_tamper(spark, tmp_path):
    rows = spark.createDataFrame([(f"{i:064x}", "train", f"text {i}") for i in range(25)], "record_id string, split string, text string")
    index = sinks.write_shards(rows, str(tmp_path / "s"), 10)
    assert [r.records for r in index.orderBy("shard").collect()] == [10, 10, 5]
    again = sinks.shard_index(spark.read.text(str(tmp_path / "s")).select("shard", F.get_json_object("value", "$.record_id").alias("record_id"), F.col("value").alias("line")))
    assert sinks.stale_shards(index, again.withColumn("shard", F.col("shard").cast("bigint"))).count() == 0
    assert sinks.stale_shards(index, again.withColumn("sha256", F.lit("x"))).count() == 3


def test_ledger_append_and_overwrite_guard(spark, tmp_path):
    row = spark.createDataFrame([("a", "x")], "approval_id string, status string")
    sinks.append_ledger(row, str(tmp_path / "l"), "approval_id")
    with pytest.raises(ValueError, match="exists"):
        sinks.append_ledger(row, str(tmp_path / "l"), "approval_id")
    records = spark.createDataFrame([("b", 1), ("a", 2)], "record_id string, n int")
    sinks.write_manifest(records, str(tmp_path / "m"))
    with pytest.raises(Exception, match="exists|EXISTS"):
        sinks.write_manifest(records, str(tmp_path / "m"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "m")).collect()] == [{"n": 2, "record_id": "a"}, {"n": 1, "record_id": "b"}]


def test_stream_owners_resume(spark, tmp_path):
    schema = schemas.struct("record_id string, text string")
    source = tmp_path / "in"
    source.mkdir()
    (source / "0.json").write_text("".join(json.dumps({"record_id": f"r{i}", "text": "// @Filename: /a.ts" if i == 3 else "t"}) + "\n" for i in range(8)))
    seen = []

    def write(df, number):
        seen.extend(r.record_id for r in df.collect())

    for rank in range(2):
        stream = shards.for_worker(shards.ordinary(shards.stream_documents(spark, str(source), schema)), "record_id", rank, 2)
        shards.drain(stream, str(tmp_path / f"c{rank}"), write).awaitTermination()
    assert sorted(seen) == [f"r{i}" for i in range(8) if i != 3]
    (source / "1.json").write_text(json.dumps({"record_id": "later", "text": "t"}) + "\n")
    for rank in range(2):
        stream = shards.for_worker(shards.ordinary(shards.stream_documents(spark, str(source), schema)), "record_id", rank, 2)
        shards.drain(stream, str(tmp_path / f"c{rank}"), write).awaitTermination()
    assert seen.count("later") == 1 and len(seen) == 8
