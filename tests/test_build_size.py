"""What the corpus build stores between its steps."""

from lodestrand.plans import corpus


def test_only_the_first_stored_table_of_a_build_has_whole_records(spark, monkeypatch):
    rows = [("r", "https://github.com/a/b", "c" * 40, "2024-01-01T00:00:00Z", p, t) for p, t in (("LICENSE", "Permission is hereby granted, free of charge, to any person"), ("a.ts", "let a = 1;\n"), ("b.ts", "let a = 1;\n"))]
    files = spark.createDataFrame(rows, "repository_id string, source_uri string, commit_sha string, retrieved_at string, relative_path string, text string")
    stored, cut = [], corpus.cut
    monkeypatch.setattr(corpus, "cut", lambda df: stored.append(df.columns) or cut(df))
    built = {r.relative_path: r for r in corpus.build(files).collect()}
    assert "quality_metrics" in stored[0] and len(stored) > 2 and all(len(c) <= 6 for c in stored[1:])
    assert sorted("duplicate" in built[p].exclusion_reasons for p in ("a.ts", "b.ts")) == [False, True]
