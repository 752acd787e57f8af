import re

from pyspark.sql import functions as F

from lodestrand.functions import model, paths
from lodestrand.functions import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_normalized_text(spark):
    assert one(spark, T.normalized(F.col("t")), t="//x\nconst x = 1") == "const x = 1"
    assert one(spark, T.normalized(F.col("t")), t="a /* b\n */ c // d") == "a c"


def test_quality_of_empty_and_crlf(spark):
    q = one(spark, T.quality_metrics(F.col("t")), t="")
    assert (q.size_bytes, q.line_count, q.max_line_length, q.repetition_ratio) == (0, 1, 0, 0.0)
    text = "a\r\nb é\n"
    q = one(spark, T.quality_metrics(F.col("t")), t=text)
    assert q.line_count == len(text.splitlines()) and q.size_bytes == len(text.encode())


def test_shingles_match_python(spark):
    import hashlib

    def python(text):
        tokens = re.findall(r"[A-Za-z_$][\w$]*|\S", re.sub(r"\s+", " ", re.sub(r"/\*[\s\S]*?\*/|//[^\n]*", "", text)).strip())
        return {hashlib.sha256("\x1f".join(tokens[i : i + 5]).encode()).hexdigest()[:16] for i in range(max(1, len(tokens) - 4))}

    for text in ("", "a b", "const é = (x) => x + 1; // c", "let a=1\nlet b=2\nlet a=1"):
        assert set(one(spark, T.shingles(F.col("t")), t=text)) == python(text)


def test_repetition_and_accuracy(spark):
    assert one(spark, T.repetition_rate(F.col("t")), t="a b") == 0.0
    assert one(spark, T.repetition_rate(F.col("t")), t="a b c a b c") == 0.25
    df = spark.createDataFrame([([1, 2], [1, 3]), ([], [1])], "e array<int>, a array<int>")
    assert [r.x for r in df.select(T.token_accuracy(F.col("e"), F.col("a")).alias("x")).collect()] == [0.5, 1.0]


def test_uris(spark):
    cases = {
        "https://user:pw@git.example:8443/a/b.git?token=x#y": "https://git.example:8443/a/b.git", "https://git.example:99999/a": "https://git.example/a", "urn:repo?x=1": "urn:repo", "local/path?sig=1#f": "local/path",
        "HTTPS://Git.Example/A": "https://git.example/A",
    }
    for raw, safe in cases.items():
        assert one(spark, paths.safe_uri(F.col("u")), u=raw) == safe


def test_paths(spark):
    def kind(p):
        return one(spark, paths.source_type(F.col("p")), p=p)

    assert [kind(p) for p in ("tests/a.d.ts", "tests/a.tsx", "src/test/a.ts", "package.json", "a.ts", "a.md")] == ["declaration", "code", "test", "metadata", "code", "metadata"]
    assert one(spark, paths.path_reasons(F.col("p")), p="a/vendor/b.ts") == ["excluded-path"]
    assert one(spark, paths.path_reasons(F.col("p")), p="a/b.PEM") == ["excluded-file-type"]
    assert one(spark, paths.in_scope(F.col("p"), ["include:src/*"]), p="src/a/b.ts") and not one(spark, paths.in_scope(F.col("p"), ["exclude:x"]), p="src/a.ts")
    assert one(spark, paths.harness_reasons(F.col("p"), F.col("t")), p="tests/x.ts", t="verify.completions(1)") == ["test-harness-verify-api"]


def test_draws_match_python(spark):
    import hashlib

    for key in ("a", "b", "c", "zz"):
        d = int(hashlib.sha256(f"42:{key}".encode()).hexdigest()[:16], 16) / 2**64
        assert one(spark, T.split_of(F.col("k")), k=key) == ("train" if d < 0.9 else "validation" if d < 0.95 else "test")
        assert one(spark, T.owner_of(F.col("k"), 7), k=key) == int(hashlib.sha256(key.encode()).hexdigest()[:16], 16) % 7


def test_model_totals_and_rates(spark):
    row = spark.range(1).select(*(c.alias(k) for k, c in model.parameter_totals(*map(F.lit, (100, 8, 2, 4, 2, 16, True))).items())).first()
    assert row.total == 100 * 8 + 2 * (64 * 2 + 8 * 4 * 2) + 2 * 3 * 8 * 16 + 2 * 16 + 8
    rates = [r.x for r in spark.createDataFrame([(0,), (9,), (10,), (200,)], "s int").select(model.cosine_rate(F.col("s"), 10, 200).alias("x")).collect()]
    assert rates[0] == 0.1 and rates[1] == 1.0 and rates[2] == 1.0 and abs(rates[3] - 0.1) < 1e-12
