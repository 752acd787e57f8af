"""Measures of a public tokenizer over a corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEXICAL = re.compile(r"[A-Za-z_$][\w$]*|\d+|\S")
ROWS = "bytes bigint, chars bigint, tokens bigint, lines bigint, lexical bigint, same int, used array<int>"


def tokenizer_metrics(documents: DataFrame, tokenizer_file: str) -> DataFrame:
    """One row of weighted ratios. Texts are encoded in Arrow batches; a batch sends its distinct ids once, so what is
    shuffled is bounded by batches times vocabulary."""
    schema = [x.split() for x in ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_file)
        tok.encode_special_tokens = True
        used: set[int] = set()
        total = [0] * 6
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t is not None]
            for k in range(0, len(texts), 256):
                part = texts[k : k + 256]
                for t, e in zip(part, tok.encode_batch(part, add_special_tokens=False)):
                    used.update(e.ids)
                    for i, v in enumerate((len(t.encode()), len(t), len(e.ids), max(1, len(t.splitlines())), len(LEXICAL.findall(t)), int(tok.decode(e.ids, skip_special_tokens=False) == t))):
                        total[i] += v
        yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32() if n == 5 else pa.int64()) for n, v in enumerate(total)), pa.array([sorted(used)], pa.list_(pa.int32()))], names=[n for n, _ in schema])

    from tokenizers import Tokenizer

    size = Tokenizer.from_file(tokenizer_file).get_vocab_size()
    rows = documents.where("text is not null").select("text").mapInArrow(run, ROWS)
    from lodestrand.session import cut

    rows = cut(rows)
    used = rows.select(F.explode("used").alias("id")).agg(F.count_distinct("id").alias("distinct_ids"))
    s = rows.agg(*(F.sum(c).alias(c) for c in ("bytes", "chars", "tokens", "lines", "lexical", "same")))
    n = F.greatest(F.col("tokens"), F.lit(1))
    texts = documents.where("text is not null").agg(F.count("*").alias("documents"))
    return s.join(used).join(texts).select("documents", (F.col("bytes") / n).alias("bytes_per_token"), (F.col("chars") / n).alias("characters_per_token"), (F.col("tokens") / F.greatest("lines", F.lit(1))).alias("tokens_per_line"),
        (F.col("tokens") / F.greatest("lexical", F.lit(1))).alias("tokens_per_lexical_token"), (F.col("same") / F.greatest("documents", F.lit(1))).alias("round_trip_rate"), (F.col("distinct_ids") / F.lit(size)).alias("vocabulary_utilization"))
