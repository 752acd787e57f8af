"""Problem 3: the same or nearly the same texts on both sides of a split.

Method: a text is reduced to its words (comments, layout, quotes and character form left out), and those to a
similarity hash. Each of its 288 samples is the pair of neighbouring words that comes first under a permutation of
its own, so two texts agree in a sample as often as their distinct pairs are common ones. The hash's bits are one
bit of each of 192 samples; its 96 blocks are the names of three samples each. Train and held-out texts are joined on equal
blocks, pairs whose lengths can't match or whose bits lie beyond a Hamming radius fall away inside the join, and
the rest is verified by the longest common subsequence of the words.

Pairs of words tell texts apart that share most of a language's and a template's words: of two unrelated texts 2 % of
the pairs are common, of texts with a quarter of the words replaced at random 40 %. Texts with equal words are one
class throughout: copies are never paired with each other, only expanded at the end into the rows of the result.

A pair is lost if no block is equal or the bits say too little; README.md has the measured recall by share of
common words. More blocks or fewer samples a block lose less and join more.

Defined results: null texts and texts under min_chars characters are in no pair; split values are trimmed
and lower-cased; rows that repeat a doc_id count once; other columns pass unread; no rows, no pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.words import WordHash, code_words, common_words, extension
from lodestrand.session import cut

HELD_OUT = ("validation", "test")
#: Blocks of a hash, and samples in a block: texts with a share J of their pairs in common miss all blocks with (1 - J**3)**96.
BLOCKS, SAMPLES = 96, 3
#: Hamming radius of the hash's 192 bits, of which two texts differ in (1 - J) / 2: about 58 at three quarters of the words, 94 if unrelated.
BITS, RADIUS = 192, 78
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
CODES = "doc_id bigint, split string, source string, class binary, words binary, n_words int"
KEYS = "class binary, side int, n_words int, bits array<bigint>, keys array<bigint>"


def mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= MIX[1]
    x ^= x >> np.uint64(29)
    x *= MIX[2]
    x ^= x >> np.uint64(32)
    return x




SEEDS = mixed(np.arange(1, BLOCKS * SAMPLES + 1, dtype=np.uint64) * MIX[0]) | np.uint64(1)


def samples(words: np.ndarray) -> np.ndarray:
    """Of each permutation the smallest number of a pair of neighbouring words (of the word, where there is but one)."""
    w = words.astype(np.uint64)
    pairs = np.unique(w[:-1] * MIX[0] ^ w[1:] * MIX[1] if len(w) > 1 else w)
    pairs = mixed(pairs * MIX[2])
    out = np.full(len(SEEDS), np.iinfo(np.uint64).max)
    for k in range(0, len(pairs), 256):
        x = pairs[k : k + 256, None] ^ SEEDS
        x *= SEEDS
        x ^= x >> np.uint64(32)
        x *= MIX[1]
        np.minimum(out, x.min(0), out=out)
    return out


def fingerprint(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The similarity hash of a text: its bits, as 64-bit numbers, and its blocks' names."""
    s = samples(words)
    bits = np.packbits((s[:BITS] >> np.uint64(20) & np.uint64(1)).astype(np.uint8)).view(np.int64)
    parts = s.reshape(BLOCKS, SAMPLES)
    name = parts[:, 0].copy()
    for k in range(1, SAMPLES):
        name = mixed(name * MIX[0] + parts[:, k])
    return bits, mixed(name).view(np.int64)


def numbers(words: list[str], known: WordHash) -> np.ndarray:
    """Words as 32-bit numbers, half as long to keep as 64-bit ones."""
    return (known.array(words) & 0xFFFFFFFF).astype(np.uint32)


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHash()
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            paths, texts = part.column(3).to_pylist(), part.column(4).to_pylist()
            names, words, n = [], [], []
            for path, text in zip(paths, texts):
                w = code_words(text, extension(path))
                names.append(hashlib.blake2b("\n".join(w).encode("utf-8", "surrogatepass"), digest_size=16).digest())
                words.append(numbers(w, known).tobytes())
                n.append(len(w))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array(names, pa.binary()), pa.array(words, pa.binary()), pa.array(n, pa.int32())], names=[x.split()[0] for x in CODES.split(", ")])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [fingerprint(np.frombuffer(w, np.uint32)) for w in batch.column(3).to_pylist()]
        lists = [
            pa.ListArray.from_arrays(pa.array(np.arange(0, len(out) * size + 1, size), pa.int32()), pa.array(np.concatenate([x[i] for x in out] or [np.zeros(0, np.int64)]), pa.int64()))
            for i, size in ((0, BITS // 64), (1, BLOCKS))
        ]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *lists], names=[x.split()[0] for x in KEYS.split(", ")])


def _verify(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = []
            for x, y in zip(a, b):
                p, q = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                keep.append(common_words(p, q) >= share * max(len(p), len(q)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def split_overlaps(documents: DataFrame, share: float = 0.75, min_chars: int = 200, radius: int = RADIUS) -> DataFrame:
    """doc_id_a, doc_id_b, split_a, split_b, source_a, source_b: a train and a held-out document, smaller id first."""
    split = F.lower(F.trim("split"))
    rows = documents.where(F.length("text") >= min_chars).select("doc_id", split.alias("split"), "source", "relative_path", "text").where(split.isin("train", *HELD_OUT))
    codes = cut(rows.mapInArrow(_codes, CODES))
    members = codes.select("doc_id", "split", "source", "class").dropDuplicates(["doc_id"])
    side = F.when(F.col("split") == "train", 1).otherwise(2).alias("side")
    keyed = codes.where("n_words > 0").select("class", side, "n_words", "words").mapInArrow(_hashes, KEYS)
    sides = keyed.groupBy("class").agg(F.bit_or("side").alias("sides"), *(F.first(c).alias(c) for c in ("n_words", "bits", "keys")))
    # joined by number: a class's name is twice as long
    sides = cut(sides.withColumn("number", F.monotonically_increasing_id()))
    words_of_bits = range(BITS // 64)
    a, b = (sides.where(w).select(F.col("number").alias(x), F.col("n_words").alias(f"n_{x}"), *(F.col("bits")[k].alias(f"{x}{k}") for k in words_of_bits), F.explode("keys").alias("key")) for x, w in (("a", "sides % 2 = 1"), ("b", "sides >= 2")))
    differ = F.lit(0)
    for k in words_of_bits:
        differ = differ + F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}")))
    pairs = a.join(b, "key").where("a <> b").where(F.least("n_a", "n_b") >= share * F.greatest("n_a", "n_b")).where(differ <= radius)
    name = sides.select("number", "class")
    near = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).distinct().join(name.toDF("x", "a"), "x").join(name.toDF("y", "b"), "y")
    near = cut(near.select("a", "b"))
    wanted = near.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    words = codes.join(wanted, "class", "left_semi").dropDuplicates(["class"]).select("class", "words")
    joined = near.join(words.toDF("a", "words_a"), "a").join(words.toDF("b", "words_b"), "b").select("a", "b", "words_a", "words_b")
    found = joined.mapInArrow(_verify(share), "a binary, b binary")
    found = found.unionByName(sides.where("sides = 3").select(F.col("class").alias("a"), F.col("class").alias("b")))
    train = members.where("split = 'train'").select(F.col("class").alias("a"), F.col("doc_id").alias("x"), F.col("split").alias("x_split"), F.col("source").alias("x_source"))
    held_out = members.where("split <> 'train'").select(F.col("class").alias("b"), F.col("doc_id").alias("y"), F.col("split").alias("y_split"), F.col("source").alias("y_source"))
    out = cut(found).join(train, "a").join(held_out, "b").where("x <> y")
    first = F.col("x") < F.col("y")
    return out.select(
        F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"),
        *(F.when(first, F.col(f"x_{c}")).otherwise(F.col(f"y_{c}")).alias(f"{c}_a") for c in ("split", "source")),
        *(F.when(first, F.col(f"y_{c}")).otherwise(F.col(f"x_{c}")).alias(f"{c}_b") for c in ("split", "source")),
    ).distinct()


def overlap_counts(pairs: DataFrame) -> DataFrame:
    """split, source: the held-out documents of each that occur in train, and in how many pairs."""
    a_held = F.col("split_a") != "train"
    return (
        pairs.select(F.when(a_held, F.col("split_a")).otherwise(F.col("split_b")).alias("split"), F.when(a_held, F.col("source_a")).otherwise(F.col("source_b")).alias("source"), F.when(a_held, F.col("doc_id_a")).otherwise(F.col("doc_id_b")).alias("doc_id"))
        .groupBy("split", "source").agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("pairs"))
    )
