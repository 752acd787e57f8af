"""Candidates of a similarity join that lose no pair and need few bytes of a set: equal segments, then a parity bitmap.

Two sets with Jaccard >= t differ in d <= (1 - t) / (1 + t) (n_x + n_y) items. The items' hashes are cut into more than d
segments, the same ones for all sets of a size class, so a pair has a segment in which both hold the same items: joined are
32-bit names of segments, about 0.3 of them an item at t = 0.85. On a ring, by the cycle lemma, one of these segments and the
k - 1 that follow it differ in less than k items, for any k. So each name has a check, the parity of the items of CHAIN segments in 32 cells, and
checks differ in less than CHAIN cells. A bitmap of the parity of all items differs in at most d cells, which nearly no candidate but a
similar pair passes. Only pairs that pass need their sets."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.text import TOKEN, normalized

#: Below this threshold segments would hold too few items to tell sets apart.
LEAST = 0.8
#: The largest over the smallest size of a class. Sets near a class's end are named in the next class as well.
RATIO = 1.5
SKETCH = "n int, segments binary, parity binary"
ASCII_TOKEN = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*|[^\t-\r\x1c-\x20]")
#: Words of which the hashes are kept at once by a Python worker.
KNOWN = 500_000
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
PAIRS_AT_ONCE = 1_000_000
CHAIN = 5


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * M2
    x = (x ^ (x >> np.uint64(29))) * M3
    return x ^ (x >> np.uint64(32))


class Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


def shingle_hashes(words: list[str], known: Words, width: int = 5) -> np.ndarray:
    """Distinct hashes of each `width` words; of all words if they are fewer. Sorted."""
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(width, len(h)), np.uint64)
    for k in range(min(width, len(h))):
        out = mixed(out * M1 + h[k : k + n])
    return np.unique(out)


@lru_cache(maxsize=100_000)
def classes(n: int, threshold: float) -> list[tuple[int, int, int]]:
    """Of each class that a set of n items is in: its number, its segments, and how many of them may be empty in a pair that still
    shares one that isn't (so many starts more has the ring)."""
    out, low, k = [], 1, 0
    while n >= threshold * low - 1e-6:
        high = max(low + 1, int(low * RATIO))
        if n < high:
            d = int(2 * (1 - threshold) / (1 + threshold) * (high - 1) + 1e-6)
            spare = 1 + d // 20 if d else 0
            out.append((k, d + 1 + spare, spare))
        low, k = high, k + 1
    return out


def sketch(items: np.ndarray, threshold: float) -> tuple[bytes, bytes]:
    """Names of the segments and their checks, and the parity bitmap of the smallest power of two of cells that isn't less than n (64 at least).
    items: sorted, distinct, well mixed."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(items + M1), dtype=np.uint64)])
    bits = np.uint32(1) << (items & np.uint64(31)).astype(np.uint32)
    odd = np.bitwise_xor.accumulate(np.concatenate([np.zeros(1, np.uint32), bits]))
    names, checks = [], []
    for k, m, spare in classes(len(items), threshold):
        segment = ((items >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        ends = np.searchsorted(segment, np.arange(m + 1, dtype=np.uint64))
        name = mixed(mixed(sums[ends[1:]] - sums[ends[:-1]]) + mixed(np.arange(m, dtype=np.uint64) + np.uint64(k << 32)))
        some = ends[1:] > ends[:-1]
        stop = np.arange(m) + min(CHAIN, m)
        check = odd[ends[:-1]] ^ odd[ends[np.where(stop > m, stop - m, stop)]] ^ np.where(stop > m, odd[-1], np.uint32(0))
        if m - some.sum() <= spare:  # the spare segments make up for these empty ones
            name, check = name[some], check[some]
        names.append(name >> np.uint64(32))
        checks.append(check)
    cells = 1 << max(6, (len(items) - 1).bit_length())
    parity = np.bincount((items & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.concatenate([x.astype("<u4") for x in names + checks]).tobytes(), np.packbits(parity.astype(np.uint8)).tobytes()


def names_of(segments: bytes) -> np.ndarray:
    """Two rows: names, checks."""
    return np.frombuffer(segments, "<u4").reshape(2, -1)


def differ(x: bytes, y: bytes) -> int:
    """The cells in which two bitmaps differ; the larger is folded to the smaller one's cells first."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(p) > len(q):
        p, q = q, p
    if len(q) > len(p):
        q = np.bitwise_xor.reduce(q.reshape(-1, len(p)), axis=0)
    return int(np.bitwise_count(p ^ q).sum())


def tokens(text: Column) -> list[Column]:
    """What the Python side cuts into words: the normalised text, and its words already cut where it isn't ASCII."""
    return [text.alias("text"), F.when(text.rlike(r"[^\x00-\x7f]"), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).alias("words")]


def _items(batch: pa.RecordBatch, known: Words) -> Iterator[np.ndarray | None]:
    """Of each row its distinct mixed items. The last columns are text and words, or items alone."""
    if batch.schema.names[-1] == "words":
        for text, words in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)):
            yield shingle_hashes(words.as_py() if words.is_valid else ASCII_TOKEN.findall(text.as_py()), known) if text.is_valid else None
    else:
        for x in batch.column(batch.num_columns - 1):
            yield np.unique(mixed(x.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + M1)) if x.is_valid else None


def _sketches(threshold: float, keep: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                rows = [(None, None, None) if x is None else (len(x), *(sketch(x, threshold) if len(x) else (b"", b""))) for x in _items(part, known)]
                made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(keep)), *made], names=names)

    return run


def _sets(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if x is None else x.tobytes() for x in _items(part, known)], pa.binary())], names=names)

    return run


def source(rows: DataFrame, *keep: str) -> DataFrame:
    """id, keep and what _items reads. rows: id, and text (normalised or not, see `text_rows`) or items."""
    if "items" in rows.columns:
        kind = rows.schema["items"].dataType.elementType.typeName()
        items = F.col("items").cast("array<bigint>") if kind in ("byte", "short", "integer", "long") else F.transform("items", lambda x: F.xxhash64(x))
        return rows.select("id", *keep, items.alias("items"))
    return rows.select("id", *keep, *tokens(F.col("text")))


def text_rows(rows: DataFrame, text: str = "text", id_col: str = "record_id", *keep: str) -> DataFrame:
    return rows.select(F.col(id_col).alias("id"), *keep, normalized(F.col(text)).alias("text"))


def sketches(rows: DataFrame, threshold: float, *keep: str) -> DataFrame:
    """id, keep, n, segments, parity of each row; number names the row once the result is stored. Null sets have nulls."""
    read = source(rows, *keep)
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.select("id", *keep).schema)
    names = ["id", *keep, *(x.split()[0] for x in SKETCH.split(", "))]
    return read.mapInArrow(_sketches(threshold, 1 + len(keep), names), f"{own}, {SKETCH}").withColumn("number", F.monotonically_increasing_id())


def sets_of(rows: DataFrame) -> DataFrame:
    """id, x: the sorted 64-bit hashes of the items."""
    read = source(rows)
    return read.mapInArrow(_sets(["id", "x"]), f"id {read.schema['id'].dataType.simpleString()}, x binary")


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers = [batch.column(0).to_numpy(zero_copy_only=False) for batch in batches]
    number = np.sort(np.concatenate(numbers)) if numbers else np.zeros(0, np.int64)
    for part in np.unique(number >> 33):
        rows = number[np.searchsorted(number, part << 33) : np.searchsorted(number, (part + 1) << 33)] & ((1 << 33) - 1)
        bits = np.zeros(int(rows[-1]) + 1, np.uint8)
        bits[rows] = 1
        yield pa.RecordBatch.from_arrays([pa.array([int(part)], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["part", "bits"])


def bits_of(numbers: DataFrame) -> dict[int, bytes]:
    """A bit for each row of a stored table, by its partitions: whether `number` is among these. 2 MB for 16 million rows; so that
    rows are left out where they are stored, without a shuffle."""
    rows = numbers.select("number").repartition(F.shiftright("number", 33)).mapInArrow(_bits, "part bigint, bits binary").collect()
    return {r["part"]: bytes(r["bits"]) for r in rows}


def _kept(batch: pa.RecordBatch, bits: dict[int, bytes]) -> pa.RecordBatch:
    number = batch.column(0).to_numpy(zero_copy_only=False)
    keep = np.zeros(len(number), bool)
    for part in np.unique(number >> 33):
        own = np.flatnonzero(number >> 33 == part)
        rows = number[own] & ((1 << 33) - 1)
        flags = np.unpackbits(np.frombuffer(bits.get(int(part), b""), np.uint8))
        inside = rows < len(flags)
        keep[own[inside]] = flags[rows[inside]] == 1
    return batch.filter(pa.array(keep))


def _dealt(parts: int, bits: dict[int, bytes] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if bits is not None:
                batch = _kept(batch, bits)
            listed = [names_of(x) for x in batch.column(1).to_pylist()]
            if not listed:
                continue
            name, check = np.concatenate(listed, axis=1)
            number = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [x.shape[1] for x in listed])
            part = name.astype(np.uint64) * np.uint64(parts) >> np.uint64(32)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
            spans = [(k, a, b) for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if b > a]
            blobs = ([x[a:b].tobytes() for _, a, b in spans] for x in (name[order], check[order], number[order].astype("<i8")))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in spans], pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)], names=["part", "name", "check", "number"])

    return run


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [batch for batch in batches if batch.num_rows]
    if not parts:
        return
    name, check, number = (np.concatenate([np.frombuffer(x, kind) for batch in parts for x in batch.column(i).to_pylist()]) for i, kind in ((1, "<u4"), (2, "<u4"), (3, "<i8")))
    parts.clear()
    order = np.argsort(name, kind="stable")
    name, check, number = name[order], check[order], number[order]

    def out(found: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.sort(np.concatenate(found), axis=1)
        a, b = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))].T
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["a", "b"])

    at, step, found, size = np.arange(len(name)), 0, [], 0
    while len(at):
        step += 1
        at = at[: np.searchsorted(at, len(name) - step)]
        at = at[name[at] == name[at + step]]
        i = at[(np.bitwise_count(check[at] ^ check[at + step]) < CHAIN) & (number[at] != number[at + step])]
        if len(i):
            found.append(np.stack([number[i], number[i + step]], 1))
            size += len(i)
        if size >= PAIRS_AT_ONCE:
            yield out(found)
            found, size = [], 0
    if size:
        yield out(found)


def _near(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (2, 3))
            most = (1 - threshold) / (1 + threshold) * (n_a + n_b) + 1e-6
            fits = np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b) - 1e-6
            keep = [bool(f) and differ(x, y) <= d for f, d, x, y in zip(fits, most, batch.column(4).to_pylist(), batch.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _common(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            made = [[len(np.intersect1d(x, y, assume_unique=True)) for x, y in pairs], [len(x) for x, _ in pairs], [len(y) for _, y in pairs]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in made)], names=names)

    return run


def candidates(stored: DataFrame, threshold: float, only: DataFrame | None = None) -> DataFrame:
    """a, b: the numbers of all pairs of stored sketches that can be similar, and of few others. only: the numbers of those that
    take part."""
    spark = stored.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    some = stored.where("n > 0")
    dealt = some.select("number", "segments").mapInArrow(_dealt(parts, None if only is None else bits_of(only)), "part int, name binary, check binary, number binary")
    pairs = dealt.repartition(parts, "part").mapInArrow(_paired, "a bigint, b bigint").distinct()
    x = some.select(F.col("number").alias("a"), F.col("n").alias("n_a"), F.col("parity").alias("x"))
    both = pairs.join(x, "a").join(x.toDF("b", "n_b", "y"), "b").select("a", "b", "n_a", "n_b", "x", "y")
    return both.mapInArrow(_near(threshold), "a bigint, b bigint")


def counted(near: DataFrame, rows: DataFrame) -> DataFrame:
    """near: a, b (ids). Adds common and jaccard, from the rows' sets; read are only the rows of these ids."""
    wanted = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # texts of few rows pass this; by a hash, which is short, so that no text is shuffled
    some = rows.join(F.broadcast(wanted.select(F.xxhash64("id").alias("wanted")).distinct()), F.xxhash64("id") == F.col("wanted"), "left_semi")
    x = sets_of(some).dropDuplicates(["id"])
    kind = near.schema["a"].dataType.simpleString()
    both = near.join(x.toDF("a", "x"), "a").join(x.toDF("b", "y"), "b").select("a", "b", "x", "y")
    names = ["a", "b", "common", "n_a", "n_b"]
    return both.mapInArrow(_common(names), f"a {kind}, b {kind}, common bigint, n_a bigint, n_b bigint").select("a", "b", "common", (F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))).alias("jaccard"))
