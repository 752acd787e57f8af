"""Problem 7: token ids of whole corpora under a public byte-level BPE vocabulary.

Method: forced-boundary splitting. A pair of adjacent bytes that occurs inside no vocabulary token can
never be merged, so a text may be cut between the two and its fragments encoded on their own. Two more
conditions keep the pre-tokeniser from noticing the cut: the byte before it is ASCII and no white space
(a run of spaces is split by what follows it), and the byte after it is no apostrophe (which may open a
contraction only where the pre-tokeniser starts anew) and no continuation byte. Any subset of such cuts
is valid. ASCII text is cut between runs of letters, digits, marks and white space, which is checked against
the table of pairs; other text before line feeds, and finer inside long lines. Equal fragments are encoded
once per worker cache.

Null and empty texts have the ids [] (an empty list, never null). Extra columns are not read. Repeated
rows are encoded like any other row. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

TOKENIZER_DIR = "/opt/tokenizers"
#: The pre-tokeniser of the byte_bpe vocabularies (a fixed value of theirs).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fragments longer than this are cut again where the vocabulary forces a boundary.
LONG = 2048
#: Fragments that a worker remembers before it starts afresh.
REMEMBERED = 200_000


def vocabulary(name: str, directory: str = TOKENIZER_DIR) -> bytes:
    """The rank file of a public tokenizer; about 1 MB, so it may be broadcast."""
    return Path(directory, f"{name}.tiktoken").read_bytes()


def forced_cuts(ranks: dict[bytes, int]) -> np.ndarray:
    """cuts[256 * left + right]: a text may be cut between these two bytes."""
    inside = np.zeros(65536, bool)
    for token in ranks:
        t = np.frombuffer(token, np.uint8).astype(np.int64)
        inside[t[:-1] * 256 + t[1:]] = True
    cuts = ~inside.reshape(256, 256)
    cuts[128:, :] = False
    cuts[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32], :] = False
    cuts[:, 0x27] = False
    cuts[:, 0x80:0xC0] = False
    return cuts.reshape(-1)


#: ASCII classes between which byte-level BPE vocabularies hold no token. An apostrophe keeps all up to the next white space.
RUNS = ("A-Za-z", "0-9", r"!-&(-/:-@\[-`{-~")
FRAGMENT = re.compile(r"[\t-\r ]*(?:" + "|".join(f"[{x}]+" for x in RUNS) + r")(?:'[^\t-\r ]*)?|[\t-\r ]*'[^\t-\r ]*|[\t-\r ]+")
PLAIN = re.compile(r"[\t-\r -~]*")


class Known(dict):
    """Fragment to ids; encodes what it doesn't know, remembers what is short."""

    def __init__(self, bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, fragment: str) -> list[int]:
        ids = tuple(self.bpe.encode_ordinary(fragment))
        if len(fragment) <= 48:
            self[fragment] = ids
        return ids


class Encoder:
    def __init__(self, rank_file: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
        self.bpe = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cuts = forced_cuts(ranks)
        self.known = Known(self.bpe)
        chars = [[i for i in range(128) if re.fullmatch(f"[{x}]", chr(i))] for x in (*RUNS, r"\t-\r ")]
        between = [a * 256 + b for i, x in enumerate(chars[:3]) for j, y in enumerate(chars) if i != j for a in x for b in y]
        quote = [0x27 * 256 + b for b in chars[3]]
        #: whether this vocabulary forces a boundary wherever FRAGMENT cuts
        self.by_class = bool(self.cuts[between + quote].all())

    def fragments(self, text: str) -> list[str]:
        if self.by_class and PLAIN.fullmatch(text):
            return FRAGMENT.findall(text)
        return [x for line in self.lines(text) for x in (FRAGMENT.findall(line) if self.by_class and PLAIN.fullmatch(line) else (line,))]

    def lines(self, text: str) -> list[str]:
        """Cuts by the table of byte pairs: before line feeds, and finer inside long lines."""
        data = text.encode("utf-8")
        b = np.frombuffer(data, np.uint8).astype(np.int32)
        if len(b) < 2:
            return [text]
        may = np.flatnonzero(self.cuts[b[:-1] * 256 + b[1:]]) + 1
        at = may[b[may] == 10]
        gaps = np.diff(np.concatenate([at, [len(b)]]), prepend=0)
        if gaps.max() > LONG:
            long = gaps > LONG
            finer = []
            for end, gap in zip(np.concatenate([at, [len(b)]])[long].tolist(), gaps[long].tolist()):
                inner = may[np.searchsorted(may, end - gap, "right") : np.searchsorted(may, end)]
                # the first forced boundary of each stretch of LONG / 2 bytes
                finer.append(inner[np.unique((inner - (end - gap)) // (LONG // 2), return_index=True)[1]])
            at = np.unique(np.concatenate([at, *finer]))
        at = at.tolist()
        return [data[i:j].decode("utf-8") for i, j in zip([0, *at], [*at, len(data)])]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        ids = list(chain.from_iterable(map(self.known.__getitem__, self.fragments(text))))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return ids


@functools.lru_cache(maxsize=2)
def encoder(rank_file: bytes) -> Encoder:
    """One encoder a worker, whatever the number of batches."""
    return Encoder(rank_file)


def per_text(
    df: DataFrame, id_col: str, text_col: str, schema: str, make: Callable[[Encoder, pa.Array, list], list[pa.Array]], ranks: Broadcast
) -> DataFrame:
    """Arrow batches of (id, text) through make, at most 256 texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks.value)
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                yield pa.RecordBatch.from_arrays(make(enc, part.column(0), part.column(1).to_pylist()), names=names)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def _ids(enc: Encoder, keys: pa.Array, texts: list) -> list[pa.Array]:
    ids = [enc.encode(t) for t in texts]
    return [keys, pa.array(ids, pa.list_(pa.int32()))]


def _counts(enc: Encoder, keys: pa.Array, texts: list) -> list[pa.Array]:
    return [keys, pa.array([len(enc.encode(t)) for t in texts], pa.int64())]


def token_ids(spark: SparkSession, documents: DataFrame, tokenizer: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR) -> DataFrame:
    """doc_id, ids: the token ids of each text, without special tokens; [] for empty and null texts."""
    ranks = spark.sparkContext.broadcast(vocabulary(tokenizer, directory))
    return per_text(documents, "doc_id", "text", "doc_id bigint, ids array<int>", _ids, ranks)


def token_counts(spark: SparkSession, documents: DataFrame, tokenizer: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR) -> DataFrame:
    """doc_id, n_tokens: the length of token_ids; 0 for empty and null texts."""
    ranks = spark.sparkContext.broadcast(vocabulary(tokenizer, directory))
    return per_text(documents, "doc_id", "text", "doc_id bigint, n_tokens bigint", _counts, ranks)
