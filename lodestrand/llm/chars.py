"""Problem 9: one form for texts that look the same, and the pairs of documents that only differ in it.

Method: a text is exploded to positioned code points, mapped through broadcast tables (canonical and some
compatibility decompositions, look-alike letters, spaces, hyphens, invisible characters), combining marks
are ordered by class, and the code points are recomposed to strings. The explosion is an array of code
points per Arrow batch, whose index is the position: one row per code point would shuffle 30 times the
text to rebuild it. Plain ASCII texts are their own form and never leave the JVM.

What stays different: words, digits, accents, line breaks (CR LF counts as LF), tabs against spaces and
the number of spaces, super- and subscripts, circled and styled letters.

Defined results: a null text stays null and is no case, empty texts stay empty; ties and repeated rows are
rows of their own; extra columns pass unread. Unpaired surrogates can't occur in a Spark string.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of other scripts that look like the Latin ones below them.
LOOK_ALIKES = (
    ("АВЕЅІЈКМНОРСТУХҮԌԚԜӀаеѕіјорсухһԁԛԝгѵѡ", "ABESIJKMHOPCTYXYGQWIaesijopcyxhdqwrvw"),  # Cyrillic
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳοανικρυχγϲ", "ABEZHIKMNOPTYXCjoavikpuxyc"),  # Greek
    ("ՍՏՕԼոսօցհզ", "USOLnuoghq"),  # Armenian
    ("ᎪᎬᎠᎢᎫᎳᎷᎻᏀᏃᏌᏎᏔᏟᏢᏦ", "AEDTJWMHGZU4WCPK"),  # Cherokee
    ("ıɑɡɩʋƖǀ", "iagivIl"),  # Latin beyond ASCII
)
#: Dashes as short as a hyphen.
HYPHENS = "‐‑‒–⁃˗۔−﹘﹣－"
#: Characters without a mark of their own that Unicode doesn't file under Cf.
INVISIBLE = [0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
#: Compatibility decompositions of another look than what they decompose to.
OTHER_LOOK = "ſ℀℁℅℆№℡℻"
NOT_ASCII = r"[^\x00-\x7F]|\r"


def _expand(c: int) -> str | None:
    """What a code point stands for, fully decomposed; None: itself."""
    ch = chr(c)
    cat = unicodedata.category(ch)
    if cat == "Cs" or cat == "Cn":
        return None
    if c in _invisible() or (cat == "Cf" and not 0x600 <= c <= 0x605 and c != 0x6DD):
        return ""
    if cat == "Zs" and c not in (0x20, 0x1680):
        return " "
    if ch in HYPHENS:
        return "-"
    d = unicodedata.decomposition(ch)
    if 0xAC00 <= c <= 0xD7A3:
        return unicodedata.normalize("NFD", ch)
    if d.startswith("<"):
        kind = d[1 : d.index(">")]
        if ch in OTHER_LOOK or kind not in ("wide", "narrow", "noBreak", "compat") or d.split()[1] == "0020" or (kind == "compat" and cat[0] not in "LP"):
            return None
        d = d[d.index(">") + 2 :]
    if d:
        parts = [int(x, 16) for x in d.split()]
        return "".join(x if (x := _expand(p)) is not None else chr(p) for p in parts)
    return _alike().get(ch)


@functools.cache
def _invisible() -> frozenset[int]:
    return frozenset(INVISIBLE)


@functools.cache
def _alike() -> dict[str, str]:
    return {a: b for x, y in LOOK_ALIKES for a, b in zip(x, y, strict=True)}


class Tables:
    """Dense tables over all code points: single maps each to one code point, -1 drops it, -2 asks many."""

    def __init__(self):
        top = 0x110000
        self.single = np.arange(top, dtype=np.int32)
        self.many: dict[int, list[int]] = {}
        self.rank = np.zeros(top, np.uint8)
        for c in range(128, top if top < 0x32000 else 0x32000):
            self._enter(c)
        for c in range(0xE0000, 0xE0200):
            self._enter(c)

    def _enter(self, c: int) -> None:
        self.rank[c] = unicodedata.combining(chr(c))
        e = _expand(c)
        if e is None:
            return
        if len(e) == 1:
            self.single[c] = ord(e)
        elif e:
            self.single[c] = -2
            self.many[c] = [ord(x) for x in e]
        else:
            self.single[c] = -1


@functools.cache
def tables() -> Tables:
    return Tables()


def canonical(text: str) -> str:
    """The form in which texts that look the same are equal."""
    if text.isascii():
        return text.replace("\r\n", "\n")
    t = tables()
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    mapped = t.single[points]
    if (mapped == -2).any():
        sizes = np.ones(len(points), np.int64)
        where = np.flatnonzero(mapped == -2)
        full = [t.many[int(c)] for c in points[where]]
        sizes[where] = [len(x) for x in full]
        ends = np.cumsum(sizes)
        out = np.repeat(mapped, sizes)
        for i, x in zip((ends - sizes)[where].tolist(), full):
            out[i : i + len(x)] = x
        mapped = out
    mapped = mapped[mapped >= 0]
    ranks = t.rank[mapped]
    marks = np.flatnonzero(ranks)
    if len(marks):
        # one stable sort orders all marks: a base and its marks share a group, the base has class 0
        group = np.cumsum(ranks == 0)
        mapped = mapped[np.lexsort((ranks, group))]
    s = mapped.astype(np.uint32).tobytes().decode("utf-32-le")
    return unicodedata.normalize("NFC", s).replace("\r\n", "\n")


def _canonical(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else canonical(t) for t in texts.to_pylist()], pa.string())


def canonical_text(text: Column) -> Column:
    """The one form of a text column; Python sees only the texts that hold other characters than ASCII."""
    return F.coalesce(F.arrow_udf(_canonical, "string")(F.when(text.rlike(NOT_ASCII), text)), text)


def canonical_documents(documents: DataFrame) -> DataFrame:
    """doc_id, text in its one form."""
    return documents.select("doc_id", canonical_text(F.col("text")).alias("text"))


def same_looks(documents: DataFrame, min_chars: int = 200) -> DataFrame:
    """doc_id_a, doc_id_b: documents of at least min_chars characters that look the same but whose texts differ.

    Equal texts are one class, so only classes are joined with each other; the rows of a pair of classes
    are joined last, which makes exactly the rows of the result.
    """
    rows = documents.where(F.length("text") >= min_chars).select("doc_id", F.md5("text").alias("raw"), F.md5(canonical_text(F.col("text"))).alias("form"))
    return pairs_of_forms(rows)


def pairs_of_forms(rows: DataFrame) -> DataFrame:
    """rows: doc_id, raw, form. Pairs of ids, smaller first, with equal form and different raw."""
    from lodestrand.session import cut

    rows = cut(rows)
    classes = rows.groupBy("form", "raw").agg(F.count("*").alias("n"))
    several = classes.groupBy("form").agg(F.count("*").alias("forms")).where("forms > 1").select("form")
    members = cut(rows.join(several, "form"))
    classes = members.select("form", "raw").distinct()
    a, b = classes.toDF("form", "raw_a"), classes.toDF("form", "raw_b")
    joined = a.join(b, "form").where("raw_a < raw_b")
    ids = members.select("raw", "doc_id").distinct()
    out = joined.join(ids.toDF("raw_a", "x"), "raw_a").join(ids.toDF("raw_b", "y"), "raw_b").where("x <> y")
    return out.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()
