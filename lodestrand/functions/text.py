"""Column functions over source texts. All stay in the JVM; none needs a Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ends a line, and what counts as white space, by Unicode.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
IDENTIFIER = r"[A-Za-z_$][\p{L}\p{N}_$]*"
TOKEN = rf"{IDENTIFIER}|[^{SPACE[1:]}"
COMMENT = r"//[^\n]*|/\*[\s\S]*?\*/"


def let(value: Column, body) -> Column:
    """body(value), with the value computed once a row. Written plainly, an expression that a lambda refers to is computed
    anew for every element."""
    return F.transform(F.array(value), body)[0]


def lines(text: Column) -> Column:
    """The lines of a text; a line end at the very end adds no empty line. An empty text is one empty line."""
    return F.split(F.regexp_replace(text, f"(?:{LINE_END})\\z", ""), LINE_END, -1)


def without_space(text: Column, by: str, runs: bool = True) -> Column:
    """White space (runs of it, or each) replaced. Texts of ASCII characters alone, nearly all, need a narrower class only,
    which takes less than half the time."""
    more = "+" if runs else ""
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.regexp_replace(text, SPACE + more, by)).otherwise(F.regexp_replace(text, r"[\s\x1c-\x1f]" + more, by))


def normalized(text: Column) -> Column:
    """Comments taken out (lexically, also in strings), white space runs made one space, trimmed."""
    bare = F.regexp_replace(text, r"/\*[\s\S]*?\*/|//[^\n]*", "")
    return let(bare, lambda t: F.trim(without_space(t, " ")))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def joined_sha256(*parts: Column) -> Column:
    """sha256 of parts joined by U+0000; null if a part is."""
    joined = parts[0]
    for p in parts[1:]:
        joined = F.concat(joined, F.lit("\u0000"), p)
    return F.sha2(joined, 256)


def record_id(repository_id: Column, relative_path: Column, content_sha256: Column) -> Column:
    return joined_sha256(repository_id, relative_path, content_sha256)


def repository_id(safe_uri: Column) -> Column:
    return F.substring(F.sha2(safe_uri, 256), 1, 24)


def unit_draw(text: Column) -> Column:
    """A number in [0, 1] from the first 64 bits of the text's sha256; exact up to the last rounding."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def split_of(cluster: Column, seed: int = 42, train: float = 0.9, validation: float = 0.05) -> Column:
    draw = unit_draw(F.concat(F.lit(f"{seed}:"), cluster))
    return F.when(draw < train, "train").when(draw < train + validation, "validation").otherwise("test")


def uses_infilling(sample_id: Column, seed: int = 42, fraction: float = 0.5) -> Column:
    if not 0.0 <= fraction <= 1.0:
        raise ValueError("the fraction must lie in [0, 1]")
    if fraction in (0.0, 1.0):
        return F.lit(fraction == 1.0)
    return unit_draw(F.concat(F.lit(f"objective:{seed}:"), sample_id)) < fraction


def owner_of(record: Column, world_size: int) -> Column:
    """The worker that owns a record: the first 64 bits of its sha256 modulo the number of workers."""
    return (F.conv(F.substring(F.sha2(record, 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(world_size).cast("decimal(20,0)")).cast("int")


def quality_metrics(text: Column) -> Column:
    """Eight measures as one struct. Sums are integers until the one division, so results don't depend on order."""
    ids = F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))
    return let(F.struct(lines(text).alias("ls"), ids.alias("ids")), lambda v: _measures(text, v["ls"], v["ids"]))


def _measures(text: Column, ls: Column, ids: Column) -> Column:
    sizes = F.transform(ls, lambda x: F.length(x))
    chars = F.greatest(F.length(text), F.lit(1))
    total = F.aggregate(sizes, F.lit(0), lambda a, x: a + x)
    return F.struct(
        F.octet_length(text).cast("bigint").alias("size_bytes"),
        F.size(ls).cast("bigint").alias("line_count"),
        (total / F.size(ls)).alias("mean_line_length"),
        F.array_max(sizes).cast("bigint").alias("max_line_length"),
        ((F.length(text) - F.length(F.regexp_replace(text, COMMENT, ""))) / chars).alias("comment_ratio"),
        ((F.length(text) - F.length(without_space(text, "", runs=False))) / chars).alias("whitespace_ratio"),
        (F.size(F.array_distinct(ids)) / F.greatest(F.size(ids), F.lit(1))).alias("identifier_diversity"),
        (F.lit(1) - F.size(F.array_distinct(ls)) / F.size(ls)).alias("repetition_ratio"),
    )


def quality_reasons(text: Column, max_bytes: int = 1_000_000) -> Column:
    longest = F.array_max(F.transform(lines(text), lambda x: F.length(x)))
    return reasons(
        (F.contains(text, F.lit("\u0000")), "null-byte"), (text.rlike(r"[\x{202a}-\x{202e}]"), "unicode-control"), (F.octet_length(text) > max_bytes, "oversized"), (longest > 5000, "minified")
    )


def quality_score(reason_count: Column, repetition: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(0.25) * reason_count - F.lit(0.3) * repetition)


def reasons(*rules: tuple[Column, str]) -> Column:
    """The names of the rules that hold, as an array; a rule that is null doesn't hold."""
    return F.filter(F.array(*(F.when(c, F.lit(n)) for c, n in rules)), lambda x: x.isNotNull())


def all_reasons(*arrays: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*arrays)))


def shingles(text: Column, width: int = 5, fast: bool = False) -> Column:
    """Distinct hashes of each `width` tokens of the normalised text; of all tokens if they are fewer.

    fast: 64-bit xxhash instead of 16 hex digits of sha256; same sets up to the names of their members."""
    t = F.regexp_extract_all(normalized(text), F.lit(TOKEN), F.lit(0))
    name = (lambda x: F.xxhash64(x)) if fast else (lambda x: F.substring(F.sha2(x, 256), 1, 16))
    all_starts = lambda v: F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(v) - width + 1))
    return let(t, lambda v: F.array_distinct(F.transform(all_starts(v), lambda i: name(F.array_join(F.slice(v, i, width), "\u001f")))))


def repetition_rate(text: Column, width: int = 3) -> Column:
    """The share of repeated word windows; 0 if there is none."""
    words = F.filter(F.split(F.regexp_replace(text, f"{SPACE}+", " "), " "), lambda w: w != "")

    def rate(v: Column) -> Column:
        n = F.size(v) - width + 1
        windows = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(v, i, width), "\u001f"))
        return F.when(n < 1, F.lit(0.0)).otherwise(F.lit(1.0) - F.size(F.array_distinct(windows)) / F.greatest(n, F.lit(1)))

    return let(words, rate)


def token_accuracy(expected: Column, actual: Column) -> Column:
    """Equal positions over the expected length; 1 if nothing was expected."""
    same = F.aggregate(F.zip_with(expected, actual, lambda a, b: F.when(a.eqNullSafe(b) & a.isNotNull(), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(expected) == 0, F.lit(1.0)).otherwise(same / F.greatest(F.size(expected), F.lit(1)))
