"""Words of source texts, with what layout, comments, quoting and character form add taken away."""

from __future__ import annotations

import hashlib
import re

import numpy as np

from lodestrand.llm.chars import canonical

WORD = re.compile(r"\w+")
#: One pass over C-like text: strings, templates and regular expressions are kept, comments go.
C_LIKE = re.compile(
    r"""("(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`"""
    r"""|(?:(?<=[(=,:\[!&|?{};] )|(?<=[(=,:\[!&|?{};\n])|(?<=return ))/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/)"""
    r"""|/\*[\s\S]*?\*/|//[^\n]*"""
)
HASH = re.compile(r"""("(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?<![^\s])#[^\n]*""")
MARKUP = re.compile(r"()<!--[\s\S]*?-->")
#: Extensions by the form of their comments (a fixed list); all other texts are C-like.
HASHED, MARKED, BARE = ("py", "yaml", "yml", "env", "toml", "sh"), ("md", "html", "xml"), ("json", "txt", "csv")
ESCAPES = re.compile(r"\\u([0-9a-fA-F]{4})|\\+[nrt]|&(?:amp|lt|gt|quot|apos|nbsp|#39|#x27|#34);")


def extension(path: str | None) -> str:
    name = (path or "").strip().lower().rpartition("/")[2]
    return name.rpartition(".")[2] if "." in name else ""


def without_comments(text: str, ext: str) -> str:
    if ext in BARE:
        return text
    pattern = HASH if ext in HASHED else MARKUP if ext in MARKED else C_LIKE
    return pattern.sub(lambda m: m[1] or " ", text)


def code_words(text: str, ext: str) -> list[str]:
    """The words of a text in their one character form, without comments."""
    return WORD.findall(without_comments(canonical(text), ext))


def _unescape(m: re.Match) -> str:
    if m[1]:
        c = chr(int(m[1], 16))
        return c if c.isalnum() or c == "_" else " "
    return " "


def quoted_words(text: str) -> list[str]:
    """All words of a text, also those of comments and of escaped or quoted code."""
    text = canonical(text)
    return WORD.findall(ESCAPES.sub(_unescape, text) if "\\" in text or "&" in text else text)


class WordHash(dict):
    """Word to a 64-bit hash, the same in every process."""

    def __missing__(self, word: str) -> int:
        h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        if len(self) > 400_000:
            self.clear()
        self[word] = h
        return h

    def array(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the longest common subsequence, bit-parallel over the shorter one."""
    if len(a) > len(b):
        a, b = b, a
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(same.argmin())
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    tail = 0
    if n:
        same = a[::-1][:n] == b[::-1][:n]
        tail = n if same.all() else int(same.argmin())
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    at: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        m = at.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return head + tail + len(a) - v.bit_count()
