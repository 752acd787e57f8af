"""Problem 4: passages of held-out tasks inside the corpus.

Method: a generalised suffix automaton over the words of all normalised task passages is broadcast (the
tasks are a table of fixed size; its bytes are checked before), and each document's words stream through
it, which gives the longest match that ends at every word. A passage's matches of at least min_run words that
can't be grown further in that passage are its runs, also where a match with another passage goes on. A document
leaks a passage wherever, in one stretch of the document, a common subsequence with the passage, in which every word
stands where a run has it, covers `coverage` of the passage (all of a passage under `whole` words, of which less says nothing).
Inserted comments and renamed identifiers only break runs, they don't end a stretch, and no number of runs does.

Words are taken after the one character form and without escapes, comment marks or quotes, in which a
passage may be hidden. Documents whose words hold too few word triples of any passage skip the automaton,
and passages of which too few words lie in triples of the document are not looked for in it: what is covered lies in
runs of at least min_run = 3 words, so this loses none.

Defined results: null passages and passages under min_run words are no cases; null and empty texts leak
nothing; several passages of one task, and several stretches of one passage, count once in `leaked`; repeated
rows repeat in `leaks`, not in `leaked`; other columns pass unread.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm.chars import canonical
from lodestrand.llm.words import ESCAPES, WORD, _unescape, quoted_words

#: The most characters that all passages together may have to be broadcast as one automaton.
MOST = 50_000_000
LEAKS = "doc_id bigint, task_id string, passage string, covered int, words int, first_word int, last_word int"


class Automaton:
    """Suffix automaton of several word sequences; of each state one place where its words end."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.place = [-1], [0], [(-1, -1)]
        self.places: list[list[tuple[int, int]]] = []

    def add(self, words: list[int], number: int) -> None:
        last = 0
        for i, w in enumerate(words):
            last = self._extend(last, w, (number, i))

    def _state(self, following: dict[int, int], link: int, length: int, place: tuple[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.place.append(place)
        return len(self.next) - 1

    def _extend(self, last: int, w: int, place: tuple[int, int]) -> int:
        following, link, length = self.next, self.link, self.length
        q = following[last].get(w)
        if q is not None:
            if length[q] == length[last] + 1:
                self.ends.append((q, place))
                return q
            clone = self._clone(last, w, q)
            self.ends.append((clone, place))
            return clone
        cur = self._state({}, 0, length[last] + 1, place)
        self.ends.append((cur, place))
        p = last
        while p >= 0 and w not in following[p]:
            following[p][w] = cur
            p = link[p]
        if p >= 0:
            q = following[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    ends: list[tuple[int, tuple[int, int]]]

    def _clone(self, p: int, w: int, q: int) -> int:
        following, link = self.next, self.link
        clone = self._state(dict(following[q]), link[q], self.length[p] + 1, self.place[q])
        while p >= 0 and following[p].get(w) == q:
            following[p][w] = clone
            p = link[p]
        link[q] = clone
        return clone

    @classmethod
    def of(cls, sequences: list[list[int]]) -> Automaton:
        self = cls()
        self.ends = []
        for number, words in enumerate(sequences):
            self.add(words, number)
        # every state gets all places where its words end: from its own ends, and from those that link to it
        own: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for q, place in self.ends:
            own[q].append(place)
        for q in sorted(range(1, len(self.next)), key=lambda q: -self.length[q]):
            own[self.link[q]] += own[q] if self.length[self.link[q]] >= 3 else []
        self.places = own
        return self

    def runs(self, words: list[int], min_run: int) -> list[tuple[int, int, int]]:
        """(end, length, state) of the matches that the next word doesn't lengthen at some place of the state."""
        following, link, length = self.next, self.link, self.length
        q, n, out = 0, 0, []
        for i, w in enumerate(words):
            t = following[q].get(w)
            if n >= min_run:
                self._lost(out, i, n, q, w, min_run)
            if t is not None:
                q, n = t, n + 1
                continue
            while q and t is None:
                q = link[q]
                t = following[q].get(w)
            n = length[q] + 1 if t is not None else 0
            q = t or 0
        if n >= min_run:
            self._lost(out, len(words), n, q, None, min_run)
        return out

    def _lost(self, out: list[tuple[int, int, int]], end: int, n: int, q: int, w: int | None, min_run: int) -> None:
        """Adds the match that ends before `end` and its suffixes, each if w doesn't go on at some place that the longer ones don't have."""
        lost = 0
        while n >= min_run:
            t = self.next[q].get(w)
            mine = len(self.places[q]) - (len(self.places[t]) if t is not None else 0)
            if mine > lost:
                out.append((end, n, q))
                lost = mine
            q = self.link[q]
            n = self.length[q]


def covered_words(masks: list[int], size: int) -> list[int]:
    """The length of the longest common subsequence of each beginning of a stretch with a passage of `size` words,
    bit-parallel over the passage: a word's mask has the places of the passage that it may be matched with."""
    full = (1 << size) - 1
    v, out = full, []
    for m in masks:
        u = v & m
        if u:
            v = ((v + u) | (v - u)) & full
        out.append(size - v.bit_count())
    return out


def aligned(spots: list[int], words: list[int], passage: list[int], min_run: int) -> list[int]:
    """Of each word at `spots` the places of the passage with which it lies in a run of at least min_run equal words."""
    places: dict[int, int] = defaultdict(int)
    for k, w in enumerate(passage):
        places[w] |= 1 << k
    same = {i: places.get(words[i], 0) for i in spots}
    ends = {}
    for i in spots:
        m = same[i]
        for k in range(1, min_run):
            m &= same.get(i - k, 0) << k
        ends[i] = m
    out = []
    for i in spots:
        m = 0
        for k in range(min_run):
            m |= ends.get(i + k, 0) >> k
        out.append(m)
    return out


def mirrored(mask: int, size: int) -> int:
    return int(format(mask, f"0{size}b")[::-1], 2)


def stretches(spots: list[int], masks: list[int], size: int, need: int, room: int) -> list[tuple[int, int, int]]:
    """(words covered, first, end) of the stretches of at most `room` words whose words at `spots` (ascending) cover at least
    `need` of the passage's in order; they don't overlap. A window that covers too little rules out the next ones
    up to the one with as many further words as it lacks, so few are looked at."""
    out, i, m = [], 0, len(spots)
    while i + need <= m:
        j = bisect_left(spots, spots[i] + room)
        lacks = need - (j - i)
        if lacks <= 0:
            covers = covered_words(masks[i:j], size)
            if covers[-1] >= need:
                end = bisect_left(covers, covers[-1])
                # the same from its end backwards: the latest word from which as many are covered
                begin = bisect_left(covered_words([mirrored(x, size) for x in reversed(masks[i : i + end + 1])], size), covers[-1])
                out.append((covers[-1], spots[i + end - begin], spots[i + end] + 1))
                i += end + 1
                continue
            lacks = need - covers[-1]
        if j + lacks > m:
            break
        i = max(i + 1, bisect_right(spots, spots[j + lacks - 1] - room))
    return out


def leaked_stretches(
    runs: list[tuple[int, int, int]], places: list[list[tuple[int, int]]], sequences: list[list[int]], needs: list[int], words: list[int], stretch: float, min_run: int, wanted: set[int]
) -> list[tuple[int, int, int, int]]:
    """(passage, words covered, first word, end) of the stretches in which the document leaks a wanted passage."""
    inside: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for end, n, q in runs:
        for number in {number for number, _ in places[q]} & wanted:
            inside[number].append((end - n, end))
    out = []
    for number, parts in sorted(inside.items()):
        parts.sort()
        spots, at = [], 0
        for d, e in parts:
            spots += range(max(d, at), e)
            at = max(at, e)
        sequence = sequences[number]
        if len(spots) >= needs[number]:
            masks = aligned(spots, words, sequence, min_run)
            out += [(number, *x) for x in stretches(spots, masks, len(sequence), needs[number], int(stretch * len(sequence)) + 40)]
    return out


class Scanner:
    def __init__(self, passages: list[tuple[str, str, list[str]]], coverage: float, min_run: int, stretch: float, whole: int = 12):
        self.names = [(t, k) for t, k, _ in passages]
        self.sizes = [len(w) for _, _, w in passages]
        self.ids: dict[str, int] = {}
        sequences = [[self.ids.setdefault(x, len(self.ids) + 1) for x in w] for _, _, w in passages]
        self.sequences = sequences
        self.automaton = Automaton.of(sequences)
        self.needs = [n if n < whole else math.ceil(coverage * n) for n in self.sizes]
        self.min_run, self.stretch = min_run, stretch
        base = len(self.ids) + 2
        self.base = base
        self.triples = np.unique(np.concatenate([self._triples(np.array(s, np.int64)) for s in sequences] or [np.zeros(0, np.int64)]))
        # of each word of each passage the triple that begins there; the last two begin none
        none = np.full(2, len(self.triples))
        self.begins = np.concatenate([np.concatenate([np.searchsorted(self.triples, self._triples(np.array(s, np.int64))), none])[: len(s)] for s in sequences] or [none])
        self.offsets = np.cumsum([0, *self.sizes[:-1]])
        # what the smallest passage needs; a run of n words has n - 2 triples, so runs of 3 need a third of the words
        self.least = max(1, min(self.needs, default=1) // 3)

    def _triples(self, a: np.ndarray) -> np.ndarray:
        t = a[:-2] * (self.base * self.base) + a[1:-1] * self.base + a[2:]
        return t[(a[:-2] > 0) & (a[1:-1] > 0) & (a[2:] > 0)]

    def leaks(self, text: str) -> list[tuple[str, str, int, int, int, int]]:
        words = quoted_words(text)
        get = self.ids.get
        a = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        t = self._triples(a)
        if len(t) < self.least:
            return []
        at = np.searchsorted(self.triples, t)
        same = self.triples[np.minimum(at, len(self.triples) - 1)] == t
        if same.sum() < self.least:
            return []
        # covered are only words of the passage that lie in a triple of the document
        present = np.zeros(len(self.triples) + 1, np.bool_)
        present[at[same]] = True
        begun = present[self.begins]
        covered = begun.copy()
        covered[1:] |= begun[:-1]
        covered[2:] |= begun[:-2]
        wanted = np.flatnonzero(np.add.reduceat(covered, self.offsets, dtype=np.int64) >= np.array(self.needs))
        if not len(wanted):
            return []
        known = a.tolist()
        found = leaked_stretches(self.automaton.runs(known, self.min_run), self.automaton.places, self.sequences, self.needs, known, self.stretch, self.min_run, set(wanted.tolist()))
        return [(*self.names[k], c, self.sizes[k], f, e) for k, c, f, e in found]


def passages_of(fim: DataFrame, completion: DataFrame, min_words: int = 3) -> list[tuple[str, str, list[str]]]:
    """(task_id, passage, words) of the middles, prefixes and prompts; their size is checked before they are collected."""
    rows = fim.select("id", F.lit("middle").alias("passage"), F.col("middle").alias("text")).unionByName(fim.select("id", F.lit("prefix").alias("passage"), F.col("prefix").alias("text")))
    rows = rows.unionByName(completion.select("id", F.lit("prompt").alias("passage"), F.col("prompt").alias("text"))).where("id is not null and text is not null").distinct()
    size = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    if size > MOST:
        raise ValueError(f"the passages have {size} characters; an automaton of at most {MOST} is broadcast")
    out = [(r["id"], r["passage"], quoted_words(r["text"])) for r in rows.orderBy("id", "passage").collect()]
    return [x for x in out if len(x[2]) >= min_words]


def leaks(
    spark: SparkSession, documents: DataFrame, fim: DataFrame, completion: DataFrame, coverage: float = 0.42, min_run: int = 3, stretch: float = 2.5
) -> DataFrame:
    """doc_id, task_id, passage, covered, words, first_word, last_word: one row per document and stretch of it that leaks a
    passage."""
    shared = spark.sparkContext.broadcast(passages_of(fim, completion, min_run))
    made: dict[int, Scanner] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = made.get(0) or made.setdefault(0, Scanner(shared.value, coverage, min_run, stretch))
        names = [x.split()[0] for x in LEAKS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), *[pa.int32()] * 4]
        for batch in batches:
            rows = [(i.as_py(), *x) for i, t in zip(batch.column(0), batch.column(1)) if t.is_valid for x in scanner.leaks(t.as_py())]
            columns = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return documents.select("doc_id", "text").mapInArrow(run, LEAKS)


def leaked(found: DataFrame) -> DataFrame:
    """task_id, doc_id."""
    return found.select("task_id", "doc_id").distinct()


def without_leaks(spark: SparkSession, documents: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, text: documents with their leaked stretches of words (and what stands between them) cut out; what is left
    stays as it was written."""
    spans = found.groupBy("doc_id").agg(F.collect_set(F.struct("first_word", "last_word")).alias("spans"))

    def cut_out(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([_cut(t, s) if t and s else t for t, s in zip(texts.to_pylist(), spans.to_pylist())], pa.string())

    rows = documents.select("doc_id", "text").join(spans, "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.arrow_udf(cut_out, "string")(F.when(F.col("spans").isNotNull(), F.col("text")), "spans")).alias("text"))


#: An ASCII run, or what may become one character: an ASCII one with what follows it.
PIECE = re.compile(r"[\x00-\x7f]+(?![^\x00-\x7f])|[\x00-\x7f]?[^\x00-\x7f]+")


def _pieces(text: str) -> Iterator[tuple[str, int, int]]:
    """(canonical, start, end): pieces of a text with their one character form; together that of the text, but for \\r."""
    for m in PIECE.finditer(text):
        piece = m[0]
        if piece.isascii():
            yield from ((c, m.start() + k, m.start() + k + 1) for k, c in enumerate(piece))
            continue
        ends = [k for k in range(1, len(piece)) if not unicodedata.combining(piece[k])] + [len(piece)]
        parts = [(canonical(piece[a:b]), a, b) for a, b in zip([0, *ends], ends)]
        if "".join(p for p, _, _ in parts) != canonical(piece):
            parts = [(canonical(piece), 0, len(piece))]
        yield from ((p, m.start() + a, m.start() + b) for p, a, b in parts)


def word_places(text: str) -> list[tuple[int, int]]:
    """Where in the text the words stand that quoted_words has of it."""
    if text.isascii():
        form, at = text, range(len(text) + 1)
        until = range(1, len(text) + 2)
    else:
        kept = [x for x in _pieces(text) if x[0]]
        form = "".join(p for p, _, _ in kept)
        at = [a for p, a, _ in kept for _ in p]
        until = [b for p, _, b in kept for _ in p]
    if "\\" in form or "&" in form:
        # an escape becomes one character, which stands where the whole escape does
        chars, a, b, k = [], [], [], 0
        for m in ESCAPES.finditer(form):
            chars += [form[k : m.start()], _unescape(m)]
            a += [*at[k : m.start()], at[m.start()]]
            b += [*until[k : m.start()], until[m.end() - 1]]
            k = m.end()
        form, at, until = "".join([*chars, form[k:]]), [*a, *at[k:]], [*b, *until[k:]]
    return [(at[m.start()], until[m.end() - 1]) for m in WORD.finditer(form)]


def _cut(text: str, spans: list[dict]) -> str:
    words = word_places(text)
    out, at = [], 0
    for a, b in sorted((words[s["first_word"]][0], words[s["last_word"] - 1][1]) for s in spans):
        if a > at:
            out.append(text[at:a])
        at = max(at, b)
    return "".join(out) + text[at:]
