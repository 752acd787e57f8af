"""Next-fit packing of repositories of any size, without walking one in a single task.

Next-fit is sequential: where a text goes depends on how full the open bin is. But how a stretch of texts changes
the fill level is a function of the level before it, and such functions can be composed. So the texts, sorted by
(repository, path), are cut into ranges; each range finds, for all levels at once, where it would end and how
many bins it would close (levels soon coincide, so this is hardly more work than one walk); the driver chains one
short function per range; then each range is walked once more from its now known start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.session import cut


def step(fill: int, n: int, context: int) -> tuple[int, int, bool]:
    """The level after a text of n tokens, the bins closed, and whether the open bin was closed before it."""
    flush = fill > 0 and fill + n > context
    whole = (n - 1) // context
    return (0 if flush else fill) + n - whole * context, whole + flush, flush


class Levels:
    """The function of a stretch: for every level at its start the level at its end and the bins closed."""

    def __init__(self, context: int):
        self.context = context
        self.now = np.arange(context + 1)  # the distinct levels that are still apart
        self.closed = np.zeros(context + 1, np.int64)
        self.group = np.arange(context + 1)  # which of them a start has come to
        self.extra = np.zeros(context + 1, np.int64)

    def add(self, n: int) -> None:
        flush = (self.now > 0) & (self.now + n > self.context)
        whole = (n - 1) // self.context
        now = np.where(flush, 0, self.now) + n - whole * self.context
        closed = self.closed + whole + flush
        if len(now) > 1:
            now, first, back = np.unique(now, return_index=True, return_inverse=True)
            if len(first) < len(closed):
                # starts that have met count their difference in bins apart
                self.extra += (closed - closed[first][back])[self.group]
                self.group = back[self.group]
                closed = closed[first]
        self.now, self.closed = now, closed

    def runs(self) -> list[tuple[int, int, int]]:
        """(first start level, end level, bins), one for each run of equal values."""
        end, bins = self.now[self.group], self.closed[self.group] + self.extra
        new = np.flatnonzero(np.r_[True, (np.diff(end) != 0) | (np.diff(bins) != 0)])
        return [(int(k), int(end[k]), int(bins[k])) for k in new]


def next_fit_plan(sizes: DataFrame, context: int, ranges: int | None = None) -> DataFrame:
    """sizes: repository_id, relative_path, record_id, n (> 0). Pieces: repository_id, bin, at, record_id, from, to."""
    keys = ["repository_id", "relative_path", "record_id"]
    slim = sizes.select(*keys, F.col("n").cast("int").alias("n"))
    spread = slim.repartitionByRange(ranges, *keys) if ranges else slim.repartitionByRange(*keys)
    rows = cut(spread.sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()))

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = first = repo = None
        levels, texts, fill, bins, pieces = Levels(context), 0, 0, 0, 0
        many = False
        for b in batches:
            for r, p, n in zip(b["repository_id"], b["part"], b["n"].tolist()):
                if first is None:
                    part, first, repo = int(p), r, r
                if r != repo:
                    repo, fill, bins, pieces, many = r, 0, 0, 0, True
                if not many:
                    levels.add(n)
                    texts += 1 + (n - 1) // context
                else:
                    fill, more, _ = step(fill, n, context)
                    bins += more
                    pieces += 1 + (n - 1) // context
        if first is not None:
            runs = [] if many else levels.runs()
            yield pd.DataFrame({"part": [part], "first": [first], "last": [repo], "many": [many], "fill": [fill], "bins": [bins], "pieces": [pieces if many else texts], "runs": [[list(x) for x in runs]]})

    found = rows.mapInPandas(ends, "part int, first string, last string, many boolean, fill int, bins bigint, pieces bigint, runs array<array<bigint>>").orderBy("part").collect()
    starts: dict[int, tuple[int, int, int]] = {}
    repo, state = None, (0, 0, 0)
    for x in found:
        starts[x["part"]] = state = state if x["first"] == repo else (0, 0, 0)
        if x["many"]:
            state = (x["fill"], x["bins"], x["pieces"])
        else:
            run = [r for r in x["runs"] if r[0] <= state[0]][-1]
            state = (int(run[1]), state[1] + int(run[2]), state[2] + x["pieces"])
        repo = x["last"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repo, fill, bin_no, at, fresh = None, 0, 0, 0, True
        for b in batches:
            out = []
            for r, p, rid, n in zip(b["repository_id"], b["part"], b["record_id"], b["n"].tolist()):
                if fresh:
                    repo, (fill, bin_no, at), fresh = r, starts[int(p)], False
                elif r != repo:
                    repo, fill, bin_no, at = r, 0, 0, 0
                after, closed, flush = step(fill, n, context)
                here, start = bin_no + flush, 0
                while n - start > context:
                    out.append((r, here, at, rid, start, start + context))
                    here, start, at = here + 1, start + context, at + 1
                out.append((r, here, at, rid, start, n))
                at += 1
                fill, bin_no = after, bin_no + closed
            yield pd.DataFrame(out, columns=["repository_id", "bin", "at", "record_id", "from", "to"])

    return rows.mapInPandas(walk, "repository_id string, bin bigint, at bigint, record_id string, from int, to int")
