"""Problem 2: files that nobody wrote by hand for their repository.

Method: belief propagation over directory trees. Every file and directory has one of five labels
(handwritten, generated, minified, vendored, blob). A file's evidence is a score per label, taken from its
text and name; a directory's is taken from its name. Neighbours in the tree, child and parent, agree by a
compatibility table, and through their common parent siblings support each other. On a tree the two sweeps
of sum-product messages, leaves to roots and back, give exact marginals.

Both sweeps are group-bys on (repository, directory), one per level of depth; a directory only receives the
sum of its children's messages, which is pre-aggregated before the shuffle, so a directory or repository may
hold any share of all files. Texts are read once; after that only scores move.

Defined results: null, empty and blank texts and null paths give no evidence beyond the other's; a null
repository makes a tree of its own per document; rows that repeat a doc_id are files of their own and the
document is reported once; no rows, no result. Ties go to handwritten.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestrand.llm.families import key
from lodestrand.session import cut

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
#: The probability of a file's, and of a directory's, label under that of the directory it lies in. Rows add up
#: to one, so what nothing is known of says nothing.
FILE = [
    [0.955, 0.015, 0.01, 0.005, 0.015],
    [0.01, 0.93, 0.03, 0.01, 0.02],
    [0.2, 0.1, 0.65, 0.04, 0.01],
    [0.03, 0.03, 0.04, 0.88, 0.02],
    [0.4, 0.05, 0.02, 0.03, 0.5],
]
DIRECTORY = [
    [0.993, 0.002, 0.001, 0.003, 0.001],
    [0.002, 0.983, 0.005, 0.005, 0.005],
    [0.2, 0.02, 0.75, 0.02, 0.01],
    [0.02, 0.005, 0.005, 0.965, 0.005],
    [0.3, 0.02, 0.02, 0.02, 0.64],
]
FILE_LOG, DIRECTORY_LOG = ([[math.log(x) for x in row] for row in t] for t in (FILE, DIRECTORY))
#: How much a mark's score counts against the tables above.
MARKED = 1.6
#: A repository as a whole is its authors'.
ROOT = [0.0, -20.0, -20.0, -20.0, -20.0]
#: What a file says by showing no mark at all: minified and blob files always show one, the others mostly.
UNMARKED = [0.0, -3.5, -7.0, -1.0, -7.0]
#: What a directory's name says, by label (fixed values: names that tools and package managers use).
DIRECTORIES = {
    1: [({"generated", "__generated__", "__snapshots__", "autogen"}, 30.0), ({"dist", ".next"}, 9.0)],
    3: [({"node_modules", "third_party", "third-party", "thirdparty", "vendor", "vendored", "bower_components"}, 30.0), ({"external", "externals"}, 12.0)],
}
#: A directory named after a package and its version.
PACKAGE_VERSION = r"^[a-z][\w.-]*[-@]v?[0-9]+\.[0-9]+\.[0-9]+$"

LEAD = re.compile(r"﻿?(?:#![^\n]*\n)?(?:\s|//[^\n]*|/\*[\s\S]*?\*/|#[^\n{]*\n|<!--[\s\S]*?-->|[\"']use strict[\"'];?)*")
QUOTED = re.compile(r"\"[^\"\n]*\"|'[^'\n]{2,}'|“[^”\n]*”")
GENERATED = re.compile(
    r"(?i)@generated\b|<auto-?generated\b|\bauto-?generated\s+file\b|\bauto(?:matically|-)\s*generated\s+(?:from|by|with|using|on)\b|\bcode\s+generated\s+by\b"
    r"|\b(?:is|was|were|been|file|parts?|code|types?|end of)\b[^.;\n]{0,60}\bgenerated\s+(?:by|from|with|using)\b|^\W*generated\s+(?:by|from|with|using)\b|\bmachine-(?:written|generated)\b"
    r"|\bdo\s+not\s+(?:edit|modify)\b|\bdon't\s+edit\b|\bregenerated?\s+(?:with|by|using)\b|\b(?:produced|emitted|built|created|written|compiled)\s+(?:from|by)\b[^\n]*\b(?:emitter|generator|codegen|compiler|transpiler)\b"
    r"|\bautomatisch\s+(?:erzeugt|generiert|erstellt)\b|\bnicht\s+(?:bearbeiten|ändern|editieren)\b|\bgénérée?s?\s+(?:automatiquement|par)\b|\bne\s+pas\s+(?:modifier|éditer)\b"
    r"|\bgenerad[oa]\s+(?:automáticamente|por)\b|\bno\s+(?:editar|modificar)\b|\bgerado\s+(?:automaticamente|por)\b|\bgenerato\s+automaticamente\b|\bавтоматически\s+(?:создан|сгенерирован)|\bсгенерирован"
    r"|自動生成|自动生成|編集しないで|请勿(?:编辑|修改)",
    re.M,
)
DENIED = re.compile(r"(?i)\b(?:no longer|not|never|once|formerly|used to be|isn't|wasn't)\s+(?:\w+\s+){0,2}generated\b|\bkept?\s+by\s+hand\b|\bwe\s+now\s+keep\b|\bwrites?\s+the\s+header\b")
COMPILED = re.compile(r"^[\"']use strict[\"'];?\s*(?:var __|Object\.defineProperty\(exports, [\"']__esModule)|^Object\.defineProperty\(exports, [\"']__esModule|^(?:var|const) __(?:awaiter|importDefault|createBinding|decorate|extends|assign|rest|spreadArray) = ", re.M)
SOURCE_MAP = re.compile(r"^//[#@] sourceMappingURL=\S+\s*\Z", re.M)
SNAPSHOT = re.compile(r"^exports\[`[^`]*`\] = `", re.M)
LOCK_NAMES = {"package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock", "bun.lock", "deno.lock", "poetry.lock", "pipfile.lock"}
LOCKED = re.compile(r"\"lockfileVersion\"\s*:\s*\d|^lockfileVersion:", re.M)
RELEASE = re.compile(
    r"(?im)^\W*!?\s*@?[a-z][\w.@/-]*(?:\.js)?\s+v?\d+\.\d+\.\d+\b[^\n]*(?:https?://|\||\blicen[sc]e|\b(?:MIT|BSD|ISC|Apache)\b)"
    r"|@license\b[\s*]*[a-z][\w.@/-]*\s+v?\d+\.\d+|\b(?:copied|vendored|imported|taken)\s+(?:\w+\s+){0,2}from\b[^\n]*\d+\.\d+|\bin\s+sync\s+with\s+upstream\b"
)
UMD = re.compile(r"\(function\s*\(\s*\w*\s*,?\s*factory\s*\)|typeof define === ['\"]function['\"] && define\.amd")
MODULES = re.compile(r"__webpack_require__|\b__require\(|parcelRequire|System\.register\(|webpackJsonp|^\s*/\*\*\*/ ", re.M)
DATUM = re.compile(r"[\"'`][MLHVCSQTAZmlhvcsqtazeE\d\s.,+-]{12,}[\"'`]|\"(?:[^\"\\\n\s]|\\.)*\"|'(?:[^'\\\n\s]|\\.)*'|(?<![\w$])[-+]?(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)n?(?![\w$])|`[^`$ ]*`")
ENCODED = re.compile(r"[\"'`](?:data:[\w/+.;=-]+,)?[A-Za-z0-9+/=_\\x-]{80,}[\"'`]")
FIELD = re.compile(r"[\w$\"'-]+\s*:\s*(?=[\"'`\d\-+{\[tfn])|[\[\]{}(),;+:]|\b(?:true|false|null)\b")
LINE_COMMENT = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/")
DATA = ("json", "md", "yaml", "yml", "env")
CODE = ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs")


def data_share(text: str) -> tuple[float, int]:
    """The share of a script's visible characters in literals without spaces and what lists them; their number."""
    visible = len(text) - len(re.findall(r"\s", text))
    if not visible:
        return 0.0, 0
    inside = sum(len(x) for x in DATUM.findall(text))
    if inside < 0.3 * visible:
        return inside / visible, inside
    listed = sum(len(x.replace(" ", "")) for x in FIELD.findall(DATUM.sub(lambda m: "0", text)))
    return min(1.0, (inside + listed) / visible), inside


def comment_end(text: str) -> int:
    """Where the comments begin that end a text."""
    at = len(text)
    while at:
        first = text.rfind("\n", 0, at - 1 if text[at - 1] == "\n" else at) + 1
        line = text[first:at].strip()
        if line.endswith("*/") and (opened := text.rfind("/*", 0, at)) >= 0:
            at = opened
        elif not line or line.startswith("//") or line[0] == "#" and "{" not in line:
            at = first
        else:
            # a comment behind the last statement
            return first + text[first:at].index("//") if "//" in line else at
    return at


def evidence(text: str | None, path: str | None) -> list[float]:
    """A file's score for each label, 0 for handwritten."""
    score = [0.0] * 5
    path = (path or "").strip().lower()
    name = path.rpartition("/")[2]
    ext = name.rpartition(".")[2] if "." in name else ""
    if re.search(r"\.(?:generated|gen|pb|g)\.\w+$|_pb2?\.\w+$|_generated\.\w+$", name):
        score[1] += 3.5
    if re.search(r"[.-]min\.\w+$|\.bundle\.js$", name):
        score[2] += 3.0
    text = text or ""
    if not text.strip():
        return [0.0, score[1] / 2, score[2] / 2, 0.0, 0.0]
    if name in LOCK_NAMES or ext in DATA and LOCKED.search(text):
        score[1] += 6.0 if name in LOCK_NAMES else 3.0
    if ext in DATA:
        # data and prose are what such files are for; only a lock file or a whole header speaks against a hand
        score = [0.0, score[1], 0.0, 0.0, 0.0]
        if ext == "md":
            return score
    lead = LEAD.match(text)[0]
    tail = text[max(len(lead), comment_end(text)) :]
    notes = QUOTED.sub('""', lead + "\n" + tail)
    if GENERATED.search(notes):
        score[1] += 6.0
    if DENIED.search(notes):
        score[1] -= 6.0
    if ext in CODE:
        if COMPILED.search(text):
            score[1] += 6.0
        if SOURCE_MAP.search(text):
            score[1] += 5.0
        if len(SNAPSHOT.findall(text)) >= 1:
            score[1] += 5.0
        if UMD.search(text):
            score[3] += 5.0
        if MODULES.search(text):
            score[2] += 4.5
        if RELEASE.search(notes):
            score[3] += 6.0
    if ext in CODE or ext == "css":
        code = LINE_COMMENT.sub("", text) if ext in CODE and "\n" in text.strip() else text
        tight = len(re.findall(r"\s", code)) / max(1, len(code))
        longest = max(map(len, code.split("\n")))
        words = re.findall(r"[A-Za-z_$][\w$]*", code) if longest > 400 else []
        short = sum(len(w) <= 2 for w in words) / max(1, len(words))
        if longest > 400 and len(code) > 300 and (tight < 0.05 and (ext == "css" or short > 0.25) or tight < 0.1 and short > 0.45):
            score[2] += 6.0
    if ext in CODE:
        share, inside = data_share(text)
        encoded = sum(len(x) for x in ENCODED.findall(text))
        size = len(text)
        if share > 0.7 and inside > 400 or encoded > 0.6 * size and encoded > 300:
            score[4] += 5.0 if size > 700 else 2.0
        elif share > 0.6 and inside > 1500:
            score[4] += 1.5
    return score


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [evidence(t.as_py(), p.as_py()) for p, t in zip(batch.column(2), batch.column(3))]
        columns = [pa.array([x[k] for x in out], pa.float64()) for k in range(1, 5)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *columns], names=["doc_id", "tree", "path", "e1", "e2", "e3", "e4"])


def _logsum(x: np.ndarray) -> np.ndarray:
    top = x.max(0)
    return top + np.log(np.exp(x - top).sum(0))


def upward(b: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The message of children with beliefs b (labels x rows) to their parents, relative to the first label."""
    m = np.stack([_logsum(b + table[p][:, None]) for p in range(5)])
    return m - m[0]


def downward(b: np.ndarray, a: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Beliefs b of children raised by what their parents, with beliefs a, know without them."""
    rest = a - upward(b, table)
    down = np.stack([_logsum(rest + table[:, c][:, None]) for c in range(5)])
    return b + down - down[0]


def _with_messages(df: DataFrame, inputs: list[str], outputs: list[str], make) -> DataFrame:
    """Five columns more, made from five or ten columns of doubles in Arrow batches. As column expressions the
    messages would grow fivefold at every step, and the plan with them."""
    keep = [c for c in df.columns if c not in outputs]
    schema = StructType([df.schema[c] for c in keep] + [StructField(c, DoubleType()) for c in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in inputs])
                y = make(x)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(v) for v in y)], names=[*keep, *outputs])

    return df.mapInArrow(run, schema)


def with_upward(df: DataFrame, b: str, m: str, table: list[list[float]]) -> DataFrame:
    t = np.array(table)
    return _with_messages(df, [f"{b}{k}" for k in range(5)], [f"{m}{k}" for k in range(5)], lambda x: upward(x, t))


def with_downward(df: DataFrame, b: str, a: str, table: list[list[float]]) -> DataFrame:
    t = np.array(table)
    return _with_messages(df, [f"{b}{k}" for k in range(5)] + [f"{a}{k}" for k in range(5)], [f"{b}{k}" for k in range(5)], lambda x: downward(x[:5], x[5:], t))


def _name_score(name: Column) -> list[Column]:
    out = []
    for k in range(5):
        c = F.when(F.lit(False), 0.0)
        for names, weight in DIRECTORIES.get(k, []):
            c = c.when(name.isin(*sorted(names)), F.lit(weight))
        if k == 3:
            c = c.when(name.rlike(PACKAGE_VERSION), F.lit(12.0))
        out.append(c.otherwise(0.0))
    return out


def _named(columns: list[Column], prefix: str) -> list[Column]:
    return [c.alias(f"{prefix}{k}") for k, c in enumerate(columns)]


def beliefs(documents: DataFrame) -> DataFrame:
    """doc_id, relative_path, label, margin: the likeliest label, and by how much it beats handwritten (log odds)."""
    tree = F.coalesce(key("repository_id"), F.concat(F.lit("document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = documents.select("doc_id", tree.alias("tree"), F.trim("relative_path").alias("path"), "text")
    files = cut(rows.mapInArrow(_scores, "doc_id bigint, tree string, path string, e1 double, e2 double, e3 double, e4 double"))
    parent = lambda p: F.regexp_replace(F.coalesce(p, F.lit("")), r"/?[^/]*$", "")
    files = files.withColumn("dir", parent(F.col("path")))
    files = files.withColumns({"b0": F.lit(0.0), **{f"b{k}": F.when(F.col(f"e{k}") > 0, MARKED * F.col(f"e{k}")).otherwise(F.col(f"e{k}") + UNMARKED[k]) for k in range(1, 5)}})
    sums = [F.sum(f"m{k}").alias(f"m{k}") for k in range(5)]
    received = cut(with_upward(files, "b", "m", FILE_LOG).groupBy("tree", "dir").agg(*sums))
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    deepest = received.agg(F.coalesce(F.max(depth), F.lit(0)).alias("d")).first()["d"]
    own = _name_score(F.lower(F.regexp_extract("dir", r"([^/]*)$", 1)))
    five = lambda x: [f"{x}{k}" for k in range(5)]
    levels: dict[int, DataFrame] = {}
    extra = None
    for at in range(deepest, -1, -1):
        # directories at this depth with the sum of all messages from below
        here = received.where(depth == at)
        if extra is not None:
            here = here.unionByName(extra).groupBy("tree", "dir").agg(*sums)
        first = [F.when(F.col("dir") == "", F.lit(ROOT[k])).otherwise(F.lit(0.0)) for k in range(5)]
        levels[at] = cut(here.select("tree", "dir", *((first[k] + own[k] + F.col(f"m{k}")).alias(f"b{k}") for k in range(5))))
        if at:
            extra = with_upward(levels[at], "b", "m", DIRECTORY_LOG).select("tree", parent(F.col("dir")).alias("dir"), *five("m"))
    # back down: a parent tells a child all it knows except what the child said
    settled = above = levels[0]
    for at in range(1, deepest + 1):
        up = above.select("tree", F.col("dir").alias("parent"), *(F.col(f"b{k}").alias(f"a{k}") for k in range(5)))
        here = levels[at].withColumn("parent", parent(F.col("dir"))).join(up, ["tree", "parent"])
        above = cut(with_downward(here, "b", "a", DIRECTORY_LOG).select("tree", "dir", *five("b")))
        settled = settled.unionByName(above)
    known = settled.select("tree", "dir", *(F.col(f"b{k}").alias(f"a{k}") for k in range(5)))
    final = with_downward(files.join(known, ["tree", "dir"]), "b", "a", FILE_LOG)
    best = F.greatest(*five("b"))
    label = F.when(F.col("b0") >= best, LABELS[0])
    for k in range(1, 5):
        label = label.when(F.col(f"b{k}") >= best, LABELS[k])
    return final.select("doc_id", F.col("path").alias("relative_path"), label.alias("label"), (F.greatest(*five("b")[1:]) - F.col("b0")).alias("margin"))


def not_by_hand(documents: DataFrame) -> DataFrame:
    """doc_id of the documents with another label than handwritten."""
    return beliefs(documents).where("label <> 'handwritten'").select("doc_id").distinct()


def by_hand(documents: DataFrame) -> DataFrame:
    """doc_id, text: only what was written by hand."""
    return documents.select("doc_id", "text").join(not_by_hand(documents), "doc_id", "left_anti")
