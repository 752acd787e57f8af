"""Problem 6: source files that do not parse in the language of their extension.

Method: a lexer per language and a pushdown stack. The lexers find unterminated literals and characters no
token begins with; the stack finds unbalanced delimiters and premature ends; what stands between the
delimiters is then recognised, group by group (grammar.py for TypeScript, TSX and JavaScript, pygrammar.py for
Python, a rewriting of value classes for JSON).

Defined results: null, empty and blank texts are valid; documents without a known extension (ts, mts, cts,
tsx, js, json, py; also d.ts) are not judged; a leading byte order mark is no fault; invisible characters
between tokens are no fault (they are problem 9's); comments and trailing commas in JSON are allowed only
in tsconfig.json. Repeated rows are judged each; extra columns pass unread; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm import pygrammar
from lodestrand.llm.families import key
from lodestrand.llm.grammar import CONFLICT, Bad, Classes, Recogniser, grouped, lexed, without_elements

LANGUAGES = {"ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "json": "json", "py": "python"}
FAULTS = "doc_id bigint, language string, fault string"


class Scripts:
    """TypeScript, TSX and JavaScript."""

    def __init__(self):
        self.classes = Classes()
        self.by = {ts: Recogniser(ts) for ts in (True, False)}

    def fault(self, text: str, language: str) -> str | None:
        if text.startswith("#!"):
            text = "//" + text
        if language != "typescript":
            text = without_elements(text)
        classes = lexed(text, self.classes)
        if "\x00" in classes:
            return "unterminated literal or unknown character"
        try:
            return self.by[language != "javascript"].fault(grouped(classes))
        except Bad as e:
            return str(e)


# -- JSON
JSON_TOKEN = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|(?:true|false|null)(?!\w)|[\[\]{}:,]|[^ \t\r\n]')
JSON_COMMENT = re.compile(r'("(?:[^"\\\n]|\\.)*")|//[^\n]*|/\*[\s\S]*?\*/')
LIST = re.compile(r"\[(?:[sv](?:,[sv])*)?(,?)\]")
OBJECT = re.compile(r"\{(?:s:[sv](?:,s:[sv])*)?(,?)\}")


def json_fault(text: str, relaxed: bool) -> str | None:
    if relaxed:
        text = JSON_COMMENT.sub(lambda m: m[1] or " ", text)
    out = []
    for t in JSON_TOKEN.findall(text):
        h = t[0]
        if h == '"' and len(t) > 1:
            out.append("s")
        elif t in "[]{}:,":
            out.append(t)
        elif h in "-0123456789" and t != "-" or t in ("true", "false", "null"):
            out.append("v")
        else:
            return "unterminated literal or unknown character"
    s = "".join(out)
    try:
        grouped(s)
    except Bad as e:
        return str(e)
    value = lambda m: "v" if not m[1] or (relaxed and len(m[0]) > 3) else "!"
    while True:
        t = OBJECT.sub(value, LIST.sub(value, s))
        if t == s:
            break
        s = t
    return None if s in ("s", "v") else "unexpected token"


@functools.cache
def scripts() -> Scripts:
    return Scripts()


def language_of(path: str | None) -> str | None:
    name = (path or "").strip().lower().rpartition("/")[2]
    return LANGUAGES.get(name.rpartition(".")[2]) if "." in name else None


def fault_of(text: str | None, path: str | None) -> str | None:
    """What is wrong with a file; None: nothing, or no judged language."""
    language = language_of(path)
    if not language or not text or not text.strip():
        return None
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    if language == "json":
        fault = json_fault(text, (path or "").strip().lower().rpartition("/")[2] == "tsconfig.json")
    elif language == "python":
        fault = pygrammar.fault(text)
    else:
        fault = scripts().fault(text, language)
    return "merge conflict marker" if fault and CONFLICT.search(text) else fault


def _faults(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, p, t in zip(batch.column(0), batch.column(1), batch.column(2)):
            path = p.as_py()
            rows.append((i.as_py(), language_of(path), fault_of(t.as_py(), path)))
        columns = list(zip(*rows)) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names=["doc_id", "language", "fault"])


def judged(documents: DataFrame) -> DataFrame:
    """doc_id, language, fault (null: it parses) of the documents in a judged language."""
    path = F.lower(F.trim("relative_path"))
    rows = documents.where(path.rlike(r"\.(" + "|".join(LANGUAGES) + ")$")).select("doc_id", "relative_path", "text")
    return rows.mapInArrow(_faults, FAULTS)


def broken(documents: DataFrame) -> DataFrame:
    """doc_id, language, fault of the documents that do not parse."""
    return judged(documents).where("fault is not null")


def fault_rates(documents: DataFrame) -> DataFrame:
    """repository_id, language, files, broken, rate."""
    rows = judged(documents).join(documents.select("doc_id", key("repository_id").alias("repository_id")).distinct(), "doc_id")
    return rows.groupBy("repository_id", "language").agg(F.count("*").alias("files"), F.count("fault").alias("broken"), (F.count("fault") / F.count("*")).alias("rate"))
