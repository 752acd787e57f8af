"""Column functions over paths, addresses and identities."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrand.functions.text import let, lines, reasons

#: Fixed values of the ingestion policy.
REJECTED_PARTS = ("node_modules", "dist", "build", ".next", "coverage", ".cache", ".git", "vendor")
GENERATED_MARKERS = ("@generated", "auto-generated", "automatically generated", "do not edit", "generated by")
SYNTAX = r"\b(interface|type|class|function|const|let|enum|namespace|import|export|declare)\b|=>|<[A-Z][\p{L}\p{N}_.]*"
COMMIT, SHA256, SOURCE_ID = r"^[0-9a-f]{40}\z", r"^[0-9a-f]{64}\z", r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,127}\z"
GITHUB = r"^https://github\.com/[A-Za-z0-9][A-Za-z0-9-]{0,38}/[A-Za-z0-9][A-Za-z0-9._-]{0,99}\z"
UTC = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?Z\z"


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def path_reasons(path: Column) -> Column:
    """One reason at most: a part that is never source, or a type that is none."""
    name = name_of(path)
    suffix = F.lower(F.regexp_extract(name, r".(\.[^.]+)$", 1))
    bad_part = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, REJECTED_PARTS)))
    bad_type = suffix.isin(".map", ".lock", ".pem", ".key") | name.endswith(".lock")
    return F.when(bad_part, F.array(F.lit("excluded-path"))).when(bad_type, F.array(F.lit("excluded-file-type"))).otherwise(F.array().cast("array<string>"))


def source_type(path: Column) -> Column:
    low = F.lower(path)
    return (
        F.when(path.endswith(".d.ts"), "declaration").when(path.endswith(".tsx"), "code").when(F.contains(low, F.lit("/test")) | low.startswith("test"), "test")
        .when(path.endswith("package.json") | path.endswith("tsconfig.json"), "metadata").when(path.endswith(".ts"), "code").otherwise("metadata")
    )


def language_reason(path: Column, text: Column) -> Column:
    """typescript, or why a file isn't taken as such; metadata files pass."""
    name = name_of(path)
    suffix = F.lower(F.regexp_extract(name, r".(\.[^.]+)$", 1))
    return (
        F.when(name.isin("package.json", "tsconfig.json"), "metadata").when(~suffix.isin(".ts", ".tsx"), "unsupported-extension")
        .when(name.endswith(".min.ts") | name.endswith(".bundle.ts"), "bundled-filename").when(~text.rlike(SYNTAX), "no-typescript-syntax").otherwise("typescript")
    )


def generated_reasons(path: Column, text: Column) -> Column:
    head = F.lower(F.substring(text, 1, 4096))
    header = F.lit(False)
    for m in GENERATED_MARKERS:
        header = header | F.contains(head, F.lit(m))
    name = name_of(path)
    return let(lines(text), lambda ls: reasons(
        (header, "generated-header"), (F.array_max(F.transform(ls, lambda x: F.length(x))) > 2000, "very-long-line"),
        (name.endswith(".generated.ts") | name.endswith(".gen.ts") | name.endswith(".d.ts"), "generated-filename"),
        ((F.size(ls) > 20) & (F.size(F.array_distinct(ls)) / F.size(ls) < 0.25), "high-repetition"),
    ))


def harness_reasons(path: Column, text: Column) -> Column:
    low = F.lower(path)
    tests = F.contains(F.concat(F.lit("/"), low), F.lit("/test")) | low.startswith("test/")
    return F.array_sort(reasons(
        (F.contains(F.concat(F.lit("/"), low, F.lit("/")), F.lit("/fourslash/")) | low.startswith("fourslash/"), "test-harness-fourslash-path"),
        (text.rlike(r"(?im)^\s*//\s*@filename\s*:"), "test-harness-filename-directive"),
        (text.rlike(r"(?i)<reference\s+path\s*=\s*[\"'](?:\.\.?/)*fourslash\.ts[\"']"), "test-harness-fourslash-reference"),
        (tests & text.rlike(r"\bverify\.[A-Za-z_$][\p{L}\p{N}_$]*\s*\("), "test-harness-verify-api"),
        (tests & text.rlike(r"\b(?:goTo|edit|formatCode|baseline)\.[A-Za-z_$][\p{L}\p{N}_$]*\s*\("), "test-harness-editor-api"),
    ))


def stream_harness(text: Column) -> Column:
    """Whether a line is a compiler directive; narrower than harness_reasons."""
    return text.rlike(r"(?m)^[ \t]*// @(?:Filename|BaselineFile):")


def glob_pattern(glob: str) -> str:
    """A shell glob as an anchored pattern; * crosses directories."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "[" and "]" in glob[i + 2 :]:
            j = glob.index("]", i + 2)
            inner = glob[i + 1 : j].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            i = j
        else:
            out += ".*" if c == "*" else "." if c == "?" else re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def in_scope(path: Column, scope: list[str] | None) -> Column:
    """Whether an approval's scope admits a path."""
    if scope is None or "typescript-source" in scope:
        return F.lit(True)
    globs = {k: [glob_pattern(x.removeprefix(f"{k}:")) for x in scope if x.startswith(f"{k}:")] for k in ("include", "exclude")}
    any_of = lambda ps: [path.rlike(p) for p in ps]
    ok, no = F.lit(False), F.lit(False)
    for c in any_of(globs["include"]):
        ok = ok | c
    for c in any_of(globs["exclude"]):
        no = no | c
    return ok & ~no


def safe_uri(uri: Column) -> Column:
    """An address without userinfo, query and fragment. A malformed port is dropped, a path alone stays."""
    bare = F.regexp_replace(uri, r"[?#].*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    authority = F.regexp_extract(rest, r"^//([^/]*)", 1)
    path = F.when(rest.startswith("//"), F.regexp_replace(rest, r"^//[^/]*", "")).otherwise(rest)
    host_port = F.regexp_replace(authority, r"^.*@", "")
    host = F.lower(F.regexp_replace(host_port, r":[^:\]]*$", ""))
    port = F.regexp_extract(host_port, r":(\d{1,5})$", 1)
    keep = F.when((port != "") & (port.cast("int") <= 65535), F.concat(host, F.lit(":"), port)).otherwise(host)
    return F.when(scheme == "", bare).when(authority == "", F.concat(scheme, F.lit(":"), F.when(rest.startswith("//"), F.concat(F.lit("//"), path)).otherwise(path))).otherwise(F.concat(scheme, F.lit("://"), keep, path))
