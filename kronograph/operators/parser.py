"""Definitions with their blocks in source files (C4, C5, C10, W18): an Arrow map over files, one file at a time.

A definition's block ends where its braces close, or, in Python, before the next
line that isn't blank and isn't indented deeper. Braces in strings and line
comments don't count. A line starts one definition at most.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Complexity of types whose body isn't looked at.
FLAT = {"struct": 2, "enum": 2, "interface": 4, "trait": 4, "class": 5}
SCHEMA = "path string, language string, kind string, name string, parent string, start bigint, end bigint, signature string, parameters array<string>, returns string, doc string, complexity bigint"

_NAME = r"(?P<name>[A-Za-z_$][\w$]*)"
_CALL = r"\s*(?:<[^(]*>)?\s*\((?P<params>[^)]*)\)?"
_RULES = {
    "rust": (
        ("function", re.compile(rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+{_NAME}{_CALL}(?:\s*->\s*(?P<returns>[^{{;]+?))?\s*(?:where\b.*)?[{{;]?\s*$")),
        ("struct", re.compile(rf"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+{_NAME}")),
        ("enum", re.compile(rf"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+{_NAME}")),
        ("trait", re.compile(rf"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+{_NAME}")),
        ("impl", re.compile(rf"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?{_NAME}")),
    ),
    "python": (
        ("function", re.compile(rf"^\s*(?:async\s+)?def\s+{_NAME}{_CALL}(?:\s*->\s*(?P<returns>[^:]+))?")),
        ("class", re.compile(rf"^\s*class\s+{_NAME}")),
    ),
    "javascript": (
        ("function", re.compile(rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+{_NAME}{_CALL}(?:\s*:\s*(?P<returns>[^{{]+?))?\s*\{{?\s*$")),
        ("function", re.compile(rf"^\s*(?:export\s+)?(?:const|let|var)\s+{_NAME}\s*=\s*(?:async\s*)?\((?P<params>[^)]*)\)(?:\s*:\s*(?P<returns>[^=]+?))?\s*=>")),
        ("class", re.compile(rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{_NAME}")),
        ("interface", re.compile(rf"^\s*(?:export\s+)?interface\s+{_NAME}")),
    ),
    "java": (
        ("class", re.compile(rf"^\s*(?:public|private|protected|static|final|abstract|\s)*class\s+{_NAME}")),
        ("interface", re.compile(rf"^\s*(?:public|private|protected|static|\s)*interface\s+{_NAME}")),
        ("function", re.compile(rf"^\s*(?:public|private|protected)\s+(?:static\s+|final\s+)*(?P<returns>[\w<>\[\], ]+?)\s+{_NAME}\s*\((?P<params>[^)]*)\)")),
    ),
    "go": (
        ("function", re.compile(rf"^func\s+(?:\([^)]*\)\s*)?{_NAME}{_CALL}(?:\s*(?P<returns>[^{{]+?))?\s*\{{?\s*$")),
        ("struct", re.compile(rf"^type\s+{_NAME}\s+struct\b")),
        ("interface", re.compile(rf"^type\s+{_NAME}\s+interface\b")),
    ),
}
_RULES["typescript"] = _RULES["javascript"]
_BY_END = {"rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go"}
_BRANCHES = ((re.compile(r"\b(?:if|elif)\b"), 1), (re.compile(r"\b(?:for|while|loop)\b"), 2), (re.compile(r"\b(?:match|switch)\b"), 2), (re.compile(r"\btry\b"), 1))
_QUIET = re.compile(r"""//.*|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)'""")
_HOLDERS = ("class", "impl", "trait", "interface", "struct")


def language_of(path: str) -> str | None:
    return _BY_END.get((path or "").rpartition(".")[2].lower())


def block_end(lines: list[str], at: int, language: str) -> int:
    """Index of the last line of the block of the definition in line at."""
    if language == "python":
        depth = len(lines[at]) - len(lines[at].lstrip())
        last = at
        for k in range(at + 1, len(lines)):
            if lines[k].strip():
                if len(lines[k]) - len(lines[k].lstrip()) <= depth:
                    break
                last = k
        return last
    open_, seen = 0, False
    for k in range(at, len(lines)):
        code = _QUIET.sub("", lines[k])
        for c in code:
            open_ += (c == "{") - (c == "}")
            seen = seen or c == "{"
        if seen and open_ <= 0 or not seen and code.rstrip().endswith(";"):
            return k
    return len(lines) - 1


def complexity(body: list[str]) -> int:
    """1, and more for each line that branches, loops, matches or tries; 10 at most."""
    return min(10, 1 + sum(points for line in body for rule, points in _BRANCHES if rule.search(line)))


def doc_of(lines: list[str], at: int, language: str) -> str:
    """The comment lines right above, or a Python docstring's first line."""
    if language == "python":
        below = next((x.strip() for x in lines[at + 1 :] if x.strip()), "")
        m = re.match(r"""[rRuU]?(?:\"{3}|'{3})\s*(.*?)\s*(?:\"{3}|'{3})?$""", below)
        return m[1] if m else ""
    out = []
    for k in range(at - 1, -1, -1):
        m = re.match(r"\s*(?:///?|\*|/\*\*)\s?(.*?)\s*(?:\*/)?$", lines[k])
        if not m:
            break
        out.append(m[1])
    return "\n".join(x for x in reversed(out) if x)


def definitions(path: str, text: str) -> list[tuple]:
    """Rows of SCHEMA of one file; none for languages that aren't known."""
    language = language_of(path)
    lines = (text or "").split("\n")
    out, holders = [], []
    for k, line in enumerate(lines if language else []):
        for kind, rule in _RULES[language]:
            m = rule.match(line)
            if not m:
                continue
            end = block_end(lines, k, language)
            holders = [h for h in holders if h[1] >= k]
            parent = holders[-1][0] if holders else None
            found = m.groupdict()
            params = [p.strip() for p in (found.get("params") or "").split(",") if p.strip()]
            returns = (found.get("returns") or "").strip() or None
            named = "method" if kind == "function" and parent else kind
            points = FLAT.get(kind) or complexity(lines[k + 1 : end + 1])
            if kind != "impl":
                out.append((path, language, named, m["name"], parent, k + 1, end + 1, line.strip().rstrip("{").strip(), params, returns, doc_of(lines, k, language), points))
            if kind in _HOLDERS:
                holders.append((m["name"], end))
            break
    return out


def parsed(files: DataFrame, path_col: str = "path", text_col: str = "content") -> DataFrame:
    """Definitions of all files (C4): one row for each, a method only once and with its type as parent."""
    names = [f.split()[0] for f in SCHEMA.replace("array<string>", "a").split(", ")]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([r for p, t in zip(pdf[path_col], pdf[text_col]) for r in definitions(p, t)], columns=names)

    return files.select(path_col, text_col).mapInPandas(run, SCHEMA)


def replace_body(files: DataFrame, name: str, body: str, path_col: str = "path", text_col: str = "content") -> DataFrame:
    """(path, content, replaced): files with the first definition of a name replaced by new lines."""

    def run(batches):
        for pdf in batches:
            out = []
            for p, t in zip(pdf[path_col], pdf[text_col]):
                hit = next((d for d in definitions(p, t) if d[3] == name), None)
                lines = (t or "").split("\n")
                out.append((p, "\n".join([*lines[: hit[5] - 1], *body.split("\n"), *lines[hit[6] :]]) if hit else t, hit is not None))
            yield pd.DataFrame(out, columns=["path", "content", "replaced"])

    return files.select(path_col, text_col).mapInPandas(run, "path string, content string, replaced boolean")


def dry_run(files: DataFrame, path_col: str = "path", text_col: str = "content") -> DataFrame:
    """(files, symbols) that an indexing run would write."""
    n = parsed(files, path_col, text_col).agg(F.count("*").alias("symbols"))
    return files.agg(F.count("*").alias("files")).crossJoin(F.broadcast(n))  # one row each
