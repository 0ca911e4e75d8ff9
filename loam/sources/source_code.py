"""Functions in source files without an index: ranges, signatures, cyclomatic and cognitive complexity.

A scanner reads each text once, past strings and comments. It keeps a stack of open blocks (braces, or indentation), so that
a function ends where its block does and a decision knows how many control blocks enclose it. Conditions of a statement count
as inside it, as in a syntax tree. It is Python over Arrow batches, since a stack has no column expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "path string, name string, line int, end_line int, signature string, cyclomatic int, cognitive int"
#: Keywords by language that decide, and that nest what stands in their block.
BRACES = {
    "go": ({"if", "for", "range", "case", "select"}, {"if", "for", "select", "switch"}),
    "javascript": ({"if", "for", "while", "do", "case", "catch"}, {"if", "for", "while", "do", "switch", "try"}),
    "java": ({"if", "for", "while", "do", "case", "catch"}, {"if", "for", "while", "do", "switch", "try"}),
    "rust": ({"if", "for", "while", "match"}, {"if", "for", "while", "loop", "match"}),
}
BRACES["typescript"] = BRACES["javascript"]
BRACES["kotlin"] = BRACES["java"]
FUNCTION = {
    "go": re.compile(r"func\s+(?:\([^)]*\)\s*)?(\w+)\s*[\[(]"),
    "javascript": re.compile(r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)\s*\("),
    "java": re.compile(r"(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+(?:<[^>]*>\s*)?[\w<>\[\], .?]+\s+(\w+)\s*\([^;{]*\)"),
    "rust": re.compile(r"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)\s*[<(]"),
    "kotlin": re.compile(r"fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)\s*\("),
}
FUNCTION["typescript"] = FUNCTION["javascript"]
_TOKEN = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])'|`[^`]*`|[A-Za-z_]\w*|&&|\|\||[{}();?]|\n""", re.S)
_QUOTED_WORDS = {"javascript", "typescript"}
_PY_DEF = re.compile(r"^(\s*)(?:async\s+)?def\s+(\w+)\s*\(")
_PY_TOKEN = re.compile(r'''#[^\n]*|"""(?:\\.|.)*?"""|\'\'\'(?:\\.|.)*?\'\'\'|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*\'''', re.S)
_PY_WORD = re.compile(r"[A-Za-z_]\w*")


def _brace_functions(text: str, language: str) -> Iterator[tuple]:
    deciding, nesting = BRACES[language]
    starts = {m.start(): m for m in FUNCTION[language].finditer(text)}
    order, at = sorted(starts), 0
    line, round_depth = 1, 0
    stack: list[bool] = []  # open blocks: does it nest?
    waiting: bool | None = None  # a statement's head stands before its block; does the block nest?
    open_functions: list[dict] = []
    heading: dict | None = None
    after_else = False
    chain = 0  # an `else if` stands inside the `if` before it
    chains: list[int] = []
    for m in _TOKEN.finditer(text):
        t = m.group()
        while at < len(order) and order[at] <= m.start():
            f = starts[order[at]]
            heading = {"name": f.group(1), "line": line + text.count("\n", m.start(), f.start()) if f.start() > m.start() else line, "from": f.start(), "one": 1, "deep": 0, "base": None}
            at += 1
        if t[0] in "/\"'`" and len(t) > 1 or t == "\n":
            line += t.count("\n")
            continue
        if t in "()":
            round_depth += 1 if t == "(" else -1
            continue
        level = sum(stack[open_functions[-1]["base"] :]) if open_functions else 0
        if t == "{":
            if heading is not None and round_depth <= 0:
                heading["base"] = len(stack) + 1
                heading["signature"] = " ".join(text[heading["from"] : m.start()].split())
                open_functions.append(heading)
                heading = None
                stack.append(False)
            else:
                stack.append(bool(waiting) and round_depth <= 0)
                if waiting is not None and round_depth <= 0:
                    waiting = None
            chains.append(chain)
            chain = 0
            continue
        if t == "}":
            if stack:
                stack.pop()
                chain = chains.pop()
            if open_functions and len(stack) < open_functions[-1]["base"]:
                f = open_functions.pop()
                yield f["name"], f["line"], line, f["signature"], f["one"], f["deep"]
            continue
        if t == ";":
            if round_depth <= 0 and waiting is not None and language not in ("go", "rust"):
                waiting = None  # a statement without a block
            if heading is not None and round_depth <= 0:
                heading = None  # a declaration without a body
            chain = 0 if round_depth <= 0 and waiting is None else chain
            continue
        if not open_functions:
            continue
        f = open_functions[-1]
        inner = 1 if waiting is not None else 0
        if t == "else":
            after_else = True
            continue
        if t == "if" and after_else:
            chain += 1
        elif t in nesting:
            chain = 0
        after_else = False
        extra = chain if t == "if" or inner else 0
        if t in deciding:
            f["one"] += 1
            f["deep"] += 1 + level + extra + (inner if t == "range" else 0)
        elif t in ("&&", "||") or (t == "?" and language in ("javascript", "typescript", "java")):
            f["one"] += 1
            f["deep"] += 1 + level + extra + inner
        if t in nesting or t == "catch":
            waiting = t in nesting


def _indent_functions(text: str) -> Iterator[tuple]:
    plain = _PY_TOKEN.sub(lambda m: "\n" * m.group().count("\n") + ("" if m.group().startswith("#") else '""'), text)
    lines, shown = plain.split("\n"), text.split("\n")
    open_functions: list[dict] = []
    stack: list[tuple[int, bool]] = []  # indentation and nesting of open statements
    last, balance = 0, 0
    for number, body in enumerate([*lines, "end"], 1):
        if not body.strip():
            continue
        wide = len(body) - len(body.lstrip())
        words = _PY_WORD.findall(body)
        if balance <= 0:
            while open_functions and wide <= open_functions[-1]["wide"]:
                f = open_functions.pop()
                yield f["name"], f["line"], last, f["signature"], f["one"], f["deep"]
            first = words[0] if words else ""
            while stack and (wide < stack[-1][0] or wide == stack[-1][0] and not (first in ("elif", "else", "except", "finally"))):
                stack.pop()
        else:
            first = ""
        if number > len(lines):
            break
        last = number
        if (m := _PY_DEF.match(body)) and balance <= 0:
            head = number - 1
            while head < len(lines) - 1 and not lines[head].rstrip().endswith(":"):
                head += 1
            signature = " ".join(" ".join(shown[number - 1 : head + 1]).split()).rstrip(":").rstrip()
            open_functions.append({"name": m.group(2), "line": number, "wide": wide, "signature": signature, "one": 1, "deep": 0, "stack": len(stack)})
        elif open_functions:
            f = open_functions[-1]
            level = sum(n for w, n in stack[f["stack"] :] if w < wide or first in ("elif", "except"))
            inside = 1 if first in ("if", "elif", "while", "for", "with", "except") else 0
            for i, w in enumerate(words):
                if i == 0 and first in ("if", "for", "while", "with", "elif", "except"):
                    f["one"] += 1
                    f["deep"] += 1 + level
                elif i and w in ("and", "or", "if", "for"):
                    f["one"] += 1
                    f["deep"] += 1 + level + inside
            if first in ("if", "for", "while", "with", "try"):
                stack.append((wide, True))
        balance += sum(body.count(c) for c in "([{") - sum(body.count(c) for c in ")]}")


def functions(files: DataFrame) -> DataFrame:
    """``path, name, line, end_line, signature, cyclomatic, cognitive`` of functions in ``path, language, text``, lines from 1.

    Cyclomatic complexity is one plus the decisions; cognitive complexity adds, for each decision, one and the number of
    control blocks around it. Texts in other languages, null ones and binary ones have none; a function whose block never
    closes is left out, as are functions without a body.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
        for batch in batches:
            for path, language, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not text or "\0" in text:
                    continue
                found = _indent_functions(text) if language == "python" else _brace_functions(text, language) if language in BRACES else ()
                rows = sorted((path, *f) for f in found)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.selectExpr("cast(path as string) as path", "language", "text").mapInArrow(run, SCHEMA)
