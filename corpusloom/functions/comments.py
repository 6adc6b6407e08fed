"""Comments of source texts, by the suffix of their path: [(line, text)]. Scanners of single texts, and the Arrow function over them."""

from __future__ import annotations

import ast
import io
import re
import tokenize
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators import kinds

Comments = list[tuple[int, str]]
_BREAKS = re.compile("\r\n|[\n\r\x85  ]")


def line_of(text: str, at: int) -> int:
    return 1 + sum(1 for _ in _BREAKS.finditer(text[:at]))


def of_python(text: str) -> Comments:
    """Comments, and the docstrings of modules, classes and functions. What can't be parsed gives what was found before."""
    out: Comments = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.COMMENT:
                out.append((t.start[0], t.string[1:].strip()))
    except (tokenize.TokenError, SyntaxError):
        pass
    try:
        for node in ast.walk(ast.parse(text)):
            if isinstance(node, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and node.body:
                first = node.body[0]
                if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
                    out.append((first.lineno, first.value.value))
    except (SyntaxError, ValueError, RecursionError):
        pass
    return out


_HERE_DOC = re.compile(r"""(?:^|[;&|()\s])<<(-?)(?!<)[ \t]*(?:(['"])(?P<quoted>[^'"]+)['"]|(?P<bare>[^\s;&|()]+))""")
_BLOCK_SCALAR = re.compile(r":\s*[|>]\s*(?:[1-9][+-]?|[+-][1-9]?)?\s*(?:#.*)?$")
#: Outside quotes: an escape, a quoted run (to the end of the line if it isn't closed; no escapes between single quotes), or a hash.
_HASH_TOKEN = re.compile(r"""\\.?|'[^']*(?:'|$)|"(?:\\.|[^"\\])*(?:"|\\?$)|`(?:\\.|[^`\\])*(?:`|\\?$)|(?P<hash>\#)""", re.S)
_TRIPLE = re.compile(r'"""|\'\'\'')


def _toml_line(line: str, inside: str) -> tuple[str, str]:
    """The line with multi-line strings as spaces, and the delimiter of one that goes on."""
    out, at = [], 0
    while True:
        if inside:
            end = line.find(inside, at)
            if end < 0:
                return "".join(out) + " " * (len(line) - at), inside
            out.append(" " * (end + 3 - at))
            at, inside = end + 3, ""
        m = _TRIPLE.search(line, at)
        if not m:
            return "".join(out) + line[at:], ""
        out.append(line[at : m.start()] + "   ")
        at, inside = m.end(), m[0]


def of_hash(text: str, dialect: str = "plain") -> Comments:
    """From a hash to the end of its line; dialect shell, yaml or toml adds what these hide hashes in."""
    out: Comments = []
    here: tuple[str, bool] | None = None
    block: int | None = None
    inside = ""
    for number, line in enumerate(text.splitlines(), 1):
        if here:
            if (line.lstrip("\t") if here[1] else line) == here[0]:
                here = None
            continue
        if block is not None:
            if not line.strip() or len(line) - len(line.lstrip(" ")) > block:
                continue
            block = None
        if dialect == "toml":
            line, inside = _toml_line(line, inside)
        for m in _HASH_TOKEN.finditer(line):
            if not m["hash"]:
                continue
            i = m.start()
            if i == 0 and line.startswith("#!"):
                break
            if dialect == "shell" and line.rfind("${", 0, i) > line.rfind("}", 0, i):
                continue
            if i and not line[i - 1].isspace() and not (dialect == "shell" and line[i - 1] in ";&|(){}"):
                continue
            out.append((number, line[i + 1 :].strip()))
            break
        if dialect == "shell" and (m := _HERE_DOC.search(line)):
            here = (re.sub(r"\\(.)", r"\1", m["quoted"] or m["bare"]), bool(m[1]))
        elif dialect == "yaml" and _BLOCK_SCALAR.search(line):
            block = len(line) - len(line.lstrip(" "))
    return out


_SLASH_TOKEN = re.compile(r"""\\.|(?P<q>['"`])(?:\\.|(?!(?P=q))[^\\])*(?:(?P=q)|\\?\Z)|(?P<line>//[^\n]*)|(?P<block>/\*)""", re.S)
_NESTING = re.compile(r"/\*|\*/")


def of_slashes(text: str, lines: bool = True, nested: bool = False) -> Comments:
    """// to the end of the line, if `lines`, and /* */, also nested. One that isn't closed goes to the end of the text without its last two characters."""
    out: Comments = []
    at = 0
    while m := _SLASH_TOKEN.search(text, at):
        at = m.end()
        if m["line"]:
            if lines:
                out.append((1 + text.count("\n", 0, m.start()), m["line"][2:].strip()))
            else:
                at = m.start() + 1
        elif m["block"]:
            depth, look, end = 1, m.end(), None
            while depth and (c := _NESTING.search(text, look)):
                look = c.end()
                if c[0] == "*/":
                    depth -= 1
                    end = c.start()
                elif nested:
                    depth += 1
                else:
                    look = c.start() + 1
            if depth:
                end = max(len(text) - 2, m.end())
            out.append((1 + text.count("\n", 0, m.start()), text[m.end() : end]))
            at = end + 2
    return out


_TEMPLATE = re.compile(r"`[^`\\]*+(?:\\.[^`\\]*+)*+`", re.S)
_EXPRESSION = re.compile(r"\$\{(.*)\}", re.S)


def of_templates(text: str) -> Comments:
    """Comments within the expressions of template literals."""
    out: Comments = []
    for t in _TEMPLATE.finditer(text):
        for e in _EXPRESSION.finditer(t[0]):
            before = line_of(text, t.start() + e.start(1)) - 1
            out += [(before + n, c) for n, c in of_slashes(e[1])]
    return out


def of_markup(text: str) -> Comments:
    return [(line_of(text, m.start()), m[1]) for m in re.finditer(r"<!--(.*?)-->", text, re.S)]


_DASH_TOKEN = re.compile(r"""\\.?|(?P<q>['"`])(?:\\.|(?!(?P=q))[^\\])*(?:(?P=q)|\\?$)|(?P<dash>--)""", re.S)


def of_dashes(text: str) -> Comments:
    out: Comments = []
    for number, line in enumerate(text.splitlines(), 1):
        if m := next((m for m in _DASH_TOKEN.finditer(line) if m["dash"]), None):
            out.append((number, line[m.end() :].strip()))
    return out


_LANGUAGES = {"bash": ".sh", "javascript": ".js", "jsonc": ".js", "python": ".py", "ruby": ".rb", "rust": ".rs", "shell": ".sh", "typescript": ".ts", "zsh": ".sh"} | {x: "." + x for x in "c cpp css go html js jsx lua php rb sh sql toml ts tsx xml yaml yml".split()}
_OPENING = re.compile(r" {0,3}(`{3,}|~{3,})([^\n]*)$")


def of_fences(text: str) -> Comments:
    """Comments of the closed code blocks of a Markdown text, by the language that a block names."""
    out: Comments = []
    lines = text.splitlines(keepends=True)
    i = 0
    while i < len(lines):
        m = _OPENING.match(lines[i].rstrip("\r\n"))
        i += 1
        if not m:
            continue
        info = m[2].strip()
        word = re.search(r"(?:^|[\s{])\.([\w+-]+)(?=[\s}])", info, re.A) if info.startswith("{") else re.match(r"([\w+-]+)", info, re.A)
        ending = _LANGUAGES.get(word[1].lower()) if word else None
        if not ending:
            continue
        closing = re.compile(r" {0,3}" + re.escape(m[1][0]) + "{%d,}\\s*$" % len(m[1]))
        end = next((j for j in range(i, len(lines)) if closing.match(lines[j].rstrip("\r\n"))), None)
        if end is None:
            break
        out += [(i + n, c) for n, c in comments("block" + ending, "".join(lines[i:end]))]
        i = end + 1
    return out


def comments(path: str, text: str) -> Comments:
    """All comments of a text, sorted, each once."""
    p = PurePosixPath(path)
    s = p.suffix.lower()
    script = not p.suffix and text.startswith("#!")
    out: Comments = []
    if s in (".py", ".pyi"):
        out += of_python(text)
    if s in kinds.HASH or p.name in kinds.HASH_NAMES:
        out += of_hash(text, "shell" if s in kinds.SHELL or script else "yaml" if s in (".yaml", ".yml") else "toml" if s == ".toml" else "plain")
    if script:
        out += of_hash(text, "shell")
    if s in kinds.SLASH:
        out += of_slashes(text, nested=s in (".rs", ".swift"))
    if s == ".css":
        out += of_slashes(text, lines=False)
    if s in kinds.TEMPLATES:
        out += of_templates(text)
    if s in (".lua", ".sql"):
        out += of_dashes(text)
    if s in kinds.MARKUP:
        out += of_markup(text)
    if s in kinds.MARKDOWN:
        out += of_fences(text)
    return sorted(set(out))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("text", T.StringType())])))
def comments_of(paths: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([[] if t is None else [{"line": n, "text": c} for n, c in comments(p or "", t)] for p, t in zip(paths, texts)], dtype=object)
