"""Views of a document that rules search, all as long as the text and with its line feeds: code, and what isn't prose, is blanked."""

from __future__ import annotations

import json
import re


import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import suffix  # noqa: F401

MARKDOWN = (".md", ".markdown", ".mdx")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_CODE_LINE = re.compile(r"(?: {4}|\t)\S")
_NOT_BREAK = re.compile(r"[^\n]")


def spaces(piece: str) -> str:
    return _NOT_BREAK.sub(" ", piece)


def without_code_blocks(text: str, markdown: bool) -> str:
    """Fenced blocks, an unclosed one to the end, as spaces; in Markdown also closed front matter and code indented after a blank line."""
    lines = text.splitlines(keepends=True)
    bare = [x.rstrip("\r\n") for x in lines]
    out: list[str] = []
    n = 0
    if markdown and lines and (mark := bare[0].strip()) in ("---", "+++"):
        ends = ("---", "...") if mark == "---" else ("+++",)
        n = next((i + 1 for i in range(1, len(bare)) if bare[i].strip() in ends), 0)
        out += map(spaces, lines[:n])
    fence, in_code, after_blank = "", False, True
    for raw, x in zip(lines[n:], bare[n:]):
        if fence:
            out.append(spaces(raw))
            if re.fullmatch(r" {0,3}" + re.escape(fence[0]) + "{%d,}\\s*" % len(fence), x):
                fence = ""
            continue
        if m := _FENCE.match(x):
            fence, after_blank = m[1], False
            out.append(spaces(raw))
            after_blank = not x.strip()
            continue
        if markdown and (in_code or after_blank) and _CODE_LINE.match(x):
            out.append(spaces(raw))
            in_code = True
        else:
            out.append(raw)
            in_code = in_code and not x.strip()
        after_blank = not x.strip()
    return "".join(out)


_TICKS = re.compile(r"`+")


def without_code_spans(text: str) -> str:
    """Spans between equally long runs of backticks as spaces; a run without a partner stays."""
    runs = [(m.start(), m.end()) for m in _TICKS.finditer(text)]
    by_length: dict[int, list[int]] = {}
    for i, (a, b) in enumerate(runs):
        by_length.setdefault(b - a, []).append(i)
    out, at, i = [], 0, 0
    place = dict.fromkeys(by_length, 0)
    while i < len(runs):
        a, b = runs[i]
        same = by_length[b - a]
        k = place[b - a]
        while k < len(same) and same[k] <= i:
            k += 1
        place[b - a] = k
        if k == len(same):
            i += 1
            continue
        end = runs[same[k]][1]
        out += [text[at:a], spaces(text[a:end])]
        at, i = end, same[k] + 1
    return "".join([*out, text[at:]])


#: What isn't prose in marked-up text, in the order in which it is masked.
_MARKUP = [
    re.compile(r"(?is)<(?:code|pre)\b[^>]*+>.*?</(?:code|pre)\s*+>"),
    re.compile(r"(?<=\])\([^)\n\\]*+(?:\\.[^)\n\\]*+)*+\)"),
    re.compile(r"(?:https?|ftp)://[^\s<>()]++"),
    re.compile(r"(?<![\w.+-])[\w.+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    re.compile(r"\{(?:#|\.)[^}\n]+\}"),
    re.compile(r"<[^>\n]++>"),
]


def without_markup(text: str) -> str:
    """Code elements, link destinations, addresses, attribute lists and tags as spaces."""
    for p in _MARKUP:
        text = p.sub(lambda m: spaces(m[0]), text)
    return text


#: A JSON string; a key has a colon after it.
_JSON_STRING = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(\s*:)?', re.S)


def json_values(text: str) -> list[tuple[int, int, str]]:
    """(start, end, decoded) of the string values of a JSON text; what can't be decoded is left out."""
    out = []
    for m in _JSON_STRING.finditer(text):
        if m[1]:
            continue
        try:
            out.append((m.start(), m.end(), json.loads(m[0])))
        except ValueError:
            continue
    return out


def json_prose(text: str) -> str:
    """Only the decoded string values, each cut or padded to the room that it has in the text."""
    out, at = [], 0
    for a, b, value in json_values(text):
        room = b - a - 2
        out += [spaces(text[at : a + 1]), value.replace("\r", " ").replace("\n", " ")[:room].ljust(room)]
        at = b - 1
    return "".join([*out, spaces(text[at:])])


def _map(f, texts: pd.Series, flags: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else f(t, bool(x)) for t, x in zip(texts, flags)], dtype=object)


@F.pandas_udf(T.StringType())
def _blocks(texts: pd.Series, markdown: pd.Series) -> pd.Series:
    return _map(without_code_blocks, texts, markdown)


@F.pandas_udf(T.StringType())
def _spans(texts: pd.Series, markdown: pd.Series) -> pd.Series:
    return _map(lambda t, _: without_code_spans(t), texts, markdown)


@F.pandas_udf(T.StringType())
def _json(texts: pd.Series, markdown: pd.Series) -> pd.Series:
    return _map(lambda t, _: json_prose(t), texts, markdown)


def _where(condition: Column, f, text: Column, flag: Column) -> Column:
    """f of the texts that need it; the others aren't sent to Python."""
    return F.coalesce(f(F.when(condition, text), flag), text)


def code_blocks_masked(text: Column, markdown: Column) -> Column:
    needs = text.rlike("(?m)^ {0,3}(?:`{3}|~{3})") | (markdown & text.rlike(r"(?m)^(?: {4}|\t)\S|\A\s*(?:---|\+\+\+)"))
    return _where(needs, _blocks, text, markdown)


def code_spans_masked(text: Column) -> Column:
    return _where(text.contains("`"), _spans, text, F.lit(False))



def json_masked(text: Column) -> Column:
    return _where(F.lit(True), _json, text, F.lit(False))
