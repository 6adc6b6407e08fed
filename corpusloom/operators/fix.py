"""Typography fixes that don't change the wording. Code, links, addresses and tags stay as they are, and a second run changes nothing."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text as X
from corpusloom.functions import views
from corpusloom.functions.text import suffix
from corpusloom.functions.units import CJK
from corpusloom.operators import kinds

_WIDE = {code: code - 0xFEE0 for a, z in ("０９", "ＡＺ", "ａｚ") for code in range(ord(a), ord(z) + 1)}
_MARKS = str.maketrans(",.;:!?", "，。；：！？")
_HAN = CJK.pattern
#: (pattern, what a match becomes, only on lines with ideographs), in the order in which they are applied.
_STEPS = [
    (re.compile("[%s]+" % "".join(map(chr, _WIDE))), lambda m, ui: m[0].translate(_WIDE), False),
    (re.compile("(?<=[0-9])．(?=[0-9])"), lambda m, ui: ".", False),
    (re.compile(r"([，。；：！？、])\1+"), lambda m, ui: m[1], False),
    (re.compile(r"(?<!\.)\.\.\.+(?!\.)"), lambda m, ui: "…" * (1 if ui else 2), True),
    (re.compile(r"(?<![\w-])--(?![\w-])"), lambda m, ui: "——", True),
    (re.compile(rf"(?<={_HAN})[,.;:!?](?=$|\s|{_HAN})"), lambda m, ui: m[0].translate(_MARKS), False),
    (re.compile(rf"{_HAN}(?=[0-9A-Za-z])"), lambda m, ui: m[0] + " ", False),
    (re.compile(rf"(?<=[0-9A-Za-z]){_HAN}"), lambda m, ui: " " + m[0], False),
]
_HEADING = re.compile(r"^ {0,3}#{1,6}\s+.+?(?P<stop>[.．。])\s*#*\s*$", re.M)
#: A text without any of these needs no fix; such texts aren't sent to Python.
TRIGGER = "[０-９Ａ-Ｚａ-ｚ．，。；：！？、\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}\\x{20000}-\\x{323af}]"


def masked(text: str, markdown: bool) -> str:
    return views.without_markup(views.without_code_spans(views.without_code_blocks(text, markdown)))


def fix_text(text: str, markdown: bool = False, style: str = "standard") -> str:
    for pattern, value, chinese in _STEPS:
        seen, out, at = masked(text, markdown), [], 0
        for m in pattern.finditer(seen):
            if chinese:
                a, z = seen.rfind("\n", 0, m.start()) + 1, seen.find("\n", m.end())
                if not CJK.search(seen, a, len(seen) if z < 0 else z):
                    continue
            out += [text[at : m.start()], value(m, style == "ui")]
            at = m.end()
        text = "".join([*out, text[at:]])
    if markdown and style == "readme":
        seen = views.without_code_spans(views.without_code_blocks(text, True))
        for m in reversed(list(_HEADING.finditer(seen))):
            text = text[: m.start("stop")] + text[m.end("stop") :]
    return text


#: What a mask might hide; texts without any of it are fixed by expressions alone.
HIDES = r"[`<{]|\]\(|://|@|(?m)^ {0,3}~~~"


def _plain(text: Column, style: str) -> Column:
    """fix_text() of texts in which nothing is masked, as expressions."""
    han = X.CJK
    text = F.translate(text, "".join(map(chr, _WIDE)), "".join(map(chr, _WIDE.values())))
    text = F.regexp_replace(text, "(?<=[0-9])．(?=[0-9])", ".")
    text = F.regexp_replace(text, r"([，。；：！？、])\1+", "$1")

    def marks(t: Column) -> Column:
        t = F.regexp_replace(t, r"(?<!\.)\.{3,}(?!\.)", "…" * (1 if style == "ui" else 2))
        return F.regexp_replace(t, r"(?U)(?<![\w-])--(?![\w-])", "——")

    def lines(t: Column) -> Column:
        return F.array_join(F.transform(F.split(t, "\n", -1), lambda x: F.when(x.rlike(han), marks(x)).otherwise(x)), "\n")

    text = X.let(text, lambda t: F.when(t.rlike(r"\.{3}|--"), lines(t)).otherwise(t))
    for a, b in zip(",.;:!?", "，。；：！？"):
        text = F.regexp_replace(text, rf"(?Ud)(?<={han})[{a}](?=\z|\s|{han})", b)
    text = F.regexp_replace(text, rf"({han})(?=[0-9A-Za-z])", "$1 ")
    return F.regexp_replace(text, rf"(?<=[0-9A-Za-z])({han})", " $1")


def fix(documents: DataFrame, style: str = "standard") -> DataFrame:
    """path, text, changed: documents(path, text) with their typography fixed. Data files and null texts pass unchanged.

    Only texts with something that a mask hides, and Markdown, are sent to Python.
    """

    @F.pandas_udf(T.StringType())
    def fixed(texts: pd.Series, markdown: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else fix_text(t, bool(m), style) for t, m in zip(texts, markdown)], dtype=object)

    s = suffix(F.col("path"))
    markdown = s.isin(kinds.MARKDOWN)
    heading = markdown & F.col("text").rlike(r"(?m)^ {0,3}#") if style == "readme" else F.lit(False)
    needs = ~s.isin(kinds.DATA) & (F.col("text").rlike(TRIGGER) | heading)
    masked_ = markdown | F.col("text").rlike(HIDES)
    by_python = fixed(F.when(needs & masked_, F.col("text")), markdown)
    by_expressions = F.when(needs & ~masked_, _plain(F.col("text"), style))
    new = F.coalesce(by_python, by_expressions, F.col("text"))
    return documents.select("path", F.col("text").alias("_old"), new.alias("text")).select("path", "text", (~F.col("text").eqNullSafe(F.col("_old"))).alias("changed"))
