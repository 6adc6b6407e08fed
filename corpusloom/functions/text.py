"""Column expressions over text: regular expressions, positions, masks and lines.

Positions count code points from 0. Patterns are Python's; java() translates them, so that `\\s` and `\\w` cover all of
Unicode, and only LF ends a line for `.`, `^` and `$`.
"""

from __future__ import annotations

import importlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ideographs, for use inside a character class of either dialect (Java's form).
CJK_CLASS = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{323af}"
CJK = f"[{CJK_CLASS}]"
#: What ends a line where lines are numbered, and the larger set that ends one where texts are split.
NUMBERED_BREAK = r"\r\n|[\n\r\x85\u2028\u2029]"
SPLIT_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def java(pattern: str, flags: int = 0) -> str:
    """A Python pattern in Java's dialect. Raises ValueError for one that Python can't compile."""
    try:
        re.compile(pattern, flags)
    except re.error as e:
        raise ValueError(f"bad pattern {pattern!r}: {e}") from e
    letters = "Ud" + "iu" * bool(flags & re.I) + "m" * bool(flags & re.M) + "s" * bool(flags & re.S)
    out = re.sub(r"\\U([0-9a-fA-F]{8})", lambda m: "\\x{" + m[1].lstrip("0") + "}", pattern)
    out = out.replace("(?P<", "(?<").replace(r"\Z", r"\z")
    out = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", out)
    return f"(?{''.join(dict.fromkeys(letters))}){out}"


def literal(text: str) -> str:
    """A pattern that matches just this text, for Java."""
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def _lit(x: Column | str) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def has(text: Column, pattern: str) -> Column:
    """pattern in Java's dialect."""
    return text.rlike(pattern)


def let(x: Column, f) -> Column:
    """f(x) with x evaluated once, however often f uses it; nested, the expression stays linear in size."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def running(items: Column, state: Column, step, emit, kind: str) -> Column:
    """array<kind>: emit(state, item) of each item, with the state before it; step(state, item) gives the next one. Results are gathered in runs, so that long arrays aren't copied for each item."""
    start = F.struct(state.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("done"), F.array().cast(f"array<{kind}>").alias("run"))

    def one(a: Column, x: Column) -> Column:
        full, new = F.size(a["run"]) >= 64, F.array(emit(a["s"], x).cast(kind))
        return F.struct(step(a["s"], x).alias("s"), F.when(full, F.concat(a["done"], F.array(a["run"]))).otherwise(a["done"]).alias("done"), F.when(full, new).otherwise(F.concat(a["run"], new)).alias("run"))

    return F.aggregate(items, start, one, lambda a: F.concat(F.flatten(a["done"]), a["run"]))


def _matches(t: Column, pattern: Column | str) -> Column:
    """array<struct<g, m>>: each match with the gap before it."""
    found, gaps = F.regexp_extract_all(t, _lit(pattern), F.lit(0)), F.split(t, pattern, -1)
    return let(found, lambda ms: F.zip_with(ms, F.slice(gaps, F.lit(1), F.size(ms)), lambda m, g: F.struct(g.alias("g"), m.alias("m"))))


def spans(text: Column, pattern: Column | str) -> Column:
    """array<struct<pos int, sample string>>: all matches of a pattern (Java's dialect, never empty) in their order."""
    kind = "struct<pos:int,sample:string>"

    def located(t: Column) -> Column:
        begin = lambda at, x: at + F.length(x["g"])
        return running(_matches(t, pattern), F.lit(0), lambda at, x: begin(at, x) + F.length(x["m"]), lambda at, x: F.struct(begin(at, x).alias("pos"), x["m"].alias("sample")), kind)

    return let(text, lambda t: F.when(F.regexp_like(t, _lit(pattern)), located(t)).otherwise(F.array().cast(f"array<{kind}>")))


def lined(text: Column, pattern: Column | str) -> Column:
    """array<struct<pos int, line int, sample string>>: spans() with the line_at() of each match. The text is read once, however many matches there are."""
    kind = "struct<pos:int,line:int,sample:string>"

    def located(t: Column) -> Column:
        # A line feed right after a carriage return ends no further line.
        added = lambda cr, x: F.regexp_count(x, F.lit(NUMBERED_BREAK)) - F.when(cr & x.startswith("\n"), 1).otherwise(0)
        ends = lambda cr, x: x.endswith("\r") | ((x == "") & cr)
        at = lambda a, x: a["line"] + added(a["cr"], x["g"])
        begin = lambda a, x: a["pos"] + F.length(x["g"])

        def step(a: Column, x: Column) -> Column:
            return F.struct((begin(a, x) + F.length(x["m"])).alias("pos"), (at(a, x) + added(ends(a["cr"], x["g"]), x["m"])).alias("line"), x["m"].endswith("\r").alias("cr"))

        start = F.struct(F.lit(0).alias("pos"), F.lit(1).alias("line"), F.lit(False).alias("cr"))
        return running(_matches(t, pattern), start, step, lambda a, x: F.struct(begin(a, x).alias("pos"), at(a, x).alias("line"), x["m"].alias("sample")), kind)

    return let(text, lambda t: F.when(F.regexp_like(t, _lit(pattern)), located(t)).otherwise(F.array().cast(f"array<{kind}>")))


def line_at(text: Column, pos: Column) -> Column:
    """The number of the line, from 1, at a position."""
    return F.regexp_count(F.substring(text, F.lit(1), pos), F.lit(NUMBERED_BREAK)) + 1


def blanked(text: Column, pattern: str, sign: str = "") -> Column:
    """The text with everything that matches replaced by as many spaces; line feeds stay. Length and lines don't change. Every match holds the sign or stands after it."""
    def masked(t: Column) -> Column:
        found, gaps = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.split(t, pattern, -1)
        blanks = F.concat(F.transform(found, lambda m: F.regexp_replace(m, r"[^\n]", " ")), F.array(F.lit("")))
        return F.when(F.contains(t, F.lit(sign)) & t.rlike(pattern), F.array_join(F.zip_with(gaps, blanks, lambda g, b: F.concat(g, b)), "")).otherwise(t)

    return let(text, masked)


#: What isn't prose in marked-up text, in the order in which it is masked. Unrolled, so that long texts can't exhaust Java's stack.
_NOT_PROSE = (
    (r"(?Uds)(?i)<(?:code|pre)\b[^>]*+>.*?</(?:code|pre)\s*+>", "</"),
    (r"(?Ud)(?<=\])\([^)\n\\]*+(?:\\.[^)\n\\]*+)*+\)", "]("),
    (r"(?Ud)(?:https?|ftp)://[^\s<>()]++", "://"),
    (r"(?Ud)(?<![\w.+-])[\w.+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "@"),
    (r"(?Ud)\{(?:#[^}\n]+|\.[^}\n]+)\}", "{"),
    (r"(?Ud)<[^>\n]++>", "<"),
)


def without_markup(text: Column) -> Column:
    """Code elements, link destinations, addresses, attribute lists and tags as spaces."""
    for p, sign in _NOT_PROSE:
        text = blanked(text, p, sign)
    return text


def replaced_by_spaces(text: Column, words: list[str]) -> Column:
    """Each word, in the given order, as many spaces."""
    for w in words:
        text = F.replace(text, F.lit(w), F.lit(" " * len(w)))
    return text


#: Code points from here on are wide: ideographs, kana, Hangul, full-width forms and their punctuation, but no Latin letter.
WIDE_FROM = 0x2E80
WIDE = r"[\x{2e80}-\x{10ffff}]"


def one_of(chars) -> str:
    """A class (Java's) of single characters. Java tries them one after the other; here it tries runs of eight, each after its range, so that others are told by a comparison or two."""
    codes = sorted({ord(c) for c in chars})
    if not codes:
        return "(?!)"
    x = lambda c: f"\\x{{{c:x}}}"
    runs = [codes[i : i + 8] for i in range(0, len(codes), 8)]
    parts = "".join(f"[{x(r[0])}-{x(r[-1])}&&[{''.join(map(x, r))}]]" for r in runs)
    return f"[{x(codes[0])}-{x(codes[-1])}&&[{parts}]]"


def any_of(words: list[str], flags: str = "Ud") -> str:
    """A pattern (Java's) for any of the words; one that matches nothing for no word. It looks at the first character before it tries the words that begin with it."""
    if not words:
        return f"(?{flags})(?!)"
    if "" in words:
        return f"(?{flags})"
    by: dict[str, list[str]] = {}
    for w in dict.fromkeys(words):
        by.setdefault(w[0], []).append(w[1:])
    tails = [literal(c) + ("" if "" in ws else "(?:" + "|".join(map(literal, ws)) + ")") for c, ws in sorted(by.items())]
    return f"(?{flags})(?={one_of(by)})(?:{'|'.join(tails)})"


def needs_wide(pattern: str, flags: int = 0) -> bool:
    """Whether a text in which a Python pattern matches holds a wide character for sure."""
    parser = importlib.import_module("re._parser")

    def wide(code: int) -> bool:
        return code >= WIDE_FROM and not (flags & re.I and chr(code).lower() != chr(code).upper())

    def holds(item) -> bool:
        op, arg = str(item[0]), item[1]
        if op == "LITERAL":
            return wide(arg)
        if op == "IN":
            return all(str(o) == "LITERAL" and wide(v) or str(o) == "RANGE" and wide(v[0]) and not flags & re.I for o, v in arg)
        if op == "BRANCH":
            return all(any(map(holds, b)) for b in arg[1])
        if op == "SUBPATTERN":
            return not (arg[1] | arg[2]) & re.I and any(map(holds, arg[3]))
        if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            return arg[0] > 0 and any(map(holds, arg[2]))
        if op == "ASSERT":
            return any(map(holds, arg[1]))
        return op == "ATOMIC_GROUP" and any(map(holds, arg))

    tree = parser.parse(pattern, flags)
    return not (tree.state.flags & ~flags) & re.I and any(map(holds, tree))


def of_any(patterns: list[str]) -> str | None:
    """One pattern (Java's) that matches where one of several of its dialect with equal flags does, or none if they refer to groups by number or name."""
    if any(re.search(r"\\[1-9]|\\k<|\(\?<[A-Za-z]|\(\?P", p) for p in patterns):
        return None
    return "|".join(f"(?:{p})" for p in patterns)


def wide_only(pieces: Column) -> Column:
    """Of segments() those with a wide character."""
    return F.filter(pieces, lambda s: s["text"].rlike(WIDE))


def through_wide(text: Column) -> Column:
    """The text up to the last wide character: positions and lines in it are those of the text."""
    return F.regexp_extract(text, rf"(?s)\A.*{WIDE}", 0)


def blank_lines_with(text: Column, markers: list[str]) -> Column:
    """Lines that contain one of the markers, whatever their case, as spaces."""
    if not markers:
        return text
    breaks = F.regexp_extract_all(text, F.lit(SPLIT_BREAK), F.lit(0))
    lines = F.split(text, SPLIT_BREAK, -1)
    p = any_of([m.lower() for m in markers])
    clean = F.transform(lines, lambda x: F.when(F.lower(x).rlike(p), F.repeat(F.lit(" "), F.length(x))).otherwise(x))
    # Breaks that don't number lines are blanked with their line.
    joined = F.zip_with(clean, F.concat(breaks, F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    return F.when(F.lower(text).rlike(p), F.array_join(joined, "")).otherwise(text)


def compact(text: Column) -> Column:
    """Without white space."""
    return F.regexp_replace(text, r"(?U)\s", "")


def segments(text: Column) -> Column:
    """array<struct<line int, text string>>: the pieces between line feeds, with the number of the line on which each begins."""
    pieces = F.split(text, "\n", -1)
    plain = F.transform(pieces, lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    breaks = lambda x: F.regexp_count(F.concat(x, F.lit("\n")), F.lit(NUMBERED_BREAK))
    odd = running(pieces, F.lit(1), lambda n, x: n + breaks(x), lambda n, x: F.struct(n.alias("line"), x.alias("text")), "struct<line:int,text:string>")
    return F.when(text.rlike("[\r\x85\u2028\u2029]"), odd).otherwise(plain)


def suffix(path: Column) -> Column:
    """The lower-case ending of the last part of a path, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"^.+(\.[^.]+)$", 1))
