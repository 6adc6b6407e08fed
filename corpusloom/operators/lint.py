"""The linter: documents to findings.

lint() makes one pass over documents(path, text). The views that rules search are computed once for each row, every
active rule adds an array of findings, and their concatenation is exploded; rules that a style, kind, profile or locale
rules out aren't in the plan. Line-local rules run on the pieces between line feeds, so that no position is needed.
Only findings are shuffled: to drop those that a longer dictionary word covers, and repeated ones.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions import views
from corpusloom.functions.comments import comments_of
from corpusloom.functions.units import units_of
from corpusloom.operators import kinds
from corpusloom.plans import pack as packs

FINDING = "struct<line:int,code:string,severity:string,message:string,sample:string,window:string,at:int>"
COLUMNS = ["path", "line", "code", "severity", "message", "sample"]
KINDS = ("all", "source", "prose", "pr-body", "commit-message")
LOCALES = ("auto", "zh-CN", "zh-TW", "zh-HK", "zh-SG", "zh-MY")
SCRIPT = {"zh-CN": "simplified", "zh-SG": "simplified", "zh-MY": "simplified", "zh-TW": "traditional", "zh-HK": "traditional"}


@dataclass(frozen=True)
class Options:
    kind: str = "all"
    profile: str = "general"
    style: str = "standard"
    locale: str = "auto"
    regional: bool = False
    title: str | None = None
    paragraph_limit: int | None = None
    comment_audit: bool = False
    guarded: tuple = ()
    pack: packs.Pack = field(default_factory=packs.default)
    #: Unit rules look only at text with ideographs; False lets them measure any text.
    script_gate: bool = True

    def __post_init__(self):
        for name, allowed in (("kind", KINDS), ("style", tuple(self.pack.wording["style_profiles"])), ("locale", LOCALES)):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} is none of {', '.join(allowed)}")
        if self.regional and self.locale not in ("zh-CN", "zh-TW"):
            raise ValueError("regional vocabulary needs the locale zh-CN or zh-TW")
        if self.paragraph_limit is not None and self.paragraph_limit < 1:
            raise ValueError("the paragraph limit must be positive")

    @property
    def overlay(self) -> bool:
        return self.profile.endswith("overlay")

    @property
    def effective_style(self) -> str:
        return "strict" if self.overlay else self.style


def finding(line, code: str | Column, message: str | Column, sample: Column | str = "", severity: str = "error", window: Column | None = None, at: Column | None = None) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, (str, int)) else x
    none = F.lit(None)
    return F.struct(
        lit(line).cast("int").alias("line"), lit(code).alias("code"), F.lit(severity).alias("severity"), lit(message).alias("message"), lit(sample).alias("sample"),
        (none if window is None else window).cast("string").alias("window"), (none if at is None else at).cast("int").alias("at"),
    )


def nothing() -> Column:
    return F.array().cast(f"array<{FINDING}>")


def one_if(condition: Column, f: Column) -> Column:
    return F.when(condition, F.array(f)).otherwise(nothing())


def head(x: Column, n: int) -> Column:
    return F.substring(x, 1, n)


# ---- rules by line or by document ---------------------------------------------------------------

_ODD = r"\r.|[\x85  ]"


def hits(s: Column, pattern: Column | str) -> Column:
    """array<struct<pos, line, sample>> of a line-local pattern in a piece, which may hold line breaks of other kinds."""
    return F.transform(X.lined(s["text"], pattern), lambda m: m.withField("line", m["line"] + s["line"] - 1))


def local_findings(pieces: Column, pattern: str, told, needs_wide: bool) -> Column:
    """told(m) of every match m of a line-local pattern (Java's), in the pieces that can hold one."""
    can = (lambda x: x.rlike(X.WIDE) & x.rlike(pattern)) if needs_wide else (lambda x: x.rlike(pattern))
    return F.flatten(F.transform(F.filter(pieces, lambda s: can(s["text"])), lambda s: F.transform(hits(s, pattern), told)))


def regex_findings(text: Column, pieces: Column, pattern: str, code: str, message: str, severity: str = "error", flags: int = 0, most: int | None = None) -> Column:
    """Every match of a Python pattern. A pattern whose matches need a wide character is sought only in pieces that have one."""
    cut = (lambda m: head(m, most)) if most else (lambda m: m)
    p, wide = X.java(pattern, flags), X.needs_wide(pattern, flags)
    told = lambda m: finding(m["line"], code, message, cut(m["sample"]), severity)
    if packs.line_local(pattern):
        found = local_findings(pieces, p, told, wide)
        return F.coalesce(found, nothing()) if wide else F.when(text.rlike(p), found).otherwise(nothing())
    return F.when(text.rlike(p), F.transform(X.lined(text, p), told)).otherwise(nothing())


def constant(rows: list[dict], schema: str) -> Column:
    """Rows as one constant array of structs: rules as data keep the plan small."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")


def rules_findings(text: Column, rules: list[dict], prefix: str, severity: str = "error", pieces: Column | None = None) -> Column:
    """Every match of every rule of a list. With pieces, rules that look at a line only are sought in those of them in which one of the rules matches."""
    local = [r for r in rules if pieces is not None and packs.line_local(r["pattern"])]
    wide = [r for r in local if X.needs_wide(r["pattern"])]

    def sought(some: list[dict], where: Column | None) -> Column:
        patterns = [X.java(r["pattern"]) for r in some]
        table = constant([{"p": p, "c": prefix + r["id"], "m": r["message"]} for p, r in zip(patterns, some)], "p:string,c:string,m:string")
        any_ = X.of_any(patterns)
        can = lambda x: F.lit(True) if any_ is None else x.rlike(any_)
        told = lambda r: lambda m: finding(m["line"], r["c"], r["m"], m["sample"], severity)
        of = lambda t, places: F.flatten(F.transform(F.filter(table, lambda r: F.regexp_like(t, r["p"])), lambda r: F.transform(places(r["p"]), told(r))))
        if where is None:
            return X.let(text, lambda t: F.when(can(t), of(t, lambda p: X.lined(t, p))).otherwise(nothing()))
        return F.flatten(F.transform(F.filter(where, lambda s: can(s["text"])), lambda s: of(s["text"], lambda p: hits(s, p))))

    parts = [nothing()]
    if wide:
        parts.append(sought(wide, X.wide_only(pieces)))
    if some := [r for r in local if r not in wide]:
        parts.append(sought(some, pieces))
    if some := [r for r in rules if r not in local]:
        parts.append(sought(some, None))
    return F.coalesce(F.concat(*parts), nothing())


def longest_per_line(text: Column, patterns: list[str], code: str, message: str) -> Column:
    """One finding a line: the longest sample, of equally long ones that of the first pattern and place."""
    found = nothing()
    for p in patterns:
        j = X.java(p, re.M | re.I)
        mine = F.transform(X.lined(text, j), lambda m: finding(m["line"], code, message, head(m["sample"], 48)))
        found = F.concat(found, F.when(text.rlike(j), mine).otherwise(nothing()))

    def best(same: Column) -> Column:
        return F.aggregate(F.slice(same, 2, F.greatest(F.size(same) - 1, F.lit(0))), F.element_at(same, 1), lambda a, x: F.when(F.length(x["sample"]) > F.length(a["sample"]), x).otherwise(a))

    def each_line(all_: Column) -> Column:
        lines = F.array_distinct(F.transform(all_, lambda x: x["line"]))
        return F.transform(lines, lambda n: X.let(F.filter(all_, lambda x: x["line"] == n), best))

    return X.let(found, each_line)


def literal_findings(pieces: Column, rows: list[tuple[str, str, str]], severity: str = "error", suppress: bool = False) -> Column:
    """Literal terms: rows of (term, code, message). With suppress, each hit carries its whole line for drop_covered(), so that words of any length are found."""
    if not rows:
        return nothing()
    terms = constant([{"t": t, "c": c, "m": m} for t, c, m in rows], "t:string,c:string,m:string")
    words = list(dict.fromkeys(t for t, _, _ in rows))
    p = X.any_of(words)
    can = (lambda x: x.rlike(X.WIDE) & x.rlike(p)) if all(any(ord(c) >= X.WIDE_FROM for c in w) for w in words) else (lambda x: x.rlike(p))

    def of(s: Column, t: Column) -> Column:
        places = hits(s, F.concat(F.lit("\\Q"), t["t"], F.lit("\\E")))
        return F.transform(places, lambda m: finding(m["line"], t["c"], t["m"], t["t"], severity, s["text"] if suppress else None, m["pos"] if suppress else None))

    there = F.filter(pieces, lambda s: can(s["text"]))
    return F.flatten(F.transform(there, lambda s: F.flatten(F.transform(F.filter(terms, lambda t: F.contains(s["text"], t["t"])), lambda t: of(s, t)))))


def emoji_findings(text: Column, o: Options, style: str) -> Column:
    if o.pack.profile(style)["emoji"] == "allow":
        return nothing()
    clean = X.replaced_by_spaces(text, o.pack.wording.get("emoji_exceptions", {}).get(style, []))
    return longest_per_line(clean, o.pack.patterns("emoji_patterns"), "style.emoji", "say it in words, without Emoji")


def phrase_findings(text: Column, pieces: Column, o: Options, style: str, suppress: bool = True) -> Column:
    rows = [(t, f"wording.{g['id']}", g["message"]) for g in o.pack.active("literal_groups", style) for t in g["terms"]]
    return F.concat(literal_findings(pieces, rows, suppress=suppress), rules_findings(text, o.pack.active("regex_rules", style), "wording.", pieces=pieces))


def grammar_findings(text: Column, pieces: Column, o: Options, style: str) -> Column:
    return rules_findings(text, o.pack.active("grammar_rules", style), "grammar.", "warning", pieces)


_TYPOGRAPHY = [
    ("fullwidth-alphanumeric", "[０-９Ａ-Ｚａ-ｚ]+", "write letters and digits in ASCII", False),
    ("fullwidth-decimal", "(?<=[0-9０-９])．(?=[0-9０-９])", "a decimal point is an ASCII full stop", False),
    ("repeated-punctuation", r"([，。；：！？、])\1+", "one mark is enough", False),
    ("ascii-ellipsis", r"(?<!\.)\.{3,}(?!\.)", "an ellipsis is written …… in Chinese text", True),
    ("ascii-dash", r"(?<![-\w])--(?![-\w])", "a dash is written —— in Chinese text", True),
    ("cjk-latin-spacing", f"(?:{X.CJK}[A-Za-z0-9]|[A-Za-z0-9]{X.CJK})", "put a space between Chinese and Latin letters or digits", False),
]


#: What every kind needs: a line without any of these has no finding.
_TYPED = f"[\\x{{3001}}-\\x{{323af}}&&[０-９Ａ-Ｚａ-ｚ．，。；：！？、{X.CJK_CLASS}]]"


def typography_findings(pieces: Column, style: str) -> Column:
    """Of each kind the first in a line, with what stands around it."""
    say = {"ascii-ellipsis": "an ellipsis is written … in a label"} if style == "ui" else {}
    rules = constant([{"p": "(?Ud)" + p, "c": f"typography.{name}", "m": say.get(name, message), "z": chinese} for name, p, message, chinese in _TYPOGRAPHY], "p:string,c:string,m:string,z:boolean")

    def of(s: Column, r: Column) -> Column:
        first = X.let(hits(s, r["p"]), lambda all_: F.filter(all_, lambda m, i: (i == 0) | (m["line"] != F.get(all_, i - 1)["line"])))

        def one(m: Column) -> Column:
            begin = F.greatest(m["pos"] - 12, F.lit(0))
            end = m["pos"] + F.length(m["sample"]) + 12
            around = F.substring(s["text"], begin + 1, end - begin)
            return finding(m["line"], r["c"], r["m"], head(F.regexp_replace(around, r"(?U)^\s+|\s+$", ""), 48))

        return F.transform(first, one)

    some = F.filter(pieces, lambda s: s["text"].rlike(_TYPED))
    per_rule = lambda s: F.flatten(F.transform(F.filter(rules, lambda r: F.regexp_like(s["text"], r["p"]) & (~r["z"] | s["text"].rlike(X.CJK))), lambda r: of(s, r)))
    return F.flatten(F.transform(some, per_rule))


def locale_findings(compared: Column, o: Options) -> Column:
    """compared: a view without lines of comparison."""
    traditional, simplified = o.pack.markers()
    names = [*o.pack.wording["locale_name_exceptions"], *o.pack.wording["locale_word_exceptions"]]
    cls = X.one_of
    found = lambda t, chars: F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(cls(chars)), F.lit(0))))
    seen = X.through_wide(compared) if all(ord(w[-1]) >= X.WIDE_FROM for w in [*traditional, *simplified, *filter(None, names)]) else compared
    if o.locale == "auto":
        if not (traditional and simplified):
            return nothing()

        def mixed(t: Column) -> Column:
            place = lambda chars: F.length(F.regexp_extract(t, rf"(?s)\A.*?(?={cls(chars)})", 0))
            sample = F.concat(F.array_join(F.slice(found(t, traditional), 1, 4), ""), F.array_join(F.slice(found(t, simplified), 1, 4), ""))
            return one_if(t.rlike(cls(traditional)) & t.rlike(cls(simplified)), finding(X.line_at(t, F.greatest(place(traditional), place(simplified))), "locale.mixed-script", "use one script, traditional or simplified", sample))

        # Only texts that have both are looked at without the names.
        return F.when(compared.rlike(cls(traditional)) & compared.rlike(cls(simplified)), X.let(X.replaced_by_spaces(seen, names), mixed)).otherwise(nothing())
    opposite = simplified if SCRIPT[o.locale] == "traditional" else traditional
    if not opposite:
        return nothing()

    def wrong(t: Column) -> Column:
        lines = F.transform(F.split(t, X.SPLIT_BREAK, -1), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
        bad = F.filter(lines, lambda s: s["text"].rlike(cls(opposite)))
        return F.transform(bad, lambda s: finding(s["line"], "locale.wrong-script", f"this isn't the script of {o.locale}", F.array_join(F.slice(found(s["text"], opposite), 1, 8), "")))

    return F.when(compared.rlike(cls(opposite)), X.let(X.replaced_by_spaces(seen, names), wrong)).otherwise(nothing())


def terminology_findings(compared: Column, o: Options) -> Column:
    if o.locale not in ("zh-TW", "zh-CN"):
        return nothing()
    rows = [(bad, "terminology.locale", f"{en} is {good} in {o.locale}") for en, good, bad in o.pack.rejected(o.locale)]
    return literal_findings(X.segments(compared), rows)


def guarded_findings(names: Column, pieces: Column, o: Options) -> Column:
    """A rendering of a guarded name in a document that has the name itself."""
    guarded = o.pack.guarded(list(o.guarded))
    if not guarded:
        return nothing()
    rows = [(bad, "terminology.preserved", f"is {g['en']} to be translated here? {g['note']}") for g in guarded for bad in g["reject"]]
    table = constant([{"p": r"(?iud)(?<![A-Za-z0-9_])" + X.literal(g["en"]) + r"(?:s|es)?(?![A-Za-z0-9_])", "m": f"is {g['en']} to be translated here? {g['note']}", "r": g["reject"]} for g in guarded], "p:string,m:string,r:array<string>")
    every = literal_findings(pieces, rows, "warning")
    there = F.filter(table, lambda g: F.regexp_like(names, g["p"]))
    own = lambda fs: X.let(there, lambda gs: F.filter(fs, lambda f: F.exists(gs, lambda g: (g["m"] == f["message"]) & F.array_contains(g["r"], f["sample"]))))
    return X.let(every, lambda fs: F.when(F.size(fs) > 0, own(fs)).otherwise(nothing()))


def consistency_findings(text: Column, compared: Column, o: Options) -> Column:
    """Two forms of one thing in a document, outside of lines of comparison and of longer forms."""
    every = o.pack.forms()
    groups: list[tuple[str, str, list[str]]] = []
    if o.locale == "auto":
        for t in o.pack.enforced():
            forms = {t["zh-CN"], t["zh-TW"], *(f for fs in t.get("reject", {}).values() for f in fs)} - {""}
            if len(forms) > 1:
                groups.append(("terminology", f"keep to one form for {t['en']}", sorted(forms)))
    groups += [(g["id"], "keep to one written form in a document", sorted(set(g["forms"]))) for g in o.pack.wording["consistency_groups"]]
    if not groups:
        return nothing()

    def longer(form: str) -> list[dict]:
        return [{"w": w, "i": m.start()} for w in every if len(w) > len(form) for m in re.finditer(f"(?={re.escape(form)})", w)]

    table = constant(
        [{"c": f"consistency.{id_}", "m": message, "f": [{"form": f, "p": X.literal(f), "l": longer(f)} for f in forms]} for id_, message, forms in groups],
        "c:string,m:string,f:array<struct<form:string,p:string,l:array<struct<w:string,i:int>>>>",
    )

    def of(t: Column, seen: Column) -> Column:
        covered = lambda f, pos: F.exists(f["l"], lambda w: (pos >= w["i"]) & (F.substring(t, pos - w["i"] + 1, F.length(w["w"])) == w["w"]))
        free = lambda f: F.filter(X.spans(seen, f["p"]), lambda m: ~covered(f, m["pos"]))
        first = lambda f: F.struct(F.coalesce(F.get(free(f), F.lit(0))["pos"], F.lit(-1)).alias("pos"), f["form"].alias("form"))
        used = lambda g: F.array_sort(F.filter(F.transform(F.filter(g["f"], lambda f: F.contains(seen, f["form"])), first), lambda x: x["pos"] >= 0))
        several = F.filter(table, lambda g: F.size(F.filter(g["f"], lambda f: F.contains(seen, f["form"]))) >= 2)

        def told(g: Column) -> Column:
            def tell(u: Column) -> Column:
                sample = F.array_join(F.transform(F.slice(u, 1, 3), lambda x: x["form"]), " / ")
                return one_if(F.size(u) >= 2, finding(X.line_at(t, F.get(u, F.lit(1))["pos"]), g["c"], g["m"], sample, "warning"))

            return X.let(used(g), tell)

        return F.flatten(F.transform(several, told))

    listed = [f for _, _, forms in groups for f in forms]
    seen = X.through_wide(compared) if all(ord(f[-1]) >= X.WIDE_FROM for f in listed) else compared
    found = X.let(F.struct(text.alias("t"), seen.alias("s")), lambda x: of(x["t"], x["s"]))
    return F.when(compared.rlike(X.any_of(listed)), found).otherwise(nothing())


_HEADING = r"(?Udm)^ {0,3}(#{1,6})\s+(.+?)\s*#*\s*$"


def heading_findings(text: Column, style: str) -> Column:
    found = F.transform(X.lined(text, _HEADING), lambda m: F.struct(m["line"].alias("line"), m["sample"].alias("all"), F.length(F.regexp_extract(m["sample"], _HEADING, 1)).alias("level"), F.trim(F.regexp_extract(m["sample"], _HEADING, 2)).alias("title")))
    jumps = X.let(found, lambda all_: F.filter(all_, lambda h, i: (i > 0) & (h["level"] > F.get(all_, i - 1)["level"] + 1)))
    bare = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    out = F.transform(jumps, lambda h: finding(h["line"], "markdown.heading-level", "a heading level is left out", bare(h["all"])))
    if style == "readme":
        stops = F.filter(found, lambda h: h["title"].rlike("[。.．]$"))
        out = F.concat(out, F.transform(stops, lambda h: finding(h["line"], "markdown.heading-punctuation", "a heading has no full stop", head(h["title"], 48))))
    return F.when(text.rlike(_HEADING), out).otherwise(nothing())


def link_findings(text: Column, o: Options) -> Column:
    p = r"(?Ud)(?<!!)\[([^\]\n]+)\](?:\([^)\n]+\)|\[[^\]\n]*\])"
    label = lambda m: F.regexp_replace(F.regexp_replace(F.regexp_extract(m["sample"], p.replace("(?<!!)", ""), 1), "[`*_]", ""), r"(?U)^\s+|\s+$", "")
    bad = F.filter(X.lined(text, p), lambda m: label(m).isin(o.pack.wording["generic_link_labels"]))
    return F.when(text.rlike(p), F.transform(bad, lambda m: finding(m["line"], "markdown.generic-link", "let the link tell where it leads", label(m)))).otherwise(nothing())


def list_findings(text: Column) -> Column:
    """In each run of items of one indent and kind, the first Chinese item that ends unlike the first one."""
    item = r"(?Ud)^(\s*)(?:[-*+]|\d+[.)])\s+(.+)$"
    lines = F.transform(F.split(text, X.SPLIT_BREAK, -1), lambda x, i: F.struct((i + 1).alias("line"), x.alias("x")))
    kind = "struct<line:int,value:string,stop:boolean>"
    start = F.struct(F.lit(0).alias("group"), F.lit(None).cast("string").alias("key"), F.lit(False).alias("some"), F.array().cast(f"array<struct<group:int,item:{kind}>>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        is_item = s["x"].rlike(item)
        value = F.regexp_replace(F.regexp_extract(s["x"], item, 2), r"(?U)^\s+|\s+$", "")
        key = F.concat(F.length(F.regexp_extract(s["x"], item, 1)).cast("string"), F.when(s["x"].rlike(r"(?U)^\s*\d"), "n").otherwise("m"))
        goes_on = ~is_item & a["some"] & s["x"].rlike(r"(?U)^\s{2,}\S")
        new_group = is_item & a["some"] & ~key.eqNullSafe(a["key"])
        group = a["group"] + F.when(new_group | (~is_item & ~goes_on), 1).otherwise(0)
        chinese = is_item & value.rlike(X.CJK)
        row = F.struct(group.alias("group"), F.struct(s["line"].alias("line"), value.alias("value"), value.rlike("[。；！？]$").alias("stop")).alias("item"))
        return F.struct(
            group.alias("group"),
            F.when(is_item, key).when(goes_on, a["key"]).alias("key"),
            F.when(is_item, chinese | (a["some"] & ~new_group)).otherwise(goes_on).alias("some"),
            F.when(chinese, F.concat(a["out"], F.array(row))).otherwise(a["out"]).alias("out"),
        )

    rows = F.aggregate(lines, start, step, lambda a: a["out"])
    def differing(all_: Column) -> Column:
        first = lambda r: F.element_at(F.filter(all_, lambda x: x["group"] == r["group"]), 1)["item"]
        return F.filter(all_, lambda r: r["item"]["stop"] != first(r)["stop"])

    odd = X.let(rows, differing)
    odd = X.let(odd, lambda all_: F.filter(all_, lambda r, i: (i == 0) | (r["group"] != F.get(all_, i - 1)["group"])))
    return F.when(text.rlike(r"(?Udm)^\s*(?:[-*+]|\d+[.)])\s+\S") & text.rlike(X.CJK), F.transform(odd, lambda r: finding(r["item"]["line"], "markdown.list-punctuation", "let the items of a list end alike", head(r["item"]["value"], 48)))).otherwise(nothing())


# ---- units ---------------------------------------------------------------------------------------

_SENTENCE = r"(?Ud)[^。！？!?\n]+[。！？!?]?"
CONNECTORS = "並且 並 同时 同時 以便 因此 因而 所以 但是 然而 如果 若是 除非 即使 雖然 虽然 儘管 尽管 而且 以及 另一方面".split()


def in_line(line: Column) -> Column:
    """array<string>: what _SENTENCE matches in a text without line feeds. The text is cut after each mark, as Java takes a microsecond for each character of a class that excludes wide ones."""
    return F.filter(F.split(line, "(?<=[。！？!?])", -1), lambda x: (x != "") & ~x.isin("。", "！", "？", "!", "?"))


def unit_findings(units: Column, o: Options, style: str) -> Column:
    """Lengths of paragraphs and sentences against the limits of the style."""
    limits = o.pack.profile(style)
    paragraph = o.paragraph_limit if o.paragraph_limit is not None else limits["paragraph_characters"]
    sentences, characters, clauses = limits["paragraph_sentences"], limits["sentence_characters"], limits["clause_markers"]
    if not (paragraph or sentences or characters or clauses):
        return nothing()
    gate = (lambda x: x.rlike(X.CJK)) if o.script_gate else (lambda x: x.rlike(r"(?U)\S"))
    connectors = "|".join(sorted(CONNECTORS, key=len, reverse=True))

    def of(u: Column) -> Column:
        solid = X.compact(u["text"])
        parts = [nothing()]
        if paragraph:
            parts.append(one_if((F.length(u["text"]) > paragraph) & (F.length(solid) > paragraph), finding(u["line"], "length.paragraph", f"the paragraph has more than {paragraph} characters", head(solid, 24))))
        if sentences:
            parts.append(one_if(F.regexp_count(u["text"], F.lit("[。！？!?]")) > sentences, finding(u["line"], "length.paragraph-sentences", f"the paragraph has more than {sentences} sentences", head(solid, 24))))
        if characters or clauses:

            def sentence(raw: Column, line: Column) -> Column:
                short = X.compact(raw)
                each = [nothing()]
                if characters:
                    each.append(one_if((F.length(raw) > characters) & gate(raw) & (F.length(short) > characters), finding(line, "length.sentence", f"the sentence has more than {characters} characters", head(short, 24))))
                if clauses:
                    marks = F.regexp_count(raw, F.lit("[，；：,;:]"))
                    n = marks + F.when(raw.rlike(X.WIDE), F.regexp_count(raw, F.lit(connectors))).otherwise(0)
                    each.append(one_if((n >= clauses) & gate(raw), finding(line, "structure.complex-sentence", "make several sentences of it", head(short, 24))))
                return F.concat(*each)

            # No sentence goes over a line feed.
            inner = lambda x, i: F.transform(in_line(x), lambda raw: sentence(raw, u["line"] + i))
            parts.append(F.flatten(F.flatten(F.transform(F.split(u["text"], "\n", -1), inner))))
        return F.concat(*parts)

    return F.flatten(F.transform(F.filter(units, lambda u: gate(u["text"])), of))


def repeated_findings(text: Column, o: Options) -> Column:
    """Sentences that a document has had before."""
    least = o.pack.wording["repeated_sentence_characters"]
    can = (lambda x: x.rlike(X.CJK)) if o.script_gate else (lambda x: x.rlike("[。！？!?]"))

    def of(s: Column) -> Column:
        # No sentence goes over a line feed; one that ends in a mark has no other mark, so that white space around it goes with that in it.
        bare = lambda x: F.regexp_replace(x, r"(?U)[\s`*_>#-]", "")
        plain = lambda: F.transform(in_line(s["text"]), lambda x: F.struct(x.alias("n"), s["line"].alias("line")))
        exact = lambda: F.transform(X.lined(s["text"], _SENTENCE), lambda m: F.struct(m["sample"].alias("n"), (s["line"] + m["line"] - 1).alias("line")))
        ended = F.filter(F.when(s["text"].rlike(_ODD), exact()).otherwise(plain()), lambda m: m["n"].rlike(r"[。！？!?]\z"))
        return F.transform(ended, lambda m: F.struct(bare(m["n"]).alias("n"), m["line"].alias("line")))

    every = F.flatten(F.transform(F.filter(X.segments(text), lambda s: can(s["text"])), of))
    norm = F.filter(every, lambda m: (F.length(m["n"]) >= least) & (m["n"].rlike(X.CJK) if o.script_gate else F.lit(True)))

    def again(all_: Column) -> Column:
        # Sorted by their text and place, the later ones stand right behind an equal one.
        placed = F.sort_array(F.transform(all_, lambda m, i: F.struct(m["n"].alias("n"), i.alias("i"), m["line"].alias("line"))))
        later = lambda xs: F.filter(xs, lambda m, i: (i > 0) & (m["n"] == F.get(xs, i - 1)["n"]))
        several = F.size(F.array_distinct(F.transform(all_, lambda m: m["n"]))) < F.size(all_)
        return F.when(several, X.let(placed, later))

    out = F.transform(X.let(norm, again), lambda m: finding(m["line"], "structure.repeated-sentence", "the sentence was there before", head(m["n"], 24)))
    return F.coalesce(F.when(text.rlike(X.CJK if o.script_gate else "."), out), nothing())


# ---- commits and change requests ------------------------------------------------------------------


def subject_findings(subject: Column, o: Options, what: str = "subject", line: int = 1) -> Column:
    limit = 69 if o.overlay else 72
    parts = [
        one_if(F.length(subject) > limit, finding(line, "vcs.subject-length", f"the {what} has more than {limit} characters", head(subject, 32))),
        one_if(subject.rlike(r"(?U)[。；，！？、.;,!?：:]\s*$"), finding(line, "vcs.subject-punctuation", f"the {what} ends in a punctuation mark", F.when(F.length(subject) > 16, F.substring(subject, F.length(subject) - 15, F.lit(16))).otherwise(subject))),
    ]
    if o.overlay:
        parts += [
            one_if(subject.rlike(X.CJK), finding(line, "overlay.english-subject", f"the {what} is to be English", head(subject, 32))),
            one_if(~subject.rlike(r"(?U)^\S+: \S"), finding(line, "overlay.subject-format", f"write the {what} as scope: summary", head(subject, 32))),
        ]
    return F.concat(*parts)


def commit_findings(text: Column, o: Options) -> Column:
    lines = F.split(text, X.SPLIT_BREAK, -1)
    first, second = F.coalesce(F.get(lines, F.lit(0)), F.lit("")), F.coalesce(F.get(lines, F.lit(1)), F.lit(""))
    blank = lambda x: ~x.rlike(r"(?U)\S")
    body = F.concat(subject_findings(F.regexp_replace(first, r"(?U)\s+$", ""), o, "commit subject"), one_if(~blank(second), finding(2, "vcs.subject-body-spacing", "the second line is to be blank", head(second, 32))))
    return F.when(blank(first), F.array(finding(1, "vcs.empty-subject", "there is no subject line"))).otherwise(body)


def authored(text: Column, o: Options) -> Column:
    """What stands before the first marker of a template."""
    for m in o.pack.patterns("pr_template_markers"):
        text = F.substring_index(text, m, 1)
    return text


def request_findings(text: Column, o: Options, style: str) -> Column:
    table = o.pack.wording["pr_body_limits"]
    policy = o.profile if o.profile in table else "overlay" if o.overlay and "overlay" in table else next((k for k in table if o.overlay and k.endswith("overlay")), style)
    limits = table.get(policy, table["standard"])
    solid = X.compact(text)
    parts = [nothing()]
    if limits["characters"]:
        parts.append(one_if(F.length(solid) > limits["characters"], finding(1, "vcs.pr-length", f"the description has more than {limits['characters']} characters", head(solid, 32))))
    if limits["blocks"]:
        p = r"(?Ud)(?:^|\n\s*\n)([^\n][\s\S]*?)(?=\n\s*\n|$)"
        lead = r"(?Ud)\A\n\s*\n(?=[^\n])"
        blocks = F.transform(X.spans(text, p), lambda m: F.struct((m["pos"] + F.length(F.regexp_extract(m["sample"], lead, 0))).alias("pos"), F.regexp_replace(m["sample"], r"(?U)^\s+|\s+$", "").alias("s")))
        blocks = F.filter(blocks, lambda b: (F.length(b["s"]) > 0) & ~b["s"].rlike(r"(?iU)^Closes\s+#\d+\.?$"))
        extra = F.get(blocks, F.lit(limits["blocks"]))
        parts.append(one_if(F.size(blocks) > limits["blocks"], finding(X.line_at(text, extra["pos"]), "vcs.pr-blocks", f"the description has more than {limits['blocks']} blocks", head(extra["s"], 32))))
    if limits["list_items"]:
        items = X.spans(text, r"(?Udm)^\s*(?:[-*+]|\d+[.)])\s+\S")
        extra = F.get(items, F.lit(limits["list_items"]))
        parts.append(one_if(F.size(items) > limits["list_items"], finding(X.line_at(text, extra["pos"]), "vcs.pr-list-items", f"the description has more than {limits['list_items']} list items", F.regexp_replace(extra["sample"], r"(?U)^\s+|\s+$", ""))))
    if not limits["headings"]:
        heading = F.get(X.spans(text, r"(?Udm)^\s*#{1,6}\s+\S"), F.lit(0))
        parts.append(one_if(heading.isNotNull(), finding(X.line_at(text, heading["pos"]), "vcs.pr-heading", "a description needs no headings", head(F.regexp_replace(heading["sample"], r"(?U)^\s+|\s+$", ""), 48))))
    parts.append(longest_per_line(text, o.pack.patterns("pr_inventory_patterns"), "vcs.pr-inventory", "give the reason, not a list of changes"))
    if o.title and o.title.strip():
        title = o.title.strip()
        place = F.locate(title.lower(), F.lower(text))
        parts.append(one_if(F.lower(text).contains(title.lower()), finding(X.line_at(text, place - 1), "vcs.repeated-title", "the description repeats the title", title[:48])))
    return F.concat(*parts)


def narration_findings(text: Column, o: Options) -> Column:
    return F.concat(
        longest_per_line(text, o.pack.patterns("routine_passing_patterns"), "vcs.routine-tests", "that tests pass goes without saying"),
        longest_per_line(text, o.pack.patterns("workflow_narration_patterns"), "vcs.work-diary", "give the reason in place of a work diary"),
        longest_per_line(text, o.pack.patterns("author_narration_patterns"), "vcs.author-narration", "state the fact without its author"),
    )


# ---- user interfaces ------------------------------------------------------------------------------

_SURFACE_KEY = r"(?:alt|aria[-_.]?label|button|command|field[-_.]?label|label|menu|placeholder|tab|title|tooltip)"
_SURFACES = {
    "attribute": r"""(?iUd)(?:alt|title|placeholder|aria-label)\s*=\s*(?:'[^'\n]*'|"[^"\n]*")""",
    "button": r"(?iUds)<button\b[^>]*+>.*?</button\s*+>",
    "json": r'(?iUd)"[^"\\\n]*' + _SURFACE_KEY + r'"\s*:\s*"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"',
    "yaml": r"(?iUdm)^\s*[A-Za-z0-9_.-]*" + _SURFACE_KEY + r":\s*[^#\n]+?\s*$",
}
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&hellip;": "…", "&mdash;": "—", "&amp;": "&"}


def surfaces(path: Column, text: Column) -> Column:
    """array<struct<line, value, what>>: texts that a user sees, of HTML attributes and buttons, and of JSON and YAML values under keys that end in a word for one."""
    s = views.suffix(path)
    trim = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")

    def plain(x: Column) -> Column:
        for a, b in _ENTITIES.items():
            x = F.replace(x, F.lit(a), F.lit(b))
        return trim(x)

    def at(value_begins: Column, value: Column, what: Column) -> Column:
        return F.struct(X.line_at(text, value_begins).alias("line"), plain(value).alias("value"), what.alias("what"))

    def attribute(m: Column) -> Column:
        lead = F.regexp_extract(m["sample"], r"(?U)^[^=]*=\s*.", 0)
        return at(m["pos"] + F.length(lead), F.substring(m["sample"], F.length(lead) + 1, F.length(m["sample"]) - F.length(lead) - 1), F.lower(F.regexp_extract(m["sample"], "^[A-Za-z-]+", 0)))

    def button(m: Column) -> Column:
        inner = F.regexp_extract(m["sample"], r"(?s)^<[^>]*>(.*)</[^>]*>$", 1)
        lead = F.length(F.regexp_extract(m["sample"], r"^<[^>]*>", 0))
        masked = F.array_join(F.zip_with(F.split(inner, "<[^>]+>", -1), F.concat(F.transform(F.regexp_extract_all(inner, F.lit("<[^>]+>"), F.lit(0)), lambda t: F.repeat(F.lit(" "), F.length(t))), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
        first = F.when(masked.rlike(X.CJK), F.length(F.element_at(F.split(masked, X.CJK, 2), 1))).otherwise(0)
        return at(m["pos"] + lead + first, F.regexp_replace(inner, "<[^>]+>", ""), F.lit("button"))

    def json_value(m: Column) -> Column:
        lead = F.regexp_extract(m["sample"], r'(?Ud)^"[^"]*"\s*:\s*"', 0)
        raw = F.substring(m["sample"], F.length(lead) + 1, F.length(m["sample"]) - F.length(lead) - 1)
        decoded = F.from_json(F.concat(F.lit('{"v":"'), raw, F.lit('"}')), "v string")["v"]
        return at(m["pos"] + F.length(lead), F.coalesce(decoded, raw), F.lit("label"))

    def yaml_value(m: Column) -> Column:
        lead = F.regexp_extract(m["sample"], r"(?Ud)^\s*[A-Za-z0-9_.-]+:\s*", 0)
        return at(m["pos"] + F.length(lead), F.regexp_replace(trim(F.substring(m["sample"], F.length(lead) + 1, F.length(m["sample"]))), "^['\"]+|['\"]+$", ""), F.lit("label"))

    none = F.array().cast("array<struct<line:int,value:string,what:string>>")
    made = lambda kind, f: F.transform(X.spans(text, _SURFACES[kind]), f)
    return F.when(s.isin(kinds.SURFACES), F.concat(made("attribute", attribute), made("button", button))).when(s == ".json", made("json", json_value)).when(s.isin(".yaml", ".yml"), made("yaml", yaml_value)).otherwise(none)


def surface_findings(path: Column, text: Column, checked: Column, o: Options) -> Column:
    def of(u: Column) -> Column:
        v = u["value"]
        pieces = X.segments(v)
        compared = X.blank_lines_with(v, o.pack.wording["comparison_markers"])
        inner = F.concat(emoji_findings(v, o, "ui"), phrase_findings(v, pieces, o, "ui"), typography_findings(X.segments(X.without_markup(v)), "ui"), grammar_findings(v, pieces, o, "ui"), locale_findings(compared, o), terminology_findings(compared, o))
        moved = F.transform(inner, lambda f: f.withField("line", f["line"] + u["line"] - 1))
        stop = one_if(v.rlike(X.CJK) & v.rlike(r"[。；，！？.!?;,:：]$"), finding(u["line"], "ui.control-punctuation", "a label ends without punctuation: " + "the text of a control", head(v, 48)))
        return F.concat(moved, stop)

    p = f"{X.CJK}[！!]"
    loud = F.when(checked.rlike(p), F.transform(X.spans(checked, p), lambda m: finding(X.line_at(checked, m["pos"]), "ui.exclamation", "a label doesn't shout", m["sample"]))).otherwise(nothing())
    return F.concat(F.flatten(F.transform(surfaces(path, text), of)), loud)


# ---- comments -------------------------------------------------------------------------------------


def comment_language(comments: Column) -> Column:
    bad = F.filter(comments, lambda c: c["text"].rlike(X.CJK))
    line = lambda c: c["line"] + F.regexp_count(F.element_at(F.split(c["text"], X.CJK, 2), 1), F.lit("\n"))
    return F.transform(bad, lambda c: finding(line(c), "comments.language", "comments are to be in English", head(F.regexp_replace(c["text"], r"(?U)^\s+|\s+$", ""), 32)))


#: (what a comment says, what the next line of code does) of comments that only tell the code again.
OBVIOUS = [
    (r"^(?:先)?(?:準備|准备|宣告|声明|設|设|建立|創建|创建).{0,6}空的?(?:串列|列表|字典|集合|陣列|数组|清單|清单)", r"^[A-Za-z_]\w*(?:\.\w+)*\s*(?::[^=]+)?=\s*(?:\[\s*\]|\{\s*\}|(?:list|dict|set|tuple)\(\s*\))"),
    (r"^(?:逐一|逐個|逐个|依序|遍歷|遍历|迭代)", r"^(?:async\s+for|for|while)\b"),
    (r"^(?:如果|若|假如|當|当).{0,20}(?:就|則|则)", r"^(?:if|elif|unless|when)\b"),
    (r"^(?:最後|最后)?(?:返回|回傳|回传|傳回|传回)(?:結果|结果|值|它|資料|数据)?[。.]?$", r"^return\b"),
    (r"^(?:匯入|导入|引入|載入|加载)(?:模組|模块|套件|函式庫|库)", r"^(?:import|from|require|use|#include)\b"),
]


def obvious_comments(comments: Column, text: Column) -> Column:
    lines = F.split(text, X.SPLIT_BREAK, -1)

    def of(c: Column) -> Column:
        source = F.coalesce(F.get(lines, c["line"] - 1), F.lit(""))
        rest = F.filter(F.slice(lines, c["line"] + 1, F.greatest(F.size(lines) - c["line"], F.lit(0))), lambda x: x.rlike(r"(?U)\S"))
        code = F.regexp_replace(F.coalesce(F.get(rest, F.lit(0)), F.lit("")), r"(?U)^\s+", "")
        value = F.regexp_replace(F.regexp_replace(c["text"], r"(?U)^\s*[*#/]+\s*", ""), r"(?U)^\s+|\s+$", "")
        told = reduce(lambda a, b: a | b, [value.rlike(X.java(p)) & code.rlike(X.java(q)) for p, q in OBVIOUS])
        return one_if(source.rlike(r"(?U)^\s*(?:#|//|/\*|\*)") & told, finding(c["line"], "comments.obvious", "the comment tells only what the next line does", head(value, 48), "warning"))

    return F.flatten(F.transform(F.filter(comments, lambda c: c["text"].rlike(X.CJK) & (c["line"] <= F.size(lines))), of))


# ---- the whole ------------------------------------------------------------------------------------


def with_views(documents: DataFrame, o: Options) -> DataFrame:
    """path, text and the views: checked (without code), rule (prose only), names (with code spans), length (for lengths), and prose, whether rules for prose apply."""
    path, text = F.col("path"), F.col("text")
    s = views.suffix(path)
    markdown = s.isin(kinds.MARKDOWN)
    prose = F.lit(True) if o.kind in ("prose", "pr-body", "commit-message") else kinds.is_prose(path, text) if o.kind == "all" else F.lit(False)
    df = documents.select(path, text).filter("text is not null").withColumn("prose", prose).withColumn("written", authored(text, o) if o.kind == "pr-body" else text)
    df = df.withColumn("blocks", F.when(F.col("prose"), views.code_blocks_masked(F.col("written"), markdown)).otherwise(F.col("written")))
    df = df.withColumn("checked", F.when(F.col("prose"), views.code_spans_masked(F.col("blocks"))).otherwise(F.col("blocks")))
    df = df.withColumn("bare", X.without_markup(F.col("checked"))).withColumn("names", X.without_markup(F.col("blocks")))
    json = F.col("prose") & (s == ".json")
    df = df.withColumn("rule", F.coalesce(views._json(F.when(json, F.col("checked")), F.lit(False)), F.col("bare")))
    return df.withColumn("length", F.when(s.isin(kinds.DATA), F.col("checked")).otherwise(F.col("bare"))).withColumn("suffix", s)


def raw_findings(documents: DataFrame, o: Options) -> DataFrame:
    """Findings before suppression and deduplication, with the surroundings of literal hits."""
    style = o.effective_style
    df = with_views(documents, o)
    rule, checked, text = F.col("rule"), F.col("checked"), F.col("text")
    df = df.withColumn("pieces", X.segments(rule)).withColumn("compared", X.blank_lines_with(rule, o.pack.wording["comparison_markers"]))
    if o.kind in ("all", "source") and (o.pack.profile(style)["comment_language"] == "english" or o.comment_audit):
        df = df.withColumn("comments", comments_of(F.col("path"), F.when(text.rlike(X.CJK), text)))
    if o.kind != "source":
        kind = F.when(F.col("suffix") == ".json", "json").when(F.col("suffix").isin(kinds.DATA), "data").otherwise("prose")
        measured = F.when(F.col("prose") & (F.col("length").rlike(X.CJK) if o.script_gate else F.lit(True)), F.col("length"))
        df = df.withColumn("units", units_of(measured, kind))
    pieces, compared = F.col("pieces"), F.col("compared")
    raw_pieces = X.segments(text)
    parts = [
        *[regex_findings(text, raw_pieces, p, "attribution.ai", "leave out who or what generated the text", flags=re.M | re.I, most=48) for p in o.pack.patterns("attribution_patterns")],
        emoji_findings(rule, o, style),
        phrase_findings(rule, pieces, o, style),
        locale_findings(compared, o),
        terminology_findings(compared, o),
        guarded_findings(F.col("names"), pieces, o),
    ]
    if o.kind != "source":
        typed = F.when(F.col("suffix") == ".json", X.without_markup(rule)).otherwise(rule)
        prose = [
            typography_findings(X.segments(typed), style),
            grammar_findings(rule, pieces, o, style),
            consistency_findings(rule, compared, o),
            F.when(F.col("suffix").isin(kinds.MARKDOWN), F.concat(heading_findings(checked, style), link_findings(checked, o), list_findings(checked) if style in ("strict", "academic", "technical", "readme") else nothing())).otherwise(nothing()),
            unit_findings(F.col("units"), o, style),
            repeated_findings(F.col("length"), o),
        ]
        parts.append(F.when(F.col("prose"), F.concat(*prose)).otherwise(nothing()))
    if style == "ui":
        parts.append(surface_findings(F.col("path"), text, checked, o))
    if "comments" in df.columns:
        if o.pack.profile(style)["comment_language"] == "english":
            parts.append(comment_language(F.col("comments")))
        if o.comment_audit:
            parts.append(obvious_comments(F.col("comments"), text))
    if o.kind == "commit-message":
        parts.append(commit_findings(text, o))
    if o.kind in ("pr-body", "commit-message"):
        parts.append(narration_findings(checked, o))
        if o.overlay:
            parts += [regex_findings(text, raw_pieces, p, "attribution.invalid-signoff", "sign off with an address that can be reached", flags=re.M | re.I, most=48) for p in o.pack.patterns("invalid_signoff_patterns")]
    if o.kind == "pr-body":
        parts.append(request_findings(checked, o, style))
        if o.overlay:
            parts.append(F.array(finding(0, "overlay.missing-title", "the overlay profile needs a title")) if o.title is None else subject_findings(F.lit(o.title), o, "title", line=0))
    return df.select("path", F.inline(F.concat(*parts)))


def covering_words(spark: SparkSession, terms: list[str], words: DataFrame | None, pack: packs.Pack) -> DataFrame:
    """(term, word): dictionary words, of the pack and of a dictionary, that contain a term and are longer."""
    own = spark.createDataFrame([(w,) for w in pack.words()], "word string")
    every = own if words is None else own.unionByName(words.select("word"))
    flagged = spark.createDataFrame([(t,) for t in sorted(set(terms))], "term string")
    maybe = every.filter(F.col("word").rlike(X.any_of(sorted(set(terms))))).distinct()
    return maybe.join(F.broadcast(flagged), F.contains("word", "term") & (F.length("word") > F.length("term")))


def drop_covered(found: DataFrame, covering: DataFrame) -> DataFrame:
    """Findings without those whose hit lies within an occurrence of a longer word; sample, window and at tell the hit."""
    n, m = F.length("sample"), F.length("word")
    begin = F.greatest(F.col("at") + n - m, F.lit(0))
    near = F.substring(F.col("window"), begin + 1, F.col("at") + m - begin)
    # Hits that no word can cover, which have no window, take part with keys that no term has, so that found is computed once.
    keyed = found.withColumn("_key", F.when(F.col("window").isNotNull(), F.col("sample")).otherwise(F.concat(F.lit("\0"), F.coalesce("path", F.lit("")))))
    return keyed.join(covering, (F.col("_key") == F.col("term")) & F.contains(near, F.col("word")), "left_anti").drop("_key")


def lint(documents: DataFrame, options: Options | None = None, words: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """path, line, code, severity, message, sample of every finding in documents(path, text), each once.

    words(word) is a dictionary whose longer words clear literal hits in them; pairs(wrong, preferred) is the regional
    vocabulary that the option `regional` needs. Null texts have no findings. Order with ordered().
    """
    o = options or Options()
    found = raw_findings(documents, o)
    terms = [t for g in o.pack.wording["literal_groups"] for t in g["terms"]]
    if terms:
        found = drop_covered(found, covering_words(documents.sparkSession, terms, words, o.pack))
    out = found.select(*COLUMNS)
    if o.regional:
        if pairs is None:
            raise ValueError("regional vocabulary needs pairs")
        from corpusloom.operators.lexicon import regional_findings

        out = out.unionByName(regional_findings(with_views(documents, o).select("path", "rule"), pairs, words, o))
    return out.distinct()


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("path", "line", "message", "sample", "code", "severity")


def payload(findings: DataFrame) -> DataFrame:
    """One row with the JSON of all findings: {version, count, findings}. For reports; large results are better written as a table."""
    rows = F.array_sort(F.collect_list(F.struct("path", "line", "message", "sample", "code", "severity")))
    listed = F.transform(rows, lambda r: F.struct(*[r[c].alias(c) for c in COLUMNS]))
    return findings.agg(F.to_json(F.struct(F.lit(1).alias("version"), F.count("*").alias("count"), listed.alias("findings"))).alias("json"))


def diagnostics(findings: DataFrame) -> DataFrame:
    """(path, line, text): a line of text for each finding, path:line: message [sample]; line 0 isn't shown."""
    where = F.when(F.col("line") > 0, F.concat("path", F.lit(":"), F.col("line").cast("string"))).otherwise(F.col("path"))
    return findings.select("path", "line", F.concat(where, F.lit(": "), "message", F.when(F.col("sample") != "", F.concat(F.lit(" ["), "sample", F.lit("]"))).otherwise("")).alias("text"))


def failed(findings: DataFrame, level: str = "error") -> DataFrame:
    """One row: whether a finding is of the level that fails a check, and how many findings there are."""
    bad = F.lit(True) if level == "warning" else F.col("severity") == "error"
    return findings.agg(F.coalesce(F.bool_or(bad), F.lit(False)).alias("failed"), F.count("*").alias("findings"))


