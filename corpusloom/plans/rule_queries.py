"""Queries of the single rules, views and extractors, each with its SQL.

Rules that look around a match are told by SQL without look-around: whether they match in a line, not what. So these
queries give (doc_id, line, code).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions import views
from corpusloom.functions.comments import comments_of
from corpusloom.functions.units import units_of
from corpusloom.operators import fix as fixer
from corpusloom.operators import kinds, lint
from corpusloom.plans import catalogue as c
from corpusloom.plans import passages

_LINES, ZH, query, zh, table = c._LINES, c.ZH, c.query, c.zh, c.table
_PACK = c._PACK
CJK = X.CJK  # the same class in Java and in RE2
_STRICT = lint.Options(style="strict")
_OVERLAY = lint.Options(profile="some-overlay")


def q(x: str) -> str:
    """A text as an SQL literal."""
    return "'" + x.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """An escape for code points that Python has and RE2 hasn't."""
    import re

    return re.sub(r"\\u([0-9a-fA-F]{4})|\\U([0-9a-fA-F]{8})", lambda m: chr(int(m[1] or m[2], 16)), pattern)


def found(docs: DataFrame, f: Column, key: str = "doc_id") -> DataFrame:
    return docs.select(key, F.inline(f)).select(key, F.col("line").cast("long").alias("line"), "code").distinct()


def matching(rules: list[tuple[str, str]], lines: str = _LINES) -> str:
    """SQL: the lines in which a condition on x holds, with its code."""
    return " UNION ".join(f"SELECT doc_id, CAST(line AS BIGINT) AS line, {q(code)} AS code FROM ({lines}) WHERE {condition}" for code, condition in rules)


def has(pattern: str) -> str:
    return f"regexp_matches(x, {q(re2(pattern))})"


# ---- wording and grammar --------------------------------------------------------------------------

#: Rules with look-around, told without; lines of generated text hold such a match once at most.
_TOLD = {
    "colloquial-run": has("[在再未沒没]跑([^步道車车馬马]|$)"),
    "colloquial-install": has("(^|[^安])[裝装]上([^游]|$)"),
    "conversational-conditional": has("[的](話|话)[，。；：]"),
    "redundant-passive": has("被[^，。；：、]{0,8}所[一-鿿]"),
    "vague-improvement": has("(大大|極大|极大|顯著|显著)地?(提升|提高|改善|優化|优化)") + " AND NOT " + has("(大大|極大|极大|顯著|显著)地?(提升|提高|改善|優化|优化)[^，。；：]{0,20}[0-9]"),
    "ascii-punctuation": has(r"[一-鿿][,.;:!?](\s|$|[一-鿿])"),
    "verb-degree-de": has("(跑|走|寫|写|執行|执行|運行|运行)的[很更太]?(快|慢|好|差|穩定|稳定)"),
    "adverbial-de": has("(快速|直接|自動|自动|逐一)的(執行|执行|檢查|检查|下載|下载|更新)"),
    "attributive-di": has("(認真|认真|專業|专业)地(態度|态度|方式|方法)"),
}
_EVERY = [*_PACK.wording["regex_rules"], *_PACK.wording["grammar_rules"]]


@query(matching([(r["id"], _TOLD.get(r["id"]) or has(r["pattern"])) for r in _EVERY]))
def rule_lines(spark, sf_dir):
    """All regex and grammar rules of the pack, of all styles."""
    t = F.col("text")
    return found(zh(spark, sf_dir), X.let(X.segments(t), lambda pieces: lint.rules_findings(t, _EVERY, "", pieces=pieces)))


@query(matching([(f"wording.{g['id']}", " OR ".join(f"contains(x, {q(t)})" for t in g["terms"])) for g in _PACK.active("literal_groups", "ui")]))
def phrases_of_labels(spark, sf_dir):
    """The literal groups of the style for labels, which has all."""
    rows = [(t, f"wording.{g['id']}", g["message"]) for g in _PACK.active("literal_groups", "ui") for t in g["terms"]]
    return found(zh(spark, sf_dir), lint.literal_findings(X.segments(F.col("text")), rows))


_WORD = r"[^-0-9A-Za-z_\p{L}\p{N}]"


@query(matching([
    ("typography.fullwidth-alphanumeric", has("[０-９Ａ-Ｚａ-ｚ]")),
    ("typography.fullwidth-decimal", has("[0-9０-９]．[0-9０-９]")),
    ("typography.repeated-punctuation", has("，，|。。|；；|：：|！！|？？|、、")),
    ("typography.ascii-ellipsis", has(r"\.\.\.") + " AND " + has(CJK)),
    ("typography.ascii-dash", has(f"(^|{_WORD})--($|{_WORD})") + " AND " + has(CJK)),
    ("typography.cjk-latin-spacing", has(f"{CJK}[A-Za-z0-9]|[A-Za-z0-9]{CJK}")),
]))
def typography_lines(spark, sf_dir):
    return found(zh(spark, sf_dir), lint.typography_findings(X.segments(F.col("text")), "standard"))


def _free(form: str, every: list[str]) -> str:
    """SQL: whether a form is in the text other than within a longer one."""
    x = "text"
    for longer in sorted((w for w in every if form in w and w != form), key=len, reverse=True):
        x = f"replace({x}, {q(longer)}, '#')"
    return f"contains({x}, {q(form)})"


_GROUPS = [("terminology", sorted({t["zh-CN"], t["zh-TW"], *(f for fs in t.get("reject", {}).values() for f in fs)} - {""})) for t in _PACK.enforced()]
_GROUPS = [g for g in _GROUPS if len(g[1]) > 1] + [(g["id"], g["forms"]) for g in _PACK.wording["consistency_groups"]]


@query(" UNION ".join(f"SELECT doc_id, 'consistency.{id_}' AS code FROM ({ZH}) WHERE {' + '.join(f'CAST({_free(f, _PACK.forms())} AS INT)' for f in forms)} >= 2" for id_, forms in _GROUPS))
def consistency_codes(spark, sf_dir):
    return found(zh(spark, sf_dir), lint.consistency_findings(F.col("text"), F.col("text"), c._O)).select("doc_id", "code").distinct()


@query(matching([("style.emoji", " OR ".join(has(p) for p in _PACK.patterns("emoji_patterns")))]))
def emoji_lines(spark, sf_dir):
    return found(zh(spark, sf_dir), lint.emoji_findings(F.col("text"), _STRICT, "strict"))


@query(f"SELECT doc_id, CAST(line AS BIGINT) AS line FROM (SELECT doc_id, line, replace(x, '✓', ' ') AS x FROM ({_LINES})) WHERE {' OR '.join(has(p) for p in _PACK.patterns('emoji_patterns'))}")
def emoji_of_labels(spark, sf_dir):
    """Of the style for labels, with the signs that it excepts."""
    return found(zh(spark, sf_dir), lint.emoji_findings(F.col("text"), lint.Options(style="ui"), "ui")).select("doc_id", "line")


@query(matching([("attribution.ai", " OR ".join(has("(?i)" + p) for p in _PACK.patterns("attribution_patterns"))), ("attribution.invalid-signoff", " OR ".join(has("(?i)" + p) for p in _PACK.patterns("invalid_signoff_patterns")))]))
def attribution_lines(spark, sf_dir):
    t = F.col("text")
    kinds_ = [("attribution.ai", "attribution_patterns"), ("attribution.invalid-signoff", "invalid_signoff_patterns")]
    return found(zh(spark, sf_dir), F.concat(*[lint.regex_findings(t, X.segments(t), p, code, "", flags=lint.re.M | lint.re.I, most=48) for code, kind in kinds_ for p in _PACK.patterns(kind)]))


@query(matching([(code, " OR ".join(has("(?i)" + p) for p in _PACK.patterns(kind))) for code, kind in (("vcs.routine-tests", "routine_passing_patterns"), ("vcs.work-diary", "workflow_narration_patterns"), ("vcs.author-narration", "author_narration_patterns"))]))
def narration_lines(spark, sf_dir):
    return found(zh(spark, sf_dir), lint.narration_findings(F.col("text"), c._O))


# ---- masks ------------------------------------------------------------------------------------------


_SEEN = f"SELECT doc_id, line, {'replace(' * len(_PACK.wording['locale_name_exceptions'] + _PACK.wording['locale_word_exceptions'])}x" + "".join(f", {q(w)}, ' ')" for w in _PACK.wording["locale_name_exceptions"] + _PACK.wording["locale_word_exceptions"]) + f" AS x, x AS raw FROM ({_LINES})"


@query(f"SELECT doc_id, CAST(line AS BIGINT) AS line FROM ({_SEEN}) WHERE {has('[' + c._A + ']')} AND NOT {has('(?i)' + '|'.join(_PACK.wording['comparison_markers'])).replace('(x,', '(raw,')}")
def wrong_script_beside_exceptions(spark, sf_dir):
    """Traditional characters in a Mainland document, but for names of scripts, excepted words and lines of comparison."""
    compared = X.blank_lines_with(F.col("text"), _PACK.wording["comparison_markers"])
    return found(zh(spark, sf_dir), lint.locale_findings(compared, lint.Options(locale="zh-CN"))).select("doc_id", "line")


_MASKED = r"html"
for _p, _r in ((r"(?is)<(code|pre)\b[^>]*>.*?</(code|pre)\s*>", " "), (r"\]\([^)\n]*\)", "]"), (r"(https?|ftp)://[^\s<>()]+", " "), (r"[\w.+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", " "), (r"\{(#|\.)[^}\n]+\}", " "), (r"<[^>\n]+>", " ")):
    _MASKED = f"regexp_replace({_MASKED}, {q(_p)}, {q(_r)}, 'g')"


@query(f"SELECT page_id, CAST(length(regexp_replace({_MASKED}, '\\s', '', 'g')) AS BIGINT) AS solid, CAST(length(html) AS BIGINT) AS length FROM pages WHERE html IS NOT NULL")
def markup_mask(spark, sf_dir):
    """What the mask leaves of pages, without white space, and the length, which doesn't change."""
    m = X.without_markup(F.col("html"))
    return table(spark, sf_dir, "pages").filter("html is not null").select("page_id", F.length(X.compact(m)).cast("long").alias("solid"), F.length(m).cast("long").alias("length"))


_CODE = "concat('before ', doc_id, chr(10), '```py', chr(10), 'hidden = ', doc_id, chr(10), '```', chr(10), 'a `span ', doc_id, '` b ``c `d` e`` f', chr(10), chr(10), '    indented', chr(10), 'after')"


@query("SELECT doc_id, concat('before', doc_id, 'abfafter') AS left_over FROM documents")
def code_mask(spark, sf_dir):
    """Fences, spans of backticks and indented code of generated Markdown; white space is taken away from what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_CODE).alias("t"))
    seen = views.code_spans_masked(views.code_blocks_masked(F.col("t"), F.lit(True)))
    return docs.select("doc_id", X.compact(seen).alias("left_over"))


# ---- Markdown -----------------------------------------------------------------------------------------

_MARKDOWN = {
    "spark": "concat(repeat('#', cast(doc_id % 3 + 1 as int)), ' one', chr(10), 'text ', doc_id, chr(10), repeat('#', cast(doc_id % 5 + 1 as int)), ' two。', chr(10), repeat('#', cast(doc_id % 4 + 1 as int)), ' three. ##', chr(10), 'see [', element_at(array('這裡', 'the manual', '**点此**'), cast(doc_id % 3 + 1 as int)), '](x', doc_id, '.md)', chr(10))",
}
_MARKDOWN["duckdb"] = _MARKDOWN["spark"].replace("element_at(array('這裡', 'the manual', '**点此**')", "list_extract(['這裡', 'the manual', '**点此**']")
_HEADS = f"SELECT doc_id, line, length(regexp_extract(x, '^(#+) ', 1)) AS level, regexp_extract(x, '^#+ (.*?) *#*$', 1) AS title, lag(length(regexp_extract(x, '^(#+) ', 1))) OVER (PARTITION BY doc_id ORDER BY line) AS before FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS line FROM (SELECT doc_id, {_MARKDOWN['duckdb']} AS t FROM documents)) WHERE x LIKE '#%'"


@query(f"SELECT doc_id, CAST(line AS BIGINT) AS line, 'markdown.heading-level' AS code FROM ({_HEADS}) WHERE level > before + 1 UNION SELECT doc_id, CAST(line AS BIGINT), 'markdown.heading-punctuation' FROM ({_HEADS}) WHERE regexp_matches(title, '[。.．]$') UNION SELECT doc_id, CAST(5 AS BIGINT), 'markdown.generic-link' FROM documents WHERE doc_id % 3 <> 1")
def markdown_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_MARKDOWN["spark"]).alias("t"))
    return found(docs, F.concat(lint.heading_findings(F.col("t"), "readme"), lint.link_findings(F.col("t"), lint.Options(style="readme"))))


_ITEMS = {
    "spark": "concat('甲 ', doc_id, chr(10), '- 一項', if(doc_id % 2 = 0, '。', ''), chr(10), '- 二項', if(doc_id % 3 = 0, '。', ''), chr(10), '- 三項', if(doc_id % 5 = 0, '。', ''), chr(10), '1. 四項', if(doc_id % 7 = 0, '。', ''), chr(10), '2. 五項', if(doc_id % 11 = 0, '；', ''), chr(10), chr(10), '- 六項。')",
}
_ITEMS["duckdb"] = _ITEMS["spark"].replace("if(", "if(")
_ITEM_ROWS = f"SELECT doc_id, line, regexp_matches(x, '[。；！？]$') AS stop, CASE WHEN x LIKE '- %' THEN 'm' ELSE 'n' END AS kind FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS line FROM (SELECT doc_id, {_ITEMS['duckdb']} AS t FROM documents)) WHERE regexp_matches(x, '^(-|[0-9][.]) ')"
_ISLANDS = f"SELECT *, line - row_number() OVER (PARTITION BY doc_id, kind ORDER BY line) AS island FROM ({_ITEM_ROWS})"


@query(f"SELECT doc_id, CAST(min(line) AS BIGINT) AS line FROM (SELECT *, first_value(stop) OVER (PARTITION BY doc_id, kind, island ORDER BY line) AS lead FROM ({_ISLANDS})) WHERE stop <> lead GROUP BY doc_id, kind, island")
def list_islands(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_ITEMS["spark"]).alias("t"))
    return found(docs, lint.list_findings(F.col("t"))).select("doc_id", "line")


# ---- units ----------------------------------------------------------------------------------------------

_ANY = lint.Options(style="strict", script_gate=False)
_RAW = "SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL"
_SENTENCES = f"SELECT doc_id, line, unnest(regexp_extract_all(trim(x), '[^。！？!?]+[。！？!?]?')) AS s FROM ({_RAW})"
_CONNECTORS = "|".join(sorted(lint.CONNECTORS, key=len, reverse=True))


@query(
    matching([("length.paragraph", "length(regexp_replace(x, '\\s', '', 'g')) > 280"), ("length.paragraph-sentences", "len(regexp_extract_all(x, '[。！？!?]')) > 4")], _RAW)
    + f" UNION SELECT doc_id, CAST(line AS BIGINT), 'length.sentence' FROM ({_SENTENCES}) WHERE length(regexp_replace(s, '\\s', '', 'g')) > 80"
    + f" UNION SELECT doc_id, CAST(line AS BIGINT), 'structure.complex-sentence' FROM ({_SENTENCES}) WHERE length(regexp_replace(s, '\\s', '', 'g')) > 0 AND len(regexp_extract_all(s, '[，；：,;:]')) + len(regexp_extract_all(s, {q(_CONNECTORS)})) >= 5"
)
def lengths_of_lines(spark, sf_dir):
    """The lengths of data: each line is a unit. Documents as they are, of any script."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").withColumn("units", units_of(F.col("text"), F.lit("data")))
    return found(docs, lint.unit_findings(F.col("units"), _ANY, "strict"))


_PARAGRAPHS = "concat('# head ', doc_id, chr(10), chr(10), 'first ', doc_id, chr(10), 'goes on', chr(10), chr(10), '> quoted', chr(10), '> more', chr(10), chr(10), '- item one', chr(10), '  wrapped', chr(10), '- item two', chr(10), chr(10), '| a | b |', chr(10), '| --- | --- |', chr(10), '| c ', doc_id, ' | d |')"


@query("SELECT doc_id, CAST(u.line AS BIGINT) AS line, u.unit AS unit FROM (SELECT doc_id, unnest([{'line': 3, 'unit': concat('first ', doc_id, chr(10), 'goes on')}, {'line': 6, 'unit': concat('quoted', chr(10), 'more')}, {'line': 9, 'unit': concat('item one', chr(10), '  wrapped')}, {'line': 11, 'unit': 'item two'}, {'line': 13, 'unit': 'a'}, {'line': 13, 'unit': 'b'}, {'line': 15, 'unit': concat('c ', doc_id)}, {'line': 15, 'unit': 'd'}]) AS u FROM documents)")
def paragraph_units(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(units_of(F.expr(_PARAGRAPHS), F.lit("prose"))).alias("u"))
    return docs.select("doc_id", F.col("u.line").cast("long").alias("line"), F.col("u.text").alias("unit"))


_JSON = "concat('{\"k', doc_id, '\": \"v', doc_id, '\", \"n\": [1, \"a\\\\nb\"],', chr(10), ' \"z\": \"\\\\u4e2d\"}')"


@query("SELECT doc_id, CAST(u.line AS BIGINT) AS line, u.unit AS unit FROM (SELECT doc_id, unnest([{'line': 1, 'unit': concat('v', doc_id)}, {'line': 1, 'unit': concat('a', chr(10), 'b')}, {'line': 2, 'unit': '中'}]) AS u FROM documents)")
def json_units(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(units_of(F.expr(_JSON), F.lit("json"))).alias("u"))
    return docs.select("doc_id", F.col("u.line").cast("long").alias("line"), F.col("u.text").alias("unit"))


@query("SELECT doc_id, concat('v', doc_id, 'ab中') AS solid, length(t) AS length FROM (SELECT doc_id, " + _JSON.replace("\\\\", "\\") + " AS t FROM documents)")
def json_prose_view(spark, sf_dir):
    """Only the values of JSON are left, in a view as long as the text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_JSON).alias("t"))
    seen = views.json_masked(F.col("t"))
    return docs.select("doc_id", X.compact(seen).alias("solid"), F.length(seen).cast("long").alias("length"))


_NORM = "regexp_replace(trim(s), '[\\s`*_>#-]', '', 'g')"
_LEAST = _PACK.wording["repeated_sentence_characters"]


@query(f"SELECT doc_id, CAST(count(*) - count(DISTINCT n) AS BIGINT) AS repeats FROM (SELECT doc_id, {_NORM} AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^。！？!?\\n]+[。！？!?]?')) AS s FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(trim(s), '[。！？!?]$')) WHERE length(n) >= {_LEAST} GROUP BY doc_id HAVING count(*) > count(DISTINCT n)")
def repeated_sentences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return docs.select("doc_id", F.size(lint.repeated_findings(F.col("text"), _ANY)).cast("long").alias("repeats")).filter("repeats > 0")


# ---- commits and change requests ---------------------------------------------------------------------------

_SUBJECT = "regexp_replace(string_split(t, chr(10))[1], '\\s+$', '')"
_COMMIT = f"SELECT doc_id, concat(list_extract(['', '  ', 'core: fix it', 'core:fix', '修正 core: x', 'x: ' || repeat('y', 70)], CAST(doc_id % 6 AS INT) + 1), chr(10), list_extract(['', 'body', ' '], CAST(doc_id % 5 % 3 AS INT) + 1), chr(10), text) AS t FROM documents WHERE text IS NOT NULL"
_SOME = f"{_SUBJECT} <> ''"


@query(
    " UNION ".join(
        f"SELECT doc_id, '{code}' AS code FROM ({_COMMIT}) WHERE {condition}"
        for code, condition in (
            ("vcs.empty-subject", f"{_SUBJECT} = ''"),
            ("vcs.subject-length", f"length({_SUBJECT}) > 69"),
            ("vcs.subject-punctuation", f"regexp_matches({_SUBJECT}, '[。；，！？、.;,!?：:]$')"),
            ("overlay.english-subject", f"regexp_matches({_SUBJECT}, '{CJK}')"),
            ("overlay.subject-format", f"{_SOME} AND NOT regexp_matches({_SUBJECT}, '^\\S+: \\S')"),
            ("vcs.subject-body-spacing", f"{_SOME} AND trim(string_split(t, chr(10))[2]) <> ''"),
        )
    )
)
def commit_codes(spark, sf_dir):
    made = "concat(element_at(array('', '  ', 'core: fix it', 'core:fix', '修正 core: x', 'x: ' || repeat('y', 70)), cast(doc_id % 6 as int) + 1), chr(10), element_at(array('', 'body', ' '), cast(doc_id % 5 % 3 as int) + 1), chr(10), text)"
    docs = table(spark, sf_dir, "documents").filter("text is not null").selectExpr("doc_id", f"{made} AS t")
    return found(docs, lint.commit_findings(F.col("t"), _OVERLAY)).select("doc_id", "code").distinct()


_MARK = _PACK.patterns("pr_template_markers")[0]
_REQUEST = f"concat('intro ', doc_id, chr(10), chr(10), repeat('- item' || chr(10), CAST(doc_id % 9 AS INT)), chr(10), repeat('para' || chr(10) || chr(10), CAST(doc_id % 6 AS INT)), repeat('## head' || chr(10), CAST(doc_id % 2 AS INT)), '本次修改包含三項', chr(10), substr(text, 1, CAST((doc_id % 800) AS INT)), chr(10), {q(_MARK)}, chr(10), '## template ', repeat('- x' || chr(10), 20))"
_WRITTEN = f"SELECT doc_id, split_part({_REQUEST}, {q(_MARK)}, 1) AS t FROM documents WHERE text IS NOT NULL"
_BLOCKS = "len(list_filter(regexp_split_to_array(t, '\\n\\s*\\n'), lambda b: trim(b, ' ' || chr(10) || chr(9) || chr(13)) <> ''))"


@query(
    f"SELECT doc_id, 'vcs.pr-length' AS code FROM ({_WRITTEN}) WHERE length(regexp_replace(t, '\\s', '', 'g')) > 600"
    f" UNION SELECT doc_id, 'vcs.pr-blocks' FROM ({_WRITTEN}) WHERE {_BLOCKS} > 4"
    f" UNION SELECT doc_id, 'vcs.pr-list-items' FROM ({_WRITTEN}) WHERE len(regexp_extract_all(t, '(?m)^\\s*(?:[-*+]|\\d+[.)])\\s+\\S')) > 5"
    f" UNION SELECT doc_id, 'vcs.pr-heading' FROM ({_WRITTEN}) WHERE regexp_matches(t, '(?m)^\\s*#{{1,6}}\\s+\\S')"
    f" UNION SELECT doc_id, 'vcs.pr-inventory' FROM ({_WRITTEN})"
    f" UNION SELECT doc_id, 'vcs.repeated-title' FROM ({_WRITTEN}) WHERE contains(lower(t), 'intro 7')"
)
def request_codes(spark, sf_dir):
    """Limits of a change request's description, up to the mark of the template, and the title in it."""
    o = lint.Options(kind="pr-body", style="strict", title="Intro 7")
    docs = table(spark, sf_dir, "documents").filter("text is not null").selectExpr("doc_id", f"{_REQUEST} AS t")
    return found(docs.select("doc_id", lint.authored(F.col("t"), o).alias("t")), lint.request_findings(F.col("t"), o, "strict")).select("doc_id", "code").distinct()


# ---- user interfaces -----------------------------------------------------------------------------------------

_SUFFIXES = [".html", ".json", ".yaml"]
_UI = [
    "concat('<p>', doc_id, '</p>', chr(10), '<img alt=\"圖 ', doc_id, '。\">', chr(10), '<button class=\"x\"><b>儲存 &amp; 離開！</b></button>')",
    "concat('{\"id\": \"', doc_id, '\",', chr(10), ' \"save_label\": \"存檔 ', doc_id, '。\"}')",
    "concat('id: ', doc_id, chr(10), 'menu: \"選單 ', doc_id, '\"', chr(10), 'other: 值。')",
]


def _ui(spark, sf_dir):
    made = "CASE doc_id % 3 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_UI)) + " END"
    path = F.concat(F.lit("a/b"), F.element_at(F.array(*map(F.lit, _SUFFIXES)), (F.col("doc_id") % 3 + 1).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.expr(made).alias("t"))


@query("SELECT doc_id, CAST(2 AS BIGINT) AS line, CASE doc_id % 3 WHEN 0 THEN concat('圖 ', doc_id, '。') WHEN 1 THEN concat('存檔 ', doc_id, '。') ELSE concat('選單 ', doc_id) END AS value, CASE doc_id % 3 WHEN 0 THEN 'alt' ELSE 'label' END AS what FROM documents UNION ALL SELECT doc_id, 3, '儲存 & 離開！', 'button' FROM documents WHERE doc_id % 3 = 0")
def ui_surfaces(spark, sf_dir):
    docs = _ui(spark, sf_dir)
    return docs.select("doc_id", F.inline(lint.surfaces(F.col("path"), F.col("t")))).select("doc_id", F.col("line").cast("long").alias("line"), "value", "what")


@query("SELECT doc_id, CAST(2 AS BIGINT) AS line, 'ui.control-punctuation' AS code FROM documents WHERE doc_id % 3 < 2 UNION ALL SELECT doc_id, 3, 'ui.control-punctuation' FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 3, 'ui.exclamation' FROM documents WHERE doc_id % 3 = 0")
def ui_codes(spark, sf_dir):
    docs = _ui(spark, sf_dir)
    return found(docs, lint.surface_findings(F.col("path"), F.col("t"), F.col("t"), lint.Options(style="ui"))).filter("code like 'ui.%'")


# ---- comments ---------------------------------------------------------------------------------------------------

#: Suffix, lines of source, and the comments in it; {} is the document's id.
_SOURCES = [
    (".py", ["x = '# no'  # 註解 {}", "def f():", '    "docs {}"'], [(1, "註解 {}"), (3, "docs {}")]),
    (".sh", ["cat <<EOF", "# no", "EOF", 'echo "${a#b}" # tail {}'], [(4, "tail {}")]),
    (".yaml", ["a: |", "  # no", "b: 1 # yes {}"], [(3, "yes {}")]),
    (".toml", ['s = """', "# no", '"""', "k = 1 # k {}"], [(4, "k {}")]),
    (".rs", ["/* a /* b */ c{} */", 'let s = "// no";'], [(1, " a /* b */ c{} ")]),
    (".ts", ["const x = `a ${y /* in {} */} // no`;"], [(1, " in {} ")]),
    (".html", ["<p>x</p>", "<!-- html {} -->"], [(2, " html {} ")]),
    (".sql", ["select '-- no' -- dash {}"], [(1, "dash {}")]),
    (".md", ["text", "```sh", "ls # fence {}", "```"], [(3, "fence {}")]),
    (".css", ["a { b: 'c' } /* css {} */ // no"], [(1, " css {} ")]),
    (".c", ["int x; // 中文 {}"], [(1, "中文 {}")]),
]


def _filled(x: str) -> str:
    """SQL: a text in which {} is the document's id."""
    return "concat(" + ", doc_id, ".join(q(p) for p in x.split("{}")) + ")"


def _code(spark, sf_dir):
    n = len(_SOURCES)
    text = f"CASE doc_id % {n} " + " ".join(f"WHEN {i} THEN {_filled(chr(10).join(rows))}" for i, (_, rows, _) in enumerate(_SOURCES)) + " END"
    text = text.replace("\n", "' || chr(10) || '").replace("\\", "\\\\")
    path = f"concat('src/x', doc_id, element_at(array({', '.join(q(s) for s, _, _ in _SOURCES)}), cast(doc_id % {n} + 1 as int)))"
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{path} AS path", f"{text} AS t")


@query(" UNION ALL ".join(f"SELECT doc_id, CAST({line} AS BIGINT) AS line, {_filled(x)} AS comment FROM documents WHERE doc_id % {len(_SOURCES)} = {i}" for i, (_, _, cs) in enumerate(_SOURCES) for line, x in cs))
def comments_by_suffix(spark, sf_dir):
    docs = _code(spark, sf_dir).select("doc_id", F.explode(comments_of(F.col("path"), F.col("t"))).alias("c"))
    return docs.select("doc_id", F.col("c.line").cast("long").alias("line"), F.col("c.text").alias("comment"))


@query(f"SELECT doc_id, CAST(1 AS BIGINT) AS line, 'comments.language' AS code FROM documents WHERE doc_id % {len(_SOURCES)} IN (0, 10)")
def comment_language_lines(spark, sf_dir):
    return found(_code(spark, sf_dir), lint.comment_language(comments_of(F.col("path"), F.col("t"))))


_TOLD_AGAIN = ["# 返回結果", "# 為什麼要返回", "# 遍歷所有項目", "# 如果為空就跳過"]
_NEXT = ["return x", "for a in b:", "if not a:"]


@query("SELECT doc_id, CAST(1 AS BIGINT) AS line, 'comments.obvious' AS code FROM documents WHERE (doc_id % 4 = 0 AND doc_id % 3 = 0) OR (doc_id % 4 = 2 AND doc_id % 3 = 1) OR (doc_id % 4 = 3 AND doc_id % 3 = 2)")
def obvious_comment_lines(spark, sf_dir):
    """Comments that only tell the next line of code, after a blank one."""
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("doc_id") % len(xs) + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(pick(_TOLD_AGAIN), F.lit("\n\n    "), pick(_NEXT)).alias("t"))
    return found(docs, lint.obvious_comments(comments_of(F.lit("x.py"), F.col("t")), F.col("t")))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '(?s)<!--.*?-->')) AS BIGINT) AS comments FROM pages WHERE html IS NOT NULL")
def html_comments(spark, sf_dir):
    """By the extractor of markup; comments that are alike on one line count once."""
    pages = table(spark, sf_dir, "pages").filter("html is not null")
    return pages.select("page_id", F.size(comments_of(F.lit("page.html"), F.col("html"))).cast("long").alias("comments"))


# ---- gates and outputs --------------------------------------------------------------------------------------------

_NAMES = ["x.md", "x.TXT", "Makefile", "x.bin", "x", "x.tar.gz", ".gitignore", "x.Py", "CMakeLists.txt", "x.jsonl"]
_PATH = "concat('d', doc_id, '/', {})"


@query(f"SELECT doc_id, path, known, prose FROM (SELECT doc_id, path, regexp_extract(path, '[^/]*$') AS name, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]+)$', 1)) AS suffix, suffix IN ({', '.join(map(q, kinds.KNOWN))}) OR name IN ({', '.join(map(q, kinds.HASH_NAMES))}) AS known, suffix IN ({', '.join(map(q, [*kinds.PROSE, *kinds.DATA]))}) OR suffix = '' AS prose FROM (SELECT doc_id, {_PATH.format(f'list_extract([{chr(44).join(map(q, _NAMES))}], CAST(doc_id % 10 AS INT) + 1)')} AS path FROM documents WHERE text IS NOT NULL))")
def gates_by_suffix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null").selectExpr("doc_id", _PATH.format(f"element_at(array({', '.join(map(q, _NAMES))}), cast(doc_id % 10 as int) + 1)") + " AS path", "text")
    return docs.select("doc_id", "path", kinds.known(F.col("path")).alias("known"), kinds.is_prose(F.col("path"), F.col("text")).alias("prose"))


@query("SELECT doc_id, path FROM (SELECT doc_id, concat('d', doc_id % 7, '/', doc_id, list_extract(['.md', '.txt', '.py'], CAST(doc_id % 3 AS INT) + 1)) AS path FROM documents) WHERE NOT (path LIKE '%.py' OR path LIKE 'd3/%' OR regexp_matches(path, '/1[0-9]\\.md$'))")
def exclude_globs(spark, sf_dir):
    from corpusloom.sources import files

    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "concat('d', doc_id % 7, '/', doc_id, element_at(array('.md', '.txt', '.py'), cast(doc_id % 3 as int) + 1)) AS path")
    return docs.filter(~files.excluded(F.col("path"), ["*.py", "d3/*", "1[0-9].md"]))


@query("SELECT doc_id, doc_id % 4 < 2 AND NOT (doc_id % 4 = 1 AND length(text) < 0) AS is_text FROM documents WHERE text IS NOT NULL")
def utf8_sniff(spark, sf_dir):
    """Texts of one byte a character are text; a NUL, or a lone lead byte, at the front isn't."""
    from corpusloom.sources import files

    lead = F.element_at(F.array(F.unhex(F.lit("41")), F.unhex(F.lit("C3A9")), F.unhex(F.lit("00")), F.unhex(F.lit("C3"))), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    ascii_ = F.regexp_replace("text", r"[^\x00-\x7f]", "?").cast("binary")
    return docs.select("doc_id", files.is_text(F.concat(lead, ascii_)).alias("is_text"))


_HITS = f"SELECT DISTINCT concat(doc_id, '.txt') AS path, line, code, 'error' AS severity, message, term AS sample FROM ({_LINES}) JOIN (VALUES {c._values([(t, 'wording.' + g['id'], g['message']) for g in _PACK.active('literal_groups', 'standard') for t in g['terms']])}) AS t(term, code, message) ON contains(x, term)"


def _hits(spark, sf_dir) -> DataFrame:
    rows = [(t, f"wording.{g['id']}", g["message"]) for g in _PACK.active("literal_groups", "standard") for t in g["terms"]]
    docs = zh(spark, sf_dir).select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.inline(lint.literal_findings(X.segments(F.col("text")), rows)))
    return docs.select(*lint.COLUMNS).distinct()


@query(f"SELECT path, CAST(line AS INT) AS line, concat(path, ':', line, ': ', message, ' [', sample, ']') AS text FROM ({_HITS})")
def diagnostic_lines(spark, sf_dir):
    return lint.diagnostics(_hits(spark, sf_dir))


@query(f"SELECT to_json({{'version': 1, 'count': count(*), 'findings': list({{'path': path, 'line': line, 'code': code, 'severity': severity, 'message': message, 'sample': sample}} ORDER BY path, line, message, sample, code, severity)}}) AS json FROM ({_HITS})")
def diagnostic_json(spark, sf_dir):
    """A report is one value: for a change rather than for a corpus."""
    return lint.payload(_hits(spark, sf_dir))


@query(f"SELECT count(*) > 0 AS failed, count(*) AS findings FROM ({_HITS})")
def exit_state(spark, sf_dir):
    return lint.failed(_hits(spark, sf_dir))


# ---- fixes ------------------------------------------------------------------------------------------------------------

_WIDE_FROM, _WIDE_TO = "".join(map(chr, fixer._WIDE)), "".join(map(chr, fixer._WIDE.values()))


def _fixed_sql() -> str:
    x = f"translate(x, {q(_WIDE_FROM)}, {q(_WIDE_TO)})"
    x = f"regexp_replace({x}, '([0-9])．([0-9])', '\\1.\\2', 'g')"
    for mark in "，。；：！？、":
        x = f"regexp_replace({x}, '{mark}{{2,}}', '{mark}', 'g')"
    x = f"CASE WHEN {has(CJK)} THEN regexp_replace(regexp_replace({x}, '\\.{{3,}}', '……', 'g'), '(^|{_WORD})--($|{_WORD})', '\\1——\\2', 'g') ELSE {x} END"
    for _ in range(2):  # matches may share an ideograph
        for a, b in zip(",.;:!?", "，。；：！？"):
            x = f"regexp_replace({x}, '({CJK})[{a}](\\s|$|{CJK})', '\\1{b}\\2', 'g')"
    x = f"regexp_replace({x}, '({CJK})([0-9A-Za-z])', '\\1 \\2', 'g')"
    return f"regexp_replace({x}, '([0-9A-Za-z])({CJK})', '\\1 \\2', 'g')"


_FIXABLE = "SELECT doc_id, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS line FROM (SELECT doc_id, " + passages.lines("duckdb") + " AS t FROM documents)"


@query(f"SELECT concat(doc_id, '.txt') AS path, string_agg(y, chr(10) ORDER BY line) AS text FROM (SELECT doc_id, line, CASE WHEN contains(x, '<') THEN x ELSE {_fixed_sql()} END AS y FROM ({_FIXABLE})) GROUP BY doc_id")
def fix_lines(spark, sf_dir):
    """The generated lines alone, fixed. The lines with an address in angle brackets have nothing to fix."""
    docs = table(spark, sf_dir, "documents").selectExpr("concat(doc_id, '.txt') AS path", f"{passages.lines('spark')} AS text")
    return fixer.fix(docs).select("path", "text")


@query()
def fix_typography(spark, sf_dir):
    docs = zh(spark, sf_dir).select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    return fixer.fix(docs)


#: What lint() gives of the styles' plain rules on texts without markup.
@query(
    matching([(f"wording.{g['id']}", " OR ".join(f"contains(x, {q(t)})" for t in g["terms"])) for g in _PACK.active("literal_groups", "standard")])
    + " UNION "
    + matching([(f"wording.{r['id']}", _TOLD.get(r["id"]) or has(r["pattern"])) for r in _PACK.active("regex_rules", "standard")])
    + " UNION "
    + matching([(f"grammar.{r['id']}", _TOLD.get(r["id"]) or has(r["pattern"])) for r in _PACK.active("grammar_rules", "standard")])
)
def lint_wording(spark, sf_dir):
    """The whole linter over whole texts: its findings of wording and grammar."""
    docs = zh(spark, sf_dir).select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    got = lint.lint(docs).filter("code like 'wording.%' or code like 'grammar.%'")
    return got.select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("doc_id"), F.col("line").cast("long").alias("line"), "code").distinct()
