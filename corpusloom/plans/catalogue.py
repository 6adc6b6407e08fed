"""Queries over the tables of a folder, and the same in ANSI SQL where SQL can tell them.

The tables hold no ideographs, so ZH puts four Chinese lines, which combine by doc_id in very many ways, before every
text; all documents and whole texts take part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import fix as fixer
from corpusloom.operators import integrity, lexicon, lint
from corpusloom.plans import pack as packs
from corpusloom.plans import passages

ZH = f"SELECT doc_id, concat({passages.lines('duckdb')}, text) AS text FROM documents WHERE text IS NOT NULL"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def zh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"concat({passages.lines('spark')}, text) AS text").filter("text is not null")


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def findings(docs: DataFrame, f: Column) -> DataFrame:
    return docs.select("doc_id", F.inline(f)).select("doc_id", F.col("line").cast("long").alias("line"), "code", "sample").distinct()


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)


_LINES = f"SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM ({ZH})"
_O = lint.Options()
_PACK = packs.default()
_TERMS = [(t, f"wording.{g['id']}") for g in _PACK.active("literal_groups", "standard") for t in g["terms"]]


@query(f"SELECT DISTINCT doc_id, CAST(line AS BIGINT) AS line, code, term AS sample FROM ({_LINES}) JOIN (VALUES {_values(_TERMS)}) AS t(term, code) ON contains(x, term)")
def literal_scan(spark, sf_dir):
    rows = [(t, f"wording.{g['id']}", g["message"]) for g in _PACK.active("literal_groups", "standard") for t in g["terms"]]
    return findings(zh(spark, sf_dir), lint.literal_findings(X.segments(F.col("text")), rows))


@query(f"SELECT code, count(*) AS hits FROM (SELECT DISTINCT doc_id, line, code, term FROM ({_LINES}) JOIN (VALUES {_values(_TERMS)}) AS t(term, code) ON contains(x, term)) GROUP BY code")
def literal_counts(spark, sf_dir):
    return literal_scan(spark, sf_dir).groupBy("code").agg(F.count("*").alias("hits"))


_COVER = ["搞定了", "搞定！", "抓手機", "網路賦能"]


@query(f"SELECT DISTINCT doc_id, term AS sample FROM (SELECT doc_id, text, unnest(['搞定', '抓手']) AS term FROM ({ZH})) WHERE contains(text, term) AND NOT (term = '搞定' AND contains(text, '搞定！'))")
def suppression_anti_join(spark, sf_dir):
    docs = zh(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.col("text"))
    f = lint.literal_findings(X.segments(F.col("text")), [(t, "wording.x", "") for t in ("搞定", "抓手")], suppress=True)
    words = spark.createDataFrame([(w,) for w in _COVER], "word string")
    kept = lint.drop_covered(docs.select("path", F.inline(f)), lint.covering_words(spark, ["搞定", "抓手"], words, _PACK))
    return kept.select(F.col("path").cast("long").alias("doc_id"), "sample").distinct()


_SAFE = [r for r in _PACK.active("regex_rules", "standard") if r["id"] in ("colloquial-failure", "nominalized-operation", "dui-jinxing", "redundant-aspect", "indirect-method")]


@query(f"SELECT DISTINCT doc_id, CAST(line AS BIGINT) AS line, code, unnest(regexp_extract_all(x, p)) AS sample FROM ({_LINES}) JOIN (VALUES {_values([(r['pattern'].replace(chr(92) + 'n', chr(92) + 'n'), 'wording.' + r['id']) for r in _SAFE])}) AS t(p, code) ON regexp_matches(x, p)")
def regex_scan(spark, sf_dir):
    t = F.col("text")
    return findings(zh(spark, sf_dir), F.concat(*[lint.regex_findings(t, X.segments(t), r["pattern"], f"wording.{r['id']}", r["message"]) for r in _SAFE]))


_A, _B = ("".join(sorted(x)) for x in _PACK.markers())
_NAMES = _PACK.wording["locale_name_exceptions"] + _PACK.wording["locale_word_exceptions"]
_UNNAMED = "replace(" * len(_NAMES) + "text" + "".join(f", '{w}', ' ')" for w in _NAMES)


@query(f"SELECT doc_id, 'locale.mixed-script' AS code FROM (SELECT doc_id, {_UNNAMED} AS text FROM ({ZH})) WHERE regexp_matches(text, '[{_A}]') AND regexp_matches(text, '[{_B}]')")
def mixed_script(spark, sf_dir):
    return findings(zh(spark, sf_dir), lint.locale_findings(F.col("text"), _O)).select("doc_id", "code")


@query(f"SELECT DISTINCT doc_id, CAST(line AS BIGINT) AS line FROM ({_LINES}) WHERE regexp_matches({_UNNAMED.replace('text', 'x')}, '[{_B}]')")
def wrong_script_lines(spark, sf_dir):
    return findings(zh(spark, sf_dir), lint.locale_findings(F.col("text"), lint.Options(locale="zh-TW"))).select("doc_id", "line").distinct()


@query(f"SELECT DISTINCT doc_id, CAST(line AS BIGINT) AS line, bad AS sample FROM ({_LINES}) JOIN (VALUES {_values([(b,) for _, _, b in _PACK.rejected('zh-TW')])}) AS t(bad) ON contains(x, bad)")
def terminology_locale(spark, sf_dir):
    return findings(zh(spark, sf_dir), lint.terminology_findings(F.col("text"), lint.Options(locale="zh-TW"))).select("doc_id", "line", "sample")


_GUARDED = [(bad, "(?i)(^|[^A-Za-z0-9_])" + g["en"] + "(s|es)?($|[^A-Za-z0-9_])") for g in _PACK.guarded() for bad in g["reject"]]


@query(f"SELECT DISTINCT l.doc_id, CAST(line AS BIGINT) AS line, bad AS sample FROM ({_LINES}) l JOIN (VALUES {_values(_GUARDED)}) AS t(bad, name) ON contains(x, bad) JOIN ({ZH}) d ON d.doc_id = l.doc_id AND regexp_matches(d.text, name)")
def guarded_names(spark, sf_dir):
    return findings(zh(spark, sf_dir), lint.guarded_findings(F.col("text"), X.segments(F.col("text")), _O)).select("doc_id", "line", "sample").distinct()


@query("SELECT doc_id, CAST(length(string_split(text, chr(10))[1]) AS BIGINT) AS characters FROM documents WHERE length(regexp_replace(string_split(text, chr(10))[1], '[ \\t\\r]+$', '')) > 72")
def subject_length(spark, sf_dir):
    first = F.regexp_replace(F.get(F.split("text", "\n", -1), F.lit(0)), r"(?U)\s+$", "")
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.length(F.get(F.split("text", "\n", -1), F.lit(0))).cast("long").alias("characters"), F.inline(lint.subject_findings(first, _O))).filter("code = 'vcs.subject-length'").select("doc_id", "characters")


@query("SELECT doc_id FROM documents WHERE regexp_matches(string_split(text, chr(10))[1], '[。；，！？、.;,!?：:]\\s*$')")
def subject_punctuation(spark, sf_dir):
    first = F.get(F.split("text", "\n", -1), F.lit(0))
    return findings(table(spark, sf_dir, "documents"), lint.subject_findings(first, _O)).filter("code = 'vcs.subject-punctuation'").select("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(string_split(text, chr(10))[1], '\\S') AND regexp_matches(coalesce(string_split(text, chr(10))[2], ''), '\\S')")
def body_spacing(spark, sf_dir):
    return findings(table(spark, sf_dir, "documents"), lint.commit_findings(F.col("text"), _O)).filter("code = 'vcs.subject-body-spacing'").select("doc_id")


@query("SELECT doc_id, sha256(text) AS sha256, sha1(encode('blob ' || octet_length(encode(text))) || '\\x00'::BLOB || encode(text)) AS blob FROM documents WHERE text IS NOT NULL")
def digests(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("sha256"), integrity.git_blob(F.col("text").cast("binary")).alias("blob"))


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def uniqueness_violations(spark, sf_dir):
    return integrity.repeated(table(spark, sf_dir, "documents"), "text")


@query("SELECT c.category, count(d.doc_id) AS cases FROM (SELECT DISTINCT lang AS category FROM documents UNION SELECT 'zh') c LEFT JOIN documents d ON d.lang = c.category GROUP BY c.category")
def zero_filled_categories(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kinds_ = docs.select(F.col("lang").alias("category")).unionByName(spark.createDataFrame([("zh",)], "category string"))
    return integrity.counts_by_category(docs.select(F.col("lang").alias("category"), F.col("doc_id").alias("case_id")), kinds_)


_SPLIT_WORDS = "SELECT doc_id, lower(unnest(string_split_regex(text, '[^A-Za-z]+'))) AS word FROM documents"


@query(f"SELECT query, source, CAST(n AS INTEGER) AS n, word AS term FROM (SELECT DISTINCT word AS query, 'jieba' AS source, 1 AS n, word FROM ({_SPLIT_WORDS}) WHERE word <> '') WHERE query IN (SELECT n_name FROM (SELECT lower(n_name) AS n_name FROM nation UNION SELECT 'the'))")
def lexicon_exact(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), "[^A-Za-z]+")).alias("w")).filter("w <> ''").distinct()
    entries = words.selectExpr("'jieba' source", "'segmentation-corpus' authority", "0 part", "0L ord", "array(w) as values", "cast(null as string) as whole", "w as term", "'' as detail")
    asked = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("query")).unionByName(spark.createDataFrame([("the",)], "query string"))
    return lexicon.lookup_many(entries, asked).select("query", "source", F.col("n").cast("int").alias("n"), "term")


@query()
def lint_documents(spark, sf_dir):
    docs = zh(spark, sf_dir).select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    return lint.lint(docs)


from corpusloom.plans import rule_queries, source_queries  # noqa: E402, F401  (they add their queries)
