"""Queries of dictionaries, their files, and integrity checks, each with its SQL."""

from __future__ import annotations

import gzip
import io
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import integrity, lexicon, lint
from corpusloom.plans import catalogue as c
from corpusloom.sources import lexicons as S

query, table, zh = c.query, c.table, c.zh


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors see: in spark.checkpoint.dir, or on a local master in a temporary folder."""
    there = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.gettempdir()
    return f"{there.rstrip('/')}/dictionaries-{uuid.uuid4().hex}"


def put(spark: SparkSession, path: str, data: bytes) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(data))
    out.close()
    return path


def _zip(members: dict[str, str]) -> bytes:
    to = io.BytesIO()
    with zipfile.ZipFile(to, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return to.getvalue()


_N = "SELECT n_nationkey AS k, n_regionkey AS r, replace(n_name, ' ', '_') AS n FROM nation"


@query(f"""
SELECT 'jieba' AS source, n AS term, concat('frequency=', k, '; a note') AS detail FROM ({_N})
UNION ALL SELECT 'cc-cedict', concat(n, ' / ', lower(n)), concat(r, '; the ', lower(n)) FROM ({_N})
UNION ALL SELECT 'naer', lower(n), concat('zh-TW=', n, '；', r, '; zh-CN=', k) FROM ({_N})
UNION ALL SELECT 'zhconversion', concat(n, ' → ', lower(n)), 'zh-TW table' FROM ({_N})
UNION ALL SELECT 'opencc', concat(n, ' → ', k), 'a.txt' FROM ({_N})
UNION ALL SELECT 'unihan', concat('U+4E', k), concat('kSimplified=', n) FROM ({_N})
UNION ALL SELECT 'mcbopomofo', NULL, concat('phrases: ', n, ' ', k) FROM ({_N})
UNION ALL SELECT 'zhwiki', n, 'title' FROM ({_N})
UNION ALL SELECT 'moegirl', n, 'title' FROM ({_N})
""")
def dictionary_files(spark, sf_dir):
    """Nations as files of nine kinds (gzip, CSV with a byte order mark, PHP, ZIP), read again by their readers. One file each: nations are few."""
    rows = [(r.n_nationkey, r.n_regionkey, r.n_name.replace(" ", "_")) for r in table(spark, sf_dir, "nation").collect()]
    at = scratch(spark)

    def file(name: str, lines: list[str], packed: bool = True) -> str:
        data = ("\n".join(lines) + "\n").encode()
        return put(spark, f"{at}/{name}", gzip.compress(data) if packed else data)

    php = ["<?php", "class X {", "\tpublic const ZH_TO_TW = [", *(f"\t\t'{n}' => '{n.lower()}'," for _, _, n in rows), "\t];", "}"]
    parts = [
        S.frequencies(spark, file("j.txt.gz", [f"{n} {k}" for k, _, n in rows]), "jieba", "segmentation-corpus", "a note"),
        S.cedict(spark, file("c.u8.gz", ["# comment", *(f"{n} {n.lower()} [{r}] /the {n.lower()}/" for _, r, n in rows)])),
        S.terminology_csv(spark, file("n.csv.gz", ["﻿en,tw,cn", *(f"{n.lower()},{n}；{r},{k}" for k, r, n in rows)]), ("en", "tw", "cn")),
        S.conversions(S.php_tables(spark, file("z.php", php, False), ["ZH_TO_TW"]), {"ZH_TO_TW": "zh-TW"}),
        S.conversion_archive(spark, put(spark, f"{at}/o.zip", _zip({"a.txt": "\n".join(f"{n}\t{k}" for k, _, n in rows), "b.bin": "x"}))),
        S.variants(spark, put(spark, f"{at}/u.zip", _zip({"Unihan_Variants.txt": "# c\n" + "\n".join(f"U+4E{k}\tkSimplified\t{n}" for k, _, n in rows)}))),
        S.candidates(spark, [(file("m.txt.gz", ["# comment", *(f"{n} {k}" for k, _, n in rows)]), "phrases")]),
        S.titles(spark, file("w.gz", [n for _, _, n in rows]), "zhwiki", "title"),
        S.titles(spark, file("g.gz", ["# c\tx", *(f"{n}\t{k}" for k, _, n in rows)]), "moegirl", "title", tabbed=True),
        S.optional(S.cedict, spark, f"{at}/absent.gz"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("source", "term", "detail")


_HELD = "SELECT query, p_partkey AS ord, lower(p_name) AS term, row_number() OVER (PARTITION BY query ORDER BY p_partkey) AS n FROM part JOIN (SELECT DISTINCT lower(substr(p_name, 2, 4)) AS query FROM part UNION SELECT 'a' UNION SELECT 'zz9') ON contains(lower(p_name), query)"


@query(f"SELECT query, 'jieba' AS source, CAST(n AS INTEGER) AS n, term FROM ({_HELD}) WHERE n <= 8")
def lexicon_contains(spark, sf_dir):
    entries = table(spark, sf_dir, "part").selectExpr("'jieba' source", "'x' authority", "0 part", "p_partkey ord", "array(lower(p_name)) as values", "cast(null as string) whole", "lower(p_name) term", "'' detail")
    asked = table(spark, sf_dir, "part").select(F.lower(F.substring("p_name", 2, 4)).alias("query")).unionByName(spark.createDataFrame([("a",), ("zz9",), (None,)], "query string"))
    return lexicon.lookup_many(entries, asked, contains=True).select("query", "source", F.col("n").cast("int").alias("n"), "term")


_CODES = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 19968 + o_orderkey % 20000 ELSE 131072 + o_orderkey % 40000 END AS code FROM orders"


@query(f"SELECT DISTINCT chr(CAST(code AS INTEGER)) AS query, concat('U+', printf('%04X', code)) AS term FROM ({_CODES})")
def lexicon_characters(spark, sf_dir):
    """Characters, half of them beyond the basic plane, looked up by code point."""
    codes = table(spark, sf_dir, "orders").selectExpr("case when o_orderkey % 2 = 0 then 19968 + o_orderkey % 20000 else 131072 + o_orderkey % 40000 end as code").distinct()
    named = codes.select(F.expr("decode(unhex(lpad(hex(code), 8, '0')), 'UTF-32')").alias("ch"), F.concat(F.lit("U+"), F.format_string("%04X", "code")).alias("name"))
    entries = named.selectExpr("'unihan' source", "'x' authority", "0 part", "0L ord", "array(name) as values", "cast(null as string) whole", "name as term", "'' detail")
    return lexicon.lookup_many(entries, named.select(F.col("ch").alias("query"))).select("query", "term")


_PAIRS = [("网络", "網路"), ("默认", "預設"), ("软件", "軟體"), ("内存", "記憶體"), ("没有", "無")]


@query(f"SELECT DISTINCT doc_id, CAST(line AS BIGINT) AS line, wrong AS sample FROM ({c._LINES}) JOIN (VALUES {c._values([(w,) for w, _ in _PAIRS])}) AS t(wrong) ON contains(replace(replace(x, '神经网络', '#'), '没有問題的', '#'), wrong)")
def regional_vocabulary(spark, sf_dir):
    """Words of another region, but for those within a longer word of the pack or of a dictionary."""
    docs = zh(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("rule"))
    pairs = spark.createDataFrame(_PAIRS, "wrong string, preferred string")
    words = spark.createDataFrame([("没有問題的",), ("网",)], "word string")
    got = lexicon.regional_findings(docs, pairs, words, lint.Options(locale="zh-TW", regional=True))
    return got.select(F.col("path").cast("long").alias("doc_id"), F.col("line").cast("long").alias("line"), "sample").distinct()


# ---- integrity ----------------------------------------------------------------------------------------


@query("SELECT check_ AS \"check\", subject FROM (SELECT 'repeated literal' AS check_, p_name AS subject FROM part GROUP BY p_name HAVING count(*) > 1 UNION ALL SELECT 'id is no slug', id FROM (SELECT DISTINCT p_brand AS id FROM part) WHERE NOT regexp_matches(id, '^[a-z0-9]+(-[a-z0-9]+)*$') UNION ALL SELECT 'repeated id', p_brand FROM part GROUP BY p_brand HAVING count(*) > 0)")
def wording_integrity(spark, sf_dir):
    """Parts as literals, their brands as the ids of groups and of rules."""
    part = table(spark, sf_dir, "part")
    literals = part.select(F.col("p_brand").alias("group_id"), F.col("p_name").alias("term"))
    return integrity.wording_violations(literals, part.select(F.col("p_brand").alias("id")).distinct()).distinct()


@query("SELECT 'commit' AS \"check\", CAST(o_orderkey AS VARCHAR) AS subject FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT 'blob', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT 'date', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 3 = 0 OR CAST(o_orderdate AS DATE) > DATE '1996-06-01'")
def pinned_integrity(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("source_id"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("abc")).otherwise(F.sha1(F.col("o_orderkey").cast("string"))).alias("commit"),
        F.when(F.col("o_orderkey") % 7 == 0, F.upper(F.sha1(F.lit("a")))).otherwise(F.sha1(F.lit("x"))).alias("blob"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit("1996-02-30")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"),
    )
    return integrity.pinned_violations(o, "1996-06-01")


_CASES = "SELECT CAST(o_orderkey % 9000 AS VARCHAR) AS id, o_orderpriority AS category, o_orderstatus AS prompt_locale, repeat('x', CAST(o_orderkey % 170 AS INT)) AS prompt, o_orderpriority < '3' AS should_trigger FROM orders"


@query(f"SELECT DISTINCT 'repeated case' AS \"check\", id AS subject FROM ({_CASES}) GROUP BY id HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'empty prompt', id FROM ({_CASES}) WHERE prompt = '' UNION ALL SELECT DISTINCT 'long prompt', id FROM ({_CASES}) WHERE length(prompt) > 160 UNION ALL SELECT 'too few cases', category FROM ({_CASES}) GROUP BY category HAVING count(*) < 3 UNION ALL SELECT 'category of both answers', category FROM ({_CASES}) GROUP BY category HAVING count(DISTINCT should_trigger) > 1 UNION ALL SELECT 'locale of one answer', prompt_locale FROM ({_CASES}) GROUP BY prompt_locale HAVING count(DISTINCT should_trigger) < 2")
def case_integrity(spark, sf_dir):
    """Orders as the cases of an evaluation."""
    return integrity.case_violations(table(spark, sf_dir, "orders").selectExpr("cast(o_orderkey % 9000 as string) id", "o_orderpriority category", "o_orderstatus prompt_locale", "repeat('x', cast(o_orderkey % 170 as int)) prompt", "o_orderpriority < '3' should_trigger"))


_FILES = "SELECT 'n' || n_nationkey % 20 || CASE WHEN n_nationkey % 6 = 0 THEN '/x' ELSE '' END AS path, CASE WHEN n_nationkey % 4 = 0 THEN 'http://a' ELSE 'https://a' END AS url, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE sha256(n_name) END AS sha256, n_nationkey % 2 = 0 AS rolling, n_nationkey % 9 = 0 AS relaxed_tls FROM nation"


@query(f"SELECT 'path is listed twice' AS \"check\", path AS subject FROM ({_FILES}) GROUP BY path HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'path is no plain name', path FROM ({_FILES}) WHERE contains(path, '/') UNION ALL SELECT DISTINCT 'address isn''t https', path FROM ({_FILES}) WHERE url NOT LIKE 'https://%' UNION ALL SELECT DISTINCT 'digest is missing', path FROM ({_FILES}) WHERE sha256 IS NULL AND NOT rolling UNION ALL SELECT DISTINCT 'unchecked certificate without digest', path FROM ({_FILES}) WHERE relaxed_tls AND sha256 IS NULL")
def source_integrity(spark, sf_dir):
    return integrity.source_violations(table(spark, sf_dir, "nation").selectExpr("'s' source", "concat('n', n_nationkey % 20, if(n_nationkey % 6 = 0, '/x', '')) path", "if(n_nationkey % 4 = 0, 'http://a', 'https://a') url", "if(n_nationkey % 3 = 0, null, sha2(n_name, 256)) sha256", "n_nationkey % 2 = 0 rolling", "n_nationkey % 9 = 0 relaxed_tls"))


_CITED = "SELECT c_custkey AS id, unnest([CAST(c_nationkey AS VARCHAR), CAST(c_custkey % 40 AS VARCHAR)]) AS source_id FROM customer"


@query(f"WITH cited AS (SELECT DISTINCT CAST(id AS VARCHAR) AS id, source_id, n_regionkey AS owner FROM ({_CITED}) LEFT JOIN nation ON source_id = CAST(n_nationkey AS VARCHAR)) SELECT DISTINCT 'unknown source' AS \"check\", id AS subject FROM cited WHERE owner IS NULL UNION ALL SELECT 'too little evidence', id FROM cited GROUP BY id HAVING count(*) < 2 UNION ALL SELECT 'evidence of one owner', id FROM cited GROUP BY id HAVING count(*) >= 2 AND count(DISTINCT owner) < 2")
def evidence_integrity(spark, sf_dir):
    """Customers as patterns that cite nations, whose regions own them."""
    patterns = table(spark, sf_dir, "customer").selectExpr("cast(c_custkey as string) id", "array(cast(c_nationkey as string), cast(c_custkey % 40 as string)) evidence")
    sources = table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as string) id", "concat(n_regionkey, '/x') repository")
    return integrity.evidence_violations(patterns, sources)


@query("SELECT o_orderpriority AS corpus, count(*) AS files, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS verified, CAST(count(*) FILTER (WHERE o_custkey % 2 = 0) AS BIGINT) AS optional FROM orders GROUP BY o_orderpriority")
def corpus_counts(spark, sf_dir):
    return integrity.corpus_report(table(spark, sf_dir, "orders").selectExpr("o_orderpriority corpus", "if(o_orderstatus = 'F', 'ok', 'changed') state", "o_custkey % 2 = 0 optional"))


@query("SELECT false AS holds, 'address isn''t https, digest is missing, path is listed twice, path is no plain name, unchecked certificate without digest' AS failing")
def conjunction_of_checks(spark, sf_dir):
    return integrity.checks_hold(source_integrity(spark, sf_dir))


_TERMS = "SELECT n_name AS en, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE 'c' || n_nationkey % 11 END AS zh_cn, 't' || n_nationkey % 11 AS zh_tw, CASE WHEN n_nationkey % 3 = 0 THEN 'c' || n_nationkey % 11 ELSE 'c' || (n_nationkey + 1) % 11 END AS bad FROM nation"


@query(f"SELECT 'term is preserved' AS \"check\", en AS subject FROM ({_TERMS}) WHERE en IN (SELECT r_name FROM region UNION SELECT 'CHINA') UNION SELECT 'incomplete term', en FROM ({_TERMS}) WHERE zh_cn = '' UNION SELECT 'preferred form is rejected', en FROM ({_TERMS}) WHERE bad = zh_cn UNION SELECT 'rejected form is preferred elsewhere', a.en FROM ({_TERMS}) a JOIN ({_TERMS}) b ON a.bad = b.zh_cn AND a.en <> b.en")
def term_integrity(spark, sf_dir):
    terms = table(spark, sf_dir, "nation").selectExpr("n_name en", "if(n_nationkey % 5 = 0, '', concat('c', n_nationkey % 11)) zh_cn", "concat('t', n_nationkey % 11) zh_tw", "true enforce", "map('zh-CN', array(if(n_nationkey % 3 = 0, concat('c', n_nationkey % 11), concat('c', (n_nationkey + 1) % 11)))) reject")
    preserved = table(spark, sf_dir, "region").select(F.col("r_name").alias("term")).unionByName(spark.createDataFrame([("CHINA",)], "term string"))
    return integrity.term_violations(terms, preserved).distinct()


_RULES = "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '(open' ELSE 'a+' END AS pattern, p_size FROM part"


@query(f"SELECT 'pattern doesn''t compile' AS \"check\", CAST(id AS VARCHAR) AS subject FROM ({_RULES}) WHERE pattern = '(open' UNION ALL SELECT 'unknown style', CAST(id AS VARCHAR) FROM ({_RULES}) WHERE p_size > 40 UNION ALL SELECT 'limit isn''t positive', concat('s', n_nationkey, '.paragraph') FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 'group of fewer than two forms', n_name FROM nation WHERE n_nationkey % 2 = 0")
def rule_integrity(spark, sf_dir):
    rules = table(spark, sf_dir, "part").selectExpr("cast(p_partkey as string) id", "if(p_partkey % 3 = 0, '(open', 'a+') pattern", "array(if(p_size > 40, 'other', 'strict')) styles")
    styles = spark.createDataFrame([("strict",)], "style string")
    nation = table(spark, sf_dir, "nation")
    limits = nation.selectExpr("concat('s', n_nationkey) style", "'paragraph' name", "if(n_regionkey = 0, 0, 1) value")
    return integrity.rule_violations(rules, styles, limits, nation.selectExpr("n_name id", "array('a', if(n_nationkey % 2 = 0, 'a', 'b')) forms"))


def _snapshot(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("path"))
    source = F.concat(F.lit("s"), (F.col("k") % 5).cast("string")).alias("source")
    config = s.filter("k % 7 <> 0").select(source, (F.col("k") % 5 != 4).alias("bundled"), "path", F.when(F.col("k") % 11 == 0, "old").otherwise("d").alias("pinned"))
    manifest = s.filter("k % 13 <> 0").select(source, "path", F.lit("d").alias("stored"), F.col("k").alias("bytes"))
    disk = s.filter("k % 17 <> 0").select("path", F.when(F.col("k") % 19 == 0, "x").otherwise("d").alias("stored"), F.when(F.col("k") % 23 == 0, F.lit(-1)).otherwise(F.col("k")).alias("bytes"))
    return config, manifest, disk


_K = "SELECT s_suppkey AS k, 'f' || s_suppkey AS path FROM supplier"


@query(
    f"SELECT 'missing file in manifest' AS \"check\", path AS subject FROM ({_K}) WHERE k % 7 <> 0 AND k % 5 <> 4 AND k % 13 = 0"
    f" UNION ALL SELECT 'unknown file in manifest', path FROM ({_K}) WHERE (k % 7 = 0 OR k % 5 = 4) AND k % 13 <> 0"
    f" UNION ALL SELECT 'missing file', path FROM ({_K}) WHERE k % 13 <> 0 AND k % 17 = 0"
    f" UNION ALL SELECT 'unrecorded file', path FROM ({_K}) WHERE k % 13 = 0 AND k % 17 <> 0"
    f" UNION ALL SELECT 'stored digest changed', path FROM ({_K}) WHERE k % 13 <> 0 AND k % 17 <> 0 AND k % 19 = 0"
    f" UNION ALL SELECT 'stored size changed', path FROM ({_K}) WHERE k % 13 <> 0 AND k % 17 <> 0 AND k % 23 = 0"
    f" UNION ALL SELECT 'pinned digest changed', path FROM ({_K}) WHERE k % 7 <> 0 AND k % 5 <> 4 AND k % 17 <> 0 AND (CASE WHEN k % 11 = 0 THEN 'old' ELSE 'd' END) <> (CASE WHEN k % 19 = 0 THEN 'x' ELSE 'd' END)"
    " UNION ALL SELECT 'non-bundled source', 's4'"
)
def snapshot_reconcile(spark, sf_dir):
    """Suppliers as the files of a snapshot, some of which differ in each way."""
    return integrity.reconcile(*_snapshot(spark, sf_dir))
