"""Operators of dictionaries, corpora, files, fixes, snapshots and streams on small inputs."""

import gzip
import json
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.functions import views
from corpusloom.operators import corpora, fix, integrity, lexicon, lint
from corpusloom.plans import pack as packs
from corpusloom.sources import files, lexicons
from corpusloom.streaming.lint import lint_stream


def put(path, text):
    with gzip.open(path, "wt", encoding="utf-8") as f:
        f.write(text)
    return str(path)


def listed(df):
    return [tuple(r) for r in df.collect()]


def test_dictionaries(spark, tmp_path):
    words = put(tmp_path / "w.txt.gz", "网络 12\n网络机房 3\n单\n")
    dictionary = put(tmp_path / "c.txt.gz", "# note\n網絡 网络 [wang3 luo4] /network/net/\n")
    sheet = put(tmp_path / "n.csv.gz", "﻿en,tw,cn\nnetwork,網路；網絡,网络\n")
    php = put(tmp_path / "z.php.gz", "TO_TW = [\n\t'网络' => '網路',\n\t'软件' => '軟體',\n\t];\nTO_CN = [\n\t'網路' => '网络',\n\t];")
    with zipfile.ZipFile(tmp_path / "o.zip", "w") as z:
        z.writestr("a.txt", "网络\t網路 網絡\n软件\t軟體\n")
        z.writestr("Unihan_Variants.txt", "# x\nU+53D1\tkTraditionalVariant\tU+767C\n")
    entries = lexicons.frequencies(spark, words, "jieba", "segmentation-corpus", "evidence", least=2)
    for more in (
        lexicons.cedict(spark, dictionary), lexicons.terminology_csv(spark, sheet, ("en", "tw", "cn")), lexicons.conversions(lexicons.php_tables(spark, php, ["TO_TW", "TO_CN"]), {"TO_TW": "zh-TW", "TO_CN": "zh-CN"}),
        lexicons.conversion_archive(spark, str(tmp_path / "o.zip")), lexicons.variants(spark, str(tmp_path / "o.zip")), lexicon.technical(spark, packs.default()),
        lexicons.candidates(spark, [(put(tmp_path / "m.gz", "網路 wang\n#x\n网络 lu\n"), "input")]), lexicons.optional(lambda s, p: lexicons.titles(s, p, "zhwiki", "title", True), spark, str(tmp_path / "absent.gz")),
    ):
        entries = entries.unionByName(more)
    got = listed(lexicon.lookup(entries, "网络"))
    assert [(s, t) for s, _, t, _ in got] == [("technical", "network"), ("naer", "network"), ("zhconversion", "网络 → 網路"), ("zhconversion", "網路 → 网络"), ("opencc", "网络 → 網路 網絡"), ("cc-cedict", "網絡 / 网络"), ("mcbopomofo", "网络"), ("jieba", "网络")]
    assert len(listed(lexicon.lookup(entries, "网", contains=True, limit=1, sources=["jieba", "naer"]))) == 2
    assert listed(lexicon.lookup(entries, "发"))[0][2:] == ("U+53D1", "kTraditionalVariant=U+767C")
    many = lexicon.lookup_many(entries, spark.createDataFrame([("网络",), ("网络",), ("发",), (None,)], "query string"))
    assert many.filter("query = '网络'").count() == 8 and many.filter("query = '发'").count() == 1
    with pytest.raises(ValueError):
        lexicon.lookup(entries, "x", limit=0)


def test_regional(spark):
    phrases = spark.createDataFrame([(0, 0, "打印机", "印表機"), (0, 1, "软件", "軟體"), (0, 2, "单", "單"), (1, 0, "打印机", "列印機")], "part int, ord long, key string, value string")
    characters = spark.createDataFrame([("机", "機"), ("软", "軟")], "ch string, target string")
    pairs = lexicon.regional_pairs(phrases, characters, packs.default(), "zh-TW")
    assert ("打印機", "印表機") in listed(pairs) and all(w != "軟件" for w, _ in listed(pairs))
    docs = spark.createDataFrame([("a.txt", "壞了\n打印機在這裡"), ("b.txt", "大打印機店"), ("c.txt", None)], "path string, text string")
    o = lint.Options(locale="zh-TW", regional=True)
    got = lexicon.regional_findings(docs.selectExpr("path", "text as rule"), pairs, spark.createDataFrame([("大打印機",)], "word string"), o)
    assert [(r.path, r.line, r.sample) for r in got.collect()] == [("a.txt", 2, "打印機")]


def test_corpora(spark, tmp_path):
    src = {"id": "s1", "repository": "o/r", "url": "u1", "commit": "a" * 40, "blob": "b" * 40, "date": "2026-01-01"}
    ui = {"id": "s2", "repository": "o/q", "files": [{"locale": "zh-TW", "url": "t", "commit": "x", "blob": "b" * 40, "date": "2026-02-30"}]}
    (tmp_path / "c.json").write_text(json.dumps({"schema": 1, "verified": "2026-01-01", "sources": [src, ui], "live_contracts": [{"id": "live", "url": "l"}], "patterns": [{"id": "p", "origin": "x", "evidence": ["s2", "s1"]}]}, indent=1))
    c = corpora.load(spark, str(tmp_path / "c.json"), "readme")
    assert [r.id for r in corpora.list_patterns(c).collect()] == ["p"]
    assert sorted((r.place, r.source_id) for r in corpora.pattern(c, "p").collect()) == [(0, "s2"), (1, "s1")]
    assert [r.source_id for r in corpora.pattern(c, "p", "zh-CN").collect()] == ["s1"]
    assert corpora.source(c, "live").first().type == "live_contract"
    assert sorted(listed(integrity.pinned_violations(corpora.pinned(c), "2026-12-31"))) == [("commit", "s2"), ("date", "s2")]
    with pytest.raises(KeyError):
        corpora.one(corpora.pattern(c, "none"), "none")


def test_files(spark, tmp_path):
    (tmp_path / "in/node_modules").mkdir(parents=True)
    for name, data in (("a.md", "搞定".encode()), ("b.txt", b"\xff\xfe"), ("c.bin", b"a\0b"), ("d", b"text"), ("e.log.md", b"x"), ("node_modules/f.md", b"x")):
        (tmp_path / "in" / name).write_bytes(data)
    got = files.read(spark, [str(tmp_path / "in"), str(tmp_path / "none")], ["*.log.md"])
    assert {(r.path.rpartition("/")[2], r.valid) for r in got.collect()} == {("a.md", True), ("b.txt", False), ("d", True)}
    assert [r.code for r in files.missing(spark, [str(tmp_path / "none")]).collect()] == ["input.missing"]
    assert files.unreadable(got).first().code == "io.read"


def test_snapshot_and_terms(spark):
    config = spark.createDataFrame([("a", None, "a.gz", "1"), ("b", None, "b.gz", None), ("o", False, "o.gz", None)], "source string, bundled boolean, path string, pinned string")
    manifest = spark.createDataFrame([("a", "a.gz", "1", 5), ("x", "x.gz", "2", 1), ("o", "o.gz", "3", 1)], "source string, path string, stored string, bytes long")
    disk = spark.createDataFrame([("a.gz", "9", 6), ("extra", "7", 1), ("o.gz", "3", 1)], "path string, stored string, bytes long")
    got = {(r["check"], r.subject) for r in integrity.reconcile(config, manifest, disk).collect()}
    assert got >= {("missing source", "b"), ("unknown source", "x"), ("non-bundled source", "o"), ("missing file in manifest", "b.gz"), ("missing file", "x.gz"), ("unrecorded file", "extra"), ("stored digest changed", "a.gz"), ("stored size changed", "a.gz"), ("pinned digest changed", "a.gz")}
    pack = packs.default()
    preserved = spark.createDataFrame([(t,) for t in pack.terms["preserve"]], "term string")
    assert integrity.term_violations(pack.term_table(spark), preserved).isEmpty()
    assert integrity.wording_violations(pack.literal_terms(spark), pack.regex_rules(spark)).isEmpty()
    fetched = spark.createDataFrame([("u", 200, None, bytearray(b"test")), ("v", 429, None, bytearray())], "url string, status int, remaining string, content binary")
    pinned = spark.createDataFrame([("s", "p", "u", "30d74d258442c7c65512eafab474568dd706c430"), ("s", "q", "v", ""), ("s", "r", "w", "")], "source_id string, path string, url string, blob string")
    assert {(r.path, r.state) for r in integrity.verify_blobs(pinned, fetched).collect()} == {("p", "ok"), ("q", "rate-limited"), ("r", "missing")}
    assert integrity.report(pack, spark).filter("metric = 'total'").first().value == 32


ALPHABET = st.text(alphabet="中文ａ５．，，！。.,!?-` \n<>b3()#", max_size=60)


@settings(max_examples=300, deadline=None)
@given(ALPHABET)
def test_fix_settles_and_masks_keep_length(text):
    for markdown in (False, True):
        seen = fix.masked(text, markdown)
        assert len(seen) == len(text) and [i for i, c in enumerate(seen) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]
    assert views.without_code_spans("a `b` c") == "a     c"


def test_fix(spark):
    docs = spark.createDataFrame([("a.md", "我用Ａpp，，好...\r\n`x,y` 中,文"), ("b.json", '{"a": "中,文"}'), ("c.txt", None), ("d.txt", "plain, text...")], "path string, text string")
    got = {r.path: (r.text, r.changed) for r in fix.fix(docs).collect()}
    assert got["a.md"] == ("我用 App，好……\r\n`x,y` 中，文", True)
    assert got["b.json"][1] is False and got["c.txt"] == (None, False) and got["d.txt"][1] is False
    again = fix.fix(spark.createDataFrame([("a.md", got["a.md"][0])], "path string, text string")).first()
    assert not again.changed


def test_lint_hits_near_misses_and_stream(spark, tmp_path):
    rows = [("a.md", "# 標題\n\n### 跳級\n\n搞定了。\n\n`搞定` 在程式碼。"), ("b.txt", "步道上跑步。"), ("c.txt", ""), ("d.txt", None), ("e.txt", "我們沒跑完。")]
    docs = spark.createDataFrame(rows, "path string, text string")
    got = {(r.path, r.line, r.code) for r in lint.lint(docs).collect()}
    assert got == {("a.md", 3, "markdown.heading-level"), ("a.md", 5, "wording.colloquial"), ("e.txt", 1, "wording.colloquial-run")}
    docs.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, text string").json(str(tmp_path / "in"))
    lint_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(300)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_expressions_fix_like_the_scanner(spark):
    """fix() gives what fix_text() gives, whether by expressions or in Python, and a second run changes nothing."""
    import random

    from corpusloom.operators import fix

    rng = random.Random(4)
    bits = ["中", "文字", "，", "。。", "！！", "...", "....", "--", "---", "a", "Z9", "３．５", "１", "Ａ", ",", ". ", "?", "\n", " ", "x.y", "`c,中`", "<b>", "https://a.b/中1", "𠀀", "1．2"]
    texts = ["".join(rng.choice(bits[:20] if i % 2 else bits) for _ in range(rng.randint(1, 25))) for i in range(600)]
    docs = spark.createDataFrame([(f"{i}.{'md' if i % 7 == 0 else 'txt'}", t) for i, t in enumerate(texts)], "path string, text string")
    for style in ("standard", "ui"):
        got = {r.path: r.text for r in fix.fix(docs, style).collect()}
        for i, t in enumerate(texts):
            path = f"{i}.{'md' if i % 7 == 0 else 'txt'}"
            assert got[path] == fix.fix_text(t, path.endswith("md"), style), repr(t)
            assert fix.fix_text(got[path], path.endswith("md"), style) == got[path] or "1．2" in t


def test_paragraphs():
    from corpusloom.functions.units import paragraphs

    text = "---\na: b\n---\n# 標題\n內文一\n內文二\n\n> 引文\n> 續\n\n```\ncode\n```\n\n- 一\n  續行\n- 二\n\n|甲|乙|\n|---|:---:|\n|丙|丁|\n"
    assert paragraphs(text) == [(5, "內文一\n內文二"), (8, "引文\n續"), (15, "一\n  續行"), (17, "二"), (19, "甲"), (19, "乙"), (21, "丙"), (21, "丁")]
    assert paragraphs("") == [] and paragraphs("---\nopen") == [(1, "---\nopen")]


def test_a_long_word_covers_a_hit(spark):
    """A dictionary word that reaches far beyond the hit clears it, as a short one does."""
    from corpusloom.operators import lint

    long = "甲" * 60 + "搞定" + "乙" * 60
    docs = spark.createDataFrame([("a.txt", f"這裡有{long}。"), ("b.txt", "搞定了。")], "path string, text string")
    words = spark.createDataFrame([(long,)], "word string")
    got = {r.path for r in lint.lint(docs, words=words).filter("sample = '搞定'").collect()}
    assert got == {"b.txt"}


def test_joins_are_keyed(spark):
    """Substring lookups and regional vocabulary meet by keys: no product of both sides is planned."""
    from corpusloom.operators import lexicon, lint

    entries = spark.createDataFrame([("jieba", "x", 0, i, [f"word{i}"], None, f"word{i}", "") for i in range(5)], "source string, authority string, part int, ord long, values array<string>, whole string, term string, detail string")
    asked = spark.createDataFrame([("rd3",), ("",), (None,)], "query string")
    found = lexicon.lookup_many(entries, asked, contains=True)
    assert [(r.query, r.term) for r in found.collect()] == [("rd3", "word3")]
    pairs = spark.createDataFrame([("网络", "網路")], "wrong string, preferred string")
    regional = lexicon.regional_findings(spark.createDataFrame([("a", "网络")], "path string, rule string"), pairs, None, lint.Options(locale="zh-TW", regional=True))
    for df in (found, regional):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Cartesian" not in plan and "Join Inner\n" not in plan


def test_code_points_beyond_the_basic_plane(spark):
    from corpusloom.operators import lexicon

    entries = spark.createDataFrame([("unihan", "x", 0, 0, ["U+20000"], None, "U+20000", "far"), ("unihan", "x", 0, 1, ["U+2000"], None, "U+2000", "near")], "source string, authority string, part int, ord long, values array<string>, whole string, term string, detail string")
    many = lexicon.lookup_many(entries, spark.createDataFrame([("\U00020000",)], "query string"))
    assert [r.detail for r in many.collect()] == [r.detail for r in lexicon.lookup(entries, "\U00020000").collect()] == ["far"]
