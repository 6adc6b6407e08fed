"""Work grows no faster than the input: plans, and the steps that are done for every character."""

import re
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import lexicon, lint
from corpusloom.plans import catalogue, passages
from corpusloom.plans import pack as packs

PACK = packs.default()
WORDS = [t for g in PACK.wording["literal_groups"] for t in g["terms"]]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rows = [(i, f"plain text {i}\n搞定了。" if i % 2 else None) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return str(at)


def test_lint_documents_computes_its_findings_once(spark, tables):
    """Hits that a longer word may cover, and others, are told apart after the rules, not by applying all rules twice."""
    assert plan_of(catalogue.QUERIES["lint_documents"](spark, tables)).count("FileScan") == 1


def test_only_hits_of_words_are_covered(spark):
    """Findings without a window stay, whatever words there are, and so do those with a null path."""
    rows = [("a", "搞定", "把搞定了", 1), ("a", "抓手", "抓手", 0), ("a", "搞定", None, None), (None, "搞定了", None, None), (None, "搞定", "搞定了", 0)]
    found = spark.createDataFrame(rows, "path string, sample string, window string, at int")
    covering = spark.createDataFrame([("搞定", "搞定了")], "term string, word string")
    assert sorted(map(repr, map(tuple, lint.drop_covered(found, covering).collect()))) == sorted(map(repr, rows[1:4]))


def test_lint_wording_computes_its_findings_once(spark, tables):
    assert plan_of(catalogue.QUERIES["lint_wording"](spark, tables)).count("FileScan") == 1


def test_lines_of_matches_are_counted_once(spark):
    """lined() tells the lines that line_at() tells, for line breaks of all kinds."""
    texts = ["", "a", "a\r\na\n\ra\r", "\r\na", "a\r\r\na\x85a  a", "ab\r", "\rab\nab\r\n\r\nab"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    for p in (r"(?Ud)a", r"(?Uds)a.", r"(?Ud)\r", r"(?Ud)\n", r"(?Ud)\r\n"):
        want = F.transform(X.spans(t, p), lambda m: F.struct(m["pos"], X.line_at(t, m["pos"]), m["sample"]))
        for r in df.select("t", X.lined(t, p).alias("a"), want.alias("b")).collect():
            assert [tuple(x) for x in r.a] == [tuple(x) for x in r.b] == [(m.start(), 1 + len(re.findall(X.NUMBERED_BREAK, r.t[: m.start()])), m[0]) for m in re.finditer(p[p.index(")") + 1 :], r.t, re.S)], (p, r.t)


def test_regional_vocabulary_of_long_texts(spark):
    """Runs of two characters are cut in one go: a long text takes seconds, not minutes."""
    pairs = spark.createDataFrame([("网络", "網路"), ("USB口", "x"), ("mail", "信")], "wrong string, preferred string")
    o = lint.Options(locale="zh-TW", regional=True)
    text = "网络\r\n" + "".join(f"word{i} " for i in range(60_000)) + "\n有USB口\nmail\r网络"
    docs = spark.createDataFrame([("a", text), ("b", "mail"), ("c", None)], "path string, rule string")
    began = time.time()
    got = sorted((r.path, r.line, r.sample) for r in lexicon.regional_findings(docs, pairs, None, o).collect())
    assert got == [("a", 1, "网络"), ("a", 3, "USB口"), ("a", 4, "mail"), ("a", 5, "网络")]
    assert time.time() - began < 30
    some = lexicon.regional_findings(docs, pairs.filter("wrong <> 'mail'"), None, o)
    assert sorted((r.line, r.sample) for r in some.collect()) == [(1, "网络"), (3, "USB口"), (5, "网络")]


def test_lexicon_contains_sends_the_queries(spark, tmp_path):
    """The entries, which are there once for each key, aren't broadcast because their file is small."""
    rows = [("jieba", "x", 0, i, [f"word{i}"], None, f"word{i}", "") for i in range(50)]
    spark.createDataFrame(rows, "source string, authority string, part int, ord long, values array<string>, whole string, term string, detail string").write.parquet(str(tmp_path / "e"))
    asked = spark.createDataFrame([("rd4",), ("d49",), (None,)], "query string")
    found = lexicon.lookup_many(spark.read.parquet(str(tmp_path / "e")), asked, contains=True)
    plan = plan_of(found)
    assert "BuildRight" in plan and "BuildLeft" not in plan
    assert sorted((r.query, r.n, r.term) for r in found.collect()) == [("d49", 1, "word49"), *(("rd4", n + 1, t) for n, t in enumerate(["word4", *(f"word4{i}" for i in range(7))]))]


def cost(spark, pattern, text):
    """How long a search through a text takes, of three."""
    p, best = spark._jvm.java.util.regex.Pattern.compile(pattern), 1e9
    for _ in range(3):
        m = p.matcher(text)
        began = time.time()
        assert not m.find()
        best = min(best, time.time() - began)
    return best


LONG = "plain words here, " * 100_000


def test_phrases_of_labels_are_passed_over_at_the_first_character(spark):
    """However many words a pattern has, a character that begins none costs about as much as with one class."""
    assert cost(spark, X.any_of(WORDS), LONG) < 12 * max(0.01, cost(spark, X.CJK, LONG))


def test_any_of_is_an_alternation(spark):
    words = ["ab", "a", "abc", "網路", "網", "𠀀x", "𠀀", "zh-CN", r"\E", "(", "。"]
    for some in (words, words[2:4], ["𠀀x"], [], ["", "a"]):
        p = spark._jvm.java.util.regex.Pattern.compile(X.any_of(some))
        for t in ("", "xab", "網", "\U00020000", "\U00020000x", "b", r"\E", "路。", "ZH-cn", "q("):
            assert p.matcher(t).find() == any(w in t for w in some), (some, t)


def test_literal_counts_of_lines(spark, tables):
    """Counts of hits by brute force, over lines of all the pack's words and of none."""
    rows = [(i, "\n".join([f"plain {i}", WORDS[i % len(WORDS)] * 2, "x" + WORDS[(7 * i) % len(WORDS)], "网 络"])) for i in range(len(WORDS))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rules = [(t, f"wording.{g['id']}", g["message"]) for g in PACK.wording["literal_groups"] for t in g["terms"]]
    got = catalogue.findings(docs, lint.literal_findings(X.segments(F.col("text")), rules))
    want = {(i, n, t) for i, text in rows for n, line in enumerate(text.split("\n"), 1) for t in WORDS if t in line}
    assert {(r.doc_id, r.line, r.sample) for r in got.collect()} == want
    # Lines without a wide character aren't searched for words that have one.
    assert "x{2e80}" in got._jdf.queryExecution().optimizedPlan().toJSON()


@pytest.mark.parametrize("name", ["diagnostic_json", "exit_state", "diagnostic_lines", "literal_scan"])
def test_literal_queries_search_wide_lines(spark, tables, name):
    assert "x{2e80}" in catalogue.QUERIES[name](spark, tables)._jdf.queryExecution().optimizedPlan().toJSON()


@pytest.mark.parametrize("script", [0, 1])
def test_mixed_script_is_passed_over_by_range(spark, script):
    """A class of many characters costs about as much as a range, for characters outside of it."""
    chars = PACK.markers()[script]
    assert cost(spark, X.one_of(chars), LONG) < 4 * max(0.01, cost(spark, r"[\x{2e80}-\x{10ffff}]", LONG))
    p = spark._jvm.java.util.regex.Pattern.compile(X.one_of({*chars, "𠀀", "a"}))
    for c in [*chars, "𠀀", "a", "b", "一", "𠀁", "龥"]:
        assert p.matcher(c).find() == (c in {*chars, "𠀀", "a"}), c


def test_lengths_of_lines_stay_in_the_jvm(spark, tables):
    """Lines of data are cut by expressions, as str.splitlines() and str.strip() do."""
    from corpusloom.functions.units import units, units_of

    assert "Python" not in plan_of(catalogue.QUERIES["lengths_of_lines"](spark, tables))
    texts = ["", "a", "a\n", "\n", "\n\n", " a\t\r\n\x1c b \x85c\x0b\x0cd\x1d\x1e e 　f\xa0​", "\x1f g\x1f", None]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", units_of(F.col("t"), F.lit("data")).alias("u")).collect():
        assert [tuple(u) for u in r.u] == ([] if r.t is None else units(r.t, "data")), repr(r.t)


def test_repeated_sentences_of_long_texts(spark):
    """Ten thousands of sentences, one of them twice: neither their places nor their repeats are sought for each anew."""
    text = " ".join(f"Sentence number {i}!" for i in range(40_000)) + "\nthe end\nSentence  number 3!!\r\n>Sentence number 7!\n"
    o = lint.Options(style="strict", script_gate=False)
    docs = spark.createDataFrame([(text,), ("",), ("no mark at all here",)], "text string")
    began = time.time()
    got = docs.select(F.inline(lint.repeated_findings(F.col("text"), o))).collect()
    assert sorted((r.line, r.sample) for r in got) == [(3, "Sentencenumber3!"), (4, "Sentencenumber7!")]
    assert time.time() - began < 15


def test_sentences_of_a_line(spark):
    texts = ["", "a", "！", "！！a！？b", "a.b!c? d。", "。a", "a  !", "中文。中文"]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", lint.in_line(F.col("t")).alias("s")).collect():
        assert r.s == re.findall("[^。！？!?\n]+[。！？!?]?", r.t)


def test_wrong_script_looks_no_further_than_the_last_wide_character(spark):
    o = lint.Options(locale="zh-CN")
    rows = [("軟體\r\nabc\n為\x85x 皇后 為", 1), ("abc", 2), ("", 3), ("阿里山\n後", 4)]
    docs = spark.createDataFrame([(t, i) for t, i in rows], "text string, doc_id long")
    got = docs.select("doc_id", F.inline(lint.locale_findings(F.col("text"), o)))
    assert sorted((r.doc_id, r.line, r.sample) for r in got.collect()) == [(1, 1, "軟體"), (1, 3, "為"), (1, 4, "為"), (4, 2, "後")]
    assert [r.x for r in docs.select(X.through_wide(F.col("text")).alias("x")).collect()] == [rows[0][0], "", "", rows[3][0]]


def test_rule_lines_need_wide_characters():
    """Rules that only lines with a wide character can break aren't sought in others; where that isn't sure, they are."""
    rules = [*PACK.wording["regex_rules"], *PACK.wording["grammar_rules"]]
    lines = [x for listed, _ in passages.SLOTS for x in listed]
    for r in rules:
        assert X.needs_wide(r["pattern"])
        assert all(any(ord(c) >= X.WIDE_FROM for c in x) for x in lines if re.search(r["pattern"], x))
    for p, wide in (("a", False), ("中?", False), ("中|a", False), ("[中a]", False), ("[^a]", False), ("(?!中)a", False), ("(?<=中)a", True), ("(?:中|文a)b?", True), ("(a中)+", True), ("(a中)*", False), ("[一-龥]", True), (r"\w", False), ("(?i:ａ)", False)):
        assert X.needs_wide(p) == wide, p
    assert not X.needs_wide("ａ", re.I) and X.needs_wide("中", re.I)
