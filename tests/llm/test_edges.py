"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and clashing extra columns."""

import pytest

import corpus_pipeline
from corpusloom.llm import decontaminate, langid, linededup, lmscore, minhash, packing, quality, tokencounts, toxicity


@pytest.fixture
def bench(spark):
    return spark.createDataFrame([(1, "Which stone lies under the silver river between the quiet garden and the paper window"), (2, None), (3, ""), (None, "x y z")], "item_id long, text string")


def operators(spark, bench):
    return {
        "leaks": lambda d: decontaminate.leaks(d, bench),
        "decontaminated": lambda d: decontaminate.decontaminated(d, bench),
        "toxic": lambda d: toxicity.toxic_documents(d),
        "pack": lambda d: packing.pack_documents(d),
        "score": lambda d: lmscore.scored(d, bits=16),
        "identify": lambda d: langid.identify(d),
        "accepted": lambda d: langid.accepted(d),
        "near": lambda d: minhash.near_duplicates(d),
        "drop_near": lambda d: minhash.drop_near_duplicates(d),
        "tokens": lambda d: tokencounts.token_counts(d),
        "quality": lambda d: quality.quality(d),
        "lines": lambda d: linededup.dedup_lines(d),
        "lines_spared": lambda d: linededup.dedup_lines(d, spare_copies=True),
    }


NAMES = list(operators(None, None))


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, make, bench, name):
    assert operators(spark, bench)[name](make([])).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows(spark, make, bench, name, corpus):
    rows = [*corpus[:12], (None, None, None), (900, None), (901, ""), (902, "  \n\n "), (903, "!!! ###"), (None, corpus[1][1], None), corpus[2], corpus[2], (904, "中文字符测试 " * 30), (905, "word " * 60_000 + "end."), (906, "x" * 200_000), (907, "\x00\x01 odd\r\nbreaks here")]
    run = operators(spark, bench)[name]
    plain = [tuple(r) for r in run(make(rows)).collect()]
    clashing = run(make(rows, clashing=True))
    kept = run(make(rows)).columns
    again = [tuple(r) for r in clashing.select(*kept).collect()]
    assert sorted(map(repr, plain)) == sorted(map(repr, again))
    n = {"leaks": None, "toxic": None, "pack": None, "near": None, "drop_near": None, "accepted": None, "tokens": None, "decontaminated": len(rows)}.get(name, len(rows))
    assert n is None or len(plain) == n


def test_stages_return_the_columns_of_documents(spark, make, bench, corpus, tmp_path):
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = make([*corpus, (None, None), (500, "")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).schema.names == docs.schema.names, name


def test_pipeline_end_to_end(spark, make, bench, corpus, tmp_path):
    leak = "Which stone lies under the silver river between the quiet garden and the paper window"
    line = "Paper silver garden number of the morning letter."
    rows = [*corpus, (100, corpus[4][1], "en"), (101, corpus[7][1] + " And " + leak + ". " + corpus[8][1], "en")]
    rows = [(i, t + ("\n" + line if i in (10, 11, 13, 14) else ""), lang) for i, t, lang in rows]
    make(rows).write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert ids == {i for i, _, _ in corpus}
    sizes = {}
    for r in out:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.n_tokens
    count = tokencounts.Counter()
    for i, t, _ in corpus:
        assert sizes[i] == count(t), i
