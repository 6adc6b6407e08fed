import json

from corpusloom.llm import tokencounts as t


def test_like_brute_force(make, corpus):
    rows = [*corpus, (300, None), (301, ""), *corpus[:4], (302, "it's 12²½ ٣_ of\x1c  things\n\n 中文　字 ")]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(t.TOKENIZERS + "/byte_bpe_50k.json")
    tokenizer.encode_special_tokens = True
    sizes = [len(tokenizer.encode(x or "", add_special_tokens=False).ids) for _, x, *_ in rows]
    sums = t.token_counts(make(rows))
    got = {r.n_tokens: r for r in sums.collect()}
    assert sorted(got) == sorted(set(sizes))
    for n, r in got.items():
        assert r.n_docs == sizes.count(n)
        assert r.docs_at_least == sum(s >= n for s in sizes)
        assert r.tokens_at_least == sum(s for s in sizes if s >= n)
        assert r.docs_at_most == sum(s <= n for s in sizes)
        assert r.tokens_if_cut_here == sum(min(s, n) for s in sizes)
        assert r.tokens_total == sum(sizes)
    for limit in (0, 1, 7, 50, 10_000):
        assert t.tokens_if_cut(sums, limit) == sum(min(s, limit) for s in sizes)
    ordered = sorted(sizes)
    for q in (0.1, 0.5, 0.9, 1.0):
        assert t.quantile(sums, q) == next(x for x in ordered if sum(s <= x for s in sizes) >= q * len(sizes) - 1e-9)


def test_blocks_of_lengths(spark):
    rows = [(i * 37 % 9000, 1 + i % 3) for i in range(9000)]
    h = spark.createDataFrame(rows, "n_tokens long, n_docs long").groupBy("n_tokens").agg({"n_docs": "sum"}).toDF("n_tokens", "n_docs")
    total = sum(a * b for a, b in rows)
    got = t.with_suffix_sums(h).orderBy("n_tokens").collect()
    assert got[0].tokens_at_least == total and got[-1].docs_at_most == sum(b for _, b in rows)
    assert json.dumps([r.tokens_if_cut_here for r in got]) == json.dumps(sorted(r.tokens_if_cut_here for r in got))


def test_empty(make):
    sums = t.token_counts(make([]))
    assert t.quantile(sums, 0.5) is None and t.tokens_if_cut(sums, 10) == 0
