import numpy as np
import pyarrow as pa

from corpusloom.llm import langid as g


def test_held_out_accuracy(make, corpus):
    docs = make([(i, t, lang if i < 60 else None) for i, t, lang in corpus])
    got = {r.doc_id: r for r in g.identify(docs).collect()}
    held = [(i, lang) for i, _, lang in corpus if i >= 60]
    assert sum(got[i].predicted == lang for i, lang in held) >= 0.95 * len(held)
    assert sum(got[i].accepted for i, _ in held) >= 0.95 * len(held)


def test_rejects_what_is_no_language(make, corpus):
    rng = np.random.default_rng(1)
    noise = "".join(chr(c) for c in rng.integers(0x400, 0x4FF, 600))
    keys = " ".join("".join(chr(c) for c in rng.choice([113, 120, 122, 106, 118, 107], 7)) for _ in range(60))
    rows = [*corpus, (100, noise), (101, ""), (102, None), (103, "12345 67890 !!"), (104, keys)]
    docs = make([r if r[0] < 100 else (*r, None) for r in rows])
    got = {r.doc_id: r for r in g.identify(docs).collect()}
    assert not any(got[i].accepted for i in range(100, 105))
    assert got[101].predicted is None and got[103].predicted is None
    left = {r.doc_id for r in g.accepted(docs).collect()}
    assert left == {i for i, r in got.items() if r.accepted}


def test_short_texts_are_not_rejected_for_being_short(make, corpus):
    rows = [*corpus, (200, "the", None), (201, "under the stone", None), (202, "zwischen", None)]
    got = {r.doc_id: r.accepted for r in g.identify(make(rows)).collect()}
    assert got[200] and got[201] and got[202]


def test_counts_like_brute_force():
    text = "Ab c1 dé"
    b = "ab c dé ".encode()
    tf = g.counts(pa.array([text, None, ""]))
    assert tf[0].sum() == (len(b) - 1) + (len(b) - 2) and tf[1:].sum() == 0


def test_document_frequencies(make, corpus):
    n = 20
    df, docs = g.document_frequencies(make([*corpus[:n], corpus[0]]))
    tf = g.counts(pa.array([t for _, t, _ in corpus[:n]] + [corpus[0][1]]))
    assert docs == n + 1 and (df == (tf > 0).sum(axis=0)).all()


def test_sample_is_bounded(make, corpus):
    def chosen(rows):
        return sorted((r.lang, r.text) for r in g.training_texts(make(rows), sample=7).collect())

    got = chosen(corpus)
    assert [lang for lang, _ in got] == ["de"] * 7 + ["en"] * 7
    assert got == chosen(corpus[::-1])


def plain_vector(text, idf, buckets):
    """TF-IDF by the definition: bigrams and trigrams of the letters' bytes, hashed, counted one by one."""
    import math
    import re

    b = re.sub(r"[^\W\d_]+", lambda m: m.group(), text.lower())
    kept = bytearray()
    for c in b.encode():
        letter = 97 <= c <= 122 or c >= 128
        if letter:
            kept.append(c)
        elif kept and kept[-1] != 32:
            kept.append(32)
    if kept and kept[-1] != 32:
        kept.append(32)
    tf, m = {}, (1 << 32) - 1
    shift = 32 - (buckets - 1).bit_length()
    for i in range(len(kept) - 1):
        two = (kept[i] * 0x01000193 + kept[i + 1]) & m
        k = ((two * 0x9E3779B1) & m) >> shift
        tf[k] = tf.get(k, 0) + 1
        if i + 2 < len(kept):
            k = ((((two * 0x01000193) & m) + kept[i + 2] & m) * 0x85EBCA77 & m) >> shift
            tf[k] = tf.get(k, 0) + 1
    v = {k: (1 + math.log(n)) * float(idf[k]) for k, n in tf.items()}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {k: x / norm for k, x in v.items()} if norm else {}


def test_answers_like_brute_force(make, corpus):
    """Language, cosine and rejection of every document from the model's centroids, by plain sums."""
    rows = [*corpus[:40], (200, "the river", None), (201, None), (202, "12 34"), (203, "zażółć gęślą jaźń", None), (204, "river " * 3000)]
    docs = make(rows)
    model = g.fit(docs)
    got = {r.doc_id: r for r in g.identify(docs, model).collect()}
    for i, text, *_ in rows:
        v = plain_vector(text or "", model.idf, len(model.idf))
        cosines = [sum(x * float(c[k]) for k, x in v.items()) for c in model.centroids]
        if not v:
            assert got[i].predicted is None and not got[i].accepted
            continue
        best = max(range(len(cosines)), key=lambda k: cosines[k])
        assert got[i].predicted == model.languages[model.owner[best]]
        assert abs(got[i].cosine - cosines[best]) < 1e-3
        n = int(g._length(g.counts(pa.array([text])))[0])
        if abs(cosines[best] - model.thresholds[n]) > 1e-3:
            assert got[i].accepted == (cosines[best] >= model.thresholds[n])


def test_short_foreign_and_junk_texts_are_rejected(make, corpus):
    foreign = ["zażółć gęślą jaźń i jeszcze więcej tego samego", "tämä on lyhyt suomenkielinen virke ilman mitään muuta sisältöä", "这是一个没有字母的中文句子用来测试语言识别", "xqzvw kjxqz vwqxz jkqxv zzqxw vkjxq xzqwv kqjxz", "dGhpcyBpcyBiYXNlNjQgZW5jb2RlZCB0ZXh0IHdpdGhvdXQ"]
    docs = make([*corpus, *[(300 + i, t, None) for i, t in enumerate(foreign)], *[(400 + i, " ".join(t.split()[3:9]), None) for i, t, _ in corpus[:40]]])
    got = {r.doc_id: r for r in g.identify(docs).collect()}
    assert not any(got[300 + i].accepted for i in range(len(foreign)))
    assert sum(got[400 + i].accepted for i in range(40)) >= 39


def test_junk_under_a_label_gets_no_centroid(corpus):
    rng = np.random.default_rng(5)
    junk = ["".join(chr(c) for c in rng.integers(0x400, 0x4FF, 200)) for _ in range(2)]
    texts = [t for _, t, lang in corpus if lang == "en"] + junk
    idf = g._idf((g.counts(pa.array(texts)) > 0).sum(axis=0), len(texts))
    c, _ = g.fit_language(texts, idf)
    assert (g.vectors(g.counts(pa.array(junk)), idf) @ c.T).max() < 0.05


def test_clusters():
    x = np.eye(6, dtype=np.float32)[[0, 0, 1, 1, 2, 2]]
    c = g.k_means(x, 3)
    assert np.allclose((x @ c.T).max(axis=1), 1)


def test_no_labels(make, corpus):
    assert not any(r.accepted for r in g.identify(make([(i, t, None) for i, t, _ in corpus[:5]])).collect())
