import random

import numpy as np
import pyarrow as pa

from corpusloom.llm import quality as q


def test_em_recovers_accuracies():
    rng = np.random.default_rng(2)
    n, accuracy = 40_000, np.array([0.95, 0.9, 0.8, 0.7, 0.85, 0.6])
    good = rng.random(n) < 0.7
    right = rng.random((n, 6)) < accuracy
    v = np.where(right == good[:, None], 1, -1)
    v[rng.random((n, 6)) < 0.2] = 0
    patterns, count = np.unique(v, axis=0, return_counts=True)
    share, right_good, right_bad = q.expectation_maximisation(patterns, count.astype(float))
    assert abs(share - 0.7) < 0.03
    assert np.abs(right_good - accuracy).max() < 0.04 and np.abs(right_bad - accuracy).max() < 0.06
    p = q.posterior(v, share, right_good, right_bad)
    majority = v.sum(axis=1) > 0
    assert ((p > 0.5) == good).mean() > 0.93 and ((p > 0.5) == good).mean() >= (majority == good).mean()


def features(text):
    return {k: float(v[0]) for k, v in q.features(pa.array([text])).items()}


def test_features():
    f = features("The cat sat. The Cat sat!!\nsame line\nsame line\n")
    assert f["n_words"] == 10 and f["capital_share"] == 3 / 34
    assert abs(f["same_line_share"] - 1 / 4) < 0.1
    assert f["shout_share"] == 1 / 10 and f["stop_share"] == 2 / 10
    assert features("no no no yes")["repeat_share"] == 0.5
    assert features("a | b | c")["bar_share"] == 2 / 3
    assert abs(features("été")["word_length"] - 3) < 1e-9
    assert all(v == 0 for v in features("").values())


def test_batches_dont_matter(corpus):
    rows = [t for _, t, _ in corpus[:30]] + ["", None, "!!"]
    whole = q.votes(pa.array(rows))
    for i in (0, 3, 29, 30, 32):
        assert (q.votes(pa.array(rows[i : i + 1], pa.string()))[0] == whole[i]).all()


def test_junk_is_told_from_prose(make, corpus):
    rng = random.Random(9)
    rows = [t for _, t, _ in corpus]
    junk = []
    for i in range(0, 40):
        w = corpus[i][1].split()
        junk.append([" | ".join(w), "!! ".join(x.upper() for x in w), " ".join(x + rng.choice(["###", "$$$", "***"]) for x in w), " ".join([w[0]] * 80)][i % 4])
    got = {r.doc_id: r for r in q.quality(make(rows + junk)).collect()}
    assert all(got[i].keep for i in range(90))
    assert sum(not got[i].keep for i in range(90, 130)) >= 38


def test_posterior_is_that_of_the_votes(make, corpus):
    docs = make([t for _, t, _ in corpus] + ["## $$ %% && ## $$", None])
    patterns = q.vote_patterns(docs)
    model = q.fit(patterns)
    rows = patterns.orderBy("doc_id").toPandas()
    v = q.unpacked(rows["pattern"].to_numpy())
    got = q.quality(docs).orderBy("doc_id").toPandas()
    assert np.allclose(got["posterior"], q.posterior(v, *model))
    assert (got["votes_good"] == (v == 1).sum(axis=1)).all() and (got["votes_bad"] == (v == -1).sum(axis=1)).all()
