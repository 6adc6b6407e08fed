import random

import numpy as np
import pyarrow as pa

from corpusloom.llm import common, minhash


def shingle_set(text, k=minhash.SHINGLE):
    w = text.lower().replace(".", " ").split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0


def variants(seed=3):
    """Texts and copies with more and more words replaced."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(40, 160))]
        rows.append(" ".join(base))
        for share in (0.0, 0.01, 0.03, 0.06, 0.12, 0.3)[: 1 + g % 6]:
            rows.append(" ".join(rng.choice(vocabulary) if rng.random() < share else w for w in base))
    return rows


def test_estimate_is_unbiased():
    rows = variants()
    s = minhash.signatures(pa.array(rows))
    sets = [shingle_set(r) for r in rows]
    off = [(s[i] == s[j]).mean() - jaccard(sets[i], sets[j]) for i in range(len(rows)) for j in range(i + 1, min(i + 7, len(rows)))]
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.05


def test_blocks_dont_matter(monkeypatch):
    rows = pa.array([*variants()[:40], "", None, "one", " ".join(f"q{i % 977}" for i in range(5000))])
    whole = minhash.signatures(rows)
    monkeypatch.setattr(minhash, "_BLOCK", 100)
    assert (minhash.signatures(rows) == whole).all()
    assert (whole[:5] == minhash.signatures(rows.slice(0, 5))).all()


def test_recall_against_brute_force(make):
    rows = variants()
    sets = [shingle_set(r) for r in rows]
    pairs = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if jaccard(sets[i], sets[j]) >= minhash.THRESHOLD}
    group = {r.doc_id: r.group_id for r in minhash.near_duplicates(make(rows)).collect()}
    found = sum(i in group and group[i] == group.get(j) for i, j in pairs)
    assert found >= 0.9 * len(pairs)
    # Nothing is grouped that isn't similar to something in its group.
    for i, g in group.items():
        assert max(jaccard(sets[i], sets[j]) for j, h in group.items() if h == g and j != i) >= minhash.THRESHOLD - 0.2


def test_one_of_each_group_stays(make):
    rows = variants()[:40] + ["exactly the same few words"] * 4
    found = minhash.near_duplicates(make(rows)).collect()
    by = {}
    for r in found:
        by.setdefault(r.group_id, []).append(r)
    for g, members in by.items():
        assert g == min(r.doc_id for r in members) and len(members) == members[0].group_size >= 2
        assert [r.doc_id for r in members if r.kept] == [g]
    left = {r.doc_id for r in minhash.drop_near_duplicates(make(rows)).collect()}
    assert left == set(range(len(rows))) - {r.doc_id for r in found if not r.kept}


def test_repeated_rows_and_ids(make):
    text = "one two three four five six"
    rows = [(7, text), (7, text), (None, text), (8, "alone here with some other words"), (8, "and again with quite different ones")]
    assert sorted(r.doc_id for r in minhash.drop_near_duplicates(make(rows)).collect()) == [7, 8, 8]
    found = minhash.near_duplicates(make(rows)).collect()
    assert len(found) == 3 and sum(r.kept for r in found) == 1


def test_a_crowd_in_one_bucket(make):
    rng = random.Random(2)
    base = [f"c{i}" for i in range(120)]
    rows = []
    for i in range(800):
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        rows.append(" ".join(w))
    assert minhash.drop_near_duplicates(make(rows)).count() <= 8


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)]
    edges = [(min(e), max(e)) for e in edges if e[0] != e[1]]
    parent = {v: v for e in edges for v in e}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.v: r.root for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in parent}


def test_shuffled_join_gives_the_same(make, monkeypatch):
    rows = variants()[:60]
    small = sorted(r.doc_id for r in minhash.drop_near_duplicates(make(rows)).collect())
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert sorted(r.doc_id for r in minhash.drop_near_duplicates(make(rows)).collect()) == small


def test_clashing_names(make):
    from pyspark.sql import functions as F

    text = "one two three four five six"
    docs = make([(1, text), (2, text), (3, "another text of its own here")]).withColumns({"_cl_h": F.lit("own"), "_CL_ID": F.lit("x"), "_cl_winner": F.lit(1), "a.b": F.lit("dot")})
    got = minhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r["_cl_h"], r["_CL_ID"], r["_cl_winner"], r["a.b"]) for r in got.collect()) == [(1, "own", "x", 1, "dot"), (3, "own", "x", 1, "dot")]


def test_a_bucket_over_many_tasks(spark, make):
    """All texts share buckets, which the sort cuts into many tasks: one group all the same."""
    base = [f"c{i}" for i in range(200)]
    rows = [" ".join(base + [f"x{i}"]) for i in range(600)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = minhash.near_duplicates(make(rows)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(found) == 600 and {r.group_id for r in found} == {0} and sum(r.kept for r in found) == 1


def test_hot_groups_dont_meet_in_one_task(make):
    """No window over a bucket or a group is planned."""
    docs = make(variants()[:20])
    plan = minhash.near_duplicates(docs)._jdf.queryExecution().toString()
    assert "Window" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def halves(seed=8):
    """Texts that share most of a passage with each other and have more or less of a further one: many share buckets, and only some of them are similar."""
    rng = random.Random(seed)
    rows = []
    for g in range(4):
        passage = [f"p{g}q{i}" for i in range(90)]
        kinds = [[f"k{g}x{k}y{i}" for i in range(60)] for k in range(12)]
        for _ in range(70):
            kind = rng.choice(kinds)
            rows.append(" ".join(passage + [w if rng.random() > 0.04 else f"z{rng.randrange(10**9)}" for w in kind[: rng.randint(25, 60)]]))
    return rows


def brute_force_groups(rows):
    """Groups of two texts or more: chains of pairs that share a bucket and agree in enough values, all pairs tried."""
    s = minhash.signatures(pa.array(rows))
    keys = minhash.band_keys(s)
    parent = list(range(len(rows)))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i in range(len(rows)):
        for j in np.flatnonzero((keys == keys[i]).any(axis=1) & ((s == s[i]).mean(axis=1) >= minhash.THRESHOLD)).tolist():
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    groups = {}
    for v in range(len(rows)):
        groups.setdefault(find(v), set()).add(v)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def found_groups(docs):
    groups = {}
    for r in minhash.near_duplicates(docs).collect():
        groups.setdefault(r.group_id, set()).add(r.doc_id)
    return {frozenset(g) for g in groups.values()}


def test_every_pair_of_a_bucket_counts(make, monkeypatch):
    """Links between texts that are neither the first of a bucket nor neighbours in it join groups, too."""
    for seed in (8, 9):
        rows = halves(seed)
        expected = brute_force_groups(rows)
        assert len(expected) > 4
        assert found_groups(make(rows)) == expected
        kept = {r.doc_id for r in minhash.drop_near_duplicates(make(rows)).collect()}
        assert kept == set(range(len(rows))) - {v for g in expected for v in g if v != min(g)}
        with monkeypatch.context() as m:
            m.setattr(minhash, "TILE", 5)
            assert found_groups(make(rows)) == expected


def test_links_of_a_tile():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 32, (9, 128), dtype=np.uint64).astype(np.uint32)
    s = base[rng.integers(0, 9, 300)].copy()
    for row in s:
        some = rng.random(128) < rng.random() * 0.35
        row[some] = rng.integers(0, 1 << 32, some.sum(), dtype=np.uint64).astype(np.uint32)
    group = rng.integers(0, 40, 300)
    need = minhash.least_agreements(0.7, 128)
    near = (s[:, None] == s[None]).sum(axis=2) >= need
    for left, right in ((slice(0, 300), None), (slice(0, 120), slice(120, 300))):
        pairs = {(min(group[i], group[j]), max(group[i], group[j])) for i in range(300)[left] for j in range(300)[right or left] if group[i] != group[j] and near[i, j]}
        assert minhash.links((group[left], s[left]), right and (group[right], s[right]), need) == pairs and pairs


def test_pipeline_stage_keeps_one_of_each_group(spark, make):
    """The pipeline's stage drops what is linked to its group through any pair of a bucket."""
    import corpus_pipeline

    rows = halves(9)
    left = {r.doc_id for r in corpus_pipeline.near_dedup(spark, make(rows), "").collect()}
    assert left == set(range(len(rows))) - {v for g in brute_force_groups(rows) for v in g if v != min(g)}


def test_similar_texts_always_share_a_band():
    """Whatever values differ, if they are as many as the threshold allows."""
    rng = np.random.default_rng(11)
    for width, threshold in ((128, 0.7), (128, 0.8), (32, 0.5), (6, 0.7)):
        most = width - minhash.least_agreements(threshold, width)
        base = rng.integers(0, 1 << 32, (400, width), dtype=np.uint64).astype(np.uint32)
        other = base.copy()
        for i, row in enumerate(other):
            # Spread over the signature, in the order of the permutations or at random.
            at = np.arange(most) * width // max(most, 1) // 2 + np.arange(most) % 2 * (width // 2) if i == 0 else rng.permutation(width)[:most]
            row[at] ^= 1
        assert minhash.verified(base, other, threshold).all()
        assert (minhash.band_keys(base, threshold=threshold) == minhash.band_keys(other, threshold=threshold)).any(axis=1).all()


def test_every_similar_pair_counts(spark, make, monkeypatch):
    """Groups are those of all pairs of texts that meet the threshold, whether they share a band of ROWS values or not; so is what the pipeline's stage leaves."""
    import corpus_pipeline

    rng = random.Random(12)
    rows = []
    for g in range(150):
        base = [f"g{g}w{i}" for i in range(40)]
        rows += [" ".join(base), " ".join(base[: rng.randint(28, 38)] + [f"g{g}v{i}" for i in range(4)])]
    options = dict(threshold=0.6, permutations=8)
    s = minhash.signatures(pa.array(rows), 8)
    near = (s[:, None] == s[None]).sum(axis=2) >= minhash.least_agreements(0.6, 16)
    expected = {frozenset({i, i + 1}) for i in range(0, len(rows), 2) if near[i, i + 1]}
    assert near.sum() == len(rows) + 2 * len(expected) and len(expected) > 40
    groups = {}
    for r in minhash.near_duplicates(make(rows), **options).collect():
        groups.setdefault(r.group_id, set()).add(r.doc_id)
    assert {frozenset(g) for g in groups.values()} == expected
    drop = minhash.drop_near_duplicates
    monkeypatch.setattr(minhash, "drop_near_duplicates", lambda docs: drop(docs, **options))
    left = {r.doc_id for r in corpus_pipeline.near_dedup(spark, make(rows), "").collect()}
    assert left == set(range(len(rows))) - {max(p) for p in expected}
