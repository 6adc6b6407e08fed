import random

from corpusloom.llm import packing, tokencounts


def fewest(sizes, capacity):
    """The least number of bins, by trying all."""
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def put(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        seen = set()
        for k, r in enumerate(rooms):
            if r >= sizes[i] and r not in seen:
                seen.add(r)
                rooms[k] -= sizes[i]
                put(i + 1, rooms)
                rooms[k] += sizes[i]
        put(i + 1, [*rooms, capacity - sizes[i]])

    put(0, [])
    return best[0]


def test_optimal_on_small_shards():
    rng = random.Random(1)
    for _ in range(300):
        capacity = rng.choice([10, 60, 100])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 11))]
        bins = packing.pack(sizes, capacity, nodes=100_000)
        assert sorted(sum(bins, [])) == sorted(sizes) and all(sum(b) <= capacity for b in bins)
        assert len(bins) == fewest(sizes, capacity)


def test_search_improves_best_fit():
    sizes = [42, 41, 17, 16, 39, 45]
    assert len(packing.best_fit(sizes, 100)) == 3 and len(packing.pack(sizes, 100)) == fewest(sizes, 100) == 2


def test_never_worse_than_best_fit():
    rng = random.Random(2)
    for _ in range(20):
        sizes = [rng.randint(1, 70) for _ in range(80)]
        assert len(packing.pack(sizes, 100, nodes=50)) <= len(packing.best_fit(sizes, 100))


def test_dominance():
    assert packing.dominated([3, 2], [5]) and packing.dominated([2, 2], [3, 2])
    assert not packing.dominated([5], [3, 2]) and not packing.dominated([3, 3], [4, 2])


def test_round_trip(make, corpus):
    rows = [*corpus, (200, "long text here. " * 700), (201, None), (202, ""), *corpus[:3]]
    got = packing.pack_documents(make(rows), capacity=256, shard_docs=20).collect()
    count = tokencounts.Counter()
    # Every token of every row once, without gaps.
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append((r.doc_start, r.n_tokens))
    rows_of = {}
    for i, t, *_ in rows:
        rows_of.setdefault(i, []).append(count(t))
    for i, sizes in rows_of.items():
        assert sum(n for _, n in by_doc.get(i, [])) == sum(sizes)
        expected = sorted((a, min(256, n - a)) for n in sizes for a in range(0, n, 256))
        assert sorted(by_doc.get(i, [])) == expected
    # No bin overflows, and pieces lie end to end.
    bins = {}
    for r in got:
        bins.setdefault((r.shard, r.bin), []).append((r.bin_start, r.n_tokens))
    for pieces in bins.values():
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert at <= 256
    total = sum(r.n_tokens for r in got)
    assert len(bins) <= 1.1 * total / 256 + len({s for s, _ in bins})
    again = packing.pack_documents(make(rows), capacity=256, shard_docs=20).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def fits(a, b):
    """Whether the pieces of a can be put into rooms b, by trying all."""
    if not a:
        return True
    return any(fits(a[1:], b[:k] + [b[k] - a[0]] + b[k + 1 :]) for k in range(len(b)) if b[k] >= a[0])


def test_fillings_are_the_undominated_ones():
    from collections import Counter

    rng = random.Random(5)
    for _ in range(300):
        left = Counter(rng.randint(1, 60) for _ in range(rng.randint(1, 9)))
        room, pieces = rng.randint(10, 150), sorted(left.elements(), reverse=True)
        every = {tuple(x for k, x in enumerate(pieces) if chosen >> k & 1) for chosen in range(1 << len(pieces))}
        every = [f for f in every if sum(f) <= room]
        expected = [f for f in every if not any(f != g and sum(g) >= sum(f) and fits(list(f), list(g)) for g in every)]
        got = [tuple(f) for f in packing.fillings(sorted(left), left, room) if f is not None]
        assert sorted(got) == sorted(expected)
        assert [sum(f) for f in got] == sorted((sum(f) for f in got), reverse=True)


def test_bins_of_many_pieces():
    """Eight pieces and more a bin: the search comes to the lower bound where best-fit doesn't."""
    rng = random.Random(6)
    sizes = [rng.randint(480, 540) for _ in range(2048)]
    got = packing.pack(sizes, 4096)
    assert sorted(sum(got, [])) == sorted(sizes) and all(sum(b) <= 4096 for b in got)
    assert len(got) == packing.least_bins(sizes, 4096) < len(packing.best_fit(sizes, 4096))


def test_lower_bound_holds():
    rng = random.Random(7)
    for _ in range(200):
        sizes = [rng.randint(1, 60) for _ in range(rng.randint(1, 10))]
        assert -(-sum(sizes) // 60) <= packing.least_bins(sizes, 60) <= fewest(sizes, 60)


def test_walks_begun_again(monkeypatch):
    rng = random.Random(8)
    for _ in range(40):
        sizes = [rng.randint(1, 60) for _ in range(14)]
        whole = packing.pack(sizes, 100, nodes=20_000)
        monkeypatch.setattr(packing, "_KEPT", 1)
        assert packing.pack(sizes, 100, nodes=20_000) == whole
        monkeypatch.undo()
