import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import lmscore as m


def brute(texts, corpus, parts):
    """Code lengths by the definition, bit by bit: corpus is bytes, parts the part of each."""
    ones, zeros = [Counter() for _ in m.ORDERS], [Counter() for _ in m.ORDERS]
    after = defaultdict(list)
    for b, part in zip(corpus, parts):
        for i in range(len(b)):
            for o, k in enumerate(m.ORDERS):
                c = (b"\0" * k + b)[i : i + k]
                for j in range(8):
                    (ones if b[i] >> (7 - j) & 1 else zeros)[o][c, j, b[i] >> (8 - j)] += 1
            if is_anchor(b, i):
                after[b[i - m.ANCHOR : i]].append((part, (b[i : i + m.FOLLOWER] + b"\0" * m.FOLLOWER)[: m.FOLLOWER]))
    k = len(m.ORDERS)
    out = []
    for b in texts:
        w = np.full((m.GATES, 8, k + 1), m.FIRST)
        w[:, :, k] = m.MATCH_FIRST
        right, total = np.zeros(m.BUCKETS // 2 + 1), np.zeros(m.BUCKETS // 2 + 1)
        for x in range(len(right)):
            start = 1 / (1 + math.exp(-x / 2))
            right[x], total[x] = m.TRUST * start, m.TRUST
        bits, follow = 0.0, []
        for begin in range(0, len(b), m.BLOCK):
            gradient, seen_right, seen = np.zeros_like(w), np.zeros(len(right)), np.zeros(len(right))
            for i in range(begin, min(begin + m.BLOCK, len(b))):
                if is_anchor(b, i) and b[i - m.ANCHOR : i] in after:
                    follow.append((i, min(after[b[i - m.ANCHOR : i]])[1]))
                follow = [(a, f) for a, f in follow if i - a < m.FOLLOWER and f[: i - a] == b[a:i] and f[i - a]]
                expected = follow[-1][1][i - follow[-1][0]] if follow else None
                context = [(b"\0" * kk + b)[i : i + kk] for kk in m.ORDERS]
                known = [ones[o][c, 0, 0] + zeros[o][c, 0, 0] for o, c in enumerate(context)]
                gate = 3 if expected else 2 if known[4] or known[3] else 1 if known[1] or known[2] else 0
                for j in range(8):
                    bit, before = b[i] >> (7 - j) & 1, b[i] >> (8 - j)
                    x = [max(-127, min(127, round(16 * math.log((ones[o][c, j, before] + m.DELTA) / (zeros[o][c, j, before] + m.DELTA))))) / 16 for o, c in enumerate(context)]
                    x.append(0 if expected is None or expected >> (8 - j) != before else m.MATCH_ODDS / 16 * (1 if expected >> (7 - j) & 1 else -1))
                    x = np.array(x)
                    mixed = float(np.clip(w[gate, j] @ x, -20, 20))
                    p = 1 / (1 + math.exp(-mixed))
                    at = min(round(abs(mixed) * 2), len(right) - 1)
                    sure = right[at] / total[at]
                    q = (p + (0.5 if at == 0 else sure if mixed > 0 else 1 - sure)) / 2
                    q = min(max(q, 1 / 65536), 1 - 1 / 65536)
                    bits -= math.log2(q if bit else 1 - q)
                    seen[at] += 1
                    seen_right[at] += (mixed > 0) == bit
                    gradient[gate, j] += m.RATE * (bit - p) * x
            w += gradient
            right += seen_right
            total += seen
        out.append(bits)
    return out


def is_anchor(b, i):
    if i < m.ANCHOR:
        return False
    at, _ = m.anchors(np.frombuffer(b[i - m.ANCHOR : i] + b"x", np.uint8), np.array([0, m.ANCHOR + 1]))
    return len(at) > 0


def test_like_brute_force(make, corpus):
    teachers = [t for _, t, _ in corpus[:25]] + ["été über 中文 " * 12, "zz" * 300, None, ""]
    asked = [corpus[30][1], corpus[2][1][20:300] + corpus[31][1], "", None, "a", "été über 中文 " * 5, "\x01\x7f odd", corpus[4][1]]
    docs = make([(i, t) for i, t in enumerate(teachers)])
    parts = [r.p for r in docs.orderBy("doc_id").select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(m.FOLDS)).alias("p")).collect()]
    got = {r.doc_id: r for r in m.scored(make(asked), docs).collect()}
    expected = brute([(t or "").encode() for t in asked], [(t or "").encode() for t in teachers], parts)
    for i, (t, bits) in enumerate(zip(asked, expected)):
        assert got[i].n_bytes == len((t or "").encode())
        assert got[i].total_bits == pytest.approx(bits, rel=0.01, abs=1)
        assert (got[i].bits_per_byte is None) == (not t)


def model_of(teachers, asked, monkeypatch):
    """The engine's own steps, on bytes that needn't be UTF-8."""

    def raw(column):
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1)
        return np.frombuffer(column.buffers()[2], np.uint8), offsets

    monkeypatch.setattr(m, "text_bytes", raw)
    count = m._count(1)
    tables = [count(pa.table({"part": [p], "text": pa.array([b], pa.large_binary())})) for p, b in [*enumerate(teachers), (-1, b"".join(asked))]]
    # Asking texts end where they end: they are counted one by one.
    tables = tables[:-1] + [count(pa.table({"part": [-1] * len(asked), "text": pa.array(asked, pa.large_binary())}))]
    known = m._add_up(pa.concat_tables(tables))
    return m.Model.of(known.filter(pa.compute.equal(known.column("part"), -1)))


def test_probabilities_of_the_next_byte_add_up(corpus, monkeypatch):
    rng = random.Random(2)
    teachers = [t.encode() for _, t, _ in corpus[:40]] + ["été über 中文 ".encode() * 9]
    places = [(corpus[i % 90][1].encode() if i % 10 else teachers[40])[: rng.randrange(1, 260)] for i in range(120)]
    for before in places:
        texts = [before + bytes([c]) for c in range(256)]
        model = model_of(teachers, texts, monkeypatch)
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.arange(257) * (len(before) + 1)
        costs = np.zeros(len(data))
        bits = m.code_lengths(model, data, offsets, costs)
        assert np.allclose([costs[a:z].sum() for a, z in zip(offsets, offsets[1:])], bits, rtol=1e-4)
        assert abs((2.0 ** -costs[offsets[1:] - 1]).sum() - 1) < 1e-3


def test_random_bytes_cant_be_coded(corpus, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (20, 500, 20_000)]
    model = model_of([t.encode() for _, t, _ in corpus] + [rng.integers(0, 256, 50_000, dtype=np.uint8).tobytes()], texts, monkeypatch)
    for t in texts:
        assert m.code_lengths(model, np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] >= 7.9 * len(t)


def test_no_text_predicts_itself(make, corpus):
    """Alone, and repeated with the same id, a text is coded with 8 bits a byte, but for what the coder learns."""
    for rows in ([corpus[3]], [corpus[3]] * 3):
        for r in m.scored(make(rows)).collect():
            assert r.total_bits == pytest.approx(8 * r.n_bytes, rel=1e-3)


def test_order_matters_and_corpus_helps(make, corpus):
    rows = [t for _, t, _ in corpus]
    shuffled = list(rows[3])
    random.Random(1).shuffle(shuffled)
    got = {r.doc_id: r.bits_per_byte for r in m.scored(make([*rows, "".join(shuffled)])).collect()}
    assert got[90] > 2 * got[3]
    assert got[3] < 4


def test_texts_that_occur_twice_are_told_apart(make, corpus):
    rng = random.Random(8)
    words = [w for _, t, _ in corpus for w in t.split()]
    rows = [" ".join(rng.choice(words) for _ in range(150)) for _ in range(160)]
    got = {r.doc_id: r.bits_per_byte for r in m.scored(make(rows + rows[:12])).collect()}
    others = sorted(got[i] for i in range(12, 160))
    caught = sum(got[i] < others[5] for i in range(12))
    assert caught >= 9  # those in one part with their copy can't be


def test_grouping_and_pieces_dont_matter(make, corpus, monkeypatch):
    long = " ".join(t for _, t, _ in corpus[:20])
    rows = [*[t for _, t, _ in corpus[:25]], long, "", None, "zz" * 300]
    docs, teachers = make(rows), make([(i, t) for i, t, _ in corpus])
    whole = {r.doc_id: r.total_bits for r in m.scored(docs, teachers).collect()}
    monkeypatch.setattr(m, "GROUP_BYTES", 640)
    assert {r.doc_id: r.total_bits for r in m.scored(docs, teachers).collect()} == pytest.approx(whole, rel=1e-4)
    # What is gathered from a text in pieces is what is gathered from it whole.
    cut = m.distinct(pa.chunked_array([pa.array([long])]))
    monkeypatch.setattr(m, "GROUP_BYTES", 1 << 20)
    for a, b in zip(cut, m.distinct(pa.chunked_array([pa.array([long])]))):
        assert all((x == y).all() for x, y in zip(a, b))


def test_no_context_is_left_out(make):
    """Every (context, byte) that another part has is known; none that doesn't occur is."""
    rng = random.Random(4)
    rows = ["".join(chr(rng.randint(33, 126)) for _ in range(2000)) for _ in range(60)]
    count = m._count(7)
    tables = [count(pa.table({"part": pa.array([p] * 60, pa.int32()), "text": rows})) for p in (0, 1)]
    rows_of = pa.concat_tables(tables)
    known = [m._add_up(rows_of.filter(pa.compute.equal(rows_of.column("bucket"), b))) for b in range(7)]
    known = pa.concat_tables(known)
    model = m.Model.of(known.filter(pa.compute.equal(known.column("part"), 0)))
    data, offsets = m.text_bytes(pa.array(rows))
    for i, key in m.contexts(data, offsets):
        assert (model.look_up(i, key) != 0).all()
        assert not model.look_up(i, key | np.uint64(128)).any()  # such bytes don't occur


def test_all_predictors_are_there(corpus):
    assert m.ORDERS == (1, 2, 3, 4, 6)
    data, offsets = m.text_bytes(pa.array([corpus[0][1]]))
    assert [i for i, _ in m.contexts(data, offsets)] == [0, 1, 2, 3, 4]


def test_only_followers_that_are_asked_for_are_sent(make, corpus):
    """Parts tell each other their anchors, and then what follows those that another part has: with the same result as if all was sent."""
    texts = [t for _, t, _ in corpus[:40]]
    texts += [t[30:] + f" and {i} more" for i, t in enumerate(texts[:20])]
    docs = make(texts)
    part = np.array([r.p for r in docs.orderBy("doc_id").select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(m.FOLDS)).alias("p")).collect()])
    tables = {p: pa.table({"part": pa.array([p] * int((part == p).sum()), pa.int32()), "text": [t for t, q in zip(texts, part) if q == p]}) for p in sorted(set(part.tolist()))}
    lean = pa.concat_tables(m._count(1, followed=False)(t) for t in tables.values())
    anchors = lean.filter(pa.compute.equal(lean.column("kind"), 1))
    assert anchors.num_rows and max(len(v) for v in anchors.column("values").to_pylist()) < 16
    known = m._add_up(pa.concat_tables(m._count(1)(t) for t in tables.values()))
    expected = {}
    for p, t in tables.items():
        model = m.Model.of(known.filter(pa.compute.equal(known.column("part"), p)))
        bits = m.code_lengths(model, *m.text_bytes(t.column("text").combine_chunks()))
        assert len(model.anchor)
        expected |= dict(zip(np.flatnonzero(part == p).tolist(), bits.tolist()))
    got = {r.doc_id: r.total_bits for r in m.scored(docs).collect()}
    assert got == pytest.approx(expected, rel=1e-6)


def test_runs_and_texts_at_once_dont_matter(corpus, monkeypatch):
    """Neither how many bytes are looked up and hashed at once nor how many texts are worked on at once changes a result."""
    texts = [t.encode() for _, t, _ in corpus[:30]]
    texts = sorted([*texts, *(t[40:] for t in texts), b"", b"ab", b"zz" * 300], key=len, reverse=True)
    got = []
    for run, at_once in ((1 << 16, 64), (100, 7), (1, 1)):
        with monkeypatch.context() as patch:
            patch.setattr(m, "RUN", run)
            patch.setattr(m, "TEXTS", at_once)
            model = model_of(texts[::2], texts, patch)
            data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            costs = np.zeros(len(data))
            got.append((m.code_lengths(model, data, offsets, costs), costs, *m.anchors(data, offsets), *m.predictions(model, data, offsets)))
    assert len(got[0][2]) and got[0][0].sum() > 0
    for other in got[1:]:
        assert all(np.array_equal(x, y) for x, y in zip(got[0], other))
