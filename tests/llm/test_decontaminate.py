import random
import re

import pytest

from corpusloom.llm import decontaminate as d


@pytest.fixture
def bench(spark):
    return spark.createDataFrame(
        [
            (1, "Anna walks 12 km in 3 hours. How far does Anna walk in 5 hours if she keeps the same speed throughout?"),
            (2, "what colour has the morning sky over the quiet harbour when the first ships leave"),
            (3, "short item of five"),
            (4, "the"),
        ],
        "item_id long, text string",
    )


def found(df):
    return {(r.doc_id, r.item_id): r for r in df.collect()}


FILL = "some words before it that nobody would look for, then "


def test_exact_and_reparameterised(make, bench):
    rows = [
        FILL + "Anna walks 12 km in 3 hours. How far does Anna walk in 5 hours if she keeps the same speed throughout?",
        FILL + "Boris walks 40 miles in 7 days. How far does Boris walk in 9 days if she keeps the same speed throughout?",
        "And what Colour has the MORNING sky over the quiet harbour when the first ships leave, then?",
        "nothing of the kind is said here about the harbour or the ships that leave in the morning sky",
        "a text with a short item of five in its middle",
        "the the the the",
    ]
    got = found(d.leaks(make(rows), bench))
    assert set(got) == {(0, 1), (1, 1), (2, 2), (4, 3)}
    assert got[0, 1].changed_slots == 0 and got[1, 1].changed_slots >= 3


def test_inconsistent_slots_are_no_leak(make, bench):
    item = "On 5 days Anna met Boris and then on 5 days Anna met Boris and on 5 days Anna left Boris again"
    other = "On 5 days Anna met Boris and then on 6 days Clara met David and on 7 days Edgar left Fiona again"
    b = bench.sparkSession.createDataFrame([(9, item)], "item_id long, text string")
    assert not found(d.leaks(make([FILL + other]), b))
    same = "On 8 days Clara met David and then on 8 days Clara met David and on 8 days Clara left David again"
    assert set(found(d.leaks(make([FILL + same]), b))) == {(0, 9)}


def test_parts_of_items(make, bench):
    words = "what colour has the morning sky over the quiet harbour when the first ships leave".split()
    rows = [" ".join(["x"] + words[:n] + ["y"]) for n in range(len(words) + 1)]
    got = found(d.leaks(make(rows), bench.filter("item_id = 2")))
    assert {i for i, _ in got} == {n for n in range(len(words) + 1) if n >= 8 and n / len(words) >= d.COVERAGE}


def test_against_brute_force(make, bench):
    """Documents of a few common words, in which windows come up by chance, against a search through all places."""
    rng = random.Random(8)
    vocabulary = ["red", "blue", "green", "one", "two"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(4, 14)))) for i in range(30)]
    rows = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    for k in range(0, 60, 3):
        rows[k] = rows[k] + " " + items[k // 3][1]

    def leak(text, item):
        t, w = text.split(), item.split()
        size = min(8, len(w))
        covered = set()
        for a in range(len(t) - size + 1):
            for b in range(len(w) - size + 1):
                if t[a : a + size] == w[b : b + size]:
                    covered.update(range(b, b + size))
        return len(covered) / len(w)

    expected = {(i, j): c for i, t in enumerate(rows) for j, w in items if (c := leak(t, w)) >= d.COVERAGE}
    b = bench.sparkSession.createDataFrame(items, "item_id long, text string")
    got = {k: r.coverage for k, r in found(d.leaks(make(rows), b)).items()}
    assert got == pytest.approx(expected)


def test_without_bit_map(make, bench, monkeypatch):
    rows = [FILL + "what colour has the morning sky over the quiet harbour when the first ships leave", "none"]
    with_map = set(found(d.leaks(make(rows), bench)))
    monkeypatch.setattr(d, "MAP_WINDOWS", 0)
    assert set(found(d.leaks(make(rows), bench))) == with_map == {(0, 2)}


def test_decontaminated_keeps_the_rest(make, bench):
    rows = [FILL + "what colour has the morning sky over the quiet harbour when the first ships leave", "clean", None, (None, "x")]
    assert [r.doc_id for r in d.decontaminated(make(rows), bench).collect()] == [1, 2, None]


def test_empty_benchmark(make, bench):
    assert d.leaks(make(["a b c d e f g h i j"]), bench.limit(0)).count() == 0


def test_templates():
    import pyarrow as pa

    text = "In May Anna paid 3.50 dollars. Bob paid dollars"
    template, _, slot, _ = d.templates(pa.array([text]))
    kinds = {int(d._NUM): "#", int(d._NAME): "N", int(d._UNITS): "U"}
    words = re.findall(r"\w+", text)
    assert [kinds.get(int(t), w.lower()) for t, w in zip(template, words)] == ["in", "N", "N", "paid", "#", "#", "U", "bob", "paid", "dollars"]
    assert slot.sum() == 5


def test_items_dense_in_slots_are_found_as_copies(make, bench):
    items = [(7, "Compute 12 + 7 * 3 - 45 / 9 + 18 = ?"), (8, "In 2001 Anna Berg 12 km 30 kg 45 days 17 miles and 3 hours")]
    b = bench.sparkSession.createDataFrame(items, "item_id long, text string")
    rows = [FILL + items[0][1], FILL + items[1][1], FILL + "compute 13 + 7 * 3 - 45 / 9 + 18 = ?"]
    assert set(found(d.leaks(make(rows), b))) == {(0, 7), (1, 8)}


def test_names_that_begin_sentences_numbers_with_separators_and_case(make, bench):
    anna = "Anna has 12 apples. Anna gives 5 apples to Boris. Anna buys 3 more. How many has Anna now?"
    money = "a plain ticket to the far harbour costs 5 dollars and the way back costs 7 dollars"
    walk = "On the way home Anna meets Boris and then Anna tells Boris what Clara said of David"
    b = bench.sparkSession.createDataFrame([(1, anna), (2, money), (3, walk)], "item_id long, text string")
    rows = [anna.replace("Anna", "Carla"), FILL + money.replace("5", "3.50").replace("7", "1,200"), FILL + walk.lower(), FILL + walk.upper(), "The end. In The Hall. " + anna]
    assert set(found(d.leaks(make(rows), b))) == {(0, 1), (1, 2), (2, 3), (3, 3), (4, 1)}
