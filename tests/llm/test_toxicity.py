import random

import pyarrow as pa
import pytest

from corpusloom.llm import toxicity as t


def worst(text, lexicon=None):
    got = t.Scorer(lexicon or t.seeded()).batch(pa.array([text]))
    return got[0][2] if got else 0.0


def test_clauses_not_words():
    assert worst("You are an idiot.") > worst("There was an idiot.") >= t.THRESHOLD
    assert worst("You are not an idiot.") < t.THRESHOLD
    assert worst("She said he was an idiot.") < t.THRESHOLD
    assert worst("I will kill you.") >= t.THRESHOLD
    assert worst("They will beat the eggs.") < t.THRESHOLD
    assert worst("Kill the process.") < t.THRESHOLD
    assert worst("The idiot, you know.") > worst("The idiot.")
    assert worst("The morning is not bright. Idiot!") >= t.THRESHOLD
    assert worst("She said it. Idiot!") >= t.THRESHOLD


def plain(symbols):
    """The grammar by its definition: what each insult or threat meets before and after it in its clause."""
    total = 0.0
    for k, x in enumerate(symbols):
        if x not in (t.INSULT, t.THREAT):
            continue
        negated = t.NEGATION in symbols[max(0, k - t.SCOPE) : k]
        reported = t.REPORT in symbols[:k]
        aimed = t.TARGET in symbols[max(0, k - t.REACH) : k]
        will = False
        for y in reversed(symbols[:k]):
            if y == t.WILL:
                will = True
            if y in (t.OTHER, t.INSULT, t.THREAT, t.WILL):
                break
        damp = (0.15 if negated else 1) * (0.35 if reported else 1)
        threat = x == t.THREAT
        score = ((0.9 if will else 0.3) if threat else 1.0) + ((0.8 if threat else 0.5) if aimed and (will or not threat) else 0)
        total += score * damp
    return total


def test_composition_is_the_chain():
    rng = random.Random(3)
    machines = [t.negation(), t.reported(), t.target(), t.scoring()]
    whole = t.grammar()
    for _ in range(2000):
        symbols = [rng.randrange(8) for _ in range(rng.randint(1, 14))]
        x, total = symbols, 0.0
        for m in machines:
            x, w = m.run(x)
            total += w
        assert whole.run(symbols)[1] == pytest.approx(total)


def test_marks_against_definition():
    """Without targets after them, the composed weights are those of the definition."""
    rng = random.Random(4)
    whole, n = t.grammar(), 0
    for _ in range(4000):
        symbols = [rng.choice([t.OTHER, t.OTHER, t.OTHER, t.INSULT, t.THREAT, t.NEGATION, t.REPORT, t.TARGET]) for _ in range(rng.randint(1, 9))]
        last = max([k for k, x in enumerate(symbols) if x == t.TARGET], default=-1)
        first = min([k for k, x in enumerate(symbols) if x in (t.INSULT, t.THREAT)], default=99)
        if first < last:
            continue
        n += 1
        assert whole.run(symbols)[1] == pytest.approx(plain(symbols)), symbols
    assert n > 500


def test_documents(make):
    rows = ["A fine day. You pathetic loser! More of it.", "A fine day.", None, "", (None, "what an idiot"), "Idiot idiot\n" * 2000]
    got = {r.doc_id: r for r in t.toxic_documents(make(rows)).collect()}
    assert set(got) == {0, None, 5}
    assert got[0].n_clauses == 1 and got[0].clauses == ["you pathetic loser"]
    assert got[5].n_clauses == 2000


def test_learned_words_held_out(spark, make, corpus):
    """Insults of an unknown language, also inflected, are learned from labels and found in documents that aren't labelled."""
    rng = random.Random(6)
    rows, toxic = [], {}
    for i in range(400):
        words = corpus[i % 90][1].split(" ")
        toxic[i] = int(rng.random() < 0.25)
        if toxic[i]:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["grumblix", "grumblixen", "zorkel", "grumblixor"]))
        rows.append((i, " ".join(words)))
    labels = spark.createDataFrame([(i, x) for i, x in toxic.items() if i < 250] + [(None, 1), (3, None)], "doc_id long, toxic int")
    docs = make(rows)
    lexicon = t.fit(docs, labels)
    got = {r.doc_id for r in t.toxic_documents(docs, lexicon).collect()}
    expected = {i for i, x in toxic.items() if x}
    assert len({i for i in got if i >= 250} & expected) >= 0.95 * len([i for i in expected if i >= 250])
    assert len(got - expected) <= 2


def test_no_labels(spark, make):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert t.fit(make(["You idiot"]), labels).stems == {}


CLEAN = """The trash was collected. This garbage collector is fast. You should kill the process. They will beat the eggs.
The morning train to work was closed. The clown performed for the children. We will crush the grapes tomorrow.
This program is distributed in the hope that it will be useful, but without any warranty. You may lose your data.
In no event shall the authors be liable for any claim. Set the path to the working directory. The tradition is old.
Your trash was collected. He will shoot the film in May. Burn the disc and close the tray. The students discussed it. I do not think you are an idiot."""


def test_clean_prose_stays(make):
    for clause in CLEAN.replace("\n", " ").split(". "):
        assert worst(clause) < t.FLOOR, clause
    assert t.toxic_documents(make([CLEAN, CLEAN * 20])).count() == 0


def test_weak_words_need_an_aim_or_company(make):
    assert worst("A stupid mistake.") < t.THRESHOLD <= worst("You are stupid.")
    assert worst("Such garbage!") < t.THRESHOLD <= worst("You are garbage.")
    assert worst("I will kill you.") > t.THRESHOLD > worst("I will kill the process.")
    rows = ["A stupid mistake.", "A stupid mistake. A pathetic excuse.", "A stupid mistake. A pathetic excuse. " + "All is well here. " * 2000]
    assert {r.doc_id for r in t.toxic_documents(make(rows)).collect()} == {1}


def brute(text, lexicon):
    """A document by the definition: its clauses one after the other, each through the chain of machines."""
    import re

    machines = [t.household(), t.negation(), t.reported(), t.target(), t.scoring()]
    total = top = n = 0
    for clause in re.split(r"[.!?;\n]", (text or "").lower()):
        symbols = []
        for w in re.findall(r"[^\W_]+", clause):
            learned = any(w.startswith(s) for s in lexicon.stems)
            symbols.append(lexicon.words.get(w, t.WEAK if learned else t.OTHER) or (t.WEAK if learned else t.OTHER))
        score = 0.0
        for m in machines:
            symbols, w = m.run(symbols)
            score += w
        top = max(top, score)
        if score >= t.FLOOR - 1e-9:
            total, n = total + score, n + 1
    words = len(re.findall(r"[^\W_]+", text or ""))
    return (total, top, n) if top >= t.THRESHOLD - 1e-9 or total >= t.THRESHOLD + words / t.WORDS - 1e-9 else None


def test_documents_like_brute_force(make):
    rng = random.Random(11)
    seeds = [w for ws in t.SEEDS.values() for w in ws]
    lexicon = t.seeded()
    lexicon.words["zorkel"], lexicon.stems["grumb"] = t.WEAK, 0.6
    plain = ["river", "stone", "grumblix", "grumbly", "zorkel", "zorkels", "x1", "été", "42"]
    rows = ["".join(rng.choice(rng.choice([seeds, plain, plain])) + rng.choice([" ", " ", " ", ", ", ". ", "!\n", "; "]) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    got = {r.doc_id: r for r in t.toxic_documents(make(rows), lexicon).collect()}
    for i, row in enumerate(rows):
        expected = brute(row, lexicon)
        assert (i in got) == (expected is not None), row
        if expected:
            assert (got[i].score, got[i].worst_clause, got[i].n_clauses) == pytest.approx(expected), row
            assert len(got[i].clauses) == got[i].n_clauses


def test_learned_stems_have_forms():
    counts = {"=grumbling": (9, 0), "=grumbled": (9, 0), "grumb": (18, 0), "grumbl": (18, 0), "=workable": (9, 0), "worka": (9, 0), "=pathway": (2, 9)}
    words, stems = t.learn(counts, 40, 400)
    assert stems == ["grumb"] and words == ["workable"]
    assert not t.stems("Idiots work the path") & {"idiot", "=idiots", "work", "path"}
